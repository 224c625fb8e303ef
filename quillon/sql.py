"""SQL sessions.

``Session.query`` puts single-table statements onto frames, so null, NaN and
order rules are the engine's everywhere: comparisons with NaN are false, nulls
come last in either direction.  ``Session.spark_sql`` runs any other statement
by Spark's own rules over the same tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.expr import AGGREGATES, Expr, call, coalesce, col, columns, contains, lit, walk, when
from quillon.frame import Frame
from quillon.plans.parse import _COMPARE, ParseError, Parser

_AGGS = {"sum": "sum", "min": "min", "max": "max", "avg": "mean", "mean": "mean", "count": "count", "first": "first", "last": "last", "median": "median", "stddev": "std", "variance": "var"}
_ROWWISE = frozenset("abs sqrt exp floor ceil round sign".split())
_STRINGS = {"upper": "str.upper", "lower": "str.lower", "length": "str.len_chars", "trim": "str.trim", "reverse": "str.reverse"}
_CLAUSES = ("from", "where", "group", "having", "order", "limit")
_RESERVED = frozenset((*_CLAUSES, "select", "as", "by", "and", "or", "join", "on", "union", "case", "when", "then", "else", "end"))
ONE = "__one"


@dataclass
class Statement:
    distinct: bool = False
    #: (expression or None for all columns, output name)
    items: list[tuple[Expr | None, str]] = field(default_factory=list)
    table: str = ""
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None


class _Sql(Parser):
    """SELECT [DISTINCT] items FROM table with WHERE, GROUP BY, HAVING, ORDER BY and LIMIT in any order."""

    def name(self) -> str:
        kind, value = self.take()
        if kind not in ("id", "str"):
            raise ParseError(f"a name is needed, found {value!r}")
        return value

    def several(self, one) -> list:
        out = [one()]
        while self.op(","):
            out.append(one())
        return out

    def item(self) -> tuple[Expr | None, str]:
        if self.op("*"):
            return None, "*"
        began = self.at
        e = self.either()
        name = e.params[0] if e.op == "col" else "".join(str(v) for _, v in self.toks[began : self.at])
        if e.op in AGGREGATES:
            name = name[: name.index("(")].lower() + name[name.index("(") :]
        return e, self.name() if self.word("as") else name

    def ordering(self) -> tuple[Expr, bool]:
        e = self.either()
        return e, self.word("asc", "desc") == "desc"

    def statement(self) -> Statement:
        s = Statement()
        if not self.word("select"):
            raise ParseError("expected SELECT")
        s.distinct = bool(self.word("distinct"))
        s.items = self.several(self.item)
        while self.peek()[0] != "end":
            clause = self.word(*_CLAUSES)
            if clause == "from":
                s.table = self.name()
            elif clause == "where":
                s.where = self.either()
            elif clause == "group":
                self.must("by")
                s.group = self.several(self.either)
            elif clause == "having":
                s.having = self.either()
            elif clause == "order":
                self.must("by")
                s.order = self.several(self.ordering)
            elif clause == "limit":
                kind, n = self.take()
                if kind != "num" or not isinstance(n, int):
                    raise ParseError("LIMIT needs a whole number")
                s.limit = n
            else:
                raise ParseError(f"unexpected {self.peek()[1]!r}")
        if not s.table:
            raise ParseError("FROM is missing")
        return s

    def must(self, word: str) -> None:
        if not self.word(word):
            raise ParseError(f"expected {word.upper()}, found {self.peek()[1]!r}")

    def compared(self) -> Expr:
        e = self.sum_()
        if self.word("is"):
            no = self.word("not")
            self.must("null")
            return Expr("is_not_null" if no else "is_null", (e,))
        no = self.word("not")
        if self.word("in"):
            self.expect("(")
            out = e.is_in(*self.several(self.sum_))
            self.expect(")")
        elif self.word("between"):
            low = self.sum_()
            self.must("and")
            out = (e >= low) & (e <= self.sum_())
        elif self.word("like"):
            kind, pattern = self.take()
            if kind != "str":
                raise ParseError("LIKE needs a text")
            out = Expr("str.like", (e,), (pattern,))
        elif no:
            raise ParseError("unexpected NOT")
        else:
            o = self.op(*_COMPARE)
            return call(_COMPARE[o], e, self.sum_()) if o else e
        return ~out if no else out

    def primary(self) -> Expr:
        kind, value = self.peek()
        if kind == "id" and value.lower() in ("true", "false", "null"):
            self.take()
            return lit({"true": True, "false": False, "null": None}[value.lower()])
        if self.word("case"):
            found = []
            while self.word("when"):
                test = self.either()
                self.must("then")
                found.append((test, self.either()))
            out = self.either() if self.word("else") else lit(None)
            self.must("end")
            for test, then in reversed(found):
                out = when(test).then(then).otherwise(out)
            return out
        if kind == "id" and value.lower() in _RESERVED:
            raise ParseError(f"unexpected {value!r}")
        return super().primary()

    def named_call(self, name: str) -> Expr:
        low = name.lower()
        if low == "count" and self.toks[self.at : self.at + 3] == [("op", "("), ("op", "*"), ("op", ")")]:
            self.at += 3
            return col(ONE).count()
        args = self.arguments()
        if low == "coalesce":
            return coalesce(*args)
        if low == "round" and len(args) == 2:
            return args[0].round(args[1].params[0])
        if len(args) == 1 and low in _AGGS:
            return getattr(args[0], _AGGS[low])()
        if len(args) == 1 and low in _ROWWISE:
            return getattr(args[0], low)()
        if len(args) == 1 and low in _STRINGS:
            return Expr(_STRINGS[low], (args[0],))
        raise ParseError(f"no function {name}")


def parse(query: str) -> Statement:
    # double quotes are identifiers, as in standard SQL
    return _Sql(re.sub(r'"([^"]*)"', r"`\1`", query.strip().rstrip(";"))).statement()


def execute(s: Statement, f: Frame) -> Frame:
    """WHERE, then GROUP BY or aggregates, HAVING, columns, DISTINCT, ORDER BY, LIMIT."""
    if s.where is not None:
        f = f.filter(s.where)
    named = {n: e for e, n in s.items if e is not None}
    # an output name stands for its expression
    order = [(named[e.params[0]] if e.op == "col" and e.params[0] in named else e, way) for e, way in s.order]
    items = [x for e, n in s.items for x in ([(col(c), c) for c in f.columns] if e is None else [(e, n)])]
    uses = [e for e, _ in items] + [e for e, _ in order] + ([s.having] if s.having is not None else [])
    if s.group or s.having is not None or any(contains(e, AGGREGATES) for e, _ in items):
        f, swap = _grouped(s, f, uses, named)
        items, order = [(swap(e), n) for e, n in items], [(swap(e), way) for e, way in order]
        if s.having is not None:
            f = f.filter(swap(s.having))
    if not s.distinct and order:
        f = f.with_columns(*[e.alias(f"?order{i}") for i, (e, _) in enumerate(order)])
        f = f.sort_by([f"?order{i}" for i in range(len(order))], [way for _, way in order])
    f = f.select(*[e.alias(n) for e, n in items])
    if s.distinct:
        f = f.unique()
        if s.order:
            f = f.sort_by([e.params[0] for e, _ in s.order], [way for _, way in s.order])
    return f if s.limit is None else f.head(s.limit)


def _grouped(s: Statement, f: Frame, uses: list[Expr], named: dict[str, Expr]):
    """The grouped frame, and what puts its columns in the place of keys and aggregates."""
    if any(x.op == "col" and x.params[0] == ONE for e in uses for x in walk(e)):
        f = Frame(f.df.withColumn(ONE, F.lit(1)), f.order, f.dense)
    keys: list[tuple[Expr, str]] = []
    for i, k in enumerate(s.group):
        e = named[k.params[0]] if k.op == "col" and k.params[0] in named and k.params[0] not in f.columns else k
        keys.append((e, e.params[0] if e.op == "col" else f"?key{i}"))
    aggs: list[tuple[Expr, str]] = []
    for x in (x for e in uses for x in walk(e) if x.op in AGGREGATES):
        if not any(x.same(a) for a, _ in aggs):
            aggs.append((x, f"?agg{len(aggs)}"))
    made = [e.alias(n) for e, n in keys if e.op != "col"]
    if made:
        one = ONE in f.df.columns
        f = f.with_columns(*made)
        f = Frame(f.df.withColumn(ONE, F.lit(1)), f.order, f.dense) if one else f
    outs = [a.alias(n) for a, n in aggs]
    f = f.group_by(*[n for _, n in keys]).agg(*outs) if keys else f.select(*outs)

    def swap(e: Expr) -> Expr:
        for x, n in (*keys, *aggs):
            if e.same(x):
                return col(n)
        if e.op == "col":
            raise ValueError(f"{e.params[0]} is neither grouped nor aggregated")
        return Expr(e.op, tuple(swap(a) for a in e.args), e.params)

    return f, swap


class Session:
    """Registry of named frames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, Frame] = {}

    def register(self, name: str, f: Frame) -> None:
        self.frames[name] = f
        f.to_df().createOrReplaceTempView(name)

    def deregister(self, name: str) -> None:
        self.frames.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def close(self) -> None:
        for n in list(self.frames):
            self.deregister(n)

    def query(self, query: str) -> Frame:
        """A single-table statement, by the engine's rules."""
        s = parse(query)
        if s.table not in self.frames:
            raise KeyError(f"no table {s.table}")
        f = self.frames[s.table]
        unknown = {c for e, _ in s.items if e is not None for c in columns(e)} - {*f.columns, ONE}
        if unknown:
            raise KeyError(f"no column {sorted(unknown)[0]}")
        return execute(s, f)

    def spark_sql(self, query: str) -> Frame:
        """Any statement (joins, subqueries, windows, ...) by Spark's rules: NaN is the largest value, nulls come first."""
        return Frame(self.spark.sql(query))
