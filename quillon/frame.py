"""Lazy frames with row order, over Spark DataFrames.

``Frame.order`` is None while rows lie in input order (nothing was shuffled),
else it names hidden columns that hold the order.  Operations that don't need
an order leave the plan free of it, so filters and projections still reach the
scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from quillon import order, reshape, selectors, stats
from quillon.expr import AGGREGATES, ORDERED, RESHAPING, Expr, col, columns, contains, output_name, walk
from quillon.functions import aggregates, rowwise
from quillon.plans.resolver import ROW, Order, Resolver, sort_columns
from quillon.runtime import durable, quoted


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


class Frame:
    """A lazy, ordered, immutable frame."""

    def __init__(self, df: DataFrame, order: Order | None = None, dense: bool = False):
        self.df, self.order, self.dense = df, order, dense

    # --- construction and inspection

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str] | None = None) -> Frame:
        """Frame over ``df``; ``order_by`` names columns that are unique together
        and give the row order, else it is the order of the input."""
        if not order_by:
            return cls(df)
        df = df.select("*", *[F.col(quoted(c)).alias(f"__o{i}") for i, c in enumerate(order_by)])
        return cls(df, tuple((f"__o{i}", False, False) for i in range(len(order_by))))

    @classmethod
    def from_map(cls, spark: SparkSession, data: dict[str, list], columns: list[str] | None = None) -> Frame:
        names = columns or list(data)
        if len({len(data[n]) for n in names}) > 1:
            raise ValueError("columns differ in length")
        return cls.from_arrow(spark, pa.table({n: data[n] for n in names}))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table) -> Frame:
        # times without a zone stay so
        return cls(spark.createDataFrame(table, from_arrow_schema(table.schema, prefer_timestamp_ntz=True)).coalesce(1))

    @classmethod
    def empty(cls, spark: SparkSession, schema: T.StructType | str) -> Frame:
        return cls(spark.createDataFrame([], schema))

    def _with(self, df: DataFrame, order: Order | None = None, dense: bool | None = None, same_order: bool = True) -> Frame:
        """Frame over another DataFrame, by default in the same order."""
        return Frame(df, self.order if same_order else order, (self.dense if dense is None else dense) if same_order else False)

    @property
    def columns(self) -> list[str]:
        return visible(self.df)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if not f.name.startswith("__")])

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.schema.fields]

    def has_column(self, name: str) -> bool:
        return name in self.columns

    def height(self) -> int:
        return self.df.count()

    def width(self) -> int:
        return len(self.columns)

    def shape(self) -> tuple[int, int]:
        return self.height(), self.width()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def to_df(self, ordered: bool = False) -> DataFrame:
        """The visible columns, sorted by row order if asked for."""
        df = self.df
        if ordered and self.order is not None:
            df = df.orderBy(*sort_columns(self.order))
        return df.select(*[F.col(quoted(c)) for c in self.columns])

    def collect(self) -> list:
        return self.to_df(ordered=True).collect()

    def to_arrow(self) -> pa.Table:
        return self.to_df(ordered=True).toArrow()

    def to_map(self) -> dict[str, list]:
        return self.to_arrow().to_pydict()

    def rows(self) -> list[list]:
        return [list(r) for r in self.collect()]

    def row(self, i: int) -> list:
        return list(self.slice(i, 1).collect()[0])

    def iter_batches(self, rows: int | None = None) -> Iterator[pa.RecordBatch]:
        """Arrow batches in row order, of at most ``rows`` rows, one partition at a time at the driver."""
        from quillon.sources.files import arrow_batches

        for b in arrow_batches(self):
            step = rows or max(b.num_rows, 1)
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)

    def sink(self, writer: Callable[[DataFrame], Any]) -> Any:
        return writer(self.to_df(ordered=True))

    def cache(self) -> Frame:
        return self._with(self.df.persist())

    def materialise(self) -> Frame:
        """Write the frame once to the shared checkpoint folder."""
        r = Resolver(self)
        r.ordered()
        return Frame(durable(r.df), r.order, r.dense)

    def equals(self, other: Frame) -> bool:
        """Same columns and the same rows in the same order; NaN equals NaN."""
        if self.schema.simpleString() != other.schema.simpleString():
            return False
        a, b = self.with_row_index("__at").df, other.with_row_index("__at").df
        c = self.columns
        left = a.select("__at", F.struct(*[F.col(quoted(x)) for x in c]).alias("a"))
        right = b.select("__at", F.struct(*[F.col(quoted(x)) for x in c]).alias("b"))
        return left.join(right, "__at", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()

    def estimated_size(self) -> int:
        """Arrow bytes of the visible columns, measured in batches."""
        count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        return self.to_df().mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def glimpse(self, n: int = 5) -> str:
        rows = self.head(n).collect()
        return "\n".join(f"{name} <{kind}>: {', '.join(str(r[i]) for r in rows)}" for i, (name, kind) in enumerate(self.dtypes))

    # --- projection and columns

    def select(self, *exprs: Expr | str) -> Frame:
        es = [col(e) if isinstance(e, str) else e for e in exprs]
        if any(contains(e, RESHAPING) for e in es):
            return self._reshaped(es)
        if es and all(contains(e, AGGREGATES) and not _bare(e) for e in es):
            return self._aggregated(es)
        r = Resolver(self._only(es))
        r.prepare(es)
        named = [(output_name(e), r.column(e)) for e in es]
        if len({n for n, _ in named}) < len(named):
            raise ValueError("two outputs have the same name")
        hidden = [n for n, _, _ in r.order or ()] + ([order.INDEX] if r.dense and order.INDEX not in [n for n, _, _ in r.order or ()] else [])
        return Frame(r.df.select(*[c.alias(n) for n, c in named], *hidden), r.order, r.dense)

    def _only(self, es: list[Expr]) -> Frame:
        """The frame with the columns that expressions need, so no more is sorted or written."""
        need = {c for e in es for c in columns(e)}
        gone = [c for c in self.columns if c not in need]
        return self._with(self.df.drop(*gone)) if self.order is not None and gone and len(gone) < len(self.columns) else self

    def _aggregated(self, es: list[Expr]) -> Frame:
        """One row of aggregates, or of row-local functions of aggregates: one pass."""
        r = Resolver(self)
        parts = [x for e in es for x in walk(e) if x.op in AGGREGATES]
        if all(x.op not in ("entropy", "median", "quantile") and not contains(x.args[0], AGGREGATES | ORDERED | {"over"}) for x in parts):
            names = {id(x): f"__a{i}" for i, x in enumerate(parts)}
            # aggregates first: they may add columns
            cols = [r.aggregate_column(x).alias(names[id(x)]) for x in parts]
            one = Frame(r.df.agg(*cols))

            def swap(e: Expr) -> Expr:
                return col(names[id(e)]) if id(e) in names else Expr(e.op, tuple(swap(a) for a in e.args), e.params)

            after = Resolver(one)
            return Frame(one.df.select(*[after.column(swap(e)).alias(output_name(e)) for e in es]))
        cols = [r.column(e).alias(output_name(e)) for e in es]
        return Frame(self.df.sparkSession.range(1).select(*cols))

    def _reshaped(self, es: list[Expr]) -> Frame:
        """A single expression that changes the length."""
        if len(es) != 1:
            raise ValueError("an expression that changes the length must be selected alone")
        name, e = output_name(es[0]), es[0]
        while e.op == "alias":
            e = e.args[0]
        if e.op == "int_range":
            return Frame(self.df.sparkSession.range(*e.params).select(F.col("id").alias(name)).orderBy(F.asc(name) if e.params[2] > 0 else F.desc(name)))
        if e.op == "constant":
            return Frame(self.df.sparkSession.range(e.params[1]).select(F.lit(e.params[0]).alias(name)))
        f = self.select(e.args[0].alias(name))
        c = F.col(quoted(name))
        if e.op == "sort":
            return f.sort(name, bool(e.params[0]))
        if e.op == "drop_nulls":
            return f.drop_nulls(name)
        if e.op == "mode":
            return stats.mode(f, name)
        if e.op in ("arg_sort", "arg_true", "arg_unique"):
            i = f.with_row_index("__at").df
            if e.op == "arg_true":
                return Frame(i.filter(c).select(F.col("__at").alias(name)), None).sort(name)
            if e.op == "arg_unique":
                return Frame(i.groupBy(c).agg(F.min("__at").alias("__f")).select(F.col("__f").alias(name))).sort(name)
            s = Frame(i).sort(name)
            return Frame(s.df.select(F.col("__at").alias("__pos"), *[n for n, _, _ in s.order]).withColumn(name, F.col("__pos")).drop("__pos"), s.order)
        return getattr(f, e.op)(*e.params)

    def with_columns(self, *exprs: Expr) -> Frame:
        """Add or replace columns, one after the other: later ones see earlier ones."""
        f = self
        for e in exprs:
            r = Resolver(f)
            c = r.column(e)
            df = r.df.withColumn(output_name(e), c)
            keep = {n for n, _, _ in r.order or ()} | ({order.INDEX} if r.dense else set()) | set(f.columns) | {output_name(e)} | {n for n, _, _ in f.order or ()}
            f = Frame(df.drop(*[x for x in df.columns if x not in keep]), r.order, r.dense)
        return f

    with_column = with_columns

    def with_series(self, *others: Frame) -> Frame:
        """Attach columns of frames of equal height, row by row."""
        return self.hstack(*others)

    def drop(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def rename(self, old: str, new: str) -> Frame:
        if old not in self.columns:
            raise ValueError(f"no column {old}")
        if new != old and new in self.columns:
            raise ValueError(f"column {new} exists")
        return self._with(self.df.withColumnRenamed(old, new))

    def cast(self, name: str, to: str) -> Frame:
        return self.with_columns(col(name).cast(to).alias(name))

    def select_by(self, selector: selectors.Selector) -> Frame:
        return self.select(*selector(self.schema))

    def drop_by(self, selector: selectors.Selector) -> Frame:
        return self.drop(*selector(self.schema))

    def pipe(self, f: Callable[[Frame], Frame]) -> Frame:
        return f(self)

    def apply(self, f: Callable[[Expr], Expr]) -> Frame:
        """Apply a function to every column."""
        return self.select(*[f(col(c)).alias(c) for c in self.columns])

    def map_values(self, name: str, f: Callable[[Any], Any], to: str | None = None) -> Frame:
        """Host function on the non-null values of a column, in Arrow batches."""
        kind = to or dict(self.dtypes)[name]
        target = to_arrow_type(T.StructType.fromDDL(f"x {kind}")[0].dataType)

        # Arrow, not pandas: whole numbers beside nulls stay whole
        @F.arrow_udf(kind)
        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if v is None else f(v) for v in a.to_pylist()], target)

        return self._with(self.df.withColumn(name, F.when(F.col(quoted(name)).isNotNull(), run(F.col(quoted(name))))))

    def map_batches(self, f: Callable, schema: T.StructType | str) -> Frame:
        """Host function on Arrow batches."""
        return Frame(self.to_df().mapInArrow(f, schema))

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        r = Resolver(self)
        r.indexed()
        df = r.df.select((F.col(order.INDEX) + offset).cast("long").alias(name), *r.df.columns)
        return Frame(df, r.order, r.dense)

    def hstack(self, *others: Frame) -> Frame:
        f = self
        for o in others:
            if set(f.columns) & set(o.columns):
                raise ValueError("the frames share a column name")
            a, b = Resolver(f), Resolver(o)
            a.indexed()
            b.indexed()
            if a.df.count() != b.df.count():
                raise ValueError("the frames differ in height")
            right = b.df.select(order.INDEX, *[F.col(quoted(c)) for c in o.columns])
            f = Frame(a.df.join(right, order.INDEX), a.order, True)
        return f

    # --- rows

    def filter(self, *preds: Expr) -> Frame:
        """Rows for which all predicates are true; null is not true."""
        r = Resolver(self)
        for p in preds:
            c = r.column(p)
            if not isinstance(r.kind(c), (T.BooleanType, T.NullType)):
                raise ValueError("a predicate must be boolean")
            r.df = r.df.filter(c)
        keep = set(self.df.columns) | {n for n, _, _ in r.order or ()}
        return Frame(r.df.drop(*[c for c in r.df.columns if c not in keep]), r.order, False)

    def sort(self, by: str, descending: bool = False) -> Frame:
        return self.sort_by([by], [descending])

    def sort_by(self, keys: list[str], descending: list[bool] | None = None, nulls_first: list[bool] | None = None) -> Frame:
        """Stable sort; nulls last in either direction unless asked otherwise."""
        r = Resolver(self)
        old = r.ordered()
        flags = [*zip(keys, descending or [False] * len(keys), nulls_first or [False] * len(keys), strict=True)]
        spec = [(r.put(F.col(quoted(k))), bool(d), bool(n)) for k, d, n in flags]
        return Frame(r.df, (*spec, *old), False)

    def reverse(self) -> Frame:
        r = Resolver(self)
        return Frame(r.df, tuple((n, not d, not f) for n, d, f in r.ordered()), False) if r.ordered() else self

    def head(self, n: int = 10) -> Frame:
        """First rows in order: a top-n, or by position where ``n`` is more than a block."""
        if self.order is None:
            return self._with(self.df.limit(n))
        if n > order.BLOCK_ROWS:
            return self._positions(0, n)
        return self._with(self.df.orderBy(*sort_columns(self.order)).limit(n), dense=False)

    limit = head

    def tail(self, n: int = 10) -> Frame:
        return self.reverse().head(n).reverse()

    def slice(self, offset: int, length: int) -> Frame:
        """Rows [offset, offset + length), cut at the end."""
        if offset < 0:
            raise ValueError("the offset is negative")
        if offset + length > order.BLOCK_ROWS:
            return self._positions(offset, offset + length)
        r = Resolver(self)
        r.ordered()
        return Frame(r.df.orderBy(*sort_columns(r.order)).offset(offset).limit(length), r.order, False)

    def _positions(self, low: int, high: int) -> Frame:
        """Rows by position, each task keeping its own: no task receives them all."""
        r = Resolver(self)
        r.indexed()
        return Frame(r.df.filter((F.col(order.INDEX) >= low) & (F.col(order.INDEX) < high)), r.order, False)

    def top_k(self, k: int, by: str) -> Frame:
        return self.sort(by, True).head(k)

    def bottom_k(self, k: int, by: str) -> Frame:
        return self.sort(by).head(k)

    def sample(self, n: int, replacement: bool = False, seed: int = 0) -> Frame:
        """Exactly ``n`` rows in input order, drawn with a seed."""
        total = self.height()
        if not replacement and n > total:
            raise ValueError("more rows asked for than there are")
        r = Resolver(self)
        r.indexed()
        key = F.xxhash64(F.lit(seed), F.col(order.INDEX))
        if not replacement and n <= order.BLOCK_ROWS:
            return Frame(r.df.orderBy(key, order.INDEX).limit(n), r.order, False)
        if not replacement:
            # the n rows that come first by hash, cut by position
            drawn = order.dense_index(r.df, [key.asc(), F.asc(order.INDEX)], "__drawn")
            return Frame(drawn.filter(F.col("__drawn") < n).drop("__drawn"), r.order, False)
        if not total:
            return self.head(0)
        draws = self.df.sparkSession.range(n).select(F.col("id").alias("__w"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(total)).alias(order.INDEX))
        return Frame(r.df.join(draws, order.INDEX), (*r.order, ("__w", False, False)), False)

    def sample_frac(self, fraction: float, replacement: bool = False, seed: int = 0) -> Frame:
        return self.sample(int(fraction * self.height()), replacement, seed)

    def shuffle(self, seed: int = 0) -> Frame:
        """A random permutation of the rows."""
        r = Resolver(self)
        r.indexed()
        key = r.put(F.xxhash64(F.lit(seed), F.col(order.INDEX)))
        return Frame(r.df, ((key, False, False), *r.order), False)

    def gather(self, indices: list[int]) -> Frame:
        """Rows by position, in the order of the list, repeats included."""
        r = Resolver(self)
        r.indexed()
        total = r.df.count()
        if any(i < 0 or i >= total for i in indices):
            raise IndexError("a position is outside the frame")
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(indices)), "__w long, __i long")
        df = wanted.join(r.df, order.INDEX).drop(order.INDEX)
        return Frame(df.drop(*[n for n, _, _ in r.order if n in df.columns and n != "__w"]), (("__w", False, False),))

    def partition_by(self, *keys: str) -> list[Frame]:
        """A frame per combination of keys, in key order.  Lists the keys at the driver."""
        found = self.to_df().select(*[F.col(quoted(k)) for k in keys]).distinct().orderBy(*[F.col(quoted(k)).asc_nulls_last() for k in keys]).collect()
        return [self._with(self.df.filter(reduce(and_, [F.col(quoted(k)).eqNullSafe(F.lit(v)) for k, v in zip(keys, row, strict=True)])), dense=False) for row in found]

    def unique(self) -> Frame:
        """Distinct rows, in key order."""
        return Frame(self.to_df().distinct()).sort_by(self.columns) if len(self.columns) > 1 else self._first_seen()

    def _first_seen(self) -> Frame:
        r = Resolver(self)
        key = r.order_key()
        name = self.columns[0]
        return Frame(r.df.groupBy(F.col(quoted(name))).agg(F.min(key).alias(ROW)), ((ROW, False, False),))

    # --- nulls

    def fill_null(self, value: Any) -> Frame:
        """Every column whose type fits the value."""
        fits = {bool: T.BooleanType, str: T.StringType}.get(type(value), T.NumericType)
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, fits)]
        return self._with(self.df.withColumns({n: F.coalesce(F.col(quoted(n)), F.lit(value).cast(self.df.schema[n].dataType)) for n in names}))

    def fill_nan(self, value: float) -> Frame:
        floats = selectors.floats()(self.schema)
        return self._with(self.df.withColumns({n: F.when(F.isnan(quoted(n)), F.lit(value)).otherwise(F.col(quoted(n))) for n in floats}))

    def forward_fill(self, limit: int = 0) -> Frame:
        return self.with_columns(*[col(c).forward_fill(limit).alias(c) for c in self.columns])

    def backward_fill(self, limit: int = 0) -> Frame:
        return self.with_columns(*[col(c).backward_fill(limit).alias(c) for c in self.columns])

    def drop_nulls(self, *names: str) -> Frame:
        return self._with(self.df.filter(reduce(and_, [F.col(quoted(c)).isNotNull() for c in names or self.columns])), dense=False)

    def any_null_mask(self, name: str = "any_null") -> Frame:
        return self._with(self.df.withColumn(name, reduce(or_, [F.col(quoted(c)).isNull() for c in self.columns]))).select(name)

    def null_count(self) -> Frame:
        return Frame(self.df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in self.columns]))

    # --- grouping, joins, unions

    def group_by(self, *keys: str) -> GroupBy:
        return GroupBy(self, keys)

    def join(self, right: Frame, on: list[str] | str, how: str = "inner", suffix: str = "_right") -> Frame:
        """Equi-join; the right keys are dropped, clashing names get ``suffix``.

        Null and NaN keys never match.  ``how``: inner, left, cross, and beyond
        the reference right, full, semi, anti.  Rows come in left order, then
        right order.
        """
        on = [on] if isinstance(on, str) else list(on)
        a, b = Resolver(self), Resolver(right)
        a.ordered()
        b.ordered()
        left_names, drop = self.columns, set() if how == "cross" else set(on)
        renames = {c: c + suffix if c in left_names else c for c in right.columns if c not in drop}
        if len(set(renames.values()) | set(left_names)) < len(renames) + len(left_names):
            raise ValueError("a suffixed name is taken")
        r_order = [(f"__r_{n}", d, f) for n, d, f in b.order]
        r = b.df.select(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(on if how != "cross" else [])], *[F.col(quoted(c)).alias(n) for c, n in renames.items()], *[F.col(n).alias(f"__r_{n}") for n, _, _ in b.order])
        left = a.df.select(*[F.col(quoted(c)) for c in left_names], *[F.col(n).alias(f"__l_{n}") for n, _, _ in a.order])
        l_order = [(f"__l_{n}", d, f) for n, d, f in a.order]
        if how == "cross":
            return Frame(left.crossJoin(r), (*l_order, *r_order))
        cond = []
        for i, k in enumerate(on):
            cond.append(left[quoted(k)] == r[f"__k{i}"])
            if rowwise.is_float(self.df.schema[k].dataType):
                cond.append(~F.isnan(left[quoted(k)]))
        kinds = {"semi": "left_semi", "anti": "left_anti"}
        out = left.join(r, reduce(and_, cond), kinds.get(how, how))
        if how in ("semi", "anti"):
            return Frame(out, tuple(l_order))
        if how in ("right", "full"):
            out = out.withColumns({k: F.coalesce(F.col(quoted(k)), F.col(f"__k{i}")) for i, k in enumerate(on)})
        return Frame(out.drop(*[f"__k{i}" for i in range(len(on))]), (*l_order, *r_order))

    def vstack(self, *others: Frame) -> Frame:
        """Rows of all frames, in order; the schemas must agree."""
        frames = [self, *others]
        if any(f.schema.simpleString() != self.schema.simpleString() for f in others):
            raise ValueError("the schemas differ")
        parts = []
        for i, f in enumerate(frames):
            r = Resolver(f)
            plain = len(r.ordered()) == 1 and not (r.order[0][1] or r.order[0][2]) and r.df.schema[r.order[0][0]].dataType == T.LongType()
            if not plain:
                r.indexed()
            parts.append(r.df.select(*[F.col(quoted(c)) for c in f.columns], F.lit(i).alias("__frame"), F.col(r.order[0][0]).alias(ROW)))
        return Frame(reduce(DataFrame.unionByName, parts), (("__frame", False, False), (ROW, False, False)))

    extend = vstack

    # --- whole-frame aggregates and reshaping

    def agg_all(self, op: str) -> Frame:
        """One row: an aggregate of every numeric column as f64 (count: every column)."""
        names = self.columns if op in ("count", "null_count") else selectors.numeric()(self.schema)
        if op in ("median", "quantile"):
            return self.select(*[getattr(col(n), op)().alias(n) for n in names])
        out = self.select(*[getattr(col(n), op)().alias(n) for n in names])
        return out if op in ("count", "null_count") else out.select(*[col(n).cast("f64").alias(n) for n in names])

    def __getattr__(self, name: str) -> Any:
        if name.endswith("_all") and name[:-4] in ("sum", "mean", "min", "max", "std", "var", "median", "count", "null_count"):
            return lambda: self.agg_all(name[:-4])
        if name.endswith("_horizontal"):
            return lambda out, *cols, propagate=False: reshape.horizontal(self, name[: -len("_horizontal")], out, list(cols), propagate)
        for module in (reshape, stats):
            if name in module.METHODS:
                return lambda *a, **k: module.METHODS[name](self, *a, **k)
        raise AttributeError(name)


class GroupBy:
    """Pending grouping; nulls form a group."""

    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        self.frame, self.keys = frame, keys

    def agg(self, *exprs: Expr) -> Frame:
        """Keys, then aggregates; no aggregate gives the distinct keys.

        Groups of one key come in order of first appearance, of more in key order.
        """
        r = Resolver(self.frame)
        by = [F.col(quoted(k)) for k in self.keys]
        if not exprs:
            return Frame(r.df.select(*by).distinct()).sort_by(list(self.keys))
        aggs: list[tuple[str, Expr]] = []
        for e in exprs:
            inner = e.args[0] if e.op == "alias" else e
            if inner.op not in AGGREGATES:
                raise ValueError("an aggregate of a row-local expression is needed")
            if contains(inner.args[0], AGGREGATES | ORDERED):
                inner = Expr(inner.op, (col(r.put(r.column(inner.args[0]))),), inner.params)
            aggs.append((output_name(e), inner))
        keys = {f"__k{i}": k for i, k in enumerate(self.keys)}
        if len(self.keys) == 1:
            key = r.order_key()
            out = r.per_key([(f"__a{i}", e) for i, (_, e) in enumerate(aggs)], self.keys, F.min(key).alias(ROW))
        else:
            out = r.per_key([(f"__a{i}", e) for i, (_, e) in enumerate(aggs)], self.keys)
        named = out.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.col(f"__a{i}").alias(n) for i, (n, _) in enumerate(aggs)], *([ROW] if len(self.keys) == 1 else []))
        return Frame(named, ((ROW, False, False),)) if len(self.keys) == 1 else Frame(named).sort_by(list(self.keys))


def _bare(e: Expr) -> bool:
    """Whether a column or order-dependent function is used outside an aggregate."""
    if e.op in AGGREGATES:
        return False
    if e.op in ("col", "over") or e.op in ORDERED:
        return True
    return any(_bare(a) for a in e.args)


def concat(*frames: Frame) -> Frame:
    return frames[0].vstack(*frames[1:]) if len(frames) > 1 else frames[0]


__all__ = ["Frame", "GroupBy", "aggregates", "concat"]
