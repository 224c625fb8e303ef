"""Pipeline scripts as Python programs.

Every statement becomes the frame calls it stands for; the program defines
``pipeline(spark)``, which returns the last frame, and needs no interpreter.
"""

from __future__ import annotations

import os
import shlex
from collections.abc import Callable

from quillon.expr import Expr
from quillon.plans.parse import parse, parse_predicate

_HEAD = """from pyspark.sql import SparkSession

from quillon import coalesce, col, concat_str, introspect, lit, when
from quillon.sources import files


def show(f, n=None):
    (f if n is None else f.head(n)).to_df(ordered=True).show(1_000_000, truncate=False)


def pipeline(spark):
    frames = {}
    f = source = None
"""
_TAIL = """    return f


if __name__ == "__main__":
    pipeline(SparkSession.builder.getOrCreate())
"""
_BINARY = {"add": "+", "sub": "-", "mul": "*", "div": "/", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "&", "or": "|"}


def source_of(e: Expr) -> str:
    """An expression as Python source."""
    a = [source_of(x) for x in e.args]
    p = ", ".join(repr(x) for x in e.params)
    if e.op in ("col", "lit"):
        return f"{e.op}({p})"
    if e.op in _BINARY:
        return f"({a[0]} {_BINARY[e.op]} {a[1]})"
    if e.op in ("not", "neg"):
        return f"({'~' if e.op == 'not' else '-'}{a[0]})"
    if e.op == "when":
        return f"when({a[0]}).then({a[1]}).otherwise({a[2]})"
    if e.op == "coalesce":
        return f"coalesce({', '.join(a)})"
    if e.op == "concat_str":
        return f"concat_str({', '.join([p, *a])})"
    return f"{a[0]}.{e.op}({', '.join([*([p] if p else []), *a[1:]])})"


class _Program:
    def __init__(self, folder: str):
        self.lines: list[str] = []
        self.folder = folder

    def path(self, name: str) -> str:
        return repr(name if "://" in name else os.path.normpath(os.path.join(self.folder, os.path.expanduser(name))))

    def load(self, reader: str, rest: str) -> list[str]:
        w = shlex.split(rest)
        made = f"files.{reader}(spark, {self.path(w[0])})"
        return [f"frames[{w[2]!r}] = {made}"] if len(w) >= 3 and w[1] == "as" else [f"f = source = {made}"]

    def joined(self, rest: str) -> list[str]:
        w = shlex.split(rest)
        how = w[3] if len(w) > 3 else "inner"
        on = [] if how == "cross" else w[2].split(",")
        return [f"f = f.join(frames.get({w[0]!r}) or files.scan(spark, {self.path(w[0])}), {on!r}, {how!r})"]

    def grouped(self, rest: str) -> list[str]:
        w = shlex.split(rest)
        aggs = []
        for spec in w[1:]:
            c, op, *name = spec.split(":")
            aggs.append(f"col({c!r}).{ {'avg': 'mean'}.get(op, op) }().alias({(name or [f'{c}_{op}'])[0]!r})")
        return [f"f = f.group_by({', '.join(map(repr, w[0].split(',')))}).agg({', '.join(aggs)})"]

    def statement(self, text: str) -> list[str]:
        word, _, rest = text.partition(" ")
        rest = rest.strip()
        if word == "cd":
            self.folder = os.path.normpath(os.path.join(self.folder, os.path.expanduser(rest or "~")))
            return []
        if word == "source":
            from quillon.script import statements

            with open(os.path.join(self.folder, rest), encoding="utf-8") as f:
                return [line for _, t in statements(f.read()) for line in self.statement(t)]
        if word == "join":
            return self.joined(rest)
        if word == "groupby":
            return self.grouped(rest)
        if word == "load" or word.startswith("scan_"):
            return self.load({"load": "scan", "scan_auto": "scan"}.get(word, word.replace("scan_", "read_")), rest)
        if word in ("save", "write"):
            return [f"files.save(f, {self.path(shlex.split(rest)[0])})"]
        if word in _STATEMENTS:
            return _STATEMENTS[word](shlex.split(rest) if word not in _RAW else [rest])
        if word in _QUIET:
            return [f"# {text}"]
        raise ValueError(f"no program for {word}")


def _names(w: list[str]) -> str:
    return ", ".join(repr(x) for part in w for x in part.split(",") if x)


def _number(w: list[str], default: int) -> int:
    return int(w[0]) if w else default


def _literal(text: str) -> object:
    e = parse(text)
    return e.params[0] if e.op == "lit" else text


def _with(w: list[str]) -> list[str]:
    name, _, text = w[0].partition("=")
    return [f"f = f.with_columns({source_of(parse(text))}.alias({name.strip()!r}))"]


#: Commands whose argument is one text, and those that only concern a terminal.
_RAW = frozenset(("with", "filter", "explode", "unnest"))
_QUIET = frozenset("timing info clear help pwd ls frames".split())
_STATEMENTS: dict[str, Callable[[list[str]], list[str]]] = {
    "use": lambda w: [f"f = source = frames[{w[0]!r}]"],
    "stash": lambda w: [f"frames[{w[0]!r}] = f = f.cache()"],
    "drop_frame": lambda w: [f"frames.pop({w[0]!r})"],
    "collect": lambda w: ["f = source = f.materialise()"],
    "reset": lambda w: ["f = source"],
    "with": _with,
    "filter": lambda w: [f"f = f.filter({source_of(parse_predicate(w[0]))})"],
    "select": lambda w: [f"f = f.select({_names(w)})"],
    "drop": lambda w: [f"f = f.drop({_names(w)})"],
    "drop_null": lambda w: [f"f = f.drop_nulls({_names(w)})"],
    "limit": lambda w: [f"f = f.head({_number(w, 10)})"],
    "sort": lambda w: [f"f = f.sort({w[0]!r}, {len(w) > 1 and w[1].lower() == 'desc'})"],
    "sample": lambda w: [f"f = f.sample({int(w[0])}, seed={_number(w[1:], 0)})"],
    "shuffle": lambda w: [f"f = f.shuffle({_number(w, 0)})"],
    "cast": lambda w: [f"f = f.cast({w[0]!r}, {w[1]!r})"],
    "rename": lambda w: [f"f = f.rename({w[0]!r}, {[x for x in w[1:] if x != 'as'][0]!r})"],
    "with_row_index": lambda w: [f"f = f.with_row_index({w[0]!r}, {_number(w[1:], 0)})"],
    "fill_null": lambda w: [f"f = f.fill_null({_literal(w[0])!r})"],
    "fill_nan": lambda w: [f"f = f.fill_nan({float(w[0])})"],
    "unpivot": lambda w: [f"f = f.unpivot({w[0].split(',')!r}, {w[1].split(',') if len(w) > 1 else None!r})"],
    "pivot": lambda w: [f"f = f.pivot({w[0].split(',')!r}, {w[1]!r}, {w[2]!r}, {(w[3] if len(w) > 3 else 'first')!r})"],
    "transpose": lambda w: [f"f = f.transpose({', '.join(map(repr, w))})"],
    "upsample": lambda w: [f"f = f.upsample({w[0]!r}, {w[1]!r})"],
    "partition_by": lambda w: [f"show(f.group_by({_names(w)}).agg(col({w[0].split(',')[0]!r}).count().alias('rows')))"],
    "tail": lambda w: [f"show(f.tail({_number(w, 10)}))"],
    "schema": lambda w: ["print(f.dtypes)"],
    "describe": lambda w: ["show(f.describe())"],
    "glimpse": lambda w: [f"print(f.glimpse({_number(w, 5)}))"],
    "size": lambda w: ["print(f.estimated_size())"],
    "explain": lambda w: ["print(introspect.explain(f))"],
    "mermaid": lambda w: ["print(introspect.mermaid(f))"],
    "corr": lambda w: [f"print(f.pearson_corr({w[0]!r}, {w[1]!r}))"],
    "cov": lambda w: [f"print(f.covariance({w[0]!r}, {w[1]!r}))"],
}
for _name in ("show", "head", "ishow", "browse"):
    _STATEMENTS[_name] = lambda w: [f"show(f, {_number(w, 10)})"]
for _name in ("null_count", "null_count_all"):
    _STATEMENTS[_name] = lambda w: ["show(f.null_count())"]
for _name, _call in (("explain_tree", "explain_tree"), ("tree", "explain_tree"), ("graph", "graph"), ("show_graph", "graph")):
    _STATEMENTS[_name] = lambda w, c=_call: [f"print(introspect.{c}(f))"]
for _name in ("reverse", "unique"):
    _STATEMENTS[_name] = lambda w, n=_name: [f"f = f.{n}()"]
for _name in ("explode", "unnest"):
    _STATEMENTS[_name] = lambda w, n=_name: [f"f = f.{n}({w[0]!r})"]
for _name in ("forward_fill", "backward_fill"):
    _STATEMENTS[_name] = lambda w, n=_name: [f"f = f.{n}({_number(w, 0)})"]
for _name in ("top_k", "bottom_k"):
    _STATEMENTS[_name] = lambda w, n=_name: [f"f = f.{n}({int(w[0])}, {w[1]!r})"]
for _name in ("sum", "mean", "min", "max", "median", "std", "skew", "kurtosis", "approx_n_unique"):
    _STATEMENTS[_name] = lambda w, n=_name: [f"print(f.select(col({w[0]!r}).{n}()).collect()[0][0])"]
for _name in ("sum", "mean", "min", "max", "std", "var", "median", "count"):
    _STATEMENTS[f"{_name}_all"] = lambda w, n=_name: [f"f = f.agg_all({n!r})"]
for _name in ("sum", "mean", "min", "max", "all", "any"):
    _STATEMENTS[f"{_name}_horizontal"] = lambda w, n=_name: [f"f = f.{n}_horizontal({', '.join(map(repr, w))})"]


def transpile(text: str, folder: str | None = None) -> str:
    """A script as a Python program with the same effect; relative paths start at ``folder``."""
    from quillon.script import statements

    program = _Program(folder or os.getcwd())
    body: list[str] = []
    for n, s in statements(text):
        if s in ("exit", "quit"):
            break
        try:
            body += program.statement(s)
        except (ValueError, IndexError) as e:
            raise ValueError(f"line {n}: {e}") from e
    return _HEAD + "".join(f"    {line}\n" for line in body) + _TAIL
