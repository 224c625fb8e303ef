"""Row-local functions as Spark columns: whole-stage codegen, no Python workers.

``FUNCTIONS[op](ctx, params, *args)`` builds the Column; ``ctx.kind(column)``
tells its type where the semantics depend on it.  Null goes in, null comes out,
unless a function says otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS: dict[str, Callable[..., Column]] = {}
NAN, INF = float("nan"), float("inf")

#: Type names of casts.
TYPES = {
    "i64": "bigint", "int64": "bigint", "i32": "int", "int32": "int", "u32": "bigint", "u64": "decimal(20,0)", "f64": "double", "float64": "double",
    "f32": "float", "float32": "float", "bool": "boolean", "str": "string", "string": "string", "utf8": "string", "date": "date", "datetime": "timestamp_ntz",
}


def function(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_int(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def literal(value: Any) -> Column:
    if isinstance(value, bool) or value is None or isinstance(value, (str, float)):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("long") if -(2**63) <= value < 2**63 else F.lit(value)
    return F.lit(value)


# --- arithmetic


@function("add")
def _add(ctx, p, a, b): return a + b
@function("sub")
def _sub(ctx, p, a, b): return a - b
@function("mul")
def _mul(ctx, p, a, b): return a * b
@function("neg")
def _neg(ctx, p, a): return -a


@function("div")
def divide(ctx, p, a, b):
    """Integers stay integers and x/0 is null; floats follow IEEE."""
    if is_int(ctx.kind(a)) and is_int(ctx.kind(b)):
        return F.call_function("div", a, F.nullif(b, F.lit(0)))
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, at_zero).otherwise(x / F.when(y != 0, y))


def _ieee(f: Callable[[Column, Column], Column], unequal: bool = False) -> Callable:
    """Comparison in which NaN is neither equal to nor above anything."""

    def build(ctx, p, a, b):
        base = f(a, b)
        floats = [c for c in (a, b) if is_float(ctx.kind(c))]
        for c in floats:
            base = (base | F.isnan(c)) if unequal else (base & ~F.isnan(c))
        return F.when(a.isNotNull() & b.isNotNull(), base) if unequal and floats else base

    return build


FUNCTIONS |= {
    "eq": _ieee(lambda a, b: a == b), "ne": _ieee(lambda a, b: a != b, unequal=True), "lt": _ieee(lambda a, b: a < b),
    "le": _ieee(lambda a, b: a <= b), "gt": _ieee(lambda a, b: a > b), "ge": _ieee(lambda a, b: a >= b),
    "and": lambda ctx, p, a, b: a & b, "or": lambda ctx, p, a, b: a | b, "not": lambda ctx, p, a: ~a,
    "is_null": lambda ctx, p, a: a.isNull(), "is_not_null": lambda ctx, p, a: a.isNotNull(),
    "cast": lambda ctx, p, a: cast(a, p[0], ctx.kind(a)),
}


def cast(a: Column, to: str, kind: T.DataType | None = None) -> Column:
    """Cast in which a failure gives null, narrowing included."""
    target = TYPES.get(to, to)
    if isinstance(kind, T.StringType) and target in ("tinyint", "smallint", "int", "bigint"):
        # a failing cast costs an exception a row; most failures are no numbers at all
        return F.when(a.rlike(r"\A[\s\p{Cntrl}]*[+-]?[0-9]"), a.try_cast(target))
    return a.try_cast(target)


@function("is_nan")
def _is_nan(ctx, p, a): return F.when(a.isNotNull(), F.isnan(a.cast("double")))


@function("is_infinite")
def _is_infinite(ctx, p, a): return F.abs(a.cast("double")) == F.lit(INF)


@function("is_finite")
def _is_finite(ctx, p, a): return F.when(a.isNotNull(), ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) != F.lit(INF)))


@function("when")
def _when(ctx, p, cond, a, b): return F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)


@function("coalesce")
def _coalesce(ctx, p, *cs):
    out = F.coalesce(*cs)
    return out.cast("double") if isinstance(ctx.kind(out), T.NumericType) else out


@function("concat_str")
def _concat_str(ctx, p, *cs):
    return F.when(reduce(and_, [c.isNotNull() for c in cs], F.lit(True)), F.concat_ws(p[0], *[c.cast("string") for c in cs]))


@function("fill_null")
def _fill_null(ctx, p, a, v): return F.coalesce(a, v.cast(ctx.kind(a)) if not isinstance(ctx.kind(a), T.NullType) else v)


@function("fill_nan")
def _fill_nan(ctx, p, a): return F.when(F.isnan(a), F.lit(float(p[0]))).otherwise(a) if is_float(ctx.kind(a)) else a


# --- mathematics: f64 in and out


def _unary(name: str, f: Callable[[Column], Column], guard: Callable[[Column], Column] | None = None) -> None:
    def build(ctx, p, a):
        x = a.cast("double")
        return guard(x).otherwise(f(x)) if guard else f(x)

    FUNCTIONS[name] = build


def _log_guard(edge: float) -> Callable[[Column], Column]:
    """Logarithms at and below the edge of their domain; NaN stays NaN."""
    return lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x < edge), F.lit(NAN)).when(x == edge, F.lit(-INF))


for _n, _f in {"sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
               "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "radians": F.radians, "degrees": F.degrees}.items():
    _unary(_n, _f)
for _n, _f, _e in (("log", F.ln, 0.0), ("log2", F.log2, 0.0), ("log10", F.log10, 0.0), ("log1p", F.log1p, -1.0)):
    _unary(_n, _f, _log_guard(_e))


@function("arctan2")
def _arctan2(ctx, p, a, b): return F.atan2(a.cast("double"), b.cast("double"))
@function("abs")
def _abs(ctx, p, a): return F.abs(a)
@function("sign")
def _sign(ctx, p, a): return F.signum(a).cast(ctx.kind(a))
@function("round")
def _round(ctx, p, a): return F.round(a, p[0] if p else 0) if is_float(ctx.kind(a)) else a
@function("floor")
def _floor(ctx, p, a): return _whole(ctx, a, F.floor)
@function("ceil")
def _ceil(ctx, p, a): return _whole(ctx, a, F.ceil)


def _whole(ctx, a: Column, f: Callable[[Column], Column]) -> Column:
    """Floats beyond 64-bit integers, NaN and infinities are whole as they are."""
    x = a.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(F.when(F.abs(x) < 2.0**53, x)).cast("double"))


@function("clip")
def _clip(ctx, p, a): return F.when(a.isNotNull(), F.least(F.greatest(a, F.lit(p[0])), F.lit(p[1])))
@function("pow")
def _pow(ctx, p, a): return F.pow(a.cast("double"), F.lit(float(p[0])))
@function("hash_values")
def _hash_values(ctx, p, a): return F.when(a.isNotNull(), F.xxhash64(a))


# --- strings


def _str(name: str) -> Callable:
    return function(f"str.{name}")


for _n, _f in {"upper": F.upper, "to_upper": F.upper, "to_uppercase": F.upper, "lower": F.lower, "to_lower": F.lower, "to_lowercase": F.lower, "reverse": F.reverse}.items():
    FUNCTIONS[f"str.{_n}"] = lambda ctx, p, a, f=_f: f(a)
for _n, _f in {
    "title": lambda a: F.initcap(F.trim(F.regexp_replace(a, r"\s+", " "))),
    "len_bytes": lambda a: F.octet_length(a).cast("long"),
    "len_chars": lambda a: F.char_length(a).cast("long"),
    "trim": lambda a: F.regexp_replace(a, r"\A\s+|\s+\z", ""),
    "is_numeric": lambda a: a.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"),
}.items():
    FUNCTIONS[f"str.{_n}"] = lambda ctx, p, a, f=_f: f(a)
for _n, _f in {
    "contains": lambda a, s: a.contains(s), "contains_regex": lambda a, s: a.rlike(s), "starts_with": lambda a, s: a.startswith(s), "ends_with": lambda a, s: a.endswith(s),
    "like": lambda a, s: a.like(s), "not_like": lambda a, s: ~a.like(s),
    "lstrip": lambda a, s=None: F.ltrim(a, F.lit(s or " \t\n\r")), "rstrip": lambda a, s=None: F.rtrim(a, F.lit(s or " \t\n\r")),
    "replace_all": lambda a, old, new: F.replace(a, F.lit(old), F.lit(new)) if old else a, "replace_regex": lambda a, pat, new: F.regexp_replace(a, pat, new),
    "count_matches_regex": lambda a, pat: F.regexp_count(a, F.lit(pat)).cast("long"),
    "count_matches": lambda a, s: F.regexp_count(a, F.lit(java_literal(s))).cast("long"),
    "split_exact": lambda a, sep: F.split(a, java_literal(sep)),
    "split_wide": lambda a, sep, n: F.split(a, java_literal(sep), n),
    "concat": lambda a, s: F.concat(a, F.lit(s)), "prefix": lambda a, s: F.concat(F.lit(s), a),
    "pad_start": lambda a, n, c=" ": F.lpad(a, F.greatest(F.char_length(a), F.lit(n)), F.lit(c)),
    "pad_end": lambda a, n, c=" ": F.rpad(a, F.greatest(F.char_length(a), F.lit(n)), F.lit(c)),
    "before": lambda a, sep: F.substring_index(a, sep, 1),
}.items():
    FUNCTIONS[f"str.{_n}"] = lambda ctx, p, a, f=_f: f(a, *p)


def java_literal(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", s)


@_str("find")
def _find(ctx, p, a):
    """Byte offset of the first match, -1 if there is none."""
    return F.when(F.instr(a, p[0]) > 0, F.octet_length(F.substring_index(a, p[0], 1)).cast("long")).when(a.isNotNull(), F.lit(-1).cast("long"))


@_str("head")
def _str_head(ctx, p, a):
    n = p[0]
    return F.left(a, F.lit(n)) if n >= 0 else F.left(a, F.greatest(F.char_length(a) + n, F.lit(0)))


@_str("tail")
def _str_tail(ctx, p, a):
    n = p[0]
    return F.right(a, F.lit(n)) if n >= 0 else F.substring(a, -n + 1, 2**31 - 1)


@_str("slice")
def _str_slice(ctx, p, a):
    start, length = (*p, -1)[:2]
    size = F.char_length(a)
    at = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    return F.substring(a, at + 1, size if length < 0 else F.lit(length))


@_str("strip_prefix")
def _strip_prefix(ctx, p, a): return F.when(a.startswith(p[0]), F.substring(a, len(p[0]) + 1, 2**31 - 1)).otherwise(a)
@_str("strip_suffix")
def _strip_suffix(ctx, p, a): return F.when(a.endswith(p[0]), F.left(a, F.char_length(a) - len(p[0]))).otherwise(a)


@_str("replace")
def _replace_first(ctx, p, a):
    old, new = p
    at = F.instr(a, old)
    return F.when(at > 0, F.concat(F.left(a, at - 1), F.lit(new), F.substring(a, at + len(old), F.char_length(a)))).otherwise(a)


@_str("after")
def _after(ctx, p, a):
    at = F.instr(a, p[0])
    return F.when(at > 0, F.substring(a, at + len(p[0]), F.char_length(a))).when(a.isNotNull(), F.lit(""))


@_str("extract")
def _extract(ctx, p, a):
    pattern, group = (*p, 0)[:2]
    return F.when(a.rlike(pattern), F.regexp_extract(a, pattern, group))


@_str("split_n")
def _split_n(ctx, p, a): return F.when(a.isNotNull(), F.coalesce(F.get(F.split(a, java_literal(p[0])), F.lit(p[1])), F.lit("")))
FUNCTIONS["str.split_nth"] = _split_n


@_str("split_exact_null_short")
def _split_short(ctx, p, a): return F.get(F.split(a, java_literal(p[0])), F.lit(p[1]))


@_str("zfill")
def _zfill(ctx, p, a):
    signed = a.rlike(r"\A[+-]")
    width = lambda c, n: F.lpad(c, F.greatest(F.char_length(c), F.lit(max(n, 0))), F.lit("0"))
    return F.when(signed, F.concat(F.left(a, F.lit(1)), width(F.substring(a, 2, 2**31 - 1), p[0] - 1))).otherwise(width(a, p[0]))


# --- lists and structs


def _present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _list_fold(kind: str) -> Callable:
    def build(ctx, p, a):
        some = _present(a)
        element = ctx.kind(a).elementType
        start = F.lit(0.0) if is_float(element) else F.lit(0).cast("long")
        total = F.aggregate(some, start, lambda acc, x: acc + x)
        return F.when(F.size(some) > 0, total if kind == "sum" else total.cast("double") / F.size(some))

    return build


FUNCTIONS |= {
    "list.len": lambda ctx, p, a: F.array_size(a).cast("long"),
    "list.sum": _list_fold("sum"), "list.mean": _list_fold("mean"),
    "list.min": lambda ctx, p, a: F.array_min(a), "list.max": lambda ctx, p, a: F.array_max(a),
    "list.first": lambda ctx, p, a: F.get(a, F.lit(0)), "list.last": lambda ctx, p, a: F.try_element_at(a, F.lit(-1)),
    "list.get": lambda ctx, p, a: F.try_element_at(a, F.lit(p[0] + 1 if p[0] >= 0 else p[0])),
    "list.contains": lambda ctx, p, a: F.when(a.isNotNull(), F.coalesce(F.array_contains(a, p[0]), F.lit(False))),
    "list.join": lambda ctx, p, a: F.coalesce(F.array_join(a, p[0]), F.lit("")),
    "struct.field": lambda ctx, p, a: a.getField(p[0]),
}


def horizontal(kind: str, cols: list[Column], floats: bool, propagate: bool = False) -> Column:
    """Row-wise aggregate over columns: nulls are skipped, a row of nulls gives null;
    with ``propagate`` any null gives null."""
    if not cols:
        raise ValueError("no column of a fitting type")
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])
    every = reduce(and_, [c.isNotNull() for c in cols])
    zero = F.lit(0.0) if floats else F.lit(0).cast("long")
    total = reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c in cols])
    number = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    best = lambda f: f(*cols) if len(cols) > 1 else cols[0]
    out = {
        "sum": lambda: total,
        "mean": lambda: total.cast("double") / F.nullif(number, F.lit(0)),
        "min": lambda: best(F.least),
        "max": lambda: best(F.greatest),
        "all": lambda: reduce(and_, [F.coalesce(c, F.lit(True)) for c in cols]),
        "any": lambda: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols]),
    }[kind]()
    return F.when(every if propagate else some, out)


def ln_base(base: float) -> float:
    return math.log(base)
