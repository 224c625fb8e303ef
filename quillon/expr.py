"""Expressions: an immutable tree beside Spark's Column.

Spark frames have no row order and no per-frame broadcast of aggregates, so a
tree is kept that tells row-local, aggregate and order-dependent parts apart.
``quillon.frame`` resolves it to Columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

#: Aggregates, order-dependent functions that keep the length, and those that change it.
AGGREGATES = frozenset(
    "sum mean min max count null_count first last median quantile std var any all product skew skew_unbiased kurtosis kurtosis_unbiased entropy n_unique approx_n_unique arg_min arg_max".split()
)
ORDERED = frozenset(
    "shift diff pct_change cum_sum cum_min cum_max cum_prod cum_count rolling_sum rolling_mean rolling_min rolling_max rolling_std rolling_var ewm_mean ewm_var ewm_std"
    " forward_fill backward_fill rank peak_max peak_min is_duplicated is_unique is_first_distinct is_last_distinct".split()
)
RESHAPING = frozenset("sort unique head tail slice reverse drop_nulls mode arg_sort arg_true arg_unique int_range constant".split())


@dataclass(frozen=True, eq=False)
class Expr:
    """Node ``op`` with child expressions ``args`` and constants ``params``."""

    op: str
    args: tuple[Expr, ...] = ()
    params: tuple = ()

    # arithmetic, comparison, logic
    def __add__(self, o: Any) -> Expr: return call("add", self, o)
    def __radd__(self, o: Any) -> Expr: return call("add", lit(o), self)
    def __sub__(self, o: Any) -> Expr: return call("sub", self, o)
    def __rsub__(self, o: Any) -> Expr: return call("sub", lit(o), self)
    def __mul__(self, o: Any) -> Expr: return call("mul", self, o)
    def __rmul__(self, o: Any) -> Expr: return call("mul", lit(o), self)
    def __truediv__(self, o: Any) -> Expr: return call("div", self, o)
    def __rtruediv__(self, o: Any) -> Expr: return call("div", lit(o), self)
    def __neg__(self) -> Expr: return call("neg", self)
    def __eq__(self, o: Any) -> Expr: return call("eq", self, o)  # type: ignore[override]
    def __ne__(self, o: Any) -> Expr: return call("ne", self, o)  # type: ignore[override]
    def __lt__(self, o: Any) -> Expr: return call("lt", self, o)
    def __le__(self, o: Any) -> Expr: return call("le", self, o)
    def __gt__(self, o: Any) -> Expr: return call("gt", self, o)
    def __ge__(self, o: Any) -> Expr: return call("ge", self, o)
    def __and__(self, o: Any) -> Expr: return call("and", self, o)
    def __or__(self, o: Any) -> Expr: return call("or", self, o)
    def __invert__(self) -> Expr: return call("not", self)
    def __hash__(self) -> int: return hash((self.op, self.args, repr(self.params)))

    def same(self, o: Expr) -> bool:
        """Structural equality (``==`` builds an expression)."""
        return self.op == o.op and repr(self.params) == repr(o.params) and len(self.args) == len(o.args) and all(a.same(b) for a, b in zip(self.args, o.args, strict=True))

    # naming and types
    def alias(self, name: str) -> Expr: return Expr("alias", (self,), (name,))
    def cast(self, to: str) -> Expr: return Expr("cast", (self,), (to,))
    def over(self, *keys: str) -> Expr: return Expr("over", (self,), keys)

    # predicates and nulls
    def between(self, lo: Any, hi: Any) -> Expr: return (self >= lo) & (self <= hi)
    def is_in(self, *values: Any) -> Expr:
        out = lit(False) if not values else self == values[0]
        for v in values[1:]:
            out = out | (self == v)
        return out
    def fill_null(self, v: Any) -> Expr: return call("fill_null", self, v)

    # parameters of order-dependent functions
    def shift(self, n: int = 1) -> Expr: return Expr("shift", (self,), (n,))
    def diff(self, n: int = 1) -> Expr: return Expr("diff", (self,), (n,))
    def pct_change(self, n: int = 1) -> Expr: return Expr("pct_change", (self,), (n,))
    def forward_fill(self, limit: int = 0) -> Expr: return Expr("forward_fill", (self,), (limit,))
    def backward_fill(self, limit: int = 0) -> Expr: return Expr("backward_fill", (self,), (limit,))
    def rank(self, method: str = "average") -> Expr: return Expr("rank", (self,), (method,))
    def ewm_mean(self, alpha: float) -> Expr: return Expr("ewm_mean", (self,), (_share(alpha),))
    def ewm_var(self, alpha: float) -> Expr: return Expr("ewm_var", (self,), (_share(alpha),))
    def ewm_std(self, alpha: float) -> Expr: return Expr("ewm_std", (self,), (_share(alpha),))
    def quantile(self, q: float) -> Expr: return Expr("quantile", (self,), (q,))
    def entropy(self, base: float = 2.718281828459045) -> Expr: return Expr("entropy", (self,), (base,))
    def sort(self, descending: bool = False) -> Expr: return Expr("sort", (self,), (descending,))
    def head(self, n: int = 10) -> Expr: return Expr("head", (self,), (n,))
    def tail(self, n: int = 10) -> Expr: return Expr("tail", (self,), (n,))
    def slice(self, offset: int, length: int) -> Expr: return Expr("slice", (self,), (offset, length))

    @property
    def str(self) -> Namespace: return Namespace(self, "str")
    @property
    def list(self) -> Namespace: return Namespace(self, "list")
    @property
    def struct(self) -> Namespace: return Namespace(self, "struct")


def _share(alpha: float) -> float:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return alpha


def _method(op: str) -> Callable:
    def method(self: Expr, *params: Any) -> Expr:
        return Expr(op, (self,), params)

    method.__name__ = op
    return method


def _rolling(op: str) -> Callable:
    def method(self: Expr, window: int, min_periods: int | None = None) -> Expr:
        return Expr(op, (self,), (window, window if not min_periods else min_periods))

    method.__name__ = op
    return method


_PLAIN = (
    "sum mean min max count null_count first last median std var any all product skew skew_unbiased kurtosis kurtosis_unbiased n_unique approx_n_unique arg_min arg_max"
    " cum_sum cum_min cum_max cum_prod cum_count peak_max peak_min is_duplicated is_unique is_first_distinct is_last_distinct unique reverse drop_nulls mode arg_sort arg_true arg_unique"
    " is_null is_not_null is_nan is_finite is_infinite fill_nan neg abs sqrt cbrt exp expm1 log log2 log10 log1p sin cos tan cot arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh"
    " radians degrees sign round floor ceil clip pow hash_values"
)
for _op in _PLAIN.split():
    setattr(Expr, _op, _method(_op))
for _op in ("rolling_sum", "rolling_mean", "rolling_min", "rolling_max", "rolling_std", "rolling_var"):
    setattr(Expr, _op, _rolling(_op))
Expr.arctan2 = lambda self, o: call("arctan2", self, o)  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Namespace:
    """``expr.str``, ``expr.list`` and ``expr.struct``: functions ``<space>.<name>``."""

    of: Expr
    space: str

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        from quillon.functions import rowwise

        op = f"{self.space}.{name}"
        if op not in rowwise.FUNCTIONS:
            raise AttributeError(op)
        return lambda *params: Expr(op, (self.of,), params)


def col(name: str) -> Expr:
    return Expr("col", (), (name,))


def lit(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Expr("lit", (), (value,))


def call(op: str, *args: Any) -> Expr:
    return Expr(op, tuple(lit(a) for a in args))


def coalesce(*exprs: Any) -> Expr:
    """First non-null; numbers come out as f64."""
    return call("coalesce", *exprs)


def concat_str(sep: str, *exprs: Any) -> Expr:
    """Joined texts, null if any is null."""
    return Expr("concat_str", tuple(lit(e) for e in exprs), (sep,))


def all_of(*exprs: Expr) -> Expr:
    out = exprs[0] if exprs else lit(True)
    for e in exprs[1:]:
        out = out & e
    return out


def any_of(*exprs: Expr) -> Expr:
    out = exprs[0] if exprs else lit(False)
    for e in exprs[1:]:
        out = out | e
    return out


def int_range(start: int, end: int, step: int = 1) -> Expr:
    return Expr("int_range", (), (start, end, step))


def ones(n: int) -> Expr:
    return Expr("constant", (), (1.0, n))


def zeros(n: int) -> Expr:
    return Expr("constant", (), (0.0, n))


class when:
    """``when(p).then(a).otherwise(b)``; a null condition takes ``b``."""

    def __init__(self, pred: Expr, value: Any = None):
        self.pred, self.value = pred, value

    def then(self, value: Any) -> when:
        return when(self.pred, value)

    def otherwise(self, value: Any) -> Expr:
        return call("when", self.pred, self.value, value)


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for a in e.args:
        yield from walk(a)


def columns(e: Expr) -> list[str]:
    """Referenced columns, each once, in order of appearance."""
    out = dict.fromkeys(x.params[0] for x in walk(e) if x.op == "col")
    out |= dict.fromkeys(k for x in walk(e) if x.op == "over" for k in x.params)
    return list(out)


def output_name(e: Expr) -> str:
    """The alias, else the first column's name, else ``literal``."""
    if e.op == "alias":
        return e.params[0]
    names = [x.params[0] for x in walk(e) if x.op == "col"]
    return names[0] if names else {"int_range": "int_range", "constant": "constant"}.get(e.op, "literal")


def contains(e: Expr, ops: frozenset[str]) -> bool:
    return any(x.op in ops for x in walk(e))


def with_children(e: Expr, args: tuple[Expr, ...]) -> Expr:
    return replace(e, args=args)
