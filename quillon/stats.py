"""Statistics of frames and columns."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import order as ordering
from quillon import selectors
from quillon.functions import aggregates, rowwise
from quillon.runtime import quoted

if TYPE_CHECKING:
    from quillon.frame import Frame

STATISTICS = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(f: Frame) -> Frame:
    """Statistics per column, one row each; columns that aren't numeric have counts only."""
    numeric = selectors.numeric()(f.schema)
    cells: dict[tuple[str, str], Any] = {}
    aggs = []
    for n, c in ((n, F.col(quoted(n))) for n in f.columns):
        cells |= {("count", n): F.count(c), ("null_count", n): F.count_if(c.isNull())}
        if n in numeric:
            cells |= {("mean", n): F.avg(c), ("std", n): F.stddev_samp(c), ("min", n): F.min(c), ("max", n): F.max(c)}
    keys = list(cells)
    aggs = [c.cast("double").alias(f"a{i}") for i, c in enumerate(cells.values())]
    got = dict(zip(keys, f.df.agg(*aggs).first(), strict=True)) if aggs else {}
    for n in numeric:
        found = ordering.quantiles_frame(f.df.select(F.col(quoted(n)).alias("v")), "v", [0.25, 0.5, 0.75]).first()
        got |= dict(zip([("25%", n), ("50%", n), ("75%", n)], found, strict=True))
    rows = []
    for i, s in enumerate(STATISTICS):
        row: list = [i, s]
        for n in f.columns:
            v = got.get((s, n))
            row.append(v if n in numeric else (None if v is None else str(int(v))))
        rows.append(tuple(row))
    schema = T.StructType([T.StructField("__at", T.LongType()), T.StructField("statistic", T.StringType()), *[T.StructField(n, T.DoubleType() if n in numeric else T.StringType()) for n in f.columns]])
    return type(f)(f.df.sparkSession.createDataFrame(rows, schema), (("__at", False, False),))


def value_counts(f: Frame, name: str, sort: bool = True) -> Frame:
    """Distinct non-null values and how often each occurs."""
    c = F.col(quoted(name))
    counts = type(f)(f.df.filter(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("counts")))
    return counts.sort_by(["counts", name], [True, False]) if sort else counts


def mode(f: Frame, name: str) -> Frame:
    """The most frequent non-null values, all of them."""
    c = value_counts(f, name, False).df
    return type(f)(c.filter(F.col("counts") == c.agg(F.max("counts")).scalar()).select(quoted(name))).sort(name)


def _pair(a: str, b: str):
    x, y = F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def _matrix(f: Frame, cell) -> Frame:
    names = selectors.numeric()(f.schema)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = dict(zip(pairs, f.df.agg(*[cell(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first(), strict=True))
    rows = [(i, n, *[got[min(i, j), max(i, j)] for j in range(len(names))]) for i, n in enumerate(names)]
    schema = "__at long, column string, " + ", ".join(f"{quoted(n)} double" for n in names)
    return type(f)(f.df.sparkSession.createDataFrame(rows, schema), (("__at", False, False),))


def _corr(a: str, b: str):
    """Pearson correlation; NaN where a column is constant, null without pairs."""
    x, y = _pair(a, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.when(spread != 0, spread))


def corr(f: Frame) -> Frame:
    """Pearson correlation of all numeric columns, over pairs without null."""
    return _matrix(f, _corr)


def cov(f: Frame, ddof: int = 1) -> Frame:
    return _matrix(f, lambda a, b: (F.covar_samp if ddof == 1 else F.covar_pop)(*_pair(a, b)))


def pearson_corr(f: Frame, a: str, b: str) -> float:
    return f.df.agg(_corr(a, b)).first()[0]


def covariance(f: Frame, a: str, b: str, ddof: int = 1) -> float:
    """Covariance with any ddof, over pairs without null."""
    x, y = _pair(a, b)
    pop, n = f.df.agg(F.covar_pop(x, y), F.count(x)).first()
    return float("nan") if n - ddof <= 0 or pop is None else pop * n / (n - ddof)


def series_agg(f: Frame, name: str, op: str) -> float:
    """Column scalar as f64: NaN when there is no value; min and max ignore NaN."""
    c = F.col(quoted(name))
    kind = f.schema[name].dataType
    if op in ("min", "max") and rowwise.is_float(kind):
        c = F.when(~F.isnan(c), c)
    if op in ("median", "quantile"):
        got = ordering.quantile_frame(f.df.select(c.alias("v")), "v", 0.5).first()[0]
    else:
        got = f.df.agg(F.when(F.count(c) > 0, aggregates.aggregate(op, c, kind))).first()[0]
    return float("nan") if got is None else float(got)


def search_sorted(f: Frame, name: str, value: Any) -> int:
    """Left insertion position in a sorted column."""
    return f.df.agg(F.count_if(F.col(quoted(name)) < value)).first()[0]


def index_of(f: Frame, name: str, value: Any) -> int:
    """First position of a value, -1 if it doesn't occur."""
    i = f.with_row_index("__at").df
    return i.agg(F.coalesce(F.min(F.when(F.col(quoted(name)) == value, F.col("__at"))), F.lit(-1))).first()[0]


def is_sorted(f: Frame, name: str, descending: bool = False) -> bool:
    """Whether the non-null values of a column lie in order."""
    from quillon.plans.resolver import Resolver

    r = Resolver(f.drop_nulls(name))
    r.indexed()
    c = F.col(quoted(name))
    ok = ordering.neighbours(r.df, 1, 0, {"__ok": lambda w: (F.lag(c).over(w) >= c) if descending else (F.lag(c).over(w) <= c)})
    return ok.agg(F.coalesce(F.bool_and("__ok"), F.lit(True))).first()[0]


def has_nulls(f: Frame, name: str) -> bool:
    return bool(f.df.agg(F.coalesce(F.max(F.col(quoted(name)).isNull()), F.lit(False))).first()[0])


def first_non_null(f: Frame, name: str) -> Any:
    rows = f.drop_nulls(name).head(1).select(name).collect()
    return rows[0][0] if rows else None


METHODS = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
