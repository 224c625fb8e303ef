"""Aggregates with the engine's null rules, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.rowwise import is_float, is_int

NAN = float("nan")


def aggregate(op: str, c: Column, kind: T.DataType, params: tuple = (), order: Column | None = None) -> Column:
    """Aggregate ``op`` of column ``c``.

    The sum of nothing is 0, std and var of fewer than two values are NaN, any
    of nothing is false, all true and product 1; other aggregates of nothing
    are null.  ``order`` (a sortable column) tells first and last.
    """
    number = F.count(c)
    if op == "sum":
        zero = F.lit(0.0) if is_float(kind) else F.lit(0).cast("long")
        return F.coalesce(F.sum(c), zero)
    if op in ("first", "last"):
        f = F.min_by if op == "first" else F.max_by
        return f(F.struct(c.alias("v")), order)["v"]
    if op in ("std", "var"):
        d = F.stddev_samp(c) if op == "std" else F.var_samp(c)
        return F.when(number < 2, F.lit(NAN)).otherwise(d)
    truth = c if isinstance(kind, T.BooleanType) else c != 0
    skew, kurt, n = F.skewness(c), F.kurtosis(c), number.cast("double")
    # null and NaN are no extremes; among equals the first row counts
    real = c.isNotNull() & ~F.isnan(c) if is_float(kind) else c.isNotNull()
    at = lambda i: F.when(real, F.struct(c.alias("v"), i.alias("i")))
    simple = {
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: number,
        "null_count": lambda: F.count_if(c.isNull()),
        "median": lambda: F.percentile(c, F.lit(0.5)),
        "quantile": lambda: F.percentile(c, F.lit(float(params[0]))),
        "any": lambda: F.coalesce(F.bool_or(truth), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(truth), F.lit(True)),
        "product": lambda: F.coalesce(F.product(c), F.lit(1.0)),
        "skew": lambda: skew,
        "skew_unbiased": lambda: F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
        "kurtosis": lambda: kurt,
        "kurtosis_unbiased": lambda: F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))),
        "n_unique": lambda: F.count_distinct(c),
        "approx_n_unique": lambda: F.approx_count_distinct(c, 0.008),
        "arg_min": lambda: F.coalesce(F.min(at(order))["i"], F.lit(-1)),
        "arg_max": lambda: F.coalesce(-F.max(at(-order))["i"], F.lit(-1)),
    }
    return simple[op]()


def result_is_int(op: str, kind: T.DataType) -> bool:
    return op in ("count", "null_count", "n_unique", "approx_n_unique") or (op in ("sum", "min", "max") and is_int(kind))
