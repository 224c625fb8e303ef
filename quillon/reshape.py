"""Reshaping of frames: pivots, lists, structs, time grids, row-wise aggregates."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import order as ordering
from quillon import selectors
from quillon.functions import rowwise
from quillon.runtime import quoted

if TYPE_CHECKING:
    from quillon.frame import Frame

#: Most distinct values that become columns.
MAX_PIVOT_COLUMNS = 10_000


def pivot(f: Frame, index: list[str], columns: str, values: str, agg: str = "first") -> Frame:
    """Long to wide: a column per value of ``columns`` in alphabetical order, f64 cells.

    ``agg``: first (in row order), sum, mean, min, max, count.  Combinations
    that don't occur are null, for count too.  Rows come in index order.
    """
    from quillon.plans.resolver import Resolver

    names = sorted(r[0] for r in f.df.select(F.col(quoted(columns)).cast("string")).filter(F.col(quoted(columns)).isNotNull()).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect())
    if len(names) > MAX_PIVOT_COLUMNS:
        raise ValueError("too many distinct values for columns")
    r = Resolver(f)
    v = F.col(quoted(values)).cast("double")
    if agg == "first":
        # null cells are cells: the first row counts even if its value is null
        cell = F.min_by(F.struct(v.alias("v")), r.order_key())["v"]
    else:
        cell = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.nullif(F.count(v), F.lit(0)).cast("double")}[agg]
    df = r.df.withColumn("__on", F.col(quoted(columns)).cast("string"))
    out = df.groupBy(*[F.col(quoted(i)) for i in index]).pivot("__on", names).agg(cell)
    return type(f)(out).sort_by(index)


def unpivot(f: Frame, ids: list[str], values: list[str] | None = None) -> Frame:
    """Wide to long: ids, ``variable``, ``value``; numbers become f64; all rows of the
    first column come first."""
    from quillon.plans.resolver import Resolver

    values = values or [c for c in f.columns if c not in ids]
    r = Resolver(f)
    order = r.ordered()
    number = lambda c: isinstance(f.schema[c].dataType, T.NumericType)
    as_float = lambda c: F.col(quoted(c)).cast("double") if number(c) else F.col(quoted(c))
    kind = "double" if all(number(c) for c in values) else "string"
    cells = [F.struct(F.lit(i).alias("at"), F.lit(c).alias("variable"), F.col(quoted(c)).cast(kind).alias("value")) for i, c in enumerate(values)]
    df = r.df.select(*[as_float(c).alias(c) for c in ids], *[n for n, _, _ in order], F.explode(F.array(*cells)).alias("__c"))
    out = df.select(*[F.col(quoted(c)) for c in ids], "__c.variable", "__c.value", F.col("__c.at").alias("__at"), *[n for n, _, _ in order])
    return type(f)(out, (("__at", False, False), *order))


def transpose(f: Frame, header: str = "column", prefix: str = "column_", max_rows: int = MAX_PIVOT_COLUMNS) -> Frame:
    """Numeric and boolean columns as rows: the header column, then one f64 column per row."""
    names = [x.name for x in f.schema.fields if isinstance(x.dataType, (T.NumericType, T.BooleanType))]
    if len(names) != len(f.columns):
        raise ValueError("only numeric and boolean columns can be transposed")
    i = f.with_row_index("__n").df
    height = f.df.count()
    if height > max_rows:
        raise ValueError("too many rows to become columns")
    cells = [F.struct(F.lit(k).alias("at"), F.lit(c).alias("name"), F.col(quoted(c)).cast("double").alias("v")) for k, c in enumerate(names)]
    long = i.select("__n", F.explode(F.array(*cells)).alias("c")).select("__n", "c.*")
    wide = long.groupBy("at", "name").pivot("__n", list(range(height))).agg(F.first("v"))
    out = wide.select(F.col("at").alias("__at"), F.col("name").alias(header), *[F.col(str(k)).alias(f"{prefix}{k}") for k in range(height)])
    return type(f)(out, (("__at", False, False),))


def explode(f: Frame, name: str) -> Frame:
    """List elements as rows; a null or empty list gives one row with null."""
    from quillon.plans.resolver import Resolver

    if not isinstance(f.schema[name].dataType, T.ArrayType):
        raise ValueError(f"{name} is no list")
    r = Resolver(f)
    order = r.ordered()
    keep = [c for c in r.df.columns if c != name]
    spread = r.df.select(*[F.col(quoted(c)) for c in keep], F.posexplode_outer(F.col(quoted(name))).alias("__pos", name))
    out = spread.select(*[F.col(quoted(c)) for c in f.columns], *[n for n, _, _ in order], F.coalesce("__pos", F.lit(0)).alias("__p"))
    return type(f)(out, (*order, ("__p", False, False)))


def unnest(f: Frame, name: str) -> Frame:
    """Fields of a struct as columns in its place; a null struct gives nulls."""
    fields = f.schema[name].dataType.names
    if set(fields) & (set(f.columns) - {name}):
        raise ValueError("a field has the name of a column")
    cols = [c for n in f.df.columns for c in ([F.col(quoted(name)).getField(x).alias(x) for x in fields] if n == name else [F.col(quoted(n))])]
    return f._with(f.df.select(*cols))


#: Units of upsample steps in microseconds.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def upsample(f: Frame, name: str, every: str) -> Frame:
    """Regular time grid from the first to the last value; other columns null where no row lies.

    The grid is made from rows in neighbouring pairs, so no task makes all of
    it.  Null times aren't on the grid.
    """
    got = re.fullmatch(r"(\d+)(ns|us|ms|s|m|h|d|w)", every)
    if not got or got[2] == "ns" and int(got[1]) % 1000 or int(got[1]) == 0:
        raise ValueError(f"no step: {every}")
    step = int(got[1]) // 1000 if got[2] == "ns" else int(got[1]) * UNITS[got[2]]
    kind = f.schema[name].dataType.simpleString()
    c = F.col(quoted(name))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    first = f.df.agg(F.min(micros(c))).scalar()
    t = f.df.select(micros(c).alias("t")).filter("t is not null").distinct()
    # steps after a time up to the next one that is a whole number of steps from the first
    i = ordering.dense_index(t, [F.asc("t")])
    slot = F.floor((F.col("t") - first) / step)
    n = ordering.neighbours(i.withColumn("s", slot), 0, 1, {"next": lambda w: F.lead("s").over(w)})
    low = F.when(F.col("s") * step == F.col("t") - first, F.col("s")).otherwise(F.col("s") + 1)
    grid = n.select(F.explode(F.sequence(low, F.greatest(F.coalesce(F.col("next"), F.col("s")), low))).alias("k")).select("k").distinct()
    top = f.df.agg(F.floor((F.max(micros(c)) - first) / step)).scalar()
    grid = grid.filter(F.col("k") <= top).select((F.col("k") * step + first).alias("__t"))
    right = f.df.withColumn("__u", micros(c)).drop(name)
    out = grid.join(right, F.col("__t") == F.col("__u"), "left").withColumn(name, F.timestamp_micros("__t").cast(kind))
    return type(f)(out.select(*[F.col(quoted(x)) for x in f.columns], "__t"), (("__t", False, False),))


def horizontal(f: Frame, kind: str, out: str, cols: list[str], propagate: bool = False) -> Frame:
    """Append a row-wise aggregate of the named, else of all fitting, columns."""
    fits = T.BooleanType if kind in ("all", "any") else T.NumericType
    names = cols or [x.name for x in f.schema.fields if isinstance(x.dataType, fits)]
    floats = any(rowwise.is_float(f.schema[c].dataType) for c in names)
    return f._with(f.df.withColumn(out, rowwise.horizontal(kind, [F.col(quoted(c)) for c in names], floats, propagate)))


def extend_constant(f: Frame, value: object, n: int) -> Frame:
    """Append ``n`` copies of a constant to a single column."""
    (name,) = f.columns
    more = f.df.sparkSession.range(n).select(F.lit(value).cast(f.schema[name].dataType).alias(name))
    return f.vstack(type(f)(more))


METHODS = {k: v for k, v in globals().items() if k in ("pivot", "unpivot", "transpose", "explode", "unnest", "upsample", "extend_constant")}
__all__ = ["METHODS", "horizontal", "selectors"]
