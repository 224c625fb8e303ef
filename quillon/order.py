"""Row order on unordered frames, without windows over all rows in one task.

``dense_index`` numbers rows in order by a range-partitioned sort.  Functions
over neighbouring rows then run in blocks of consecutive rows: those that look
at a bounded number of neighbours get them as a halo from the next blocks;
cumulative ones add a carry made from the blocks' own totals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import durable

INDEX = "__i"
#: Rows in a block.  The carries of all blocks are one row each.
BLOCK_ROWS = 1 << 16


def dense_index(df: DataFrame, order: list[Column], name: str = INDEX) -> DataFrame:
    """Add the position of each row in ``order``, from 0.

    The sorted rows are written once (positions must not change when a lost
    partition is computed again); the driver receives one count a partition.
    """
    rows = durable(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__m", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __start long"))  # a row a partition
    at = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")
    return rows.withColumn("__p", part).join(table, "__p").withColumn(name, at).drop("__m", "__p", "__start")


def neighbours(df: DataFrame, back: int, ahead: int, outs: dict[str, Callable[[object], Column]], block_rows: int | None = None) -> DataFrame:
    """Add columns ``name: build(window)`` whose windows reach at most ``back``
    rows back and ``ahead`` rows ahead; ``df`` has a dense index.  One shuffle
    serves all of them."""
    size = max(block_rows or BLOCK_ROWS, 2 * (back + ahead))
    block, at = F.floor(F.col(INDEX) / size), F.col(INDEX) % size
    places = [F.struct(block.alias("b"), F.lit(False).alias("halo"))]
    if back:
        places.append(F.when(at >= size - back, F.struct((block + 1).alias("b"), F.lit(True).alias("halo"))))
    if ahead:
        places.append(F.when(at < ahead, F.struct((block - 1).alias("b"), F.lit(True).alias("halo"))))
    spread = df.withColumn("__at", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())))
    w = Window.partitionBy("__at.b").orderBy(INDEX)
    return spread.withColumns({name: build(w) for name, build in outs.items()}).filter(~F.col("__at.halo")).drop("__at")


@dataclass(frozen=True)
class Running:
    """A cumulative function: ``total`` aggregates a block, ``carry(total,
    window)`` runs over the blocks before one, ``local(window)`` over the rows
    of a block up to the current, ``join(carry, local)`` is the value."""

    total: Column
    carry: Callable[[Column, object], Column]
    local: Callable[[object], Column]
    join: Callable[[Column, Column], Column]


def carried(df: DataFrame, outs: dict[str, Running], backward: bool = False, block_rows: int | None = None) -> DataFrame:
    """Add cumulative columns; one aggregation of blocks and one shuffle serve all of them."""
    rows = df.withColumn("__b", F.floor(F.col(INDEX) / (block_rows or BLOCK_ROWS)))
    step = F.desc if backward else F.asc
    blocks = rows.groupBy("__b").agg(*[r.total.alias(f"__total_{n}") for n, r in outs.items()])
    past = Window.orderBy(step("__b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = blocks.select("__b", *[r.carry(F.col(f"__total_{n}"), past).alias(f"__carry_{n}") for n, r in outs.items()])
    w = Window.partitionBy("__b").orderBy(step(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, "__b").withColumns({n: r.join(F.col(f"__carry_{n}"), r.local(w)) for n, r in outs.items()})
    return out.drop("__b", *[f"__carry_{n}" for n in outs])


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """``(value, n, before, dense)`` of the distinct non-null values: how often,
    how many rows are smaller, and how many values are."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    indexed = dense_index(counts, [F.asc(value)])
    upto = Running(F.sum("n"), lambda t, w: F.coalesce(F.sum(t).over(w), F.lit(0)), lambda w: F.sum("n").over(w), lambda a, b: a + b)
    run = carried(indexed, {"__upto": upto})
    return run.select(value, "n", (F.col("__upto") - F.col("n")).alias("before"), F.col(INDEX).alias("dense"))


def quantile_frame(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row ``q``: exact quantile of a column with linear interpolation, null if it has no value."""
    return quantiles_frame(df, value, [q]).withColumnRenamed("q0", "q")


def quantiles_frame(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row ``q0, q1, ...``: several quantiles from one ordering of the values."""
    v = durable(value_positions(df, value))
    last = v.agg(F.sum("n")).scalar() - 1
    holds = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("n")), F.col(value).cast("double")))
    cells = []
    for i, q in enumerate(qs):
        at = last.cast("double") * q
        cells += [holds(F.floor(at)).alias(f"lo{i}"), holds(F.ceil(at)).alias(f"hi{i}"), F.max(at - F.floor(at)).alias(f"part{i}")]
    return v.agg(*cells).select(*[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(qs))])


def quantiles_by(df: DataFrame, key: str, value: str, qs: list[float]) -> DataFrame:
    """``(key, q0, q1, ...)``: exact quantiles of every key that has a value.

    Keys and values are put in one order that is cut into blocks anywhere, so a
    key of any size is spread over tasks and no buffer holds its values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    indexed = dense_index(counts, [F.asc(key), F.asc(value)])
    upto = Running(F.sum("n"), lambda t, w: F.coalesce(F.sum(t).over(w), F.lit(0)), lambda w: F.sum("n").over(w), lambda a, b: a + b)
    run = carried(indexed, {"__upto": upto}).select(key, value, "n", (F.col("__upto") - F.col("n")).alias("before"))
    run = durable(run)
    per = run.groupBy(key).agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    at = [(F.col("total") - 1).cast("double") * q for q in qs]
    own = F.col("before") - F.col("start")
    holds = lambda pos: F.max(F.when((own <= pos) & (pos < own + F.col("n")), F.col(value).cast("double")))
    cells = []
    for i, a in enumerate(at):
        cells += [holds(F.floor(a)).alias(f"lo{i}"), holds(F.ceil(a)).alias(f"hi{i}"), F.max(a - F.floor(a)).alias(f"part{i}")]
    ends = run.join(per, key).groupBy(key).agg(*cells)
    return ends.select(key, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(qs))])
