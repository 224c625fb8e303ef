"""Irregular readings onto a regular grid.

Method: shape-preserving monotone cubic interpolation per source segment.
Readings are first summed to one knot per occupied slot (mean time, mean
value), which combines before the shuffle.  Time shards of a source are then
fitted on their own; each receives as a halo the last knot of the nearest
shard before it that has any, and the first two knots after it, so slopes at
its edges are those of the whole segment.  Gaps longer than a limit end a
segment and stay marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import PIECE_ROWS, with_pieces

#: Days of a source in one time shard.
SHARD_DAYS = 21


def slot_knots(df: DataFrame, source: Column, ts: Column, value: Column, ident: str, slot_seconds: int, shard_days: int = SHARD_DAYS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row ``(source, shard, slot, n, sum_t, sum_v)`` per occupied slot.

    ``slot`` counts slots since 1970, ``shard`` spans of ``shard_days``; times
    are seconds within the slot.  Repeats of a record (source, slot, ``ident``)
    count once, with the smallest of values that disagree.  Rows lacking any
    part are left out.  A source with more than ``piece_rows`` rows is spread
    over pieces by ``ident``, whose sums are then added: at most one row a slot
    and piece.
    """
    if 86400 % slot_seconds:
        raise ValueError("slots must divide a day evenly")
    per_day = 86400 // slot_seconds
    # built from calendar parts: independent of the session's time zone
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("double") + F.date_part(F.lit("SECOND"), ts).cast("double")
    slot = F.unix_date(ts.cast("date")).cast("long") * per_day + F.floor(second / slot_seconds)
    rows = df.select(source.alias("source"), slot.alias("slot"), (second % slot_seconds).alias("t"), value.cast("double").alias("v"), F.col(ident).alias("__id"))
    rows = rows.filter(F.col("source").isNotNull() & F.col("slot").isNotNull() & F.col("v").isNotNull() & F.col("__id").isNotNull())
    rows = with_pieces(rows, ["source"], "__id", piece_rows).withColumn("shard", F.floor(F.col("slot") / (per_day * shard_days)))
    # said here so that both uses of the knots have one plan and share their shuffles
    rows = rows.filter(F.col("shard").isNotNull())
    records = rows.repartition("source", "shard", "__piece").groupBy("source", "shard", "__piece", "slot", "__id").agg(F.min("t").alias("t"), F.min("v").alias("v"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"), F.sum("v").alias("sum_v")]
    parts = records.groupBy("source", "shard", "__piece", "slot").agg(*sums)
    return parts.repartition("source", "shard").groupBy("source", "shard", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "sum_t", "sum_v")])


def _edge_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """One-sided three-point slope, limited so that the shape is kept."""
    d = ((F.lit(2.0) * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    d = F.when(F.signum(d) != F.signum(s0), F.lit(0.0)).when((F.signum(s0) != F.signum(s1)) & (F.abs(d) > F.abs(F.lit(3.0) * s0)), F.lit(3.0) * s0).otherwise(d)
    return F.when(s1.isNull(), s0).otherwise(d)


def _inner_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """Weighted harmonic mean of the slopes on both sides, 0 at a turning point."""
    w0, w1 = F.lit(2.0) * h1 + h0, h1 + F.lit(2.0) * h0
    turn = (F.signum(s0) * F.signum(s1)) <= 0
    return F.when(turn, F.lit(0.0)).otherwise((w0 + w1) / (w0 / F.when(~turn, s0) + w1 / F.when(~turn, s1)))


def fit_segments(knots: DataFrame, slot_seconds: int, max_gap_slots: int) -> DataFrame:
    """The curve from each knot to the next one of its source.

    ``(source, shard, slot, n, x, y, next_slot, next_x, next_y, m, next_m)``
    from ``slot_knots``: knot, next knot (null for the last) and the slopes at
    both, which are null where more than ``max_gap_slots`` empty slots lie
    between.  A shard is one row with its knots as an array (at most the slots
    of a shard), so no knot is sorted with those of other shards.
    """
    x = F.expr(f"cast(slot as double) * {slot_seconds} + sum_t / n")
    knot = F.struct("slot", "n", x.alias("x"), (F.col("sum_v") / F.col("n")).alias("y"))
    shards = knots.groupBy("source", "shard").agg(F.array_sort(F.collect_list(knot)).alias("own"))
    by = Window.partitionBy("source").orderBy("shard")  # a row a shard
    edges = shards.select("source", "shard", F.get("own", F.lit(0)).alias("head"), F.get("own", F.lit(1)).alias("second"), F.element_at("own", -1).alias("tail"))
    halo = edges.select("source", "shard", F.lag("tail").over(by).alias("a"), F.lead("head").over(by).alias("c"), F.coalesce(F.lead("second").over(by), F.lead("head", 2).over(by)).alias("d"))
    full = F.concat(F.array("a"), F.col("own"), F.array("c", "d"))
    rows = shards.join(halo, ["source", "shard"]).select("source", "shard", full.alias("k"), F.size("own").alias("len"))
    four = F.arrays_zip(*[F.slice("k", i, F.col("len")).alias(name) for i, name in enumerate("abcd", 1)])
    k = rows.select("source", "shard", F.explode(four).alias("k")).select("source", "shard", "k.*")

    def part(p: str, q: str) -> tuple[Column, Column]:
        """Width and slope between two neighbouring knots, null across a long gap."""
        near = (F.col(f"{q}.slot") - F.col(f"{p}.slot") - 1) <= max_gap_slots
        h = F.when(near, F.col(f"{q}.x") - F.col(f"{p}.x"))
        return h, (F.col(f"{q}.y") - F.col(f"{p}.y")) / h

    parts = {n: part(*n) for n in ("ab", "bc", "cd")}
    k = k.select("source", "shard", "b", "c", *[v.alias(f"{s}_{n}") for n, hs in parts.items() for s, v in zip("hs", hs, strict=True)])
    h, s = ({n: F.col(f"{t}_{n}") for n in parts} for t in "hs")
    # a knot with a neighbour on one side only has a one-sided slope
    m = F.when(h["ab"].isNotNull(), _inner_slope(h["ab"], h["bc"], s["ab"], s["bc"])).otherwise(_edge_slope(h["bc"], h["cd"], s["bc"], s["cd"]))
    next_m = F.when(h["cd"].isNotNull(), _inner_slope(h["bc"], h["cd"], s["bc"], s["cd"])).otherwise(_edge_slope(h["bc"], h["ab"], s["bc"], s["ab"]))
    near = h["bc"].isNotNull()
    return k.select(
        "source", "shard", "b.slot", "b.n", "b.x", "b.y", F.col("c.slot").alias("next_slot"), F.col("c.x").alias("next_x"), F.col("c.y").alias("next_y"),
        F.when(near, m).alias("m"), F.when(near, next_m).alias("next_m"),
    )


def on_grid(segments: DataFrame, slot_seconds: int) -> DataFrame:
    """Slots ``(source, slot, n, value, state)`` of segments, each from its knot up to before the next one.

    ``slot`` is the start as a timestamp without zone; ``value`` of an empty
    slot is the curve at its middle.
    """
    last = F.coalesce(F.col("next_slot") - 1, F.col("slot"))
    g = segments.select("*", F.explode(F.sequence("slot", last)).alias("at"))
    mid = F.col("at").cast("double") * slot_seconds + slot_seconds / 2
    y0, y1, m0, m1 = (F.col(c) for c in ("y", "next_y", "m", "next_m"))
    h = F.col("next_x") - F.col("x")
    u = (mid - F.col("x")) / h
    cubic = (F.lit(1.0) + 2 * u) * (1 - u) * (1 - u) * y0 + u * (1 - u) * (1 - u) * h * m0 + u * u * (F.lit(3.0) - 2 * u) * y1 + u * u * (u - 1) * h * m1
    # rounding must not carry a value out of the range of its two knots
    bounded = F.when(m0.isNotNull(), F.greatest(F.least(cubic, F.greatest(y0, y1)), F.least(y0, y1)))
    observed = F.col("at") == F.col("slot")
    per_day = 86400 // slot_seconds
    start = F.expr(f"cast(date_from_unix_date(cast(floor(at / {per_day}) as int)) as timestamp_ntz) + make_dt_interval(0, 0, 0, pmod(at, {per_day}) * {slot_seconds})")
    return g.select(
        "source", start.alias("slot"),
        F.when(observed, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"),
        F.when(observed, y0).otherwise(bounded).alias("value"),
        F.when(observed, F.lit("observed")).when(m0.isNull(), F.lit("gap")).otherwise(F.lit("filled")).alias("state"),
    )


def regular_series(knots: DataFrame, slot_seconds: int, max_gap_slots: int) -> DataFrame:
    """Regular series ``(source, slot, n, value, state)`` from ``slot_knots``.

    For each source all slots from its first to its last occupied one, over
    the ends of days and shards.  ``state``: ``observed`` (value is the mean of
    its readings), ``filled`` (interpolated at the middle of the slot) or
    ``gap`` (in a gap of more than ``max_gap_slots`` empty slots; value null).
    Interpolated values never leave the range of the two knots around them.
    An empty input gives no rows.
    """
    return on_grid(fit_segments(knots, slot_seconds, max_gap_slots), slot_seconds)
