"""Percentiles per group of large numeric columns.

Method: radix selection.  Floating values become order-preserving 64-bit
integers; a histogram of their leading digit finds, for every target rank, the
digit that contains it, and only the rows with that digit are followed to the
next one.  After the last digit the value is known exactly.

Rows lie by (group, piece): groups larger than a piece are spread, so no task
gets more than about one piece, whatever the size of a group.  Each task sums
its rows to digits before anything is sent on.

The histograms of a leading digit of 24 bits are summaries: those of separate
days or files add up to the summary of all, and give percentiles whose rank is
exact to the digit and whose value is within 2**-12 of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import PIECE_ROWS, durable, key_pieces

#: Bits of the digits: sign, exponent and 8 bits of the fraction; then the rest.
DIGITS = (20, 22, 22)
#: Bits of a summary's digit: sign, exponent and 12 bits of the fraction.
SUMMARY_BITS = 24


def _power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), n.cast("double"))


def _scaled(x: Column, n: Column) -> Column:
    """``x * 2**n`` in two steps, neither of which leaves the range of doubles."""
    half = F.shiftright(n, 1)
    return x * _power_of_two(half) * _power_of_two(n - half)


def with_ordered_bits(df: DataFrame, value: str, name: str = "bits") -> DataFrame:
    """Add the order-preserving integer of a double (not null, not NaN): its
    IEEE bits, those of negative values inverted.  -0.0 and 0.0 are one value."""
    size = F.abs(value)
    d = df.withColumn("__e", F.greatest(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))), F.lit(-1022)).cast("int"))
    # the logarithm may miss the exponent by one next to a power of two
    low, high = size < _scaled(F.lit(1.0), F.col("__e")), size >= 2 * _scaled(F.lit(1.0), F.col("__e"))
    d = d.withColumn("__e", F.greatest(F.col("__e") - low.cast("int") + F.coalesce((high & (F.col("__e") < 1023)).cast("int"), F.lit(0)), F.lit(-1022)))
    fraction = _scaled(size, 52 - F.col("__e")).cast("long")
    # the leading bit of a normal fraction adds one to the exponent field
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(F.shiftleft((F.col("__e") + 1022).cast("long"), 52) + fraction)
    return d.withColumn(name, F.when(F.col(value) < 0, F.bitwise_not(bits)).otherwise(bits)).drop("__e")


def from_ordered_bits(bits: Column) -> Column:
    """The double of an order-preserving integer."""
    size = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits)
    exponent, fraction = F.shiftright(size, 52).cast("int"), size.bitwiseAND(F.lit((1 << 52) - 1))
    normal = _scaled((fraction + F.lit(1 << 52)).cast("double"), exponent - 1075)
    value = F.when(exponent == 0, _scaled(fraction.cast("double"), F.lit(-1074))).when(exponent == 2047, F.lit(float("inf"))).otherwise(normal)
    return F.when(bits < 0, -value).otherwise(value)


def records(df: DataFrame, group: Column, value: Column, ident: Column | None, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(grp, __piece, bits, n)``, repeats of a record once, lying by (grp, __piece); and the pieces of large groups.

    Rows without group or value, NaN and rows without ``ident`` (if given) are
    left out.  A record is known by group and ``ident``; should repeats
    disagree, the smallest value counts.  Without ``ident`` every row counts.
    """
    rows = df.select(group.alias("grp"), value.cast("double").alias("v"), (F.lit(None) if ident is None else ident).alias("__id"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    pieces = key_pieces(rows if ident is None else rows.filter(F.col("__id").isNotNull()), ["grp"], piece_rows)
    if ident is None:
        # equal values meet before the shuffle, so a value of many rows is no burden
        counts = with_ordered_bits(rows, "v").groupBy("grp", "bits").agg(F.count(F.lit(1)).alias("n"))
        return _spread(counts, pieces, "bits").repartition("grp", "__piece"), pieces
    rows = _spread(rows.filter(F.col("__id").isNotNull()), pieces, "__id")
    once = rows.repartition("grp", "__piece").groupBy("grp", "__piece", "__id").agg(F.min("v").alias("v"))
    return with_ordered_bits(once, "v").select("grp", "__piece", "bits", F.lit(1).cast("long").alias("n")), pieces


def _spread(rows: DataFrame, pieces: DataFrame, by: str) -> DataFrame:
    cut = rows.join(F.broadcast(pieces), "grp", "left")
    return cut.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("__pieces")).cast("int"), F.lit(0))).drop("__pieces")


def _digit(level: int) -> Column:
    """Digit of a level; the first is signed, which keeps the order."""
    below = sum(DIGITS[level + 1 :])
    if level == 0:
        return F.shiftright("bits", below)
    return F.shiftright("bits", below).bitwiseAND(F.lit((1 << DIGITS[level]) - 1))


def histogram(rows: DataFrame, digit_bits: int = SUMMARY_BITS) -> DataFrame:
    """``(grp, digit, n)`` of what ``records`` gives; with the default digits a mergeable summary."""
    local = rows.groupBy("grp", "__piece", F.shiftright("bits", 64 - digit_bits).alias("digit")).agg(F.sum("n").alias("n"))
    return local.repartition("grp").groupBy("grp", "digit").agg(F.sum("n").alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """Summary of all rows from those of disjoint parts."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("grp", "digit").agg(F.sum("n").alias("n"))


def _targets(hist: DataFrame, quantiles: list[float], min_count: int) -> DataFrame:
    """``(grp, total, q, side, digit, rank)``: for both ranks next to each quantile
    the leading digit that holds it and its rank within that digit, from 0."""
    by = Window.partitionBy("grp").orderBy("digit")
    cum = hist.select("grp", "digit", "n", (F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    cum = cum.filter(F.col("total") >= min_count)
    last = (F.col("total") - 1).cast("double")
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), f(last * q).cast("long").alias("at")) for q in quantiles for side, f in ((0, F.floor), (1, F.ceil))])
    hit = F.filter(ranks, lambda r: (r["at"] >= F.col("before")) & (r["at"] < F.col("before") + F.col("n")))
    return cum.filter(F.size(hit) > 0).select("grp", "total", "digit", "before", F.explode(hit).alias("r")).select("grp", "total", F.col("r.q").alias("q"), F.col("r.side").alias("side"), "digit", (F.col("r.at") - F.col("before")).alias("rank"))


def _interpolated(found: DataFrame) -> DataFrame:
    """``(grp, n, q, value)`` from ``(grp, total, q, side, value)``."""
    both = found.groupBy("grp", "total", "q").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("hi"))
    at = (F.col("total") - 1).cast("double") * F.col("q")
    part = at - F.floor(at)
    value = F.when((part == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * part)
    return both.select("grp", F.col("total").alias("n"), "q", value.alias("value"))


def from_summary(summary: DataFrame, quantiles: list[float], min_count: int = 1) -> DataFrame:
    """Percentiles ``(grp, n, q, value)`` of a summary, values within 2**-12 of the exact ones."""
    below = 64 - SUMMARY_BITS
    middle = F.shiftleft("digit", below) + F.lit(1 << (below - 1))
    return _interpolated(_targets(summary, quantiles, min_count).withColumn("value", from_ordered_bits(middle)))


def _followed(rows: DataFrame, pieces: DataFrame, quantiles: list[float], min_count: int) -> DataFrame:
    """Values ``(grp, digit, bits, n, want)`` whose leading digit holds a target
    rank, with the targets of their group (two a quantile)."""
    targets = _targets(histogram(rows, DIGITS[0]), quantiles, min_count)
    wanted = targets.groupBy("grp").agg(F.collect_list(F.struct("total", "q", "side", "digit", "rank")).alias("want"))
    # targets go to where the rows lie, not the rows to the targets
    spread = wanted.join(F.broadcast(pieces), "grp", "left").select("grp", "want", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces") - 1, F.lit(0)))).alias("__piece"))
    hit = rows.join(spread.hint("shuffle_hash"), ["grp", "__piece"]).withColumn("digit", _digit(0)).filter(F.exists("want", lambda t: t["digit"] == F.col("digit")))
    return hit.groupBy("grp", "digit", "bits").agg(F.sum("n").alias("n"), F.any_value("want").alias("want"))


def _select(deeper: DataFrame) -> DataFrame:
    """Exact percentiles from what ``_followed`` gives, digit by digit."""
    targets = deeper.select("grp", F.explode("want").alias("t")).select("grp", "t.*").distinct()
    deeper = deeper.drop("want")
    for level in range(1, len(DIGITS)):
        # histogram of this digit within the digits followed so far
        hist = deeper.groupBy("grp", "digit", _digit(level).alias("next")).agg(F.sum("n").alias("n"))
        by = Window.partitionBy("grp", "digit").orderBy("next")
        cum = hist.withColumn("before", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        hit = targets.join(cum, ["grp", "digit"]).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        width = DIGITS[level]
        longer = lambda d, x, w=width: F.shiftleft(d, w).bitwiseOR(x)
        targets = hit.select("grp", "total", "q", "side", longer("digit", F.col("next")).alias("digit"), (F.col("rank") - F.col("before")).alias("rank"))
        if level + 1 < len(DIGITS):
            targets = durable(targets)  # a few numbers a group; cuts the plan
            keep = targets.select("grp", "digit").distinct()
            deeper = deeper.withColumn("digit", longer("digit", _digit(level))).join(keep, ["grp", "digit"])
    return _interpolated(targets.withColumn("value", from_ordered_bits(F.col("digit"))))


def percentiles(df: DataFrame, group: Column, value: Column, quantiles: list[float], ident: Column | None = None, min_count: int = 1, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact interpolated percentiles ``(grp, n, q, value)`` of every group.

    ``n`` is the number of values of the group; groups with fewer than
    ``min_count`` are left out.  Null and NaN are no values, infinities are.
    With ``ident``, repeats of a record count once (see ``records``).  ``group``
    may be a struct.  An empty table gives no rows.  Other columns aren't read.
    """
    rows, pieces = records(df, group, value, ident, piece_rows)
    return _select(durable(_followed(rows, pieces, quantiles, min_count)))
