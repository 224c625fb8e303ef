"""Top N items of every group.

Method: a hot-cold split.  Exact group counts tell the heavy groups; their
rows are salted by score range and identity, every salted range is sorted and
cut to N on its own, and the few rows left are ranked once more.  Light groups
go through an ordinary window.  In both, the window's limit is applied before
the shuffle as well, so a map task sends at most N distinct items of a group
(or salted range) on.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import PIECE_ROWS, durable, key_pieces

#: Score quantiles that bound the ranges of a heavy group, and salts in each range.
RANGES = (0.25, 0.5, 0.75, 0.9, 0.97, 0.99)
SALTS = 8


def heavy_groups(rows: DataFrame, piece_rows: int) -> DataFrame:
    """``(grp, bounds)``: groups with more than ``piece_rows`` rows by exact
    counts, and range bounds of their scores.  As bounded as ``key_pieces``."""
    heavy = rows.join(F.broadcast(key_pieces(rows, ["grp"], piece_rows)), "grp")
    return durable(heavy.groupBy("grp").agg(F.percentile_approx("score", list(RANGES), 1000).alias("bounds")))


def top_n(df: DataFrame, group: Column, score: Column, ident: Column, n: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The up to ``n`` items of each group with the highest scores.

    Result: ``(grp, rank, item_id, score)``, rank from 1.  Among equal scores
    the smaller id comes first, so every run gives the same rows.  Rows without
    group, score or id aren't ranked; NaN is no score.  Rows that repeat group,
    score and id are one item.  A group with fewer items gives all of them, an
    empty table none.  Other columns aren't read.
    """
    rows = df.select(group.alias("grp"), score.alias("score"), ident.alias("item_id"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("score").isNotNull() & F.col("item_id").isNotNull())
    if dict(rows.dtypes)["score"] in ("double", "float"):
        rows = rows.filter(~F.isnan("score"))
    order = [F.desc("score"), F.asc("item_id")]

    def best(d: DataFrame, *by: str) -> DataFrame:
        ranked = d.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
        return ranked.groupBy(*by, "rank").agg(F.min("item_id").alias("item_id"), F.min("score").alias("score"))

    # one pass over the rows serves both: those of heavy groups get a range and a
    # salt, those of light ones are cut by their group alone
    tagged = rows.join(F.broadcast(heavy_groups(rows, piece_rows)), "grp", "left")
    in_range = reduce(add, [(F.col("score") >= F.col("bounds")[i]).cast("int") for i in range(len(RANGES))])
    heavy = F.col("bounds").isNotNull()
    tagged = tagged.select("grp", "score", "item_id", F.when(heavy, in_range).otherwise(F.lit(0)).alias("range"), F.when(heavy, F.pmod(F.xxhash64("item_id"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt"))
    cut = best(tagged, "grp", "range", "salt").select("grp", "score", "item_id")
    # at most N items of a light group and of each salted range are ranked once more
    return best(cut, "grp").select("grp", "rank", "item_id", "score")
