"""Registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, percentiles, reading_level, tokens, top_items
from quillon.runtime import clean, durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- p2: top N items within every group


def p2_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 largest trades of each symbol and the 3 best paid of each dept, ranked."""
    trades = top_items.top_n(table(spark, sf, "trades_v2"), clean("symbol", "upper"), F.col("qty"), F.col("trade_id"), 5)
    people = top_items.top_n(table(spark, sf, "people"), clean("dept", "lower"), F.col("salary"), F.col("id"), 3)
    return trades.select(F.lit("trades_v2").alias("src"), "*").unionByName(people.select(F.lit("people").alias("src"), "*"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_top(spark, sf).select("src", "grp", "item_id")


_P2_TOP = """
WITH r AS (
  SELECT 'trades_v2' AS src, 5 AS n, upper(trim(symbol)) AS grp, trade_id AS item_id, qty AS score FROM trades_v2 GROUP BY ALL
  UNION ALL SELECT 'people', 3, lower(trim(dept)), id, salary FROM people GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY src, grp ORDER BY score DESC, item_id) AS rank FROM r WHERE grp IS NOT NULL AND score IS NOT NULL)"""
_P2 = f"{_P2_TOP} SELECT src, grp, item_id FROM k WHERE rank <= n"
_P2_RANKED = f"{_P2_TOP} SELECT src, grp, CAST(rank AS INTEGER) AS rank, item_id, score FROM k WHERE rank <= n"


# --- p4: percentiles


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """Usable prices and durations as ``(src, grp, id, value, part)``; a record lies in one part (day or version)."""
    usable = table(spark, sf, "trades_v2").filter("price > 0").select(F.lit("trades_v2").alias("src"), clean("symbol", "upper").alias("grp"), F.col("trade_id").alias("id"), F.col("price").alias("value"), F.col("ts").cast("date").cast("string").alias("part"))
    whole = F.col("solution").isNotNull() & F.col("query_number").isNotNull() & F.col("io_type").isNotNull()
    runs = table(spark, sf, "timings").filter((F.col("scale_factor") == 1) & (F.col("`duration[s]`") > 0) & whole)
    group = F.concat_ws(":", F.col("solution"), F.col("query_number"), F.col("io_type"))
    timed = runs.select(F.lit("timings").alias("src"), group.alias("grp"), F.col("run_id").alias("id"), F.col("`duration[s]`").alias("value"), F.col("version").alias("part"))
    return usable.unionAll(timed).filter("grp is not null")


def _by_group(out: DataFrame) -> DataFrame:
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return out.groupBy("grp.src", "grp.grp", "n").agg(pick(0.5).alias("median"), pick(0.99).alias("p99"))


def _percentiles(spark: SparkSession, sf: str, min_count: int) -> DataFrame:
    return _by_group(percentiles.percentiles(_measured(spark, sf), F.struct("src", "grp"), F.col("value"), [0.5, 0.99], F.col("id"), min_count))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 99th percentile of prices per symbol and of durations per group."""
    return _percentiles(spark, sf, 1)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _percentiles(spark, sf, 100).filter(F.col("p99") > 4 * F.col("median")).select("src", "grp")


def p4_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The same percentiles from summaries of each day of prices and each version of timings, made apart and added up."""
    rows, _ = percentiles.records(_measured(spark, sf), F.struct("src", "grp", "part"), F.col("value"), F.col("id"))
    merged = percentiles.merge(percentiles.histogram(rows).withColumn("grp", F.struct("grp.src", "grp.grp")))
    return _by_group(percentiles.from_summary(merged, [0.5, 0.99]))


_P4 = """
WITH t AS (
  SELECT 'trades_v2' AS src, upper(trim(symbol)) AS grp, trade_id AS id, price AS v FROM trades_v2 WHERE price > 0 AND NOT isnan(price) GROUP BY ALL
  UNION ALL SELECT 'timings', solution || ':' || query_number || ':' || io_type, run_id, "duration[s]" FROM timings
    WHERE "duration[s]" > 0 AND NOT isnan("duration[s]") AND scale_factor = 1 GROUP BY ALL),
p AS (SELECT src, grp, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.99) AS p99 FROM t WHERE grp IS NOT NULL GROUP BY 1, 2)"""
_P4_ALL = f"{_P4} SELECT src, grp, n, median, p99 FROM p"
# a summary knows a value up to the middle of its digit of 12 fraction bits
_WIDTH = "pow(2, floor(log2(v)) - 12)"
_P4_MERGED = f"{_P4} SELECT src, grp, count(*) AS n, quantile_cont(floor(v / {_WIDTH}) * {_WIDTH} + {_WIDTH} / 2, 0.5) AS median, quantile_cont(floor(v / {_WIDTH}) * {_WIDTH} + {_WIDTH} / 2, 0.99) AS p99 FROM t WHERE grp IS NOT NULL GROUP BY 1, 2"
_P4_FOUND = f"{_P4} SELECT src, grp FROM p WHERE n >= 100 AND p99 > 4 * median"


# --- p8: filling containers

CAPACITY = 1024


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    sized = packing.sized_documents(table(spark, sf, "documents"), tokens.token_count(F.col("text")))
    return packing.pack(sized, "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _containers(spark, sf)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Number of containers, the least possible number, and the share of space used."""
    packed = _containers(spark, sf).filter("container is not null")
    return packed.agg(
        F.count_distinct("container").alias("containers"),
        F.ceil(F.sum("length") / CAPACITY).alias("least"),
        F.round(F.sum("length") / (F.count_distinct("container") * CAPACITY), 4).alias("used"),
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be split."""
    return _containers(spark, sf).filter("n_pieces > 1 and piece = 0").select("doc_id")


# --- p9: mixing sources


def _sized_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return durable(docs.select("doc_id", clean("source", "lower").alias("source"), tokens.token_count(F.col("text")).alias("tokens")))


def _mixed(spark: SparkSession, sf: str, on_capped: str = "leave") -> tuple[DataFrame, DataFrame]:
    sized = _sized_sources(spark, sf)
    targets = table(spark, sf, "mix_targets").select(clean("source", "lower").alias("source"), "target_share", "max_repeats")
    shares = mixing.plan_shares(sized, targets, on_capped=on_capped)
    return mixing.mix(sized, shares), shares


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, sf)[0]


def _report(spark: SparkSession, sf: str, on_capped: str) -> DataFrame:
    mixture, shares = _mixed(spark, sf, on_capped)
    return mixing.report(durable(mixture), shares)


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares aimed at and reached by each source in a mix of the size of all documents."""
    return _report(spark, sf, "leave")


def p9_report_refill(spark: SparkSession, sf: str) -> DataFrame:
    """The same with what capped sources lack taken from the others."""
    return _report(spark, sf, "refill")


def p9_report_shrink(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the largest mix in which every source reaches its share."""
    return _report(spark, sf, "shrink")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose documents the mix uses as often as allowed without reaching their share."""
    return p9_report(spark, sf).filter("exhausted").select("source")


# --- p10: reading level


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulty score and level of every document."""
    return reading_level.reading_levels(table(spark, sf, "documents"), table(spark, sf, "level_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_levels(spark, sf).filter(F.col("level") == "advanced").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_top": p2_top,
    "p4_found": p4_found,
    "p4_percentiles": p4_percentiles,
    "p4_merged": p4_merged,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p9_report_refill": p9_report_refill,
    "p9_report_shrink": p9_report_shrink,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}
SQL = {"p2_found": _P2, "p2_top": _P2_RANKED, "p4_found": _P4_FOUND, "p4_percentiles": _P4_ALL, "p4_merged": _P4_MERGED}
