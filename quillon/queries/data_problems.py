"""Queries of the core operators for data pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import copy_diff, raw_records, regular_grid, rolling_state, skewed_totals
from quillon.operators.raw_records import Rule
from quillon.runtime import clean, durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- p1: differences between two copies

TRADE_TOLERANCE = {"price": 0.00005}


def p1_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every difference between trades and trades_v2, with both values."""
    return copy_diff.diff_copies(table(spark, sf, "trades"), table(spark, sf, "trades_v2"), "trade_id", ["ts", "price", "qty"], TRADE_TOLERANCE, names=("trades", "trades_v2"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_differences(spark, sf).select("trade_id", "what")


_ONCE = "SELECT trade_id, min(ts) AS ts, min(price) AS price, min(qty) AS qty FROM {} GROUP BY 1"
_P1 = f"""
WITH a AS ({_ONCE.format('trades')}), b AS ({_ONCE.format('trades_v2')}),
j AS (SELECT coalesce(a.trade_id, b.trade_id) AS trade_id, a.trade_id IS NULL AS no_a, b.trade_id IS NULL AS no_b,
  a.ts AS ta, b.ts AS tb, a.price AS pa, b.price AS pb, a.qty AS qa, b.qty AS qb FROM a FULL JOIN b ON a.trade_id = b.trade_id)
SELECT trade_id, 'only_trades' AS what FROM j WHERE no_b UNION ALL
SELECT trade_id, 'only_trades_v2' FROM j WHERE no_a UNION ALL
SELECT trade_id, 'ts' FROM j WHERE NOT no_a AND NOT no_b AND ta IS DISTINCT FROM tb UNION ALL
SELECT trade_id, 'price' FROM j WHERE NOT no_a AND NOT no_b AND pa IS DISTINCT FROM pb
  AND NOT coalesce(NOT isnan(pa) AND NOT isnan(pb) AND abs(pa - pb) <= 0.00005, false) UNION ALL
SELECT trade_id, 'qty' FROM j WHERE NOT no_a AND NOT no_b AND qa IS DISTINCT FROM qb"""


# texts of values as they are stored; NaN and large numbers are spelt differently
_TEXT = "CASE WHEN isnan({0}) THEN 'NaN' WHEN {0} <> 0 AND abs({0}) >= 10000000 THEN regexp_replace(CAST({0} / 10 ** floor(log10(abs({0}))) AS VARCHAR), '$', 'E' || CAST(floor(log10(abs({0}))) AS INTEGER)) ELSE CAST({0} AS VARCHAR) END"
_P1_ALL = f"""
WITH d AS ({_P1}), a AS ({_ONCE.format('trades')}), b AS ({_ONCE.format('trades_v2')})
SELECT d.trade_id, what, CASE what WHEN 'ts' THEN CAST(a.ts AS VARCHAR) WHEN 'price' THEN {_TEXT.format('a.price')} WHEN 'qty' THEN CAST(a.qty AS VARCHAR) END AS left_value,
  CASE what WHEN 'ts' THEN CAST(b.ts AS VARCHAR) WHEN 'price' THEN {_TEXT.format('b.price')} WHEN 'qty' THEN CAST(b.qty AS VARCHAR) END AS right_value
FROM d LEFT JOIN a ON a.trade_id = d.trade_id LEFT JOIN b ON b.trade_id = d.trade_id"""


# --- p3: a few keys that hold most records


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and totals per symbol and per dept, all rows as delivered."""
    trades = skewed_totals.keyed_totals(table(spark, sf, "trades_v2"), clean("symbol", "upper"), F.col("qty"))
    people = skewed_totals.keyed_totals(table(spark, sf, "people"), clean("dept", "lower"), F.col("salary"))
    out = trades.withColumn("src", F.lit("trades_v2")).unionByName(people.withColumn("src", F.lit("people")))
    return out.select("src", F.col("key").alias("grp"), "n", "n_values", F.col("total").cast("long").alias("total"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    totals = durable(p3_totals(spark, sf))
    parts = [
        skewed_totals.dominant_keys(totals.filter(F.col("src") == src).withColumnRenamed("grp", "key"), percent).select("src", F.col("key").alias("grp"))
        for src, percent in (("trades_v2", 2), ("people", 5))
    ]
    return parts[0].unionAll(parts[1])


_P3_TOTALS = """
SELECT 'trades_v2' AS src, upper(trim(symbol)) AS grp, count(*) AS n, count(qty) AS n_values, CAST(sum(qty) AS BIGINT) AS total FROM trades_v2 GROUP BY 2
UNION ALL SELECT 'people', lower(trim(dept)), count(*), count(salary), CAST(sum(salary) AS BIGINT) FROM people GROUP BY 2"""
_P3 = f"""
WITH t AS ({_P3_TOTALS})
SELECT src, grp FROM (SELECT *, sum(n) OVER (PARTITION BY src) AS m FROM t)
WHERE grp IS NOT NULL AND n * 100 >= m * CASE src WHEN 'people' THEN 5 ELSE 2 END"""


# --- p5: rows that fail to parse

RULES = [
    Rule("shop_orders", 3, "unit_price", "decimal"),
    Rule("shop_orders", 4, "discount", "decimal", required=False, at_most=1.0),
    Rule("trades_v2", 4, "qty", "integer", above=0.0),
]
WIDTHS = {"shop_orders": 5, "trades_v2": 5}


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return raw_records.record_errors(table(spark, sf, "raw_lines"), RULES, WIDTHS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf).select("line_id", "reason")


def p5_shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records of feed shop_orders with types."""
    clean_rows = raw_records.clean_records(table(spark, sf, "raw_lines"), _errors(spark, sf))
    return raw_records.typed(clean_rows, "shop_orders", [("order_id", "bigint"), ("region", "string"), ("product", "string"), ("unit_price", "double"), ("discount", "double")])


def p5_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records of feed trades_v2 with types."""
    clean_rows = raw_records.clean_records(table(spark, sf, "raw_lines"), _errors(spark, sf))
    rows = raw_records.typed(clean_rows, "trades_v2", [("ts", "string"), ("symbol", "string"), ("side", "string"), ("price", "double"), ("qty", "bigint")], keep=("line_id",))
    return rows.withColumn("ts", F.regexp_replace(F.trim("ts"), "Z$", "").try_cast("timestamp_ntz"))


_CELL = '("(?:[^"]|"")*"|[^",]*)'
_PLAIN = "trim(CASE WHEN starts_with({0}, '\"') THEN substr({0}, 2, length({0}) - 2) ELSE {0} END, chr(32) || chr(9))"
_DECIMAL = "regexp_full_match({0}, '[0-9]*\\.?[0-9]*') AND regexp_matches({0}, '[0-9]')"
_P5 = f"""
WITH r AS (SELECT line_id, feed, regexp_full_match(line, '{_CELL}(,{_CELL})*', 's') AS well, regexp_extract_all(',' || line, ',{_CELL}', 1, 's') AS cells FROM raw_lines),
v AS (SELECT *, {_PLAIN.format("cells[4]")} AS a, {_PLAIN.format("cells[5]")} AS b FROM r),
e AS (SELECT line_id, CASE WHEN NOT well THEN 'quoting' WHEN len(cells) <> 5 THEN 'columns'
  WHEN feed = 'shop_orders' AND (NOT ({_DECIMAL.format("a")}) OR b <> '' AND (NOT ({_DECIMAL.format("b")}) OR TRY_CAST(b AS DOUBLE) > 1)) THEN 'value'
  WHEN feed = 'trades_v2' AND (NOT regexp_full_match(b, '[0-9]+') OR coalesce(TRY_CAST(b AS BIGINT), 0) <= 0) THEN 'value' END AS reason FROM v)
SELECT line_id, reason FROM e WHERE reason IS NOT NULL"""
_P5_SHOP = "SELECT order_id, region, product, unit_price, discount FROM shop_orders"


# --- p6: rolling totals


#: Days that a first load adds to the state at a time; a daily run adds one.
LOAD_DAYS = 28


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Current state of all trades.

    Trades that arrived by the end of their own day make version 0, day block
    after day block; later arrivals are applied to it as corrections of version 1.
    """
    trades = table(spark, sf, "trades_v2")
    day = F.col("ts").cast("date")
    # a record delivered on time and again later is on time: the minimum counts
    fields = {"qty": F.col("qty"), "late": F.coalesce(F.col("recv_ts").cast("date") > day, F.lit(False)).cast("long")}
    on_time, qty = 1 - F.col("late"), F.coalesce(F.col("qty"), F.lit(0).cast("long"))
    sums = {"qty": qty * on_time, "n": on_time, "late_qty": qty * F.col("late"), "late_n": F.col("late")}
    parts = rolling_state.partial_amounts(trades, clean("symbol", "upper"), day, "trade_id", fields, sums)
    kind = lambda version, q, n: F.when(F.col(n) > 0, F.struct(F.lit(version).alias("version"), F.col(q).alias("qty"), F.col(n).alias("n")))
    both = F.filter(F.array(kind(0, "qty", "n"), kind(1, "late_qty", "late_n")), lambda x: x.isNotNull())
    state = rolling_state.RollingState(spark, (7, 30), rolling_state.buckets_for(trades.count()))
    state.stage(parts.select("entity", "day", F.explode(both).alias("a")).select("entity", "day", "a.*"), ends_known=True)
    for first, last in rolling_state.day_blocks(state.staged_days(), LOAD_DAYS):
        state.advance(first, last)
    state.correct(version=1)
    return state.current()


def p6_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and daily averages of qty over the trailing 7 and 30 days."""
    return _rolling(spark, sf).select(
        F.col("entity").alias("symbol"), F.col("day").cast("string").alias("trade_day"), "qty", F.col("n").alias("n_trades"),
        "total_7", F.round(F.col("total_7") / 7, 6).alias("avg_7"), "total_30", F.round(F.col("total_30") / 30, 6).alias("avg_30"),
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("total_30").between(2000, 20000) & (F.col("total_7") * 10 < F.col("total_30"))
    return _rolling(spark, sf).filter(hit).select(F.col("entity").alias("symbol"), F.col("day").cast("string").alias("trade_day"))


_P6_STATE = """
d AS (SELECT symbol, day, sum(qty) AS qty, count(*) AS n FROM (
    SELECT trade_id, upper(trim(symbol)) AS symbol, CAST(ts AS DATE) AS day, min(qty) AS qty FROM trades_v2 WHERE ts IS NOT NULL AND symbol IS NOT NULL GROUP BY ALL)
  GROUP BY 1, 2),
cal AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
f AS (SELECT cal.symbol, cal.day, coalesce(d.qty, 0) AS qty, coalesce(d.n, 0) AS n FROM cal LEFT JOIN d ON d.symbol = cal.symbol AND d.day = cal.day),
s AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING) AS t7, sum(qty) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS t30 FROM f)"""
_P6_ROLLING = f"""WITH {_P6_STATE}
SELECT symbol, CAST(day AS VARCHAR) AS trade_day, CAST(qty AS BIGINT) AS qty, n AS n_trades, CAST(t7 AS BIGINT) AS total_7, round(CAST(t7 AS DOUBLE) / 7, 6) AS avg_7,
  CAST(t30 AS BIGINT) AS total_30, round(CAST(t30 AS DOUBLE) / 30, 6) AS avg_30 FROM s"""
_P6 = f"WITH {_P6_STATE} SELECT symbol, CAST(day AS VARCHAR) AS trade_day FROM s WHERE t30 BETWEEN 2000 AND 20000 AND t7 * 10 < t30"


# --- p7: a regular grid

SLOT = 1800
MAX_GAP = 6


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    trades = table(spark, sf, "trades_v2").filter((F.col("price") > 0) & ~F.isnan("price"))
    knots = regular_grid.slot_knots(trades, clean("symbol", "upper"), F.col("ts"), F.col("price"), "trade_id", SLOT)
    return regular_grid.fit_segments(knots, SLOT, MAX_GAP)


def p7_series(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hourly prices per symbol from its first to its last trade; empty slots filled, or marked in gaps of over three hours."""
    series = regular_grid.on_grid(_segments(spark, sf), SLOT)
    return series.select(F.col("source").alias("symbol"), F.substring(F.col("slot").cast("string"), 1, 16).alias("slot"), "n", F.round("value", 6).alias("price"), "state")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Slots inside busy days that the series had to fill with a usable price or to mark."""
    segments = _segments(spark, sf).withColumn("day", F.floor(F.col("slot") / (86400 // SLOT)))
    # shards hold whole days
    busy = segments.withColumn("in_day", F.sum("n").over(Window.partitionBy("source", "shard", "day")))
    inside = busy.filter((F.col("in_day") >= 10) & (F.floor(F.col("next_slot") / (86400 // SLOT)) == F.col("day")))
    series = regular_grid.on_grid(inside, SLOT).filter("n = 0 and (state = 'gap' or state = 'filled' and value > 0)")
    return series.select(F.col("source").alias("symbol"), F.substring(F.col("slot").cast("string"), 1, 16).alias("slot"))


_EDGE = """CASE WHEN {s1} IS NULL THEN {s0} WHEN sign({d}) <> sign({s0}) THEN 0 WHEN sign({s0}) <> sign({s1}) AND abs({d}) > abs(3 * {s0}) THEN 3 * {s0} ELSE {d} END"""
_SLOPE = lambda h0, h1, s0, s1: _EDGE.format(s0=s0, s1=s1, d=f"(((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}))")
_MEAN = "CASE WHEN sign({s0}) * sign({s1}) <= 0 THEN 0 ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {s0} + ({h1} + 2 * {h0}) / {s1}) END"
_P7_SERIES = f"""
WITH t AS (SELECT symbol, slot, trade_id, min(epoch(ts) - epoch(slot)) AS t, min(price) AS v FROM (
    SELECT trade_id, upper(trim(symbol)) AS symbol, ts, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, price FROM trades_v2 WHERE ts IS NOT NULL AND symbol IS NOT NULL AND price > 0 AND NOT isnan(price)) GROUP BY ALL),
k AS (SELECT symbol, CAST(epoch(slot) // 1800 AS BIGINT) AS s, count(*) AS n, epoch(slot) + sum(t) / count(*) AS x, sum(v) / count(*) AS y FROM t GROUP BY symbol, slot),
w AS (SELECT *, lag(s) OVER o AS s0, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3, lag(x) OVER o AS x0, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lag(y) OVER o AS y0, lead(y) OVER o AS y2, lead(y, 2) OVER o AS y3 FROM k WINDOW o AS (PARTITION BY symbol ORDER BY s)),
h AS (SELECT *, CASE WHEN s - s0 <= {MAX_GAP + 1} THEN x - x0 END AS ha, CASE WHEN s2 - s <= {MAX_GAP + 1} THEN x2 - x END AS hb, CASE WHEN s3 - s2 <= {MAX_GAP + 1} THEN x3 - x2 END AS hc FROM w),
q AS (SELECT *, (y - y0) / ha AS qa, (y2 - y) / hb AS qb, (y3 - y2) / hc AS qc FROM h),
m AS (SELECT *, CASE WHEN ha IS NOT NULL THEN {_MEAN.format(h0="ha", h1="hb", s0="qa", s1="qb")} ELSE {_SLOPE("hb", "hc", "qb", "qc")} END AS m1,
  CASE WHEN hc IS NOT NULL THEN {_MEAN.format(h0="hb", h1="hc", s0="qb", s1="qc")} ELSE {_SLOPE("hb", "ha", "qb", "qa")} END AS m2 FROM q),
g AS (SELECT *, unnest(range(s, coalesce(s2, s + 1))) AS pos FROM m),
u AS (SELECT *, (pos * 1800 + 900.0::DOUBLE - x) / hb AS u FROM g),
v AS (SELECT *, (1 + 2 * u) * (1 - u) * (1 - u) * y + u * (1 - u) * (1 - u) * hb * m1 + u * u * (3 - 2 * u) * y2 + u * u * (u - 1) * hb * m2 AS p FROM u)
SELECT symbol, strftime(make_timestamp(pos * 1800000000), '%Y-%m-%d %H:%M') AS slot, CASE WHEN pos = s THEN n ELSE 0 END AS n,
  round(CASE WHEN pos = s THEN y WHEN hb IS NOT NULL THEN greatest(least(p, greatest(y, y2)), least(y, y2)) END, 6) AS price,
  CASE WHEN pos = s THEN 'observed' WHEN hb IS NULL THEN 'gap' ELSE 'filled' END AS state FROM v"""
_P7 = """
WITH t AS (SELECT DISTINCT trade_id, upper(trim(symbol)) AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS slot FROM trades_v2
  WHERE ts IS NOT NULL AND symbol IS NOT NULL AND price > 0 AND NOT isnan(price)),
d AS (SELECT symbol, CAST(slot AS DATE) AS day, min(slot) AS a, max(slot) AS b FROM t GROUP BY 1, 2 HAVING count(*) >= 10),
g AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS slot FROM d)
SELECT symbol, strftime(slot, '%Y-%m-%d %H:%M') AS slot FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.symbol = g.symbol AND t.slot = g.slot)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_differences": p1_differences,
    "p3_found": p3_found,
    "p3_totals": p3_totals,
    "p5_found": p5_found,
    "p5_shop_orders": p5_shop_orders,
    "p5_trades": p5_trades,
    "p6_found": p6_found,
    "p6_rolling": p6_rolling,
    "p7_found": p7_found,
    "p7_series": p7_series,
}
SQL = {
    "p1_found": _P1,
    "p1_differences": _P1_ALL,
    "p3_found": _P3,
    "p3_totals": _P3_TOTALS,
    "p5_found": _P5,
    "p5_shop_orders": _P5_SHOP,
    "p6_found": _P6,
    "p6_rolling": _P6_ROLLING,
    "p7_found": _P7,
    "p7_series": _P7_SERIES,
}
