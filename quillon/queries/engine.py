"""Queries of the engine's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import Frame, coalesce, col, concat, concat_str, lit, selectors, when
from quillon.expr import Expr

#: Columns that are unique together, hence a row order.
ORDER = {
    "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
    "supplier": ["s_suppkey"], "embeddings": ["vec_id"], "documents": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def frame(spark: SparkSession, sf: str, name: str) -> Frame:
    return Frame.of(spark.read.parquet(f"{sf}/{name}.parquet"), ORDER.get(name))


def query(name: str, sql: str | None, *tables: str) -> Callable:
    """Register ``f(frame, ...) -> Frame`` over tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf: (lambda out: out.to_df() if isinstance(out, Frame) else out)(f(*[frame(spark, sf, t) for t in tables]))
        if sql:
            SQL[name] = sql
        return f

    return add


def r4(e: Expr, name: str) -> Expr:
    return e.cast("f64").round(4).alias(name)


# --- whole queries

_DISC = col("l_extendedprice") * (1.0 - col("l_discount"))


def _q1(li: Frame) -> Frame:
    return (
        li.with_columns(_DISC.alias("disc_price"), (col("disc_price") * (col("l_tax") + 1.0)).alias("charge"))
        .group_by("l_returnflag", "l_linestatus")
        .agg(
            col("l_quantity").sum().alias("sum_qty"), col("l_extendedprice").sum().alias("sum_base_price"), col("disc_price").sum().alias("sum_disc_price"), col("charge").sum().alias("sum_charge"),
            col("l_quantity").mean().alias("avg_qty"), col("l_extendedprice").mean().alias("avg_price"), col("l_discount").mean().alias("avg_disc"), col("l_quantity").count().alias("count_order"),
        )
        .with_columns(*[col(c).round(2).alias(c) for c in ("sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")], *[col(c).round(6).alias(c) for c in ("avg_qty", "avg_price", "avg_disc")])
        .sort_by(["l_returnflag", "l_linestatus"])
    )


_Q1_SQL = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
  count(*) AS count_order FROM lineitem {} GROUP BY 1, 2"""


@query("q1", _Q1_SQL.format("WHERE l_shipdate <= TIMESTAMP '1998-09-02'"), "lineitem")
def _(li): return _q1(li.filter(col("l_shipdate") <= lit("1998-09-02").cast("datetime")))
@query("q1_all_dates", _Q1_SQL.format(""), "lineitem")
def _(li): return _q1(li)


@query("q3", """
SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10""", "customer", "orders", "lineitem")  # fmt: skip
def _(c, o, li):
    c = c.filter(col("c_mktsegment") == "BUILDING").select(col("c_custkey").alias("o_custkey"))
    o = o.filter(col("o_orderdate") < lit("1998-01-01").cast("datetime"))
    j = o.join(c, "o_custkey").join(li.rename("l_orderkey", "o_orderkey"), "o_orderkey")
    g = j.with_columns(_DISC.alias("rev")).group_by("o_orderkey", "o_orderdate").agg(col("rev").sum().alias("revenue"))
    return g.with_columns(col("revenue").round(2).alias("revenue")).sort_by(["revenue", "o_orderkey"], [True, False]).head(10)


@query("q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""", "customer", "orders", "lineitem", "supplier", "nation")  # fmt: skip
def _(c, o, li, s, n):
    j = li.rename("l_orderkey", "o_orderkey").join(o, "o_orderkey").rename("o_custkey", "c_custkey").join(c.rename("c_nationkey", "n_nationkey"), "c_custkey")
    j = j.rename("l_suppkey", "s_suppkey").join(s.rename("s_nationkey", "n_nationkey"), ["s_suppkey", "n_nationkey"]).join(n, "n_nationkey")
    return j.with_columns(_DISC.alias("rev")).group_by("n_name").agg(col("rev").sum().alias("revenue")).with_columns(col("revenue").round(2).alias("revenue"))


@query("q6", "SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "lineitem")
def _(li):
    dates = (col("l_shipdate") >= lit("1996-01-01").cast("datetime")) & (col("l_shipdate") < lit("1997-01-01").cast("datetime"))
    return li.filter(dates, col("l_discount").between(0.05, 0.07), col("l_quantity") < 24.0).select((col("l_extendedprice") * col("l_discount")).sum().round(2).alias("revenue"))


@query("q6_all_dates", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "lineitem")
def _(li): return li.filter(col("l_discount").between(0.05, 0.07), col("l_quantity") < 24.0).select((col("l_extendedprice") * col("l_discount")).sum().round(2).alias("revenue"))


# --- projection

@query("select_exprs", "SELECT o_orderkey, o_totalprice * 2 + 1 AS twice, o_custkey - o_orderkey AS gap FROM orders", "orders")
def _(o): return o.select("o_orderkey", (col("o_totalprice") * 2 + 1).alias("twice"), (col("o_custkey") - col("o_orderkey")).alias("gap"))
@query("with_columns_in_sequence", "SELECT o_orderkey, (o_orderkey + 1) * 2 AS a, ((o_orderkey + 1) * 2) * 3 AS b FROM orders", "orders")
def _(o): return o.with_columns((col("o_orderkey") + 1).alias("a"), (col("a") * 2).alias("a"), (col("a") * 3).alias("b")).select("o_orderkey", "a", "b")
@query("drop_rename", "SELECT n_nationkey, n_name AS name FROM nation", "nation")
def _(n): return n.drop("n_regionkey", "not_there").rename("n_name", "name")
@query("literals", "SELECT n_nationkey, CAST(7 AS BIGINT) AS i, 1.5::DOUBLE AS f, true AS b, 'x' AS s, CAST(NULL AS BIGINT) AS z FROM nation", "nation")
def _(n): return n.select("n_nationkey", lit(7).alias("i"), lit(1.5).alias("f"), lit(True).alias("b"), lit("x").alias("s"), lit(None).cast("i64").alias("z"))
@query("casts", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(o_orderstatus AS BIGINT) AS bad, o_orderkey <> 0 AS b FROM orders", "orders")
def _(o): return o.select("o_orderkey", col("o_totalprice").cast("i64").alias("whole"), col("o_orderkey").cast("f64").alias("f"), col("o_orderkey").cast("str").alias("s"), col("o_orderstatus").cast("i64").alias("bad"), col("o_orderkey").cast("bool").alias("b"))
@query("row_index", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 4 AS at, o_orderkey FROM orders", "orders")
def _(o): return o.sort("o_totalprice", True).with_row_index("at", 5).select("at", "o_orderkey")
@query("selectors", "SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer", "customer")
def _(c): return c.select_by(selectors.union(selectors.numeric(), selectors.matching("_name$")))
@query("selector_algebra", "SELECT o_custkey, o_totalprice FROM orders", "orders")
def _(o): return o.select_by(selectors.minus(selectors.intersect(selectors.numeric(), selectors.starts_with("o_")), selectors.named("o_orderkey")))
@query("hstack", "SELECT a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation ORDER BY 2 LIMIT 5) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b USING (i)", "nation", "region")
def _(n, r): return n.select("n_name").head(5).hstack(r.select("r_name"))
@query("apply_all_columns", "SELECT n_nationkey * 2 AS n_nationkey, n_regionkey * 2 AS n_regionkey FROM nation", "nation")
def _(n): return n.select("n_nationkey", "n_regionkey").apply(lambda c: c * 2)

# --- predicates and nulls

_NULLED = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 END AS k FROM events"


def nulled(ev: Frame) -> Frame:
    """Events with nulls in a float and an integer column."""
    # a literal null takes the other side's type
    third, fifth = F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    df = ev.df.withColumn("v", F.when(~third, F.col("value"))).withColumn("k", F.when(~fifth, F.col("event_id") % 7))
    return Frame(df, ev.order).select("event_id", "user_id", "v", "k")


@query("comparisons", f"SELECT event_id, v = 50 AS a, v <> 50 AS b, v < 50 AS c, v <= k AS d, v > k AS e, k >= 3 AS f FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", (col("v") == 50.0).alias("a"), (col("v") != 50.0).alias("b"), (col("v") < 50.0).alias("c"), (col("v") <= col("k")).alias("d"), (col("v") > col("k")).alias("e"), (col("k") >= 3).alias("f"))
@query("kleene_logic", f"SELECT event_id, v > 50 AND k > 3 AS a, v > 50 OR k > 3 AS b, NOT (k > 3) AS c FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", ((col("v") > 50.0) & (col("k") > 3)).alias("a"), ((col("v") > 50.0) | (col("k") > 3)).alias("b"), (~(col("k") > 3)).alias("c"))
@query("filter_null_is_false", f"SELECT event_id FROM ({_NULLED}) WHERE k > 3 OR v IS NULL", "events")
def _(ev): return nulled(ev).filter((col("k") > 3) | col("v").is_null()).select("event_id")
@query("between_is_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F')", "orders")
def _(o): return o.filter(col("o_totalprice").between(1000.0, 200000.0) & col("o_orderstatus").is_in("O", "F")).select("o_orderkey")
@query("empty_is_in", "SELECT o_orderkey FROM orders WHERE false", "orders")
def _(o): return o.filter(col("o_orderstatus").is_in()).select("o_orderkey")
@query("null_tests", f"SELECT event_id, v IS NULL AS a, k IS NOT NULL AS b FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", col("v").is_null().alias("a"), col("k").is_not_null().alias("b"))
_NAN = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS x FROM events"


def with_nan(ev: Frame) -> Frame:
    m = F.col("event_id") % 4
    return Frame(ev.df.withColumn("x", F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 3, F.col("value"))), ev.order).select("event_id", "x")


@query("float_classes", f"SELECT event_id, isnan(x) AS a, isfinite(x) AS b, isinf(x) AS c FROM ({_NAN})", "events")
def _(ev): return with_nan(ev).select("event_id", col("x").is_nan().alias("a"), col("x").is_finite().alias("b"), col("x").is_infinite().alias("c"))
@query("nan_compares_false", f"SELECT event_id FROM ({_NAN}) WHERE x > 10 AND NOT isnan(x)", "events")
def _(ev): return with_nan(ev).filter(col("x") > 10.0).select("event_id")
@query("fill_nan", f"SELECT event_id, CASE WHEN isnan(x) THEN 0 ELSE x END AS x FROM ({_NAN}) WHERE x IS NULL OR NOT isinf(x)", "events")
def _(ev): return with_nan(ev).filter(col("x").is_null() | ~col("x").is_infinite()).fill_nan(0.0)
@query("when_then", f"SELECT event_id, CASE WHEN k > 3 THEN 'high' ELSE 'low' END AS c FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", when(col("k") > 3).then("high").otherwise("low").alias("c"))
@query("coalesce", f"SELECT event_id, coalesce(v, k, -1)::DOUBLE AS c FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", coalesce(col("v"), col("k"), -1).alias("c"))
@query("fill_null", f"SELECT event_id, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).fill_null(0).select("event_id", "v", "k")
_FILL = "SELECT event_id, {}(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN {} AND {}) AS v FROM (" + _NULLED + ")"
@query("forward_fill", _FILL.format("last_value", "UNBOUNDED PRECEDING", "CURRENT ROW"), "events")
def _(ev): return nulled(ev).select("event_id", col("v").forward_fill().alias("v"))
@query("forward_fill_limit", _FILL.format("last_value", "1 PRECEDING", "CURRENT ROW").replace("% 3 =", "% 3 <>"), "events")
def _(ev):
    df = Frame(ev.df.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value"))), ev.order)
    return df.select("event_id", col("v").forward_fill(1).alias("v"))
@query("backward_fill", _FILL.format("first_value", "CURRENT ROW", "UNBOUNDED FOLLOWING"), "events")
def _(ev): return nulled(ev).select("event_id", col("v").backward_fill().alias("v"))
@query("drop_nulls", f"SELECT event_id, v, k FROM ({_NULLED}) WHERE v IS NOT NULL AND k IS NOT NULL", "events")
def _(ev): return nulled(ev).select("event_id", "v", "k").drop_nulls()
@query("any_null_mask", f"SELECT v IS NULL OR k IS NULL AS any_null FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).any_null_mask()
@query("null_count", f"SELECT count(*) - count(v) AS v, count(*) - count(k) AS k FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("v", "k").null_count()

# --- joins

@query("join_inner", "SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def _(o, c): return o.rename("o_custkey", "c_custkey").join(c, "c_custkey").select("o_orderkey", "c_name", "c_acctbal")
@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey", "customer", "orders")
def _(c, o): return c.join(o.filter(col("o_orderstatus") == "P").rename("o_custkey", "c_custkey"), "c_custkey", "left").select("c_custkey", "o_orderkey")
@query("join_cross", "SELECT a.n_name, r_name FROM nation a CROSS JOIN region", "nation", "region")
def _(n, r): return n.select("n_name").join(r.select("r_name"), [], "cross")
@query("join_suffix", "SELECT a.n_regionkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_regionkey)", "nation", "nation")
def _(a, b): return a.select("n_regionkey", "n_name").join(b.select("n_regionkey", "n_name"), "n_regionkey")
@query("join_float_key", f"SELECT a.event_id, b.event_id AS event_id_right FROM ({_NAN}) a JOIN ({_NAN}) b ON a.x = b.x AND NOT isnan(a.x) AND NOT isinf(a.x)", "events", "events")
def _(a, b): return with_nan(a).filter(~col("x").is_infinite() | col("x").is_nan()).join(with_nan(b), "x").select("event_id", "event_id_right")
@query("join_more_kinds", """
SELECT 'full' AS how, count(*) AS n FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey
UNION ALL SELECT 'semi', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) RIGHT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey""", "customer", "orders")  # fmt: skip
def _(c, o):
    o = o.rename("o_custkey", "c_custkey")
    even, third = Frame(c.df.filter("c_custkey % 2 = 0"), c.order), Frame(o.df.filter("o_orderkey % 3 = 0"), o.order)
    sizes = [("full", even.join(third, "c_custkey", "full")), ("right", even.join(third, "c_custkey", "right")), ("semi", c.join(o, "c_custkey", "semi")), ("anti", c.join(o, "c_custkey", "anti"))]
    parts = [f.df.agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n")) for how, f in sizes]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])

# --- aggregation

@query("group_by_aggs", f"""
SELECT user_id, coalesce(sum(v), 0) AS s, avg(v) AS m, min(v) AS lo, max(k) AS hi, count(v) AS n, count(*) - count(v) AS z FROM ({_NULLED}) GROUP BY 1""", "events")
def _(ev):
    g = nulled(ev).group_by("user_id").agg(col("v").sum().alias("s"), col("v").mean().alias("m"), col("v").min().alias("lo"), col("k").max().alias("hi"), col("v").count().alias("n"), col("v").null_count().alias("z"))
    return g
QUERIES["group_by_aggs"] = (lambda f: lambda s, d: f(s, d).withColumns({c: F.round(c, 6) for c in ("s", "m")}))(QUERIES["group_by_aggs"])
SQL["group_by_aggs"] = SQL["group_by_aggs"].replace("coalesce(sum(v), 0) AS s, avg(v) AS m", "round(coalesce(sum(v), 0), 6) AS s, round(avg(v), 6) AS m")
@query("group_by_null_key", f"SELECT k, count(*) AS n FROM ({_NULLED}) GROUP BY 1", "events")
def _(ev): return nulled(ev).group_by("k").agg(col("event_id").count().alias("n"))
@query("group_by_no_aggs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")
def _(o): return o.group_by("o_orderstatus", "o_orderpriority").agg()
@query("group_by_expression", "SELECT o_orderstatus, round(sum(o_totalprice * 2), 2) AS s FROM orders GROUP BY 1", "orders")
def _(o): return o.group_by("o_orderstatus").agg((col("o_totalprice") * 2.0).sum().alias("s")).with_columns(col("s").round(2).alias("s"))
@query("group_first_last", f"SELECT user_id, arg_min(struct_pack(v), event_id).v AS f, arg_max(struct_pack(k), event_id).k AS l FROM ({_NULLED}) GROUP BY 1", "events")
def _(ev): return nulled(ev).group_by("user_id").agg(col("v").first().alias("f"), col("k").last().alias("l"))
@query("group_order_of_appearance", "SELECT o_orderstatus, row_number() OVER (ORDER BY m) - 1 AS at FROM (SELECT o_orderstatus, min(o_orderkey) AS m FROM orders GROUP BY 1)", "orders")
def _(o): return o.group_by("o_orderstatus").agg(col("o_orderkey").count().alias("n")).with_row_index("at").select("at", "o_orderstatus")
@query("global_aggs", f"""
SELECT round(sum(v), 4) AS s, round(avg(v), 6) AS m, count(v) AS n, count(*) - count(v) AS z, min(k) AS lo, max(k) AS hi, round(stddev_samp(v), 6) AS sd, round(var_samp(v), 4) AS va,
  bool_or(k > 5) AS an, bool_and(k > 5) AS al, count(DISTINCT k) AS u FROM ({_NULLED})""", "events")
def _(ev):
    f = nulled(ev).select(col("v").sum().alias("s"), col("v").mean().alias("m"), col("v").count().alias("n"), col("v").null_count().alias("z"), col("k").min().alias("lo"), col("k").max().alias("hi"),
                          col("v").std().alias("sd"), col("v").var().alias("va"), (col("k") > 5).any().alias("an"), (col("k") > 5).all().alias("al"), col("k").n_unique().alias("u"))
    return f.with_columns(col("s").round(4).alias("s"), col("m").round(6).alias("m"), col("sd").round(6).alias("sd"), col("va").round(4).alias("va"))
@query("sum_of_nothing", "SELECT 0::DOUBLE AS s, CAST(0 AS BIGINT) AS i, NULL::DOUBLE AS m, 'nan'::DOUBLE AS sd, false AS an, true AS al, 1::DOUBLE AS p", "events")
def _(ev): return nulled(ev).filter(lit(False)).select(col("v").sum().alias("s"), col("k").sum().alias("i"), col("v").mean().alias("m"), col("v").std().alias("sd"), (col("k") > 5).any().alias("an"), (col("k") > 5).all().alias("al"), col("v").product().alias("p"))
@query("median_quantile", "SELECT round(median(o_totalprice), 4) AS m, round(quantile_cont(o_totalprice, 0.9), 4) AS q FROM orders", "orders")
def _(o): return o.select(r4(col("o_totalprice").median(), "m"), r4(col("o_totalprice").quantile(0.9), "q"))
@query("product", "SELECT round(exp(sum(ln(1 + p_size / 100000.0))), 4) AS p FROM part", "part")
def _(p): return p.select((col("p_size") / 100000.0 + 1.0).product().round(4).alias("p"))
# user 1 holds half of all rows: a key of any size is spread over tasks
_SKEWED = f"SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE user_id END AS u FROM ({_NULLED})"


def skewed(ev: Frame) -> Frame:
    f = nulled(ev)
    return Frame(f.df.withColumn("u", F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(F.col("user_id"))), f.order)


@query("group_quantiles", f"SELECT u, round(median(v), 4) AS m, round(quantile_cont(v, 0.9), 4) AS q, count(v) AS n FROM ({_SKEWED}) GROUP BY 1", "events")
def _(ev): return skewed(ev).group_by("u").agg(col("v").median().alias("m"), col("v").quantile(0.9).alias("q"), col("v").count().alias("n")).with_columns(col("m").round(4).alias("m"), col("q").round(4).alias("q"))
@query("group_quantiles_null_keys", f"SELECT k, u, round(quantile_cont(v, 0.25), 4) AS q FROM ({_SKEWED}) GROUP BY 1, 2", "events")
def _(ev): return skewed(ev).group_by("k", "u").agg(col("v").quantile(0.25).alias("q")).with_columns(col("q").round(4).alias("q"))
@query("over_quantiles", f"SELECT event_id, round(v - median(v) OVER (PARTITION BY u), 4) AS d FROM ({_SKEWED})", "events")
def _(ev): return skewed(ev).select("event_id", (col("v") - col("v").median().over("u")).round(4).alias("d"))
@query("group_entropy", f"SELECT u, round(-sum(p * ln(p)) / ln(2), 6) AS h FROM (SELECT u, count(*) / sum(count(*)) OVER (PARTITION BY u) AS p FROM ({_SKEWED}) WHERE k IS NOT NULL GROUP BY u, k) GROUP BY 1 UNION ALL SELECT u, NULL FROM ({_SKEWED}) GROUP BY 1 HAVING count(k) = 0", "events")
def _(ev): return skewed(ev).group_by("u").agg(col("k").entropy(2.0).alias("h")).with_columns(col("h").round(6).alias("h"))
_MOMENTS = "SELECT count(x) AS n, avg(x) AS m, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM (SELECT o_totalprice / 1000 AS x FROM orders)"
@query("skew_kurtosis", f"SELECT round((m3 - 3 * m * m2 + 2 * m * m * m) / pow(m2 - m * m, 1.5), 4) AS s, round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / pow(m2 - m * m, 2) - 3, 4) AS k FROM ({_MOMENTS})", "orders")
def _(o): return o.with_columns((col("o_totalprice") / 1000.0).alias("x")).select(r4(col("x").skew(), "s"), r4(col("x").kurtosis(), "k"))
@query("skew_kurtosis_unbiased", "SELECT round(skewness(o_totalprice), 4) AS s, round(kurtosis(o_totalprice), 4) AS k FROM orders", "orders")
def _(o): return o.select(r4(col("o_totalprice").skew_unbiased(), "s"), r4(col("o_totalprice").kurtosis_unbiased(), "k"))
@query("entropy", "SELECT round(-sum(p * ln(p)) / ln(2), 6) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY o_orderpriority)", "orders")
def _(o): return o.select(col("o_orderpriority").entropy(2.0).round(6).alias("h"))
@query("approx_n_unique", None, "lineitem")
def _(li): return li.select(col("l_partkey").approx_n_unique().alias("n"))
@query("corr_matrix", "SELECT 'l_quantity' AS column, 1::DOUBLE AS l_quantity, round(corr(l_quantity, l_extendedprice), 6) AS l_extendedprice FROM lineitem UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6), 1 FROM lineitem", "lineitem")
def _(li): return li.select("l_quantity", "l_extendedprice").corr().with_columns(col("l_quantity").round(6).alias("l_quantity"), col("l_extendedprice").round(6).alias("l_extendedprice"))
@query("cov_matrix", "SELECT 'l_quantity' AS column, round(covar_samp(l_quantity, l_quantity), 4) AS l_quantity, round(covar_samp(l_quantity, l_discount), 4) AS l_discount FROM lineitem UNION ALL SELECT 'l_discount', round(covar_samp(l_quantity, l_discount), 4), round(covar_samp(l_discount, l_discount), 4) FROM lineitem", "lineitem")
def _(li): return li.select("l_quantity", "l_discount").cov().with_columns(col("l_quantity").round(4).alias("l_quantity"), col("l_discount").round(4).alias("l_discount"))
@query("mode", f"WITH c AS (SELECT k, count(*) AS n FROM ({_NULLED}) WHERE k IS NOT NULL GROUP BY 1) SELECT k FROM c WHERE n = (SELECT max(n) FROM c)", "events")
def _(ev): return nulled(ev).mode("k")
@query("value_counts", f"SELECT k, count(*) AS counts FROM ({_NULLED}) WHERE k IS NOT NULL GROUP BY 1", "events")
def _(ev): return nulled(ev).value_counts("k")
for _op, _sql in {"sum": "sum({0})", "mean": "avg({0})", "min": "min({0})", "max": "max({0})", "std": "stddev_samp({0})", "var": "var_samp({0})", "median": "median({0})"}.items():
    query(f"{_op}_all", "SELECT " + ", ".join(f"round(({_sql.format(c)})::DOUBLE, 2) AS {c}" for c in ("o_orderkey", "o_totalprice")) + " FROM orders", "orders")(
        lambda o, op=_op: o.select("o_orderkey", "o_totalprice", "o_orderstatus").agg_all(op).apply(lambda c: c.round(2)))
@query("count_all", f"SELECT count(v) AS v, count(k) AS k FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("v", "k").count_all()
@query("describe", """
SELECT statistic, round(v, 4) AS o_totalprice FROM (SELECT unnest(['count','null_count','mean','std','min','25%','50%','75%','max']) AS statistic,
  unnest([count(*)::DOUBLE, 0, avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), max(o_totalprice)]) AS v FROM orders)""", "orders")
def _(o): return o.select("o_totalprice").describe().with_columns(col("o_totalprice").round(4).alias("o_totalprice"))

# --- windows and order-dependent functions

@query("over_aggs", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, max(o_totalprice) OVER w AS hi, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)", "orders")
def _(o): return o.select("o_orderkey", col("o_totalprice").sum().over("o_custkey").round(2).alias("s"), col("o_totalprice").max().over("o_custkey").alias("hi"), col("o_orderkey").count().over("o_custkey").alias("n"))
@query("over_expression", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS d FROM orders", "orders")
def _(o): return o.select("o_orderkey", (col("o_totalprice") - col("o_totalprice").mean().over("o_custkey")).round(6).alias("d"))
@query("over_first_last", f"SELECT event_id, first_value(v) OVER w AS f, last_value(k) OVER w AS l FROM ({_NULLED}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "events")
def _(ev): return nulled(ev).select("event_id", col("v").first().over("user_id").alias("f"), col("k").last().over("user_id").alias("l"))
@query("scalar_broadcast", "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS share FROM orders", "orders")
def _(o): return o.select("o_orderkey", (col("o_totalprice") / col("o_totalprice").max()).round(6).alias("share"))
_RANK = """SELECT event_id, CASE WHEN k IS NOT NULL THEN (rank() OVER w)::DOUBLE END AS lo, CASE WHEN k IS NOT NULL THEN (rank() OVER w + count(*) OVER t - 1)::DOUBLE END AS hi,
  CASE WHEN k IS NOT NULL THEN rank() OVER w + (count(*) OVER t - 1) / 2.0 END::DOUBLE AS av, CASE WHEN k IS NOT NULL THEN (dense_rank() OVER w)::DOUBLE END AS de,
  CASE WHEN k IS NOT NULL THEN (row_number() OVER ({p} ORDER BY k NULLS LAST, event_id))::DOUBLE END AS od FROM (""" + _NULLED + ") WINDOW w AS ({p} ORDER BY k NULLS LAST), t AS (PARTITION BY {q} k)"
_METHODS = (("min", "lo"), ("max", "hi"), ("average", "av"), ("dense", "de"), ("ordinal", "od"))
@query("rank", _RANK.format(p="", q=""), "events")
def _(ev): return nulled(ev).select("event_id", *[col("k").rank(m).alias(n) for m, n in _METHODS])
@query("rank_over", _RANK.format(p="PARTITION BY user_id", q="user_id,"), "events")
def _(ev): return nulled(ev).select("event_id", *[col("k").rank(m).over("user_id").alias(n) for m, n in _METHODS])
_SHIFT = "SELECT event_id, lag(k, 2) OVER w AS a, lead(v) OVER w AS b, k - lag(k) OVER w AS d, round(v / nullif(lag(v) OVER w, 0) - 1, 6) AS p FROM (" + _NULLED + ") WINDOW w AS ({} ORDER BY event_id)"
_SHIFTS = lambda f: (f(col("k").shift(2)).alias("a"), f(col("v").shift(-1)).alias("b"), f(col("k").diff()).alias("d"), f(col("v").pct_change()).round(6).alias("p"))
@query("shift_diff", _SHIFT.format(""), "events")
def _(ev): return nulled(ev).select("event_id", *_SHIFTS(lambda e: e))
@query("shift_diff_over", _SHIFT.format("PARTITION BY user_id"), "events")
def _(ev): return nulled(ev).select("event_id", *_SHIFTS(lambda e: e.over("user_id")))
_CUM = """SELECT event_id, CASE WHEN k IS NOT NULL THEN CAST(sum(k) OVER w AS BIGINT) END AS s, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi,
  count(v) OVER w AS n FROM (""" + _NULLED + ") WINDOW w AS ({} ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_CUMS = lambda f: (f(col("k").cum_sum()).alias("s"), f(col("v").cum_min()).alias("lo"), f(col("v").cum_max()).alias("hi"), f(col("v").cum_count()).alias("n"))
@query("cumulative", _CUM.format(""), "events")
def _(ev): return nulled(ev).select("event_id", *_CUMS(lambda e: e))
@query("cumulative_over", _CUM.format("PARTITION BY user_id"), "events")
def _(ev): return nulled(ev).select("event_id", *_CUMS(lambda e: e.over("user_id")))
@query("cum_prod", "SELECT n_nationkey, round(exp(sum(ln(n_regionkey + 1)) OVER (ORDER BY n_nationkey)), 4) AS p FROM nation", "nation")
def _(n): return n.select("n_nationkey", r4((col("n_regionkey") + 1).cum_prod(), "p"))
_ROLL = "SELECT event_id, " + ", ".join(f"CASE WHEN count(v) OVER w >= 3 THEN round({f}(v) OVER w, 6) END AS {n}" for f, n in (("sum", "s"), ("avg", "m"), ("min", "lo"), ("max", "hi"), ("stddev_samp", "sd"), ("var_samp", "va"))) + " FROM (" + _NULLED + ") WINDOW w AS ({} ORDER BY event_id ROWS 5 PRECEDING)"
_ROLLS = lambda f: tuple(f(getattr(col("v"), f"rolling_{o}")(6, 3)).round(6).alias(n) for o, n in (("sum", "s"), ("mean", "m"), ("min", "lo"), ("max", "hi"), ("std", "sd"), ("var", "va")))
@query("rolling", _ROLL.format(""), "events")
def _(ev): return nulled(ev).select("event_id", *_ROLLS(lambda e: e))
@query("rolling_over", _ROLL.format("PARTITION BY user_id"), "events")
def _(ev): return nulled(ev).select("event_id", *_ROLLS(lambda e: e.over("user_id")))
@query("ewm_over", f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({_NULLED}) WHERE v IS NOT NULL)
SELECT a.event_id, round(sum(b.v * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)), 4) AS m FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1
UNION ALL SELECT event_id, NULL FROM ({_NULLED}) WHERE v IS NULL""", "events")
def _(ev): return nulled(ev).select("event_id", col("v").ewm_mean(0.3).over("user_id").round(4).alias("m"))
@query("ewm_global", f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM ({_NULLED}) WHERE v IS NOT NULL)
SELECT a.event_id, round(sum(b.v * pow(0.5, a.i - b.i)) / sum(pow(0.5, a.i - b.i)), 4) AS m FROM e a JOIN e b ON b.i BETWEEN a.i - 60 AND a.i GROUP BY 1
UNION ALL SELECT event_id, NULL FROM ({_NULLED}) WHERE v IS NULL""", "events")
def _(ev): return nulled(ev).select("event_id", col("v").ewm_mean(0.5).round(4).alias("m"))
@query("peaks", "SELECT event_id, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w, false) AS hi, coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false) AS lo FROM events WINDOW w AS (ORDER BY event_id)", "events")
def _(ev): return ev.select("event_id", col("value").peak_max().alias("hi"), col("value").peak_min().alias("lo"))
@query("occurrence", f"SELECT event_id, count(*) OVER (PARTITION BY v) > 1 AS d, count(*) OVER (PARTITION BY v) = 1 AS u, row_number() OVER (PARTITION BY k ORDER BY event_id) = 1 AS f, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1 AS l FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", col("v").is_duplicated().alias("d"), col("v").is_unique().alias("u"), col("k").is_first_distinct().alias("f"), col("k").is_last_distinct().alias("l"))
@query("arg_min_max", "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events) SELECT (SELECT i FROM e ORDER BY value, i LIMIT 1) AS a, (SELECT i FROM e ORDER BY value DESC, i LIMIT 1) AS b", "events")
def _(ev): return ev.select(col("value").arg_min().alias("a"), col("value").arg_max().alias("b"))
@query("arg_sort", "SELECT o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_totalprice FROM orders)", "orders")
def _(o): return o.select(col("o_totalprice").arg_sort())
@query("arg_true", "SELECT i AS t FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice > 200000 AS t FROM orders) WHERE t", "orders")
def _(o): return o.select((col("o_totalprice") > 200000.0).arg_true().alias("t"))
@query("arg_unique", "SELECT min(i) AS o_orderstatus FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus FROM orders) GROUP BY o_orderstatus", "orders")
def _(o): return o.select(col("o_orderstatus").arg_unique())

# --- sort, limit, sampling

@query("sort_nulls_last", f"SELECT row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS at, event_id FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).sort("v", True).with_row_index("at").select("at", "event_id")
@query("sort_by_many", f"SELECT row_number() OVER (ORDER BY k DESC NULLS FIRST, user_id, event_id) - 1 AS at, event_id FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).sort_by(["k", "user_id"], [True, False], [True, False]).with_row_index("at").select("at", "event_id")
@query("sort_column_alone", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS at, o_totalprice FROM orders", "orders")
def _(o): return o.select(col("o_totalprice").sort()).with_row_index("at")
@query("head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "orders")
def _(o): return o.head(7).select("o_orderkey")
@query("tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "orders")
def _(o): return o.tail(7).select("o_orderkey")
@query("slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", "orders")
def _(o): return o.slice(20, 10).select("o_orderkey")
@query("head_then_filter", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderstatus = 'O'", "orders")
def _(o): return o.head(50).filter(col("o_orderstatus") == "O").select("o_orderkey")
@query("reverse", "SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS at, o_orderkey FROM orders", "orders")
def _(o): return o.reverse().with_row_index("at").select("at", "o_orderkey")
@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 9", "orders")
def _(o): return o.top_k(9, "o_totalprice").select("o_orderkey", "o_totalprice")
@query("bottom_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 9", "orders")
def _(o): return o.bottom_k(9, "o_totalprice").select("o_orderkey", "o_totalprice")
@query("sample", None, "orders")
def _(o): return o.sample(100, seed=3).select("o_orderkey")
@query("sample_frac", None, "orders")
def _(o): return o.sample_frac(0.1, True, 3).select("o_orderkey")
@query("shuffle", "SELECT o_orderkey FROM orders", "orders")
def _(o): return o.shuffle(5).select("o_orderkey")
@query("gather", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) JOIN (SELECT unnest([5, 3, 3, 100]) AS i) USING (i)", "orders")
def _(o): return o.gather([5, 3, 3, 100]).select("o_orderkey")
@query("partition_by", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", "orders")
def _(o): return concat(*[p.group_by("o_orderstatus").agg(col("o_orderkey").count().alias("n")) for p in o.partition_by("o_orderstatus")])

# --- unions and reshaping

@query("concat", "SELECT row_number() OVER (ORDER BY f, n_nationkey) - 1 AS at, n_name FROM (SELECT 0 AS f, * FROM nation UNION ALL SELECT 1, * FROM nation)", "nation")
def _(n): return concat(n, n).with_row_index("at").select("at", "n_name")
@query("unique", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")
def _(o): return o.select("o_orderstatus", "o_orderpriority").unique()
@query("unique_column", "SELECT DISTINCT o_orderpriority FROM orders", "orders")
def _(o): return o.select(col("o_orderpriority").unique())
@query("pivot_sum", "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1", "orders")
def _(o): return o.pivot(["o_orderpriority"], "o_orderstatus", "o_totalprice", "sum").with_columns(*[col(s).round(2).alias(s) for s in "FOP"])
@query("pivot_first", "SELECT o_orderpriority, " + ", ".join(f"arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1", "orders")
def _(o): return o.pivot(["o_orderpriority"], "o_orderstatus", "o_totalprice")
@query("unpivot", "SELECT c_name, 'c_custkey' AS variable, c_custkey::DOUBLE AS value FROM customer UNION ALL SELECT c_name, 'c_acctbal', c_acctbal FROM customer", "customer")
def _(c): return c.select("c_name", "c_custkey", "c_acctbal").unpivot(["c_name"])
@query("transpose", "SELECT 'r_regionkey' AS column, 0::DOUBLE AS column_0, 1::DOUBLE AS column_1, 2::DOUBLE AS column_2, 3::DOUBLE AS column_3, 4::DOUBLE AS column_4", "region")
def _(r): return r.select("r_regionkey").transpose()
@query("explode", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings", "embeddings")
def _(e): return e.select("vec_id", "embedding").explode("embedding")
@query("unnest", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation", "nation")
def _(n): return Frame(n.df.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"), *[x for x, _, _ in n.order]), n.order).unnest("s")
@query("upsample", """
WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM orders WHERE o_orderkey % 37 = 0 GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day)
SELECT g.day, n FROM g LEFT JOIN d USING (day)""", "orders")
def _(o): return Frame(o.df.filter("o_orderkey % 37 = 0").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))).upsample("day", "1d")
@query("horizontal", f"""
SELECT event_id, CASE WHEN v IS NULL AND k IS NULL THEN NULL ELSE coalesce(v, 0) + coalesce(k, 0) END AS s, round((coalesce(v, 0) + coalesce(k, 0)) / nullif((v IS NOT NULL)::INT + (k IS NOT NULL)::INT, 0), 6) AS m,
  least(v, k) AS lo, greatest(v, k) AS hi FROM ({_NULLED})""", "events")
def _(ev):
    f = nulled(ev)
    for kind, out in (("sum", "s"), ("mean", "m"), ("min", "lo"), ("max", "hi")):
        f = getattr(f, f"{kind}_horizontal")(out, "v", "k")
    return f.select("event_id", "s", col("m").round(6).alias("m"), "lo", "hi")
@query("horizontal_logic", f"SELECT event_id, CASE WHEN k IS NOT NULL OR v IS NOT NULL THEN coalesce(k > 3, true) AND coalesce(v > 50, true) END AS a, CASE WHEN k IS NOT NULL OR v IS NOT NULL THEN coalesce(k > 3, false) OR coalesce(v > 50, false) END AS o FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).with_columns((col("k") > 3).alias("p"), (col("v") > 50.0).alias("q")).all_horizontal("a", "p", "q").any_horizontal("o", "p", "q").select("event_id", "a", "o")
@query("int_range", "SELECT unnest(generate_series(2, 19, 3)) AS int_range", "region")
def _(r):
    from quillon import int_range

    return r.select(int_range(2, 20, 3))
@query("ones_zeros", "SELECT 1::DOUBLE AS constant FROM range(4)", "region")
def _(r):
    from quillon import ones

    return r.select(ones(4))
@query("extend_constant", "SELECT r_regionkey FROM region UNION ALL SELECT 9 FROM range(3)", "region")
def _(r): return r.select("r_regionkey").extend_constant(9, 3)

# --- scalar functions

@query("arithmetic", "SELECT o_orderkey, o_orderkey + o_custkey AS a, o_totalprice - o_custkey AS s, o_orderkey * 3 AS m, o_orderkey // nullif(o_custkey % 5, 0) AS d, -o_orderkey AS n, o_totalprice / 7 AS f FROM orders", "orders")
def _(o):
    o = Frame(o.df.withColumn("five", F.col("o_custkey") % 5), o.order)
    return o.select("o_orderkey", (col("o_orderkey") + col("o_custkey")).alias("a"), (col("o_totalprice") - col("o_custkey")).alias("s"), (col("o_orderkey") * 3).alias("m"), (col("o_orderkey") / col("five")).alias("d"), (-col("o_orderkey")).alias("n"), (col("o_totalprice") / 7.0).alias("f"))
@query("float_division_by_zero", "SELECT event_id, CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS d FROM events", "events")
def _(ev): return ev.select("event_id", (col("value") / 0.0).alias("d"))
_X = "SELECT event_id, value / 100 AS x FROM events"
_MATH = {
    "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "exp": "exp(x)", "expm1": "exp(x) - 1", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
    "arcsinh": "asinh(x)", "radians": "radians(x)", "degrees": "degrees(x)", "abs": "abs(x)", "sign": "sign(x)::DOUBLE", "floor": "floor(x)", "ceil": "ceil(x)",
}
@query("math", "SELECT event_id, " + ", ".join(f"round({s}, 6) AS f_{n}" for n, s in _MATH.items()) + f" FROM ({_X}) WHERE x >= 0", "events")
def _(ev): return ev.with_columns((col("value") / 100.0).alias("x")).filter(col("x") >= 0.0).select("event_id", *[getattr(col("x"), n)().round(6).alias(f"f_{n}") for n in _MATH])
_UNIT = "SELECT event_id, (event_id % 19) / 20.0 AS x FROM events"
_MATH2 = {"arcsin": "asin(x)", "arccos": "acos(x)", "arctanh": "atanh(x)", "log1p": "ln(1 + x)"}
@query("math_unit", "SELECT event_id, " + ", ".join(f"round({s}, 6) AS f_{n}" for n, s in _MATH2.items()) + f", round(acosh(x + 1), 6) AS f_arccosh, round(cot(x + 1), 6) AS f_cot, round(atan2(x, 2), 6) AS f_arctan2, round(pow(x, 3), 6) AS f_pow, least(greatest(x, 0.2), 0.7) AS f_clip FROM ({_UNIT})", "events")
def _(ev):
    f = Frame(ev.df.withColumn("x", (F.col("event_id") % 19) / 20.0), ev.order)
    return f.select("event_id", *[getattr(col("x"), n)().round(6).alias(f"f_{n}") for n in _MATH2], (col("x") + 1.0).arccosh().round(6).alias("f_arccosh"), (col("x") + 1.0).cot().round(6).alias("f_cot"), col("x").arctan2(2.0).round(6).alias("f_arctan2"), col("x").pow(3).round(6).alias("f_pow"), col("x").clip(0.2, 0.7).alias("f_clip"))
@query("logs", "SELECT event_id, " + ", ".join(f"CASE WHEN x = 0 THEN '-inf'::DOUBLE WHEN x < 0 THEN 'nan'::DOUBLE ELSE round({f}(CASE WHEN x > 0 THEN x END), 6) END AS {n}" for f, n in (("ln", "l"), ("log2", "l2"), ("log10", "l10"))) + " FROM (SELECT event_id, (event_id % 9 - 2)::DOUBLE AS x FROM events)", "events")
def _(ev):
    f = Frame(ev.df.withColumn("x", (F.col("event_id") % 9 - 2).cast("double")), ev.order)
    return f.select("event_id", col("x").log().round(6).alias("l"), col("x").log2().round(6).alias("l2"), col("x").log10().round(6).alias("l10"))
@query("hash_values", None, "orders")
def _(o): return o.select("o_orderkey", col("o_orderstatus").hash_values().alias("h"))

_STR = {
    "upper": (lambda c: c.str.upper(), "upper(s)"), "lower": (lambda c: c.str.lower(), "lower(s)"), "len_bytes": (lambda c: c.str.len_bytes(), "strlen(s)"), "len_chars": (lambda c: c.str.len_chars(), "length(s)"),
    "contains": (lambda c: c.str.contains("an"), "contains(s, 'an')"), "contains_regex": (lambda c: c.str.contains_regex("[aeiou]{2}"), "regexp_matches(s, '[aeiou]{2}')"),
    "starts_with": (lambda c: c.str.starts_with("s"), "starts_with(s, 's')"), "ends_with": (lambda c: c.str.ends_with("e"), "ends_with(s, 'e')"), "like": (lambda c: c.str.like("%a_e%"), "s LIKE '%a_e%'"),
    "not_like": (lambda c: c.str.not_like("%a_e%"), "s NOT LIKE '%a_e%'"), "head": (lambda c: c.str.head(3), "left(s, 3)"), "head_neg": (lambda c: c.str.head(-3), "left(s, greatest(length(s) - 3, 0))"),
    "tail": (lambda c: c.str.tail(3), "right(s, 3)"), "tail_neg": (lambda c: c.str.tail(-3), "substr(s, 4)"), "slice": (lambda c: c.str.slice(1, 4), "substr(s, 2, 4)"), "slice_end": (lambda c: c.str.slice(-4), "right(s, 4)"),
    "find": (lambda c: c.str.find("e"), "(instr(s, 'e') - 1)"), "count_matches": (lambda c: c.str.count_matches("e"), "length(s) - length(replace(s, 'e', ''))"), "trim": (lambda c: c.str.trim(), "trim(s)"),
    "lstrip": (lambda c: c.str.lstrip("abcs"), "ltrim(s, 'abcs')"), "rstrip": (lambda c: c.str.rstrip("abcde"), "rtrim(s, 'abcde')"),
    "strip_prefix": (lambda c: c.str.strip_prefix("sp"), "CASE WHEN starts_with(s, 'sp') THEN substr(s, 3) ELSE s END"), "strip_suffix": (lambda c: c.str.strip_suffix("e"), "CASE WHEN ends_with(s, 'e') THEN left(s, length(s) - 1) ELSE s END"),
    "replace": (lambda c: c.str.replace("e", "_x"), "regexp_replace(s, 'e', '_x')"), "replace_all": (lambda c: c.str.replace_all("e", "_x"), "replace(s, 'e', '_x')"), "replace_regex": (lambda c: c.str.replace_regex("[ae]+", "."), "regexp_replace(s, '[ae]+', '.', 'g')"),
    "extract": (lambda c: c.str.extract("([a-d])e", 1), "CASE WHEN regexp_matches(s, '[a-d]e') THEN regexp_extract(s, '([a-d])e', 1) END"), "count_regex": (lambda c: c.str.count_matches_regex("[aeiou]"), "len(regexp_extract_all(s, '[aeiou]'))"),
    "split_n": (lambda c: c.str.split_n(" ", 1), "coalesce(string_split(s, ' ')[2], '')"), "split_short": (lambda c: c.str.split_exact_null_short(" ", 5), "string_split(s, ' ')[6]"),
    "before": (lambda c: c.str.before(" "), "string_split(s, ' ')[1]"), "after": (lambda c: c.str.after(" "), "CASE WHEN contains(s, ' ') THEN substr(s, instr(s, ' ') + 1) ELSE '' END"),
    "pad_start": (lambda c: c.str.pad_start(30, "*"), "lpad(s, greatest(length(s), 30)::INT, '*')"), "pad_end": (lambda c: c.str.pad_end(30, "*"), "rpad(s, greatest(length(s), 30)::INT, '*')"), "reverse": (lambda c: c.str.reverse(), "reverse(s)"),
    "concat": (lambda c: c.str.concat("!"), "s || '!'"), "prefix": (lambda c: c.str.prefix("> "), "'> ' || s"), "is_numeric": (lambda c: c.str.is_numeric(), "regexp_full_match(s, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')"),
}
@query("strings", "SELECT p_partkey, " + ", ".join(f"{s} AS s_{n}" for n, (_, s) in _STR.items()) + " FROM (SELECT p_partkey, p_name AS s FROM part)", "part")
def _(p): return p.select("p_partkey", *[f(col("p_name")).alias(f"s_{n}") for n, (f, _) in _STR.items()])
@query("zfill", "SELECT o_orderkey, CASE WHEN s[1] = '-' THEN '-' || lpad(substr(s, 2), greatest(length(s) - 1, 7)::INT, '0') ELSE lpad(s, greatest(length(s), 8)::INT, '0') END AS z FROM (SELECT o_orderkey, (o_orderkey - 300)::VARCHAR AS s FROM orders)", "orders")
def _(o): return o.select("o_orderkey", (col("o_orderkey") - 300).cast("str").str.zfill(8).alias("z"))
@query("title", "SELECT p_partkey, array_to_string([upper(w[1]) || lower(substr(w, 2)) FOR w IN string_split(p_name, ' ')], ' ') AS t FROM part", "part")
def _(p): return p.select("p_partkey", col("p_name").str.title().alias("t"))
@query("split_lists", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS j, len(string_split(p_name, ' ')) AS n FROM part", "part")
def _(p): return p.select("p_partkey", col("p_name").str.split_exact(" ").list.join("|").alias("j"), col("p_name").str.split_exact(" ").list.len().alias("n"))
@query("concat_str", f"SELECT event_id, CASE WHEN k IS NOT NULL THEN user_id || '-' || k END AS c FROM ({_NULLED})", "events")
def _(ev): return nulled(ev).select("event_id", concat_str("-", col("user_id"), col("k")).alias("c"))
@query("lists", """
SELECT vec_id, len(e) AS n, round(list_sum(e), 3) AS s, round(list_avg(e), 4) AS m, list_min(e) AS lo, list_max(e) AS hi, e[1] AS f, e[len(e)] AS l, e[3] AS g, e[len(e) - 1] AS h, list_contains(e, 5) AS c
FROM (SELECT vec_id, [floor(x * 10)::DOUBLE FOR x IN embedding] AS e FROM embeddings)""", "embeddings")
def _(e):
    f = Frame(e.df.withColumn("e", F.transform("embedding", lambda x: F.floor(x * 10).cast("double"))), e.order)
    c = col("e").list
    return f.select("vec_id", c.len().alias("n"), c.sum().round(3).alias("s"), c.mean().round(4).alias("m"), c.min().alias("lo"), c.max().alias("hi"), c.first().alias("f"), c.last().alias("l"), c.get(2).alias("g"), c.get(-2).alias("h"), c.contains(5.0).alias("c"))
@query("struct_field", "SELECT n_nationkey, n_name AS name FROM nation", "nation")
def _(n): return Frame(n.df.withColumn("s", F.struct(F.col("n_name").alias("name"))), n.order).select("n_nationkey", col("s").struct.field("name").alias("name"))

# --- host functions

@query("map_values", "SELECT o_orderkey, o_orderkey * 2 + 1 AS y FROM orders", "orders")
def _(o): return o.with_columns(col("o_orderkey").alias("y")).map_values("y", lambda v: v * 2 + 1).select("o_orderkey", "y")
@query("map_batches", "SELECT o_orderkey FROM orders", "orders")
def _(o): return o.select("o_orderkey").map_batches(lambda batches: batches, "o_orderkey long")
@query("pipe", "SELECT count(*) AS n FROM orders", "orders")
def _(o): return o.pipe(lambda f: f.select(col("o_orderkey").count().alias("n")))


# --- SQL dialect, scripts, files and streams


def sql_query(name: str, text: str, sql: str | None, *tables: str, spark_rules: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from quillon.sql import Session

        session = Session(spark)
        for t in tables:
            session.register(t, with_nan(frame(spark, sf, t)) if t == "events" else frame(spark, sf, t))
        return (session.spark_sql if spark_rules else session.query)(text).to_df()

    QUERIES[name], SQL[name] = run, sql or text


sql_query("sql_filter", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' OR o_orderkey < 5", None, "orders")
sql_query("sql_group", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) FROM orders GROUP BY o_orderstatus", 'SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS "max(o_totalprice)" FROM orders GROUP BY 1', "orders")
sql_query("sql_global", "SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderkey > -5", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders", "orders")
sql_query("sql_order_limit", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey ASC LIMIT 12", None, "orders")
sql_query("sql_distinct", "SELECT DISTINCT o_orderstatus FROM orders", None, "orders")
sql_query("sql_limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", None, "orders")
sql_query("sql_beyond", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2) SELECT c_name, n FROM c JOIN customer ON c_custkey = o_custkey WHERE c_name LIKE '%1%'", None, "orders", "customer", spark_rules=True)
# the same rules in every clause: events come with NaN, infinities and nulls in x
_X_EVENTS = f"({_NAN})"
sql_query("sql_in_nan", "SELECT event_id FROM events WHERE x > 1 AND event_id % 2 IN (0, 1)".replace("event_id % 2", "event_id - event_id"), f"SELECT event_id FROM {_X_EVENTS} WHERE x > 1 AND NOT isnan(x)", "events")
sql_query("sql_order_expression", "SELECT event_id FROM events ORDER BY x, event_id + 0 LIMIT 500", f"SELECT event_id FROM (SELECT *, isnan(x) AS n FROM {_X_EVENTS}) ORDER BY x NULLS LAST, event_id LIMIT 500", "events")
sql_query("sql_having", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) / count(*) > 1000 AS dear FROM orders GROUP BY o_custkey HAVING count(*) > 2 AND max(o_totalprice) BETWEEN 1000 AND 400000", None, "orders")
sql_query("sql_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus IN ('O', 'P') AND NOT o_orderpriority LIKE '1%' THEN 'open' ELSE lower(o_orderstatus) END AS c, o_totalprice * 2 - 1 AS d FROM orders WHERE o_custkey NOT IN (1, 2) AND o_orderpriority IS NOT NULL", None, "orders")
sql_query("sql_group_expression", "SELECT o_orderkey > 1000 AS late, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderkey > 1000 ORDER BY n DESC", None, "orders")


def script_query(name: str, text: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from quillon.script import Interpreter

        return Interpreter(spark).run(text.replace("$sf", sf)).to_df()

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


script_query("script_group", """
load $sf/orders.parquet            # comments go
.filter o_totalprice > 1000 and o_orderstatus != "P"
groupby o_orderstatus o_totalprice:max:hi \\
  o_orderkey:count:n
sort hi desc
""", "SELECT o_orderstatus, max(o_totalprice) AS hi, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1")  # fmt: skip
script_query("script_with", """
load $sf/part.parquet
with up = p_name.str.upper()
with dear = (p_retailprice * 2 - 1) / 3.0 > 500 or not p_size <= 10
with b = coalesce(p_size, 0)
select p_partkey,up,dear,b
""", "SELECT p_partkey, upper(p_name) AS up, (p_retailprice * 2 - 1) / 3.0 > 500 OR NOT p_size <= 10 AS dear, p_size::DOUBLE AS b FROM part")  # fmt: skip
script_query("script_branches", """
load $sf/nation.parquet
filter n_regionkey >= 2
stash base
sort n_name desc
limit 3
select n_nationkey
stash last
use base
join last on n_nationkey inner
select n_nationkey, n_name
""", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2 ORDER BY n_name DESC, n_nationkey LIMIT 3")  # fmt: skip


def file_query(kind: str, columns: list[str], sql: str) -> None:
    """Write orders in a format and read them back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        from quillon.runtime import ensure_checkpoint_dir
        from quillon.sources import files

        folder = ensure_checkpoint_dir(spark).removeprefix("file:")
        path = f"{folder}/roundtrip-{spark.sparkContext.applicationId}.{kind}"
        f = frame(spark, sf, "orders").select(*columns)
        if kind in ("arrow", "json"):
            import os

            os.makedirs(folder, exist_ok=True)
        files.save(f, path)
        return files.scan(spark, path).select(*columns).to_df()

    QUERIES[f"files_{kind}"], SQL[f"files_{kind}"] = run, sql


for _kind in ("csv", "parquet", "json", "ndjson", "arrow"):
    file_query(_kind, ["o_orderkey", "o_orderstatus", "o_totalprice"], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.streaming.batches import file_stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return file_stream(spark, sf, schema, pattern="events.parquet")


def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.streaming.batches import Pipeline, filter_stage, with_columns_stage

    p = Pipeline(_stream(spark, sf), filter_stage(col("value") > 50.0), with_columns_stage((col("value") * 2.0).alias("twice")))
    return p.collect("stream_filter").select("event_id", "twice")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.streaming.batches import Pipeline, window_stage

    p = Pipeline(_stream(spark, sf), window_stage("ts", "1 day", ["event_type"], {"n": F.count(F.lit(1)), "hi": F.max("value")}))
    return p.collect("stream_windows", "complete")


QUERIES |= {"stream_filter": stream_filter, "stream_windows": stream_windows}
SQL |= {
    "stream_filter": "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50",
    "stream_windows": "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2",
}
