"""Queries of sources, frames as objects, selectors, streams, plans, scripts and the command line."""

from __future__ import annotations

import contextlib
import io
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import Frame, cli, col, concat, introspect, lit, selectors, stats, tools, typed
from quillon.expr import walk
from quillon.functions.rowwise import horizontal
from quillon.queries.engine import _NAN, _NULLED, frame, nulled, with_nan
from quillon.runtime import ensure_checkpoint_dir
from quillon.series import Series
from quillon.script import COMMANDS, Interpreter, transpile
from quillon.sources import files
from quillon.streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    """Register ``f(spark, sf) -> Frame | DataFrame``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf: (lambda out: out.to_df() if isinstance(out, Frame) else out)(f(spark, sf))
        SQL[name] = sql
        return f

    return add


def facts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, fact string")


def facts_sql(rows: dict[str, str]) -> str:
    """SQL of a table of facts from SQL expressions."""
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS VARCHAR) AS fact" for k, v in rows.items())


def shared(spark: SparkSession, name: str) -> str:
    """A path of this application in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/queries-{spark.sparkContext.applicationId}"
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


def orders(spark: SparkSession, sf: str) -> Frame:
    return frame(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"

# --- sources


@query("csv_options", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus FROM orders")
def _(spark, sf):
    path = shared(spark, "options.csv")
    files.write_csv(orders(spark, sf), path, delimiter=";")
    return files.read_csv(spark, path, schema="o_orderkey bigint, o_orderstatus string, o_totalprice double", delimiter=";", null_values=["O", "NA"], columns=["o_orderkey", "o_orderstatus"], multi_line=False)


@query("csv_without_header", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    path = shared(spark, "bare.csv")
    orders(spark, sf).to_df().select("o_orderkey", "o_orderstatus").write.mode("overwrite").option("header", False).csv(path)
    return files.read_csv(spark, path, schema="o_orderkey bigint, o_orderstatus string", header=False)


def _order_query(kind: str) -> None:
    @query(f"files_{kind}_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS at FROM orders")
    def _(spark, sf):
        path = shared(spark, f"order.{kind}")
        sorted_ = orders(spark, sf).sort("o_totalprice")
        # several files of very different sizes, the first ones small
        files.save(sorted_.head(10), path)
        part = sorted_.with_row_index("i")
        rest = [part.filter((col("i") >= a) & (col("i") < b)).drop("i") for a, b in ((10, 25), (25, 10**9))]
        for f in rest:
            df = f.to_df(ordered=True).coalesce(1).write.mode("append")
            {"csv": lambda w: w.option("header", True).csv(path), "parquet": lambda w: w.parquet(path), "ndjson": lambda w: w.json(path)}[kind](df)
        names = sorted(p for p in os.listdir(path) if p.startswith("part-"))
        sizes = {p: os.path.getsize(f"{path}/{p}") for p in names}
        for i, p in enumerate(sorted(names, key=lambda p: sizes[p])):
            os.rename(f"{path}/{p}", f"{path}/run-{i}.{kind}")
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{path}/.{p}.crc")
        return files.scan(spark, path).with_row_index("at").select("o_orderkey", "at")


for _kind in ("csv", "parquet", "ndjson"):
    _order_query(_kind)


@query("files_from_urls", " UNION ALL ".join(f"SELECT '{k}' AS kind, r_regionkey::BIGINT AS r_regionkey, r_name FROM region" for k in ("csv", "parquet", "json", "ndjson", "arrow")))
def _(spark, sf):
    region = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long"), "r_name").orderBy("r_regionkey").toPandas()
    import pyarrow as pa

    out = []
    for kind in ("csv", "parquet", "json", "ndjson", "arrow"):
        path = shared(spark, f"url.{kind}")
        table = pa.Table.from_pandas(region, preserve_index=False)
        if kind == "csv":
            region.to_csv(path, index=False)
        elif kind == "parquet":
            region.to_parquet(path)
        elif kind == "arrow":
            with pa.OSFile(path, "wb") as o, pa.ipc.new_file(o, table.schema) as w:
                w.write_table(table)
        else:
            region.to_json(path, orient="records", lines=kind == "ndjson")
        out.append(files.read_url(spark, f"file://{path}").to_df().select(F.lit(kind).alias("kind"), F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("csv_chunks", "SELECT (count(*) + 699) // 700 >= 1 AS some, true AS bounded, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def _(spark, sf):
    path = shared(spark, "chunks.csv")
    files.write_csv(orders(spark, sf), path)
    got = list(files.read_csv_chunks(spark, path, 700))
    keys = [k for b in got for k in b.column("o_orderkey").to_pylist()]
    return spark.createDataFrame([(len(got) > 0, max(b.num_rows for b in got) <= 700, len(keys), sum(keys))], "some boolean, bounded boolean, n long, s long")


@query("custom_source", "SELECT part, part * 100 + i AS v FROM range(4) p(part), range(100) t(i)")
def _(spark, sf):
    import pyarrow as pa

    def read(part: int):
        for at in (0, 50):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * 50, pa.int64()), "v": pa.array([part * 100 + at + i for i in range(50)], pa.int64())})

    return files.from_source(spark, "part long, v long", 4, read)


@query("parquet_options", _ORDERS)
def _(spark, sf):
    path = shared(spark, "options.parquet")
    files.write_parquet(orders(spark, sf), path, compression="zstd", row_group_bytes=65536)
    if not any(".zstd." in p for p in os.listdir(path)):
        raise AssertionError("not compressed as asked")
    return files.read_parquet(spark, path)


@query("ipc_streams", f"{_ORDERS} UNION ALL {_ORDERS}")
def _(spark, sf):
    path, again = shared(spark, "stream.arrow"), shared(spark, "again.arrow")
    o = orders(spark, sf)
    files.write_ipc_stream(path, [o, o])
    # every batch becomes a frame, all frames one stream again
    files.write_ipc_stream(again, [concat(*files.read_ipc_stream(spark, path))])
    return files.read_ipc(spark, again)


@query("database_cursor", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def _(spark, sf):
    import sqlite3

    db = sqlite3.connect("")  # a temporary file, as large as the table
    db.execute("CREATE TABLE o (k INTEGER, p REAL)")
    rows = orders(spark, sf).select("o_orderkey", "o_totalprice").iter_batches()
    db.executemany("INSERT INTO o VALUES (?, ?)", (r for b in rows for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
    parts = list(files.read_cursor(spark, db.execute("SELECT k AS o_orderkey, p AS o_totalprice FROM o WHERE p > 1000"), "o_orderkey long, o_totalprice double", 4096))
    if any(p.height() > 4096 for p in parts):
        raise AssertionError("a batch is too large")
    return concat(*parts)


@query("database_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 10")
def _(spark, sf):
    # the database that comes with Spark
    url = f"jdbc:derby:{shared(spark, 'derby')};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    files.write_jdbc(orders(spark, sf).select("o_orderkey", "o_totalprice"), url, "orders_copy", mode="overwrite", **driver)
    return files.read_jdbc(spark, url, 'SELECT * FROM orders_copy WHERE "o_orderkey" > 10', **driver).select("o_orderkey", "o_totalprice")


@query("frames_from_memory", "SELECT r_regionkey::BIGINT AS k, r_name AS n FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    f = frame(spark, sf, "region").select(col("r_regionkey").cast("i64").alias("k"), col("r_name").alias("n"))
    empty = Frame.empty(spark, f.schema)
    made = Frame.from_map(spark, f.to_map(), ["k", "n"])
    return concat(made, Frame.from_arrow(spark, f.to_arrow()), empty.cache())


@query("frame_batches", "SELECT CAST(sum(least(500, n - 500 * i)) AS BIGINT) AS n_rows, max(least(500, n - 500 * i)) <= 500 AS bounded, true AS in_order FROM (SELECT count(*) AS n FROM orders), range(100000) t(i) WHERE 500 * i < n")
def _(spark, sf):
    keys, largest = [], 0
    for b in orders(spark, sf).select("o_orderkey").iter_batches(500):
        keys += b.column(0).to_pylist()
        largest = max(largest, b.num_rows)
    return spark.createDataFrame([(len(keys), largest <= 500, keys == sorted(keys))], "n_rows long, bounded boolean, in_order boolean")


@query("frame_sink", _ORDERS)
def _(spark, sf):
    path = shared(spark, "sink.parquet")
    orders(spark, sf).sink(lambda df: df.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


# --- frames as objects, selectors, typed handles


@query("frame_properties", facts_sql({
    "schema": "'struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>'", "dtype": "'double'", "height": "(SELECT count(*) FROM orders)", "width": "3", "has_column": "'True'", "is_empty": "'False'", "equals": "'True'",
    "differs": "'False'", "clone": "'True'", "size": "'True'", "glimpse": "(SELECT 'o_orderkey <bigint>: ' || string_agg(o_orderkey, ', ' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 3))",
    "row": "(SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1 OFFSET 4)", "columns": "'o_totalprice,o_orderkey'",
}))
def _(spark, sf):
    o = orders(spark, sf)
    other = o.with_columns((col("o_totalprice") + 1.0).alias("o_totalprice"))
    expr = (col("o_totalprice") * 2.0).sum().over("o_orderkey")
    return facts(spark, [
        ("schema", o.schema.simpleString()), ("dtype", dict(o.dtypes)["o_totalprice"]), ("height", o.shape()[0]), ("width", o.width()), ("has_column", o.has_column("o_orderkey")), ("is_empty", o.is_empty()),
        ("equals", o.equals(orders(spark, sf))), ("differs", o.equals(other)), ("clone", Frame(o.df, o.order).equals(o)), ("size", o.estimated_size() >= 16 * o.height()), ("glimpse", o.glimpse(3).split("\n")[0]),
        ("row", o.row(4)[0]), ("columns", ",".join(dict.fromkeys([x.params[0] for x in walk(expr) if x.op == "col"] + [k for x in walk(expr) if x.op == "over" for k in x.params]))),
    ])


def _selector(name: str, selector: Callable, columns: str) -> None:
    @query(f"selector_{name}", f"SELECT {columns} FROM orders")
    def _(spark, sf): return frame(spark, sf, "orders").with_columns((col("o_orderkey") > 5).alias("flag")).select_by(selector)


_selector("all", selectors.everything(), "*, o_orderkey > 5 AS flag")
_selector("exclude", selectors.exclude("o_orderkey", "flag", "o_orderdate"), "* EXCLUDE (o_orderkey, o_orderdate)")
_selector("by_dtype", selectors.by_dtype("double", "boolean"), "o_totalprice, o_orderkey > 5 AS flag")
_selector("integer", selectors.integers(), "o_orderkey, o_custkey")
_selector("float", selectors.floats(), "o_totalprice")
_selector("strings", selectors.strings(), "o_orderstatus, o_orderpriority")


@query("typed_handles", "SELECT o_orderkey + 1 AS k, o_totalprice * 2 AS p, upper(o_orderstatus) AS s FROM orders WHERE o_totalprice > 1000")
def _(spark, sf):
    o = orders(spark, sf).filter(typed.Float("o_totalprice") > 1000.0)
    return o.select((typed.Int("o_orderkey") + 1).alias("k"), (typed.Float("o_totalprice") * 2.0).alias("p"), typed.Str("o_orderstatus").str.upper().alias("s"))


@query("typed_sum", "SELECT round(sum(o_totalprice), 2) AS s FROM orders")
def _(spark, sf): return orders(spark, sf).select(typed.Float("o_totalprice").sum().round(2).alias("s"))


@query("column_scalars", facts_sql({
    "has_nulls": "'True'", "no_nulls": "'False'", "sum": "(SELECT round(sum(o_totalprice), 1) FROM orders)", "search_sorted": "(SELECT count(*) FROM orders WHERE o_orderkey < 777)",
    "index_of": "(SELECT i FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) ORDER BY o_orderkey DESC LIMIT 1)", "index_of_none": "-1", "is_sorted": "'True'", "is_not_sorted": "'False'", "is_sorted_down": "'True'", "struct_fields": "'k,p'",
}))
def _(spark, sf):
    o, ev = orders(spark, sf), nulled(frame(spark, sf, "events"))
    last = o.tail(1).row(0)[0]
    pair = o.df.select(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")).alias("s"))
    return facts(spark, [
        ("has_nulls", stats.has_nulls(ev, "v")), ("no_nulls", stats.has_nulls(o, "o_totalprice")), ("sum", round(stats.series_agg(o, "o_totalprice", "sum"), 1)), ("search_sorted", stats.search_sorted(o, "o_orderkey", 777)),
        ("index_of", stats.index_of(o, "o_orderkey", last)), ("index_of_none", stats.index_of(o, "o_orderkey", -5)), ("is_sorted", stats.is_sorted(o, "o_orderkey")), ("is_not_sorted", stats.is_sorted(o, "o_totalprice")),
        ("is_sorted_down", stats.is_sorted(o.sort("o_totalprice", True), "o_totalprice", True)), ("struct_fields", ",".join(Frame(pair).schema["s"].dataType.names)),
    ])


@query("series", facts_sql({
    "dtype": "'double'", "name": "'price'", "length": "(SELECT count(*) FROM orders)", "sum": "(SELECT round(sum(o_totalprice), 1) FROM orders)", "max": "(SELECT max(o_totalprice) FROM orders)", "null_count": "0", "get": "(SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1 OFFSET 3)",
    "added": "(SELECT round(sum(o_totalprice + o_orderkey), 1) FROM orders)", "above": "(SELECT count(*) FROM orders WHERE o_totalprice > 1000)", "applied": "(SELECT sum(o_orderkey * 2 + 1)::BIGINT FROM orders)", "appended": "(SELECT 2 * count(*) FROM orders)", "distinct": "(SELECT count(DISTINCT o_custkey) FROM orders)",
}))
def _(spark, sf):
    o = frame(spark, sf, "orders")
    price, key = Series.of(o, "o_totalprice").rename("price"), Series.of(o, "o_orderkey")
    return facts(spark, [
        ("dtype", price.dtype), ("name", price.name), ("length", len(price)), ("sum", round(price.sum(), 1)), ("max", price.max()), ("null_count", price.null_count()), ("get", key.get(3)), ("added", round((price + key).sum(), 1)),
        ("above", len(price.filter(price > 1000.0))), ("applied", int(key.apply(lambda v: v * 2 + 1).sum())), ("appended", len(key.append(key))), ("distinct", len(Series.of(o, "o_custkey").unique())),
    ])


@query("series_from_values", "SELECT 0 AS at, 1::BIGINT AS i, TIMESTAMP '1970-01-01 00:00:01' AS t, 'a' AS s UNION ALL SELECT 1, NULL, NULL, 'b' UNION ALL SELECT 2, 3, TIMESTAMP '2001-09-09 01:46:40', NULL")
def _(spark, sf):
    import pyarrow as pa

    i = Series.from_values(spark, "i", [1, 2, 3], "i64", [True, False, True])
    t = Series.from_times(spark, "t", [1, None, 1_000_000_000], "s")
    s = Series.from_arrow(spark, "s", pa.array(["a", "b"]), pa.array([None], pa.string()))
    return i.frame.hstack(t.frame, s.frame).with_row_index("at").select(col("at").cast("i32"), "i", "t", "s")


@query("expr_head", "SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 6")
def _(spark, sf): return orders(spark, sf).select(col("o_totalprice").head(6))


@query("null_strategies", f"SELECT event_id, CASE WHEN v IS NULL AND k IS NULL THEN NULL ELSE coalesce(v, 0) + coalesce(k, 0) END AS skipped, v + k AS kept FROM ({_NULLED})")
def _(spark, sf):
    ev = nulled(frame(spark, sf, "events"))
    pair = [F.col("v"), F.col("k")]
    return Frame(ev.df.select("event_id", horizontal("sum", pair, True).alias("skipped"), horizontal("sum", pair, True, propagate=True).alias("kept")))


@query("split_wide", "SELECT p_partkey, string_split(p_name, ' ')[1] AS a, array_to_string(string_split(p_name, ' ')[2:], ' ') AS b FROM part WHERE contains(p_name, ' ')")
def _(spark, sf):
    p = frame(spark, sf, "part").filter(col("p_name").str.contains(" "))
    return p.select("p_partkey", col("p_name").str.split_wide(" ", 2).alias("w")).select("p_partkey", col("w").list.get(0).alias("a"), col("w").list.get(1).alias("b"))


@query("equal_values_hash_alike", "SELECT count(DISTINCT o_orderpriority) AS n, true AS one_each, true AS apart FROM orders")
def _(spark, sf):
    h = frame(spark, sf, "orders").select("o_orderpriority", col("o_orderpriority").hash_values().alias("h")).to_df()
    per = h.groupBy("o_orderpriority").agg(F.count_distinct("h").alias("n"), F.min("h").alias("h"))
    return per.agg(F.count(F.lit(1)).alias("n"), (F.max("n") == 1).alias("one_each"), (F.count_distinct("h") == F.count(F.lit(1))).alias("apart"))


@query("approx_n_unique_close", "SELECT true AS close, count(*) AS n FROM lineitem")
def _(spark, sf):
    li = frame(spark, sf, "lineitem")
    got = li.select(col("l_partkey").approx_n_unique().alias("a"), col("l_partkey").n_unique().alias("b"), col("l_partkey").count().alias("n")).to_df()
    return got.select((F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b")).alias("close"), "n")


_DRAWN = "SELECT {n} AS n, true AS from_table, {d} AS distinct_rows, true AS in_order"


def _drawn(spark: SparkSession, sf: str, f: Frame) -> DataFrame:
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    rows = f.with_row_index("at").df.select("at", "o_orderkey")
    inside = rows.join(keys, F.col("o_orderkey") == F.col("k"), "left_semi").agg(F.count(F.lit(1))).scalar()
    late = rows.withColumn("d", F.col("o_orderkey") - F.lag("o_orderkey").over(_by_at())).agg(F.coalesce(F.min("d"), F.lit(0))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == inside).alias("from_table"), F.count_distinct("o_orderkey").alias("distinct_rows"), (late >= 0).alias("in_order"))


def _by_at():
    from pyspark.sql import Window

    return Window.partitionBy(F.floor(F.col("at") / 10_000)).orderBy("at")


@query("sample_size", _DRAWN.format(n="100::BIGINT", d="100::BIGINT"))
def _(spark, sf): return _drawn(spark, sf, orders(spark, sf).sample(100, seed=3))


@query("sample_frac_size", "SELECT n, true AS from_table, n AS distinct_rows, true AS in_order FROM (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) AS n FROM orders)")
def _(spark, sf): return _drawn(spark, sf, orders(spark, sf).sample_frac(0.5, seed=3))


@query("sample_replacement_size", "SELECT CAST(floor(count(*) * 1.5) AS BIGINT) AS n, true AS from_table, true AS repeats FROM orders")
def _(spark, sf):
    d = _drawn(spark, sf, orders(spark, sf).sample_frac(1.5, True, 3))
    return d.select("n", "from_table", (F.col("distinct_rows") < F.col("n")).alias("repeats"))


# --- joins by other key types, one plan per kind


@query("join_keys", f"""
SELECT 'string' AS kind, count(*) AS n, sum(a.o_orderkey + b.o_orderkey)::BIGINT AS s FROM (SELECT * FROM orders WHERE o_totalprice > 150000) a JOIN orders b ON a.o_orderdate::VARCHAR || a.o_custkey = b.o_orderdate::VARCHAR || b.o_custkey
UNION ALL SELECT 'bool', count(*), sum(b.n_nationkey)::BIGINT FROM region a JOIN nation b ON (a.r_regionkey > 2) = (b.n_nationkey > 12)
UNION ALL SELECT 'many', count(*), sum(a.o_orderkey)::BIGINT FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus
UNION ALL SELECT 'float', count(*), sum(a.event_id + b.event_id)::BIGINT FROM (SELECT * FROM ({_NAN}) WHERE NOT isinf(x) OR event_id < 100) a JOIN ({_NAN}) b ON a.x = b.x AND NOT isnan(a.x)""")  # fmt: skip
def _(spark, sf):
    o = frame(spark, sf, "orders")
    text = lambda f: Frame(f.df.withColumn("key", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "o_custkey")), f.order).select("key", "o_orderkey")
    s = text(o.filter(col("o_totalprice") > 150000.0)).join(text(o), "key").select((col("o_orderkey") + col("o_orderkey_right")).alias("v"))
    r = frame(spark, sf, "region").select((col("r_regionkey") > 2).alias("key"))
    n = frame(spark, sf, "nation").select((col("n_nationkey") > 12).alias("key"), col("n_nationkey").cast("i64").alias("v"))
    two = o.select("o_custkey", "o_orderstatus", "o_orderkey")
    m = two.join(two, ["o_custkey", "o_orderstatus"]).select(col("o_orderkey").alias("v"))
    ev = with_nan(frame(spark, sf, "events"))
    few = ev.filter(~col("x").is_infinite() | (col("event_id") < 100))
    x = few.join(ev, "x").select((col("event_id") + col("event_id_right")).alias("v"))
    parts = [f.df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")) for k, f in (("string", s), ("bool", r.join(n, "key")), ("many", m), ("float", x))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


_HALVES = "(SELECT * FROM customer WHERE c_custkey % 2 = 0) c {} JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) o ON c_custkey = o_custkey"
for _how in ("full", "right"):
    @query(f"join_{_how}", f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM {_HALVES.format(_how.upper())}")
    def _(spark, sf, how=_how):
        c, o = frame(spark, sf, "customer").select("c_custkey", "c_name"), frame(spark, sf, "orders").rename("o_custkey", "c_custkey").select("c_custkey", "o_orderkey")
        return Frame(c.df.filter("c_custkey % 2 = 0"), c.order).join(Frame(o.df.filter("o_orderkey % 3 = 0"), o.order), "c_custkey", how)
for _how, _no in (("semi", ""), ("anti", "NOT")):
    @query(f"join_{_how}", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {_no} IN (SELECT o_custkey FROM orders)")
    def _(spark, sf, how=_how):
        return frame(spark, sf, "customer").select("c_custkey", "c_name").join(frame(spark, sf, "orders").rename("o_custkey", "c_custkey").select("c_custkey"), "c_custkey", how)


# --- streams


def _events(spark: SparkSession, sf: str, files_per_batch: int = 1000) -> DataFrame:
    return batches.file_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, files_per_batch, "events.parquet")


@query("stream_stages", "SELECT event_id, upper(event_type) AS kind, value + 1 AS more FROM events WHERE value > 10")
def _(spark, sf):
    add = lambda it: it
    p = batches.Pipeline(
        _events(spark, sf, 1), batches.filter_stage(col("value") > 10.0), batches.project_stage(col("event_id"), col("event_type").str.upper().alias("type"), (col("value") + 1.0).alias("more")),
        batches.rename_stage("type", "kind"), batches.with_columns_stage(lit(1).alias("one")), batches.drop_stage("one"), batches.map_stage(add, "event_id long, kind string, more double"),
    )
    return p.collect("stream_stages")


@query("stream_slice", "SELECT count(*) AS n, true AS from_table FROM (SELECT * FROM events LIMIT 250 OFFSET 100)")
def _(spark, sf):
    path = shared(spark, "slice")
    batches.Pipeline(_events(spark, sf), batches.project_stage(col("event_id"))).slice(path, f"{path}-progress", 100, 250).awaitTermination()
    rows = spark.read.parquet(path).drop("batch")
    known = rows.join(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id", "left_semi").agg(F.count(F.lit(1))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == known).alias("from_table"))


@query("stream_to_files", "SELECT event_id, value FROM events WHERE value < 20")
def _(spark, sf):
    path = shared(spark, "sunk")
    batches.Pipeline(_events(spark, sf), batches.filter_stage(col("value") < 20.0), batches.project_stage(col("event_id"), col("value"))).start(path, f"{path}-progress").awaitTermination()
    return spark.read.parquet(path)


_START = "ts - to_microseconds(epoch_us(ts) % 21600000000)"


@query("stream_sliding_windows", f"SELECT {_START} - to_hours(6 * i) AS window_start, count(*) AS n FROM events, range(2) t(i) GROUP BY 1")
def _(spark, sf):
    p = batches.Pipeline(_events(spark, sf), batches.window_stage("ts", "12 hours", [], {"n": F.count(F.lit(1))}, slide="6 hours"))
    return p.collect("stream_sliding_windows", "complete")


@query("stream_sessions", """
SELECT min(ts) AS session_start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT, 1) AS fresh FROM events)) GROUP BY user_id, s""")  # fmt: skip
def _(spark, sf):
    p = batches.Pipeline(_events(spark, sf), batches.session_stage("ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))}))
    return p.collect("stream_sessions", "complete")


# --- plans


@query("plans", facts_sql({k: "'True'" for k in ("plan", "explain", "pushed", "tree", "ascii", "mermaid", "dot", "profile", "operators", "trace", "passes", "no_jobs")}))
def _(spark, sf):
    f = frame(spark, sf, "orders").filter(col("o_totalprice") > 1000.0).group_by("o_orderstatus").agg(col("o_totalprice").sum().alias("s"))
    text = introspect.explain(f)
    p = introspect.Profiler()
    p.collect("all", f)
    traces = introspect.traced(f)
    o = frame(spark, sf, "orders")
    spark.sparkContext.setJobGroup("building", "plans are built without running anything")
    lazy = o.filter(col("o_totalprice") > 5.0).select((col("o_orderkey") + 1).alias("k")).sort("k").head(5)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return facts(spark, [
        ("plan", "Aggregate" in introspect.plan(f)), ("explain", all(x in text for x in ("Logical", "Optimised", "Physical"))), ("pushed", "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text),
        ("tree", "└─ " in introspect.explain_tree(f)), ("ascii", "`- " in introspect.explain_tree(f, True)), ("mermaid", "-->" in introspect.mermaid(f)), ("dot", introspect.graph(f).startswith("digraph") and "->" in introspect.graph(f)),
        ("profile", "all" in p.report() and '"name": "all"' in p.chrome_trace()), ("operators", any("Scan" in t.operator and t.rows > 0 for t in traces)), ("trace", "rows" in introspect.format_traces(traces)),
        ("passes", any("PushDownPredicates" in x for x in introspect.optimizer_passes(f))), ("no_jobs", len(jobs) == 0 and lazy.width() == 1),
    ])


# --- scripts


def script(name: str, text: str, sql: str, prepare: Callable | None = None) -> None:
    @query(name, sql)
    def _(spark, sf):
        if prepare:
            prepare(spark, sf)
        return Interpreter(spark).run(text.replace("$sf", sf).replace("$tmp", shared(spark, "")))


def _save_nulled(spark: SparkSession, sf: str) -> None:
    ev = nulled(frame(spark, sf, "events"))
    files.save(ev, shared(spark, "nulled.parquet"))


def _save_nan(spark: SparkSession, sf: str) -> None:
    files.save(with_nan(frame(spark, sf, "events")), shared(spark, "nan.parquet"))


script("script_rows", """
load $sf/orders.parquet
drop o_orderdate,o_custkey
rename o_totalprice as price
cast o_orderkey f64
sort price desc
with_row_index at 1
reverse
filter at <= 40
tail 3
with k = o_orderkey
drop_null price
select at,k,o_orderstatus
""".replace("tail 3\n", ""), "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS at, o_orderkey::DOUBLE AS k, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")  # fmt: skip
script("script_fills", "load $tmpnulled.parquet\nforward_fill\nbackward_fill 1\nfill_null 0\nselect event_id,v,k", f"""
WITH f AS (SELECT event_id, last_value(v IGNORE NULLS) OVER w AS v, last_value(k IGNORE NULLS) OVER w AS k FROM ({_NULLED}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, coalesce(first_value(v IGNORE NULLS) OVER w, 0) AS v, coalesce(first_value(k IGNORE NULLS) OVER w, 0) AS k FROM f WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)""", _save_nulled)  # fmt: skip
script("script_nan", "scan_parquet $tmpnan.parquet\nfill_nan 7\ndrop_null x\nselect event_id,x", f"SELECT event_id, CASE WHEN isnan(x) THEN 7 ELSE x END AS x FROM ({_NAN}) WHERE x IS NOT NULL", _save_nan)
script("script_horizontal", """
scan_auto $tmpnulled.parquet
sum_horizontal s v k
mean_horizontal m v k
min_horizontal lo v k
max_horizontal hi v k
with a = v > 50
with b = k > 3
all_horizontal every a b
any_horizontal some a b
select event_id,s,m,lo,hi,every,some
""", f"""SELECT event_id, CASE WHEN v IS NULL AND k IS NULL THEN NULL ELSE coalesce(v, 0) + coalesce(k, 0) END AS s, (coalesce(v, 0) + coalesce(k, 0)) / nullif((v IS NOT NULL)::INT + (k IS NOT NULL)::INT, 0) AS m, least(v, k) AS lo, greatest(v, k) AS hi,
  CASE WHEN k IS NOT NULL OR v IS NOT NULL THEN coalesce(k > 3, true) AND coalesce(v > 50, true) END AS every, CASE WHEN k IS NOT NULL OR v IS NOT NULL THEN coalesce(k > 3, false) OR coalesce(v > 50, false) END AS some FROM ({_NULLED})""", _save_nulled)  # fmt: skip
script("script_top", "load $sf/orders.parquet as all\nuse all\ntop_k 20 o_totalprice\nbottom_k 5 o_totalprice\nwith_row_index at\nselect at,o_orderkey", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS at, o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) ORDER BY o_totalprice, o_orderkey LIMIT 5")
script("script_unique", "load $sf/orders.parquet\nselect o_orderstatus,o_orderpriority\nunique\nshuffle 4\nsort o_orderstatus", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
script("script_long_and_wide", "load $sf/customer.parquet\nselect c_name,c_custkey,c_acctbal\nunpivot c_name c_custkey,c_acctbal\npivot c_name variable value sum\nselect c_name,c_acctbal,c_custkey", "SELECT c_name, sum(c_acctbal) AS c_acctbal, sum(c_custkey)::DOUBLE AS c_custkey FROM customer GROUP BY 1")
script("script_transpose", "load $sf/region.parquet\nselect r_regionkey\ntranspose name row_", "SELECT 'r_regionkey' AS name, 0::DOUBLE AS row_0, 1::DOUBLE AS row_1, 2::DOUBLE AS row_2, 3::DOUBLE AS row_3, 4::DOUBLE AS row_4")


def _save_nested(spark: SparkSession, sf: str) -> None:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    files.save(Frame(n.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.split("n_name", "A").alias("parts")).alias("s")).coalesce(1)), shared(spark, "nested.parquet"))
    days = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    files.save(Frame(days.filter(F.dayofmonth("day") % 5 == 0)), shared(spark, "days.parquet"))


script("script_nested", "load $tmpnested.parquet\nunnest s\nexplode parts\nselect n_nationkey,name,parts", "SELECT n_nationkey, n_name AS name, unnest(string_split(n_name, 'A')) AS parts FROM nation", _save_nested)
script("script_upsample", "load $tmpdays.parquet\nupsample day 1d", """
WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM orders WHERE day(o_orderdate) % 5 = 0 GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day)
SELECT g.day, n FROM g LEFT JOIN d USING (day)""", _save_nested)  # fmt: skip
script("script_session", """
load $sf/nation.parquet
filter n_regionkey < 3
collect
stash kept
filter n_regionkey < 1
reset
save $tmpkept.parquet
write $tmpkept.csv
scan_csv $tmpkept.csv as text
use text
join kept on n_nationkey left
drop_frame kept
timing
timing
cd $tmp
source part.txt
exit
select nothing
""", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey < 3 AND n_nationkey > 3", lambda spark, sf: _write(shared(spark, "part.txt"), "filter n_nationkey > 3\nselect n_nationkey,n_name\n"))  # fmt: skip


def _write(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@query("script_scans", " UNION ALL ".join(f"SELECT '{k}' AS kind, o_orderkey, o_orderstatus FROM orders" for k in ("csv", "parquet", "json", "ndjson", "ipc", "auto")))
def _(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    out = []
    for kind in ("csv", "parquet", "json", "ndjson", "ipc", "auto"):
        path = shared(spark, f"scan-{kind}.{'parquet' if kind == 'auto' else kind}")
        files.save(o, path)
        out.append(Interpreter(spark).run(f"scan_{kind} {path}").to_df().select(F.lit(kind).alias("kind"), "o_orderkey", "o_orderstatus"))
    all_ = out[0]
    for d in out[1:]:
        all_ = all_.unionByName(d)
    return all_


_MOMENTS = "(SELECT avg(x) AS m, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM (SELECT o_totalprice / 100000 AS x FROM orders))"
_STATS = {
    "sum o_totalprice": "(SELECT sum(o_totalprice) FROM orders)", "mean o_totalprice": "(SELECT avg(o_totalprice) FROM orders)", "min o_totalprice": "(SELECT min(o_totalprice) FROM orders)", "max o_totalprice": "(SELECT max(o_totalprice) FROM orders)",
    "median o_totalprice": "(SELECT median(o_totalprice) FROM orders)", "std o_totalprice": "(SELECT stddev_samp(o_totalprice) FROM orders)", "skew o_totalprice": f"(SELECT (m3 - 3 * m * m2 + 2 * m * m * m) / pow(m2 - m * m, 1.5) FROM {_MOMENTS})",
    "kurtosis o_totalprice": f"(SELECT (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / pow(m2 - m * m, 2) - 3 FROM {_MOMENTS})", "corr o_orderkey o_totalprice": "(SELECT corr(o_orderkey, o_totalprice) FROM orders)", "cov o_orderkey o_totalprice": "(SELECT covar_samp(o_orderkey, o_totalprice) FROM orders)",
}


@query("script_statistics", " UNION ALL ".join(f"SELECT '{k}' AS command, round({v}, 3) AS value" for k, v in _STATS.items()))
def _(spark, sf):
    s = Interpreter(spark)
    s.run("\n".join([f"load {sf}/orders.parquet", *_STATS]))
    return spark.createDataFrame([(k, round(float(v), 3)) for k, v in zip(_STATS, s.out, strict=True)], "command string, value double")


_ALL = {"sum": "sum({})", "mean": "avg({})", "min": "min({})", "max": "max({})", "std": "stddev_samp({})", "var": "var_samp({})", "median": "median({})", "count": "count({})", "null_count": "count(*) - count({})"}


@query("script_all_columns", " UNION ALL ".join(f"SELECT '{op}' AS op, round(({e.format('o_orderkey')})::DOUBLE, 2) AS o_orderkey, round(({e.format('o_totalprice')})::DOUBLE, 2) AS o_totalprice FROM orders" for op, e in _ALL.items() if op != "null_count"))
def _(spark, sf):
    out = None
    for op in _ALL:
        if op == "null_count":
            continue
        f = Interpreter(spark).run(f"load {sf}/orders.parquet\nselect o_orderkey,o_totalprice\n{op}_all")
        d = f.to_df().select(F.lit(op).alias("op"), *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("o_orderkey", "o_totalprice")])
        out = d if out is None else out.unionByName(d)
    return out


@query("script_prints", facts_sql({
    "schema": "'n_nationkey: int'", "show": "6", "ishow": "6", "browse": "6", "head": "4", "tail": "'24'", "describe": "10", "glimpse": "4", "size": "'True'", "null_count": "'0 0'", "null_count_all": "'0 0'", "frames": "'kept: n_nationkey, n_name, n_regionkey'",
    "explain": "'True'", "explain_tree": "'True'", "tree": "'True'", "graph": "'True'", "show_graph": "'True'", "mermaid": "'True'", "info": "'True'", "clear": "'True'", "help": "'True'", "pwd": "'True'", "ls": "'True'", "timing": "'True'", "sample": "8", "approx": "'True'", "partition_by": "6", "quit": "'ended'",
}))
def _(spark, sf):
    s = Interpreter(spark)
    s.run(f"load {sf}/nation.parquet as kept\nuse kept")

    def out(line: str) -> str:
        s.out.clear()
        s.run_line(line)
        return "\n".join(s.out)

    lines = lambda line: len(out(line).split("\n"))
    s.focus = s.source = s.frame.select("n_nationkey", "n_name")
    found = [("schema", out("schema").split("\n")[0]), ("show", lines("show 5")), ("ishow", lines("ishow 5")), ("browse", lines("browse 5")), ("head", lines("head 3")), ("tail", out("tail 1").split("\n")[1].split()[0]), ("describe", lines("describe")),
             ("glimpse", out("glimpse 4").split("\n")[0].count(",") + 1), ("size", int(out("size").split()[0]) > 100), ("null_count", " ".join(out("null_count").split("\n")[1].split())), ("null_count_all", " ".join(out("null_count_all").split("\n")[1].split()))]
    found += [("frames", out("frames")), ("explain", "Physical" in out("explain"))]
    found += [(c, "Relation" in out(c)) for c in ("explain_tree", "tree")] + [(c, "digraph" in out(c)) for c in ("graph", "show_graph")]
    found += [("mermaid", "flowchart" in out("mermaid")), ("info", "Spark" in out("info")), ("clear", len(out("clear")) > 0), ("help", all(c in out("help") for c in COMMANDS)), ("pwd", out("pwd") == s.folder), ("ls", "nation.parquet" in out(f"ls {sf}"))]
    out("timing")
    found += [("timing", " ms" in out("schema"))]
    out("timing")
    out("sample 8 3")
    found += [("sample", s.frame.height())]
    s.run_line("reset")
    found += [("approx", abs(int(out("approx_n_unique n_nationkey")) - 25) <= 1)]
    s.run_line("use kept")
    found += [("partition_by", lines("partition_by n_regionkey")), ("quit", "ended" if s.run("quit\nnonsense") is not None else "")]
    return facts(spark, found)


@query("script_transpiled", "SELECT o_orderstatus, max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1")
def _(spark, sf):
    """A script as a program of its own, which runs without the interpreter."""
    text = f'load {sf}/orders.parquet\nfilter o_totalprice > 1000 and o_orderstatus != "P"\nwith p = o_totalprice * 1\ngroupby o_orderstatus p:max:top o_orderkey:count:n\nsort top desc\n'
    code = transpile(text)
    if "Interpreter" in code:
        raise AssertionError("the program needs the interpreter")
    space: dict = {}
    exec(compile(code, "transpiled", "exec"), space)  # noqa: S102
    return space["pipeline"](spark)


@query("script_prompt", facts_sql({"rows": "(SELECT count(*) FROM nation WHERE n_regionkey = 1)", "error": "'True'", "suggestion": "'True'", "prompts": "6"}))
def _(spark, sf):
    from quillon.script import prompt_loop

    got: list[str] = []
    asked: list[str] = []
    given = iter([f"load {sf}/nation.parquet", "filtr n_regionkey = 1", "select nowhere", "filter n_regionkey = \\", "1", "exit"])
    s = Interpreter(spark, got.append)
    prompt_loop(s, lambda p: (asked.append(p), next(given))[1])
    return facts(spark, [("rows", s.frame.height()), ("error", any("nowhere" in g for g in got)), ("suggestion", any("did you mean filter" in g for g in got)), ("prompts", len(asked))])


# --- command line and tools


@query("cli_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf): return cli.sql(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", f"{sf}/orders.parquet")


@query("cli_diff", """
SELECT 'changed' AS change, o_orderkey FROM orders WHERE o_orderkey % 10 = 3 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'removed', o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0
UNION ALL SELECT 'added', o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0""")  # fmt: skip
def _(spark, sf):
    o = orders(spark, sf)
    left = Frame(o.df.filter("o_orderkey % 11 != 0"), o.order)
    right = Frame(o.df.filter("o_orderkey % 7 != 0").withColumn("o_totalprice", F.when(F.expr("o_orderkey % 10 = 3"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), o.order)
    return cli.diff(left, right, ["o_orderkey"]).select("change", "o_orderkey")


@query("cli_convert_cat", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = shared(spark, "nation.parquet")
    files.save(frame(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    cli.convert(spark, path, shared(spark, "nation.ndjson"))
    cli.convert(spark, shared(spark, "nation.ndjson"), shared(spark, "nation2.parquet"))
    return cli.cat(spark, shared(spark, "nation.ndjson"), shared(spark, "nation2.parquet")).select(col("n_nationkey").cast("i32"), "n_name")


@query("cli_prints", facts_sql({"schema": "'r_regionkey: int'", "count": "5", "head": "3", "tail": "3", "peek": "3", "sample": "4", "stats": "10", "nulls": "2", "run": "3", "profile": "'True'", "explain": "'True'"}))
def _(spark, sf):
    path, text = f"{sf}/region.parquet", shared(spark, "run.txt")
    _write(text, f"load {path}\nlimit 2\nshow\n")

    def out(*argv: str) -> str:
        held = io.StringIO()
        with contextlib.redirect_stdout(held):
            cli.main(list(argv))
        return held.getvalue().strip("\n")

    lines = lambda *argv: len(out(*argv).split("\n"))
    return facts(spark, [("schema", out("schema", path).split("\n")[0]), ("count", out("count", path)), *[(c, lines(c, path, "2")) for c in ("head", "tail", "peek")], ("sample", lines("sample", path, "3")), ("stats", lines("stats", path)), ("nulls", lines("nulls", path)),
                         ("run", lines("run", text)), ("profile", " ms" in out("run", text, "--profile")), ("explain", "Scan" in out("explain", text))])


@query("tool_answers", facts_sql({"schema": "'o_orderkey bigint'", "head": "3", "sql": "(SELECT count(*) FROM orders)", "row_count": "(SELECT count(*) FROM orders)", "null_counts": "0", "describe": "9", "rest": "(SELECT count(*) FROM orders)"}))
def _(spark, sf):
    path = f"{sf}/orders.parquet"
    call = lambda tool, **k: tools.call(spark, tool, **k)
    pages, at = 0, 0
    while at is not None:
        page = call("rows", path=path, offset=at)
        pages, at = pages + len(page["rows"]), page["next"]
    first = call("schema", path=path)[0]
    return facts(spark, [("schema", f"{first['name']} {first['type']}"), ("head", len(call("head", path=path, n=3)["rows"])), ("sql", call("sql", query="SELECT count(*) AS n FROM orders", paths=[path])["rows"][0]["n"]), ("row_count", call("row_count", path=path)),
                         ("null_counts", call("null_counts", path=path)["o_orderkey"]), ("describe", len(call("describe", path=path)["rows"])), ("rest", pages)])
