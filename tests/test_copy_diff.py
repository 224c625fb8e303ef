import datetime as dt
import math
import random

from quillon.operators import copy_diff
from quillon.operators.copy_diff import diff_copies

SCHEMA = "id long, ts timestamp_ntz, price double, qty long, note string"
T0 = dt.datetime(2026, 3, 2, 9, 30)
NAN = float("nan")


def found(spark, a, b, key="id", schema=SCHEMA, fields=("ts", "price", "qty"), **k):
    out = diff_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), key, list(fields), {"price": 0.00005}, names=("a", "b"), **k)
    return sorted((r[0], r["what"]) for r in out.collect())


def test_each_kind_of_difference(spark):
    a = [(1, T0, 1.0, 5, "x"), (2, T0, 1.0, 5, "x"), (3, T0, 1.0, 5, "x"), (4, None, NAN, None, "x"), (5, T0, 2.0, 5, "x"), (6, T0, None, 5, "x"), (7, T0, math.inf, 1, "x")]
    b = [(1, T0, 1.00004, 5, "y"), (2, T0, 1.0001, 6, "x"), (9, T0, 1.0, 5, "x"), (4, None, NAN, None, "x"), (5, T0 + dt.timedelta(1), NAN, None, "x"), (6, T0, NAN, 5, "x"), (7, T0, math.inf, 1, "x")]
    assert found(spark, a, b) == [(2, "price"), (2, "qty"), (3, "only_a"), (5, "price"), (5, "qty"), (5, "ts"), (6, "price"), (9, "only_b")]


def test_repeats_null_keys_and_empty_copies(spark):
    row = (1, T0, 1.0, 5, "x")
    assert found(spark, [row, row, row], [row]) == []
    assert found(spark, [row, row], []) == [(1, "only_a")]
    assert found(spark, [], [row, row]) == [(1, "only_b")]
    assert found(spark, [], []) == []
    assert found(spark, [(None, T0, 1.0, 5, "x"), row], [row]) == []
    # repeats that disagree: the smallest non-null value stands for the key
    assert found(spark, [(1, T0, 1.0, 7, "x"), row], [row]) == []
    assert found(spark, [(1, T0, 1.0, None, "x"), row], [row]) == []


def test_values_shown_and_clashing_names(spark):
    s = "what string, left_value long, __b long, __side string, __word long"
    a, b = spark.createDataFrame([("k", 1, 1, "u", 0)], s), spark.createDataFrame([("k", 2, 1, "v", 0)], s)
    out = diff_copies(a.withColumnRenamed("what", "key"), b.withColumnRenamed("what", "key"), "key", ["left_value", "__b"]).collect()
    assert [tuple(r) for r in out] == [("k", "left_value", "1", "2")]


def test_string_keys_and_long_texts(spark):
    s = "k string, v string"
    long_ = "x" * 200_000
    a = [(f"k{i}", str(i)) for i in range(500)] + [("", long_), ("n", None)]
    b = [(f"k{i}", str(i if i != 77 else 0)) for i in range(500)] + [("", long_ + "y"), ("n", "")]
    assert found(spark, a, b, "k", s, ("v",)) == [("", "v"), ("k77", "v"), ("n", "v")]


def test_a_bitmap_of_any_size_gives_the_same(spark):
    rng = random.Random(5)
    a = [(i, T0, float(rng.randrange(9)), rng.randrange(9), "") for i in range(-300, 9000)]
    b = [(i, t, p + (i % 97 == 0), q + (i % 89 == 0), n) for i, t, p, q, n in a if i % 83]
    brute = {(i, "only_a") for i, *_ in a if not i % 83} | {(r[0], "price") for r in b if r[0] % 97 == 0} | {(r[0], "qty") for r in b if r[0] % 89 == 0}
    for k in ({}, {"max_words": 1}, {"levels": (3,)}, {"levels": (6, 2, 0), "max_words": 3}):
        assert set(found(spark, a, b, **k)) == brute


def test_composite_keys(spark):
    s = "g string, i long, v long"
    a = [(g, i, i) for g in ("", "x", "y") for i in range(100)] + [(None, 1, 1), ("x", None, 1)]
    b = [(g, i, i + ((g, i) == ("y", 7))) for g, i, _ in a if g is not None and i is not None and (g, i) != ("x", 3)] + [("x", None, 1), ("z", 1, 1)]
    out = diff_copies(spark.createDataFrame(a, s), spark.createDataFrame(b, s), ["g", "i"], ["v"]).collect()
    assert sorted(tuple(r) for r in out) == [("x", 3, "only_left", None, None), ("y", 7, "v", "7", "8"), ("z", 1, "only_right", None, None)]


def test_only_unequal_buckets_are_read_again(spark, tmp_path):
    a = spark.range(10_000).selectExpr("id", "id * 2 AS v")
    b = a.selectExpr("id", "CASE WHEN id = 4242 THEN -1 ELSE v END AS v")
    p, q = (copy_diff.plain(d, ["id"], ["v"]) for d in (a, b))
    coarse, fine = copy_diff.key_buckets(p, q, 1)
    cells = copy_diff.unequal_buckets(p, q, [None], fine).collect()
    assert [(r["bucket"], r["f_key"], r["f_0"]) for r in cells] == [(4242 >> 3, False, True)]
    words = copy_diff.bitmap(p, q, [None], coarse, 64)
    assert copy_diff.marked(p, words, coarse, 1, 64).count() == 8192
    # one shuffle, of the rows that are compared
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    plan = diff_copies(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")), "id", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
