import random

from pyspark.sql import functions as F

from quillon.llm.top_items import top_n

SCHEMA = "g string, s long, i long, grp long, score string, rank long"


def best(spark, rows, n=3, schema=SCHEMA, **k):
    df = spark.createDataFrame([(*r, 0, "clash", 9) for r in rows], schema)
    out = top_n(df, F.col("g"), F.col("s"), F.col("i"), n, **k).collect()
    return sorted((r["grp"], r["rank"], r["item_id"], r["score"]) for r in out)


def brute(rows, n=3):
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        items = sorted({(-s, i) for x, s, i in rows if x == g and s is not None and i is not None})
        out += [(g, k + 1, i, -s) for k, (s, i) in enumerate(items[:n])]
    return sorted(out)


def test_hot_and_cold_groups_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["warm"] * 3 + [f"t{k}" for k in range(60)]), rng.choice([5, 5, 5, 5, 9, 1, None, -2]), rng.randrange(700)) for _ in range(4000)]
    rows += rows[:500] + [(None, 99, 1), ("hot", None, 2), ("none", None, 3), ("hot", 99, None)]
    want = brute(rows)
    for piece_rows in (50, 1000, 10**6):
        assert best(spark, rows, piece_rows=piece_rows) == want
    assert best(spark, rows, 40) == brute(rows, 40)


def test_edges(spark):
    assert best(spark, []) == []
    assert best(spark, [("a", None, 1)]) == []
    assert best(spark, [("", 1, 1), ("", 1, 1), ("x" * 100_000, 1, 5)]) == [("", 1, 1, 1), ("x" * 100_000, 1, 5, 1)]


def test_float_scores(spark):
    nan = float("nan")
    rows = [("a", nan, 1), ("a", 1.5, 2), ("a", float("inf"), 3), ("a", None, 4)]
    got = best(spark, rows, schema=SCHEMA.replace("s long,", "s double,", 1))
    assert [r[2] for r in got] == [3, 2]
