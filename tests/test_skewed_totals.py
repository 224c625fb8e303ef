import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import skewed_totals
from quillon.operators.skewed_totals import dominant_keys, keyed_totals


def totals(spark, rows, parts=3, **k):
    df = spark.createDataFrame(rows, "k string, v long, key string, n long").repartition(parts)
    return {r["key"]: (r["n"], r["n_values"], None if r["total"] is None else int(r["total"])) for r in keyed_totals(df, F.col("k"), F.col("v"), **k).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + [None] + [f"t{i}" for i in range(300)]), rng.choice([None, -3, 7, 2**62]), "clash", 1) for _ in range(5000)]
    want = {}
    for k, v, *_ in rows:
        n, m, t = want.get(k, (0, 0, 0))
        want[k] = (n + 1, m + (v is not None), t + (v or 0))
    want = {k: (n, m, t if m else None) for k, (n, m, t) in want.items()}
    assert totals(spark, rows) == want
    assert totals(spark, rows, parts=7) == want


def test_blocks_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr(skewed_totals, "BLOCK_KEYS", 2)
    rows = [(f"k{i % 5000}", i, "", 0) for i in range(12_000)]
    got = totals(spark, rows)
    assert len(got) == 5000 and sum(n for n, _, _ in got.values()) == 12_000 and sum(t for _, _, t in got.values()) == sum(range(12_000))


def test_floats_add_up_and_other_types_are_refused(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 1.5), ("b", None), ("c", float("nan")), ("c", 1.0)], "k string, v double")
    got = {r["key"]: r["total"] for r in keyed_totals(df, F.col("k"), F.col("v")).collect()}
    assert got["a"] == 3.0 and got["b"] is None and got["c"] != got["c"]
    for kind in ("string", "decimal(10,2)"):
        with pytest.raises(TypeError):
            keyed_totals(df, F.col("k"), F.col("v").cast(kind))


def test_edges(spark):
    assert totals(spark, []) == {}
    assert totals(spark, [(None, None, "", 0)]) == {None: (1, 0, None)}
    assert totals(spark, [("", 1, "", 0), ("", -1, "", 0)]) == {"": (2, 2, 0)}
    # sums beyond 64 bits stay exact
    assert totals(spark, [("a", 2**63 - 1, "", 0)] * 5) == {"a": (5, 5, 5 * (2**63 - 1))}
    assert totals(spark, [("a", -(2**63), "", 0)] * 3) == {"a": (3, 3, -3 * 2**63)}
    long_ = "k" * 300_000
    assert totals(spark, [(long_, 1, "", 0)]) == {long_: (1, 1, 1)}


def test_dominant_keys_count_null_rows_in_the_total(spark):
    t = spark.createDataFrame([("a", 2), ("b", 1), (None, 97)], "key string, n long")
    assert [r["key"] for r in dominant_keys(t, 2).collect()] == ["a"]
