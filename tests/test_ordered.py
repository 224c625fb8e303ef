"""Order-dependent functions over many blocks, against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import Frame, col, order


@pytest.fixture(params=[7, 1 << 16])
def blocks(request, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_ROWS", request.param)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": rng.permutation(60), "v": rng.integers(-9, 9, 60).astype(float)})
    pdf.loc[rng.random(60) < 0.3, "v"] = np.nan
    pdf.loc[20:34, "v"] = np.nan
    rows = [(int(i), None if math.isnan(v) else v) for i, v in zip(pdf.i, pdf.v, strict=True)]
    frame = Frame.of(spark.createDataFrame(rows, "i long, v double").repartition(3), ["i"])
    return frame, pdf.sort_values("i").v.reset_index(drop=True)


def values(f, *exprs):
    out = f.select("i", *[e.alias(f"x{k}") for k, e in enumerate(exprs)]).to_df().orderBy("i").toPandas()
    return [pd.Series(out[f"x{k}"].to_numpy(dtype=float, na_value=np.nan)) for k in range(len(exprs))]


def test_neighbours_and_running_functions(blocks, data):
    f, s = data
    v = col("v")
    got = values(
        f, v.shift(3), v.shift(-2), v.diff(), v.cum_sum(), v.cum_min(), v.cum_max(), v.cum_count(), v.forward_fill(), v.backward_fill(), v.forward_fill(2), v.backward_fill(2),
        v.rolling_sum(5, 2), v.rolling_mean(5, 2), v.rolling_std(5, 2), v.rolling_max(5, 2), v.ewm_mean(0.3),
    )
    r = s.rolling(5, min_periods=2)
    want = [
        s.shift(3), s.shift(-2), s.diff(), s.cumsum(), s.cummin(), s.cummax(), s.notna().cumsum().astype(float), s.ffill(), s.bfill(), s.ffill(limit=2), s.bfill(limit=2),
        r.sum(), r.mean(), r.std(), r.max(), s.ewm(alpha=0.3, ignore_na=True).mean().where(s.notna()),
    ]
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_ewm_variance(blocks, data):
    f, s = data
    var, std = values(f, col("v").ewm_var(0.4), col("v").ewm_std(0.4))
    want = s.ewm(alpha=0.4, ignore_na=True).var().where(s.notna())
    want[s.notna().idxmax()] = 0.0  # the first value has variance 0
    np.testing.assert_allclose(var, want, atol=1e-8)
    np.testing.assert_allclose(std, np.sqrt(want), atol=1e-6)


def test_ranks(blocks, data):
    f, s = data
    methods = {"average": "average", "min": "min", "max": "max", "dense": "dense", "ordinal": "first"}
    for ours, theirs in methods.items():
        np.testing.assert_allclose(values(f, col("v").rank(ours))[0], s.rank(method=theirs))


def test_rolling_example_and_small_windows(spark):
    f = Frame.from_map(spark, {"x": [1, 2, 3, 4, 5]})
    assert [r[0] for r in f.select(col("x").rolling_sum(3)).collect()] == [None, None, 6, 9, 12]
    assert math.isnan(f.select(col("x").rolling_std(3, 1)).collect()[0][0])
    assert [r[0] for r in f.select(col("x").ewm_mean(0.5)).collect()][:2] == [1.0, pytest.approx(5 / 3)]


def test_dense_index_and_positions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") % 10)
    got = {r["id"]: r["__i"] for r in order.dense_index(df, [F.desc("k"), F.asc("id")]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert got == {x: i for i, x in enumerate(want)}
    assert order.dense_index(df.limit(0), [F.asc("id")]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_is_exact(spark, blocks, q):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 40, 101).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    assert order.quantile_frame(df, "v", q).first()[0] == pytest.approx(float(np.quantile(v, q)))
    assert order.quantile_frame(df.filter("v is null"), "v", q).first()[0] is None
