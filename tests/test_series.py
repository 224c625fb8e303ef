import datetime as dt

import pyarrow as pa
import pytest

from quillon import Frame, Series, col
from quillon.sources import files


def test_series(spark):
    s = Series.from_values(spark, "v", [3, 1, 9, 2], "i64", [True, True, False, True])
    assert s.to_list() == [3, 1, None, 2] and len(s) == 4 and s.has_nulls() and s.dtype == "bigint"
    assert (s * 2 + s).to_list() == [9, 3, None, 6] and (s > 1).to_list() == [True, False, None, True]
    assert s.filter(s > 1).to_list() == [3, 2] and s.sum() == 6.0 and s.cum_sum().to_list() == [3, 4, None, 6]
    assert s.apply(lambda v: f"<{v}>", "str").to_list() == ["<3>", "<1>", None, "<2>"] and s.sort().to_list() == [1, 2, 3, None]
    assert s.index_of(2) == 3 and s.get(1) == 1 and s.append(s).rename("w").name == "w"
    assert Series.from_times(spark, "t", [1, None], "ms").to_list() == [dt.datetime(1970, 1, 1, 0, 0, 0, 1000), None]
    assert Series.from_arrow(spark, "a", pa.array(["x"]), pa.array(["y", None])).expr(lambda c: c.str.upper()).to_list() == ["X", "Y", None]
    with pytest.raises(ValueError):
        Series.from_values(spark, "v", [1], valid=[])
    with pytest.raises(KeyError):
        Series.of(Frame.from_map(spark, {"a": [1]}), "b")
    with pytest.raises(AttributeError):
        s.nothing()


def test_bounded_rows_by_position(spark, monkeypatch):
    """Large heads, slices and samples are cut by position, with the same rows."""
    from quillon import order

    f = Frame.from_map(spark, {"v": list(range(500))}).sort("v", True)
    small = [f.head(40).to_map(), f.slice(30, 50).to_map(), f.tail(20).to_map(), f.sample(60, seed=2).to_map()]
    monkeypatch.setattr(order, "BLOCK_ROWS", 16)
    assert [f.head(40).to_map(), f.slice(30, 50).to_map(), f.tail(20).to_map(), f.sample(60, seed=2).to_map()] == small
    assert "TakeOrdered" not in f.slice(30, 50).df._jdf.queryExecution().executedPlan().toString()
    drawn = f.sample(700, True, 3).to_map()["v"]
    assert len(drawn) == 700 and drawn == sorted(drawn, reverse=True) and len(set(drawn)) < 500


def test_quantiles_of_a_dominant_key(spark):
    f = Frame.from_map(spark, {"k": ["hot" if i % 3 else None for i in range(300)] + ["none"], "v": [float(i % 37) for i in range(300)] + [None]})
    got = {r["k"]: (r["m"], r["q"]) for r in f.group_by("k").agg(col("v").median().alias("m"), col("v").quantile(0.9).alias("q")).collect()}
    import numpy as np

    for key, keep in (("hot", lambda i: i % 3), (None, lambda i: not i % 3)):
        vs = [i % 37 for i in range(300) if keep(i)]
        assert got[key] == pytest.approx((np.median(vs), np.quantile(vs, 0.9)))
    assert got["none"] == (None, None)


def test_order_over_several_files(spark, tmp_path):
    rows = [(i, f"n{i}") for i in range(3000)]
    for kind, write in (("parquet", lambda w, p: w.parquet(p)), ("csv", lambda w, p: w.option("header", True).csv(p)), ("ndjson", lambda w, p: w.json(p))):
        path = str(tmp_path / f"o.{kind}")
        for a, b in ((0, 5), (5, 40), (40, 3000)):
            write(spark.createDataFrame(rows[a:b], "i long, n string").coalesce(1).write.mode("append"), path)
        names = sorted((tmp_path / f"o.{kind}").glob("part-*"), key=lambda p: p.stat().st_size)
        for k, p in enumerate(names):
            p.rename(p.with_name(f"f{k}{p.suffix}"))
        for crc in (tmp_path / f"o.{kind}").glob(".part-*"):
            crc.unlink()
        assert files.scan(spark, path).to_map()["i"] == list(range(3000))
        assert files.scan(spark, path).slice(38, 4).to_map()["i"] == [38, 39, 40, 41]


def test_refused_arguments():
    for alpha in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            col("v").ewm_mean(alpha)
