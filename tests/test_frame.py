"""Semantics of frames where they differ from Spark's defaults."""

import math

import pytest

from quillon import Frame, coalesce, col, concat, concat_str, lit, selectors, when

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def f(spark):
    return Frame.from_map(spark, {"k": ["a", None, "a", "b", None], "x": [1, None, -3, 4, 5], "y": [1.0, NAN, None, 0.0, INF]})


def rows(f):
    return [tuple(r) for r in f.collect()]


def column(f, e):
    return [r[0] for r in f.select(e.alias("o")).collect()]


def test_order_is_kept_through_operations(spark, f):
    assert rows(f.select("x")) == [(1,), (None,), (-3,), (4,), (5,)]
    assert column(f.sort("x", True), col("x")) == [5, 4, 1, -3, None]
    assert column(f.sort("x"), col("x")) == [-3, 1, 4, 5, None]
    assert column(f.sort_by(["x"], [False], [True]), col("x")) == [None, -3, 1, 4, 5]
    assert column(f.sort("k"), col("x")) == [1, -3, 4, None, 5]  # stable
    assert column(f.reverse().head(2), col("x")) == [5, 4]
    assert column(f.tail(2), col("x")) == [4, 5]
    assert column(f.slice(1, 3), col("x")) == [None, -3, 4] and column(f.slice(4, 9), col("x")) == [5]
    assert column(f.head(3).filter(col("x") > 0), col("x")) == [1]
    assert column(f.gather([4, 0, 0]), col("x")) == [5, 1, 1]
    assert sorted(column(f.shuffle(1), col("x").fill_null(0))) == [-3, 0, 1, 4, 5]
    assert len(rows(f.sample(3, seed=1))) == 3 and len(rows(f.sample(9, True, 1))) == 9
    with pytest.raises(ValueError):
        f.sample(9)


def test_filters_below_order_dependent_columns_keep_their_meaning(spark):
    f = Frame.from_map(spark, {"x": [1, 2, 3, 4]})
    out = f.with_columns(col("x").cum_sum().alias("s")).filter(col("x") > 2)
    assert rows(out) == [(3, 6), (4, 10)]
    assert rows(f.with_columns((col("x") * 10).alias("x")).filter(col("x") > 20)) == [(30,), (40,)]
    assert rows(f.with_columns(col("x").shift(-1).alias("n")).head(2)) == [(1, 2), (2, 3)]
    assert rows(f.select(col("x").alias("y")).filter(col("y") > 3)) == [(4,)]


def test_nan_and_null_in_comparisons(f):
    assert column(f, col("y") > 0.5) == [True, False, None, False, True]
    assert column(f, col("y") == col("y")) == [True, False, None, True, True]
    assert column(f, col("y") != 1.0) == [False, True, None, True, True]
    assert column(f, col("x").is_in(1, 4)) == [True, None, False, True, False] and column(f, col("x").is_in()) == [False] * 5
    assert column(f, when(col("x") > 0).then("p").otherwise("n")) == ["p", "n", "n", "p", "p"]


def test_division_logs_and_casts(spark):
    f = Frame.from_map(spark, {"a": [7, -7, 1, None], "b": [2, 2, 0, 1], "s": ["1", "x", None, "9" * 30]})
    assert column(f, col("a") / col("b")) == [3, -3, None, None]
    got = column(f, col("a").cast("f64") / col("b").cast("f64"))
    assert got == [3.5, -3.5, INF, None]
    got = column(f, col("a").log())
    assert got[0] == pytest.approx(math.log(7)) and math.isnan(got[1]) and got[3] is None
    assert column(f, (col("a") - 1).log())[2] == -INF
    assert column(f, col("s").cast("i64")) == [1, None, None, None]
    assert column(f, (col("a").cast("f64") / 2.0).cast("i64")) == [3, -3, 0, None]


def test_aggregates_of_nothing(f):
    got = f.filter(lit(False)).select(*[getattr(col("x"), o)().alias(o) for o in ("sum", "mean", "count", "std", "any", "all", "product", "arg_min")]).collect()[0].asDict()
    assert math.isnan(got.pop("std"))
    assert got == {"sum": 0, "mean": None, "count": 0, "any": False, "all": True, "product": 1.0, "arg_min": -1}


def test_aggregates_that_need_the_row_order(spark, f):
    one = lambda f, *ops: rows(f.select(*[getattr(col("x"), o)().alias(o) for o in ops]))
    every = ("first", "arg_min", "count", "arg_max", "last")
    assert one(f, *every) == [(1, 2, 4, 4, 5)]
    assert one(f, "first", "last") == [(1, 5)] and one(f, "arg_max") == [(4,)]
    assert one(f.sort("x", True), *every) == [(5, 3, 4, 0, None)] and one(f.reverse(), *every) == [(5, 2, 4, 0, 1)]
    ties = Frame.from_map(spark, {"x": [None, NAN, 2.0, 1.0, 2.0, 1.0]})  # the first of equals; null and NaN are no extremes
    assert one(ties, "arg_min", "arg_max") == [(3, 2)] and one(ties.reverse(), "arg_min", "arg_max") == [(0, 1)]
    nulls = Frame.from_map(spark, {"x": [1, None]}).filter(col("x").is_null())
    assert one(nulls, "arg_min", "arg_max") == [(-1, -1)]
    assert rows(f.select((col("x").arg_max() - col("x").arg_min()).alias("d"))) == [(2,)]


def test_group_by(f):
    out = f.group_by("k").agg(col("x").sum().alias("s"), col("x").first().alias("f"), col("x").last().alias("l"), col("x").null_count().alias("n"))
    assert rows(out) == [("a", -2, 1, -3, 0), (None, 5, None, 5, 1), ("b", 4, 4, 4, 0)]  # first seen first
    with pytest.raises(ValueError):
        f.group_by("k").agg(col("x"))


def test_over_keeps_rows_and_null_keys(f):
    assert column(f, col("x").sum().over("k")) == [-2, 5, -2, 4, 5]
    assert column(f, (col("x") - col("x").max()).over("k")) == [0, None, -4, 0, 0]
    assert column(f, col("x").cum_count().over("k")) == [1, 0, 2, 1, 1]


def test_joins(spark):
    a = Frame.from_map(spark, {"k": [1, 2, 3, 4, None], "v": [1, 2, 3, 4, 5]})
    b = Frame.from_map(spark, {"k": [2, 3, 5, None], "v": [20, 30, 50, 60]})
    assert rows(a.join(b, "k")) == [(2, 2, 20), (3, 3, 30)]
    assert rows(a.join(b, "k", "left")) == [(1, 1, None), (2, 2, 20), (3, 3, 30), (4, 4, None), (None, 5, None)]
    assert a.join(b, "k", suffix="_b").columns == ["k", "v", "v_b"]
    assert len(rows(a.join(b, [], "cross"))) == 20 and a.join(b, [], "cross").columns == ["k", "v", "k_right", "v_right"]
    assert rows(a.join(b, "k", "anti")) == [(1, 1), (4, 4), (None, 5)]
    c = Frame.from_map(spark, {"k": [NAN, 1.0]})
    assert rows(c.join(c, "k")) == [(1.0,)]


def test_reshaping(spark):
    f = Frame.from_map(spark, {"id": ["A", "A", "B", "B"], "c": ["x", "y", "x", "y"], "v": [1, 2, 3, 4]})
    assert rows(f.pivot(["id"], "c", "v")) == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]
    assert rows(Frame.from_map(spark, {"id": ["p", "q"], "a": [1, 2], "b": [3, 4]}).unpivot(["id"])) == [("p", "a", 1.0), ("q", "a", 2.0), ("p", "b", 3.0), ("q", "b", 4.0)]
    assert rows(Frame.from_map(spark, {"a": [1, 2], "b": [3, 4]}).transpose()) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    e = Frame(spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [10, 20])], "id long, v array<long>").coalesce(1))
    assert rows(e.explode("v")) == [(1, 1), (1, 2), (1, 3), (2, None), (3, None), (4, 10), (4, 20)]
    s = Frame(spark.createDataFrame([(1, (1, "a")), (2, None)], "id long, p struct<x:long,y:string>").coalesce(1))
    assert rows(s.unnest("p")) == [(1, 1, "a"), (2, None, None)]
    h = Frame.from_map(spark, {"a": [1, 2, None], "b": [10.0, None, None]})
    assert rows(h.sum_horizontal("s", "a", "b").select("s")) == [(11.0,), (2.0,), (None,)]
    assert rows(h.sum_horizontal("s", "a", "b", propagate=True).select("s")) == [(11.0,), (None,), (None,)]


def test_upsample(spark):
    import datetime as dt

    d = [dt.datetime(2026, 1, 1 + i) for i in (0, 2, 4)]
    f = Frame.from_map(spark, {"ts": d, "v": [1, 2, 3]})
    assert [r[1] for r in f.upsample("ts", "1d").collect()] == [1, None, 2, None, 3]
    assert len(f.upsample("ts", "12h").collect()) == 9
    assert [r[1] for r in f.upsample("ts", "3d").collect()] == [1, None]
    with pytest.raises(ValueError):
        f.upsample("ts", "1mo")


def test_strings(spark):
    f = Frame.from_map(spark, {"s": ["héllo wörld", "", None, "a.b.c"]})
    c = col("s").str
    assert column(f, c.len_bytes()) == [13, 0, None, 5] and column(f, c.len_chars()) == [11, 0, None, 5]
    assert column(f, c.find("w")) == [7, -1, None, -1]
    assert column(f, c.count_matches(".")) == [0, 0, None, 2] and column(f, c.replace(".", "")) == ["héllo wörld", "", None, "ab.c"]
    assert column(f, c.split_exact(".")) == [["héllo wörld"], [""], None, ["a", "b", "c"]]
    assert column(f, c.head(-3)) == ["héllo wö", "", None, "a."] and column(f, c.tail(-2)) == ["llo wörld", "", None, "b.c"]
    assert column(f, c.title()) == ["Héllo Wörld", "", None, "A.b.c"]
    assert column(f, concat_str("-", col("s"), lit("z"))) == ["héllo wörld-z", "-z", None, "a.b.c-z"]
    assert column(Frame.from_map(spark, {"s": ["-5", "+7", "123456", "x"]}), c.zfill(4)) == ["-005", "+007", "123456", "000x"]


def test_stats(spark):
    f = Frame.from_map(spark, {"a": [1, 2, 3, 4, 5], "b": [2.0] * 5, "s": ["x", None, "y", "y", "z"]})
    d = {r["statistic"]: r for r in f.describe().collect()}
    assert d["mean"]["a"] == 3.0 and d["50%"]["a"] == 3.0 and d["25%"]["a"] == 2.0 and d["null_count"]["s"] == "1" and d["std"]["b"] == 0.0
    assert f.pearson_corr("a", "a") == pytest.approx(1.0) and math.isnan(f.pearson_corr("a", "b")) and f.covariance("a", "a") == pytest.approx(2.5) and f.covariance("a", "a", 0) == pytest.approx(2.0)
    assert rows(f.mode("s")) == [("y",)] and f.index_of("a", 3) == 2 and f.index_of("a", 9) == -1 and f.search_sorted("a", 3) == 2
    assert f.is_sorted("a") and not f.is_sorted("a", True) and f.has_nulls("s") and f.first_non_null("s") == "x"
    assert math.isnan(f.filter(lit(False)).series_agg("a", "sum")) and f.series_agg("a", "sum") == 15.0


def test_columns_and_whole_frames(spark, f):
    assert f.select_by(selectors.numeric()).columns == ["x", "y"] and f.drop_by(selectors.strings()).columns == ["x", "y"]
    with pytest.raises(ValueError):
        f.rename("k", "x")
    with pytest.raises(ValueError):
        f.rename("none", "z")
    assert f.equals(f.select("k", "x", "y")) and not f.equals(f.reverse())
    assert rows(concat(f.select("x"), f.select("x").reverse()))[5:] == [(5,), (4,), (-3,), (None,), (1,)]
    assert rows(f.select("x").with_row_index("n", 10))[0] == (10, 1)
    assert rows(f.select("x").hstack(f.select(col("x").alias("z")).reverse()))[0] == (1, 5)
    assert rows(f.fill_null(0).fill_nan(9.0).select("x", "y"))[1:3] == [(0, 9.0), (-3, 0.0)]
    assert column(f, coalesce(col("x"), -1)) == [1.0, -1.0, -3.0, 4.0, 5.0]
    assert rows(f.null_count()) == [(2, 1, 1)] and f.shape() == (5, 3)
    assert f.estimated_size() > 0 and "x <bigint>" in f.glimpse()
    assert rows(f.map_values("x", lambda v: v + 1).select("x")) == [(2,), (None,), (-2,), (5,), (6,)]
    empty = Frame.empty(spark, "a long, b string")
    assert empty.is_empty() and rows(empty.sort("a").with_row_index("i")) == [] and rows(empty.group_by("b").agg(col("a").sum())) == []
