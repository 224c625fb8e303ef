import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import percentiles as P

QS = [0.0, 0.25, 0.5, 0.99, 1.0]
SCHEMA = "g string, v double, i long, grp long, bits string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", 9) for r in rows], SCHEMA)


def got(out):
    res = {}
    for r in out.collect():
        res.setdefault(r["grp"], {"n": r["n"]})[r["q"]] = r["value"]
    return res


def agrees(found, rows):
    by = {}
    for g, v, i in set(rows):
        if g is not None and v is not None and i is not None and not math.isnan(v):
            by.setdefault(g, []).append(v)
    assert set(found) == set(by)
    for g, vs in by.items():
        assert found[g]["n"] == len(vs)
        for q in QS:
            want = float(np.quantile(np.array(vs), q))
            assert found[g][q] == pytest.approx(want, rel=1e-12, abs=1e-300), (g, q)


def rows_of(rng, n=3000):
    value = lambda: rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 9), -rng.lognormvariate(0, 9), 7.0, 7.0, 0.0, -0.0, 5e-324, 1.7e308])
    rows = [(rng.choice(["hot"] * 5 + [f"t{k}" for k in range(50)]), value(), i) for i in range(n)]
    return rows + rows[::7] + [(None, 1.0, 1), ("hot", None, -1), ("hot", float("nan"), -2), ("hot", 3.0, None), ("one", 4.0, -3)]


def test_exact_for_light_and_heavy_groups(spark):
    rows = rows_of(random.Random(3))
    for piece_rows in (100, 10**6):
        agrees(got(P.percentiles(frame(spark, rows), F.col("g"), F.col("v"), QS, F.col("i"), piece_rows=piece_rows)), rows)


def test_pieces_follow_the_rows_of_a_group(spark):
    rows = [("hot", float(i), i) for i in range(1000)] + [(f"t{i}", 1.0, i) for i in range(100)]
    records, _ = P.records(frame(spark, rows), F.col("g"), F.col("v"), F.col("i"), 100)
    sizes = sorted(r["count"] for r in records.filter("grp = 'hot'").groupBy("__piece").count().collect())
    assert len(sizes) == 10 and sizes[-1] < 200


def test_order_preserving_bits(spark):
    rng = random.Random(8)
    vs = [-math.inf, -1.7e308, -2.0, -5e-324, 0.0, 5e-324, 1.0, 2.0, 1.7e308, math.inf, 2.2250738585072014e-308, 2.225073858507201e-308]
    vs += [math.ldexp(1.0, e) * f for e in range(-1070, 1023, 3) for f in (1.0, 1.0 - 2**-53, -1.0 - 2**-52, rng.random())]
    out = P.with_ordered_bits(spark.createDataFrame([(v,) for v in vs], "v double"), "v").select("v", "bits", P.from_ordered_bits(F.col("bits")).alias("w")).collect()
    for r in out:
        raw = int(np.array([r["v"] + 0.0]).view("int64")[0])
        assert r["bits"] == (raw if raw >= 0 else raw ^ 0x7FFFFFFFFFFFFFFF), r["v"]
        assert r["w"] == r["v"]


def test_without_id_and_least_count(spark):
    rows = [("a", float(x), None) for x in (1, 2, 2, 4)] + [("b", 1.0, None)]
    assert got(P.percentiles(frame(spark, rows), F.col("g"), F.col("v"), [0.5], min_count=2)) == {"a": {"n": 4, 0.5: 2.0}}
    assert got(P.percentiles(frame(spark, []), F.col("g"), F.col("v"), [0.5])) == {}
    assert got(P.percentiles(frame(spark, [("a", None, 1)]), F.col("g"), F.col("v"), [0.5])) == {}
    assert got(P.percentiles(frame(spark, [("", math.inf, 1), ("", math.inf, 2)]), F.col("g"), F.col("v"), [0.5]))[""][0.5] == math.inf


def test_summaries_of_parts_add_up(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.lognormvariate(3, 2), i) for i in range(2000)]
    parts = []
    for k in range(3):
        parts.append(P.histogram(P.records(frame(spark, rows[k::3]), F.col("g"), F.col("v"), F.col("i"))[0]))
    found = got(P.from_summary(P.merge(*parts), QS))
    for g in "ab":
        vs = np.array([v for x, v, _ in rows if x == g])
        assert found[g]["n"] == len(vs)
        for q in QS:
            assert found[g][q] == pytest.approx(float(np.quantile(vs, q)), rel=2**-11)
