import datetime as dt
import random

from pyspark.sql import functions as F

from quillon.operators import regular_grid as rg

T0 = dt.datetime(2026, 3, 2)
SCHEMA = "id long, ts timestamp_ntz, s string, p double, source string, slot long"


def series(spark, rows, gap=4, shard_days=1, piece_rows=1000):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    knots = rg.slot_knots(df, F.col("s"), F.col("ts"), F.col("p"), "id", 1800, shard_days, piece_rows)
    return {(r["source"], r["slot"]): (r["n"], r["value"], r["state"]) for r in rg.regular_series(knots, 1800, gap).collect()}


def pchip(x, y, at):
    """Shape-preserving cubic through knots, written independently."""
    n = len(x)
    h = [x[i + 1] - x[i] for i in range(n - 1)]
    s = [(y[i + 1] - y[i]) / h[i] for i in range(n - 1)]

    def edge(h0, h1, s0, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if d * s0 <= 0:
            return 0.0
        return 3 * s0 if s0 * s1 <= 0 and abs(d) > 3 * abs(s0) else d

    if n == 2:
        m = [s[0], s[0]]
    else:
        m = [edge(h[0], h[1], s[0], s[1])]
        for i in range(1, n - 1):
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m.append(0.0 if s[i - 1] * s[i] <= 0 else (w0 + w1) / (w0 / s[i - 1] + w1 / s[i]))
        m.append(edge(h[-1], h[-2], s[-1], s[-2]))
    i = max(k for k in range(n - 1) if x[k] <= at)
    u = (at - x[i]) / h[i]
    return (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h[i] * m[i] + u * u * (3 - 2 * u) * y[i + 1] + u * u * (u - 1) * h[i] * m[i + 1]


def test_interpolation_equals_a_plain_implementation(spark):
    rng = random.Random(2)
    slots = sorted(rng.sample(range(46), 22))
    rows = [(i, T0 + dt.timedelta(seconds=1800 * k + 900), "A", float(rng.randrange(1, 90))) for i, k in enumerate(slots)]
    got = series(spark, rows, gap=60)
    x, y = [1800.0 * k + 900 for k in slots], [r[3] for r in rows]
    assert len(got) == slots[-1] - slots[0] + 1
    for k in range(slots[0], slots[-1] + 1):
        n, v, state = got["A", T0 + dt.timedelta(seconds=1800 * k)]
        assert state == ("observed" if k in slots else "filled") and n == (k in slots)
        assert abs(v - pchip(x, y, 1800.0 * k + 900)) < 1e-9


def test_shards_change_nothing(spark):
    """Slopes at the end of a shard use the nearest knots beyond it, and slots between shards are filled."""
    rng = random.Random(4)
    slots = sorted([*rng.sample(range(48 * 9), 40), *range(48 * 30, 48 * 30 + 5)])
    rows = [(i, T0 + dt.timedelta(seconds=1800 * k + 900), "A", float(rng.randrange(1, 90))) for i, k in enumerate(slots)]
    x, y = [1800.0 * k + 900 for k in slots], [r[3] for r in rows]
    for days in (1, 21):
        got = series(spark, rows, gap=10_000, shard_days=days)
        assert len(got) == slots[-1] - slots[0] + 1
        for k in range(slots[0], slots[-1] + 1):
            n, v, state = got["A", T0 + dt.timedelta(seconds=1800 * k)]
            assert state == ("observed" if k in slots else "filled") and abs(v - pchip(x, y, 1800.0 * k + 900)) < 1e-8


def test_slots_between_days_come_out(spark):
    rows = [(i, T0 + dt.timedelta(hours=h), "A", float(i)) for i, h in enumerate((22.25, 23.25, 25.25, 26.25))]
    got = series(spark, rows, gap=6)
    assert [got["A", T0 + dt.timedelta(hours=h)][2] for h in (23.5, 24, 24.5)] == ["filled"] * 3 and len(got) == 9


def test_gaps_repeats_and_ties(spark):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    rows = [(1, m(5), "A", 2.0), (1, m(5), "A", 2.0), (2, m(5), "A", 4.0), (3, m(300), "A", 8.0), (4, m(10), "B", 1.0), (5, m(10), None, 1.0), (6, None, "A", 1.0), (7, m(10), "A", None), (None, m(10), "A", 3.0)]
    got = series(spark, rows)
    assert got["A", m(0)] == (2, 3.0, "observed") and got["A", m(30)] == (0, None, "gap") and got["B", m(0)] == (1, 1.0, "observed")
    assert len(got) == 12
    assert series(spark, []) == {}


def test_hot_source_is_split(spark):
    rows = [(i, T0 + dt.timedelta(seconds=40 * i), "A" if i % 3 else f"t{i}", float(i % 13)) for i in range(900)]
    rows += rows[::5]
    close = lambda a: {k: (n, None if v is None else round(v, 9), s) for k, (n, v, s) in a.items()}
    assert close(series(spark, rows, piece_rows=50)) == close(series(spark, rows))
