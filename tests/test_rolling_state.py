import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import rolling_state as rs

D = dt.date(2026, 3, 1)


def day(n):
    return D + dt.timedelta(n)


def brute(amounts):
    """{(entity, day): (qty, total_7, total_30)} of {(entity, day number): qty}."""
    out = {}
    for e in {k[0] for k in amounts}:
        days = [d for x, d in amounts if x == e]
        for d in range(min(days), max(days) + 1):
            total = lambda p, e=e, d=d: sum(amounts.get((e, x), 0) for x in range(d - p + 1, d + 1))
            out[e, day(d)] = (amounts.get((e, d), 0), total(7), total(30))
    return out


def staged(spark, amounts, version=0):
    return spark.createDataFrame([(e, day(d), version, q, 1) for (e, d), q in amounts.items()], "entity string, day date, version int, qty long, n long")


def loaded(spark, amounts, block, periods=(7, 30), ends_known=True):
    state = rs.RollingState(spark, periods, 2)
    state.stage(staged(spark, amounts), ends_known)
    for first, last in rs.day_blocks(state.staged_days(), block):
        state.advance(first, last)
    return state


def rows(state):
    got = state.collect()
    out = {(r["entity"], r["day"]): (r["qty"], r["total_7"], r["total_30"]) for r in got}
    assert len(out) == len(got)
    return out


def test_days_follow_from_days_before(spark):
    """Quiet days, gaps longer than the periods, blocks shorter and longer than the periods."""
    rng = random.Random(3)
    amounts = {(e, rng.randrange(120)): rng.randrange(-5, 50) for e in "abc" for _ in range(12)} | {("one", 5): 3, ("far", 0): 1, ("far", 400): 2}
    for block in (5, 28):
        assert rows(loaded(spark, amounts, block).current()) == brute(amounts)


def test_day_by_day_goes_on_without_an_end(spark):
    amounts = {("a", 0): 5, ("a", 3): 7, ("b", 1): 2, ("a", 6): 1}
    state = loaded(spark, amounts, 1, (2, 4), ends_known=False)
    state.advance(day(7), day(7))
    got = {(r["entity"], (r["day"] - D).days): (r["total_2"], r["total_4"]) for r in state.current().collect()}
    total = lambda e, d, p: sum(q for (x, k), q in amounts.items() if x == e and d - p < k <= d)
    assert got == {(e, d): (total(e, d, 2), total(e, d, 4)) for e, first in (("a", 0), ("b", 1)) for d in range(first, 8)}
    with pytest.raises(ValueError, match="ends on"):
        state.advance(day(9), day(9))


def test_corrections_make_a_new_version(spark):
    rng = random.Random(4)
    for trial in range(2):
        amounts = {(e, rng.randrange(20, 90)): rng.randrange(1, 50) for e in "ab" for _ in range(8)}
        fixes = {(e, rng.randrange(130)): rng.randrange(-5, 50) for e in ("a", "b", "new")[trial:] for _ in range(3)}
        state = loaded(spark, amounts, 28)
        old = rows(state.current())
        state.stage(staged(spark, fixes, 1))
        state.correct(1)
        whole = dict(amounts)
        for k, v in fixes.items():
            whole[k] = whole.get(k, 0) + v
        assert rows(state.current()) == brute(whole)
        # only dates in reach of a correction, or new ones, are written again
        new = [(r["entity"], r["day"]) for r in state.table.read().filter("version = 1").collect()]
        for e, d in new:
            assert (e, d) not in old or any(x == e and 0 <= (d - day(k)).days < 30 for x, k in fixes)


def test_stored_state_is_read_without_a_shuffle(spark):
    state = loaded(spark, {("a", 1): 1, ("b", 2): 2}, 28)
    assert "Exchange" not in state.current()._jdf.queryExecution().executedPlan().toString()


def test_nothing_staged(spark):
    assert rows(loaded(spark, {("a", 1): 1}, 28).current().limit(0)) == {}
    state = rs.RollingState(spark, (7, 30), 2)
    state.stage(staged(spark, {("a", 1): 1}).limit(0))
    assert state.staged_days() == [] and rows(state.current()) == {}
    # corrections alone
    state.stage(staged(spark, {("a", 1): 4, ("a", 3): 1}, 1))
    state.correct(1)
    assert rows(state.current()) == brute({("a", 1): 4, ("a", 3): 1})


def test_day_blocks():
    assert rs.day_blocks([], 7) == []
    assert rs.day_blocks([day(0), day(3), day(9), day(10), day(400)], 7) == [(day(0), day(6)), (day(7), day(13)), (day(14), day(400))]


def test_daily_amounts_count_records_once_and_split_hot_entities(spark):
    ts = dt.datetime(2026, 3, 1, 12)
    base = [(i, ts + dt.timedelta(i % 5), "hot" if i % 3 else f"t{i % 40}", i % 7 if i % 11 else None) for i in range(900)]
    base += base[::4] + [(None, ts, "hot", 9), (7, None, "hot", 9), (8, ts, None, 9)]
    df = spark.createDataFrame(base, "id long, ts timestamp_ntz, s string, q long").withColumn("entity", F.lit("clash")).withColumn("day", F.lit(0))
    want = {}
    for i, t, s, q in set(base):
        if None not in (i, t, s):
            n, total = want.get((s, t.date()), (0, 0))
            want[s, t.date()] = (n + 1, total + (q or 0))
    for piece_rows in (10, 10**6):
        parts = rs.partial_amounts(df, F.col("s"), F.col("ts"), "id", {"q": F.col("q")}, {"qty": F.coalesce("q", F.lit(0)), "n": F.lit(1)}, piece_rows)
        got = parts.groupBy("entity", "day").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))
        assert {(r["entity"], r["day"]): (r["n"], r["qty"]) for r in got.collect()} == want
