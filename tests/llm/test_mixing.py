import random

import numpy as np

from quillon.llm import mixing
from quillon.runtime import durable


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        sizes, p = rng.integers(1, 500, n).astype(float), np.full(n, 0.37)
        got = mixing.flight(sizes, p, np.random.default_rng(n))
        assert ((got > 1e-9) & (got < 1 - 1e-9)).sum() <= 2
        assert abs(got.sum() - p.sum()) < 1e-6 and abs(got @ sizes - p @ sizes) < 1e-4 * (1 + sizes.sum())
        done = mixing.land(sizes, got, np.random.default_rng(n))
        assert set(np.unique(done)) <= {0.0, 1.0}
        if n:
            assert abs(done @ sizes - p @ sizes) <= 2 * sizes.max()


def test_flight_is_unbiased_and_handles_equal_sizes():
    sizes = np.array([5.0, 5, 5, 5, 9, 9, 1, 30, 2, 2])
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.2, 0.7, 0.5, 0.4, 0.6, 0.8])
    def run(seed):
        rng = np.random.default_rng(seed)
        return mixing.land(sizes, mixing.flight(sizes, p, rng), rng)

    assert np.abs(np.mean([run(s) for s in range(4000)], axis=0) - p).max() < 0.04
    equal = mixing.flight(np.full(20, 4.0), np.full(20, 0.5), np.random.default_rng(0))
    assert abs(equal.sum() - 10) < 1e-6


def mixed(spark, docs, targets, size=None, on_capped="leave", **k):
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long").persist()
    shares = durable(mixing.plan_shares(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), size, on_capped))
    mixture = durable(mixing.mix(sized, shares, **k))
    return {r["doc_id"]: r["copies"] for r in mixture.collect()}, {r["source"]: r for r in mixing.report(mixture, shares).collect()}


def test_shares_repeats_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["rare"]), rng.randrange(1, 300)) for i in range(6000)] + [(-1, None, 50), (-2, "other", 70), (-3, "big", 0)]
    copies, report = mixed(spark, docs, [("big", 0.3, 1), ("mid", 0.5, 4), ("rare", 0.2, 2), ("none", 0.0, 3)], shard=500)
    total = sum(t for *_, t in docs)
    size = {i: (s, t) for i, s, t in docs}
    for s, share, cap in (("big", 0.3, 1), ("mid", 0.5, 4)):
        assert not report[s]["exhausted"]
        assert abs(sum(size[i][1] * c for i, c in copies.items() if size[i][0] == s) - share * total) < 600
        own = {c for i, c in copies.items() if size[i][0] == s}
        assert max(own) <= cap and max(own) - min(own) <= 1
    assert report["rare"]["exhausted"] and {c for i, c in copies.items() if size[i][0] == "rare"} == {2}
    assert not report["none"]["exhausted"] and report["none"]["mixed_tokens"] == 0
    assert -1 not in copies and -2 not in copies
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    again, _ = mixed(spark, docs, [("big", 0.3, 1), ("mid", 0.5, 4), ("rare", 0.2, 2), ("none", 0.0, 3)], shard=500)
    assert again == copies


def test_empty_tables(spark):
    assert mixed(spark, [], [("a", 1.0, 2)])[0] == {}
    assert mixed(spark, [(1, "a", 5)], [])[0] == {}


def test_capped_sources_by_choice(spark):
    """A third source that can give half of its share: the others keep their amount, fill up or shrink with it."""
    rng = random.Random(9)
    docs = [(i, "abc"[min(i % 5, 2)] if i % 10 else "c", rng.randrange(1, 40)) for i in range(4000)]
    own = {s: sum(t for _, x, t in docs if x == s) for s in "abc"}
    size = own["c"] * 5
    targets = [("a", 0.4, 50), ("b", 0.2, 50), ("c", 0.4, 1)]
    reports = {way: mixed(spark, docs, targets, size, way, shard=30)[1] for way in ("leave", "refill", "shrink")}
    for s, share in (("a", 0.4), ("b", 0.2)):
        assert abs(reports["leave"][s]["mixed_tokens"] - share * size) < 80 and reports["leave"][s]["missing"] < 80
        assert abs(reports["refill"][s]["mixed_tokens"] - share / 0.6 * (size - own["c"])) < 80
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in reports["shrink"].values())
    assert reports["leave"]["c"]["exhausted"] and reports["refill"]["c"]["exhausted"]
    assert abs(reports["leave"]["c"]["missing"] - own["c"]) < 1e-6
    assert abs(sum(r["mixed_tokens"] for r in reports["refill"].values()) - size) < 160


def test_goals_hand_on_what_is_lacking_more_than_once():
    assert mixing.goals([(0.5, 10.0), (0.3, 35.0), (0.2, 1e9)], 100.0, "refill") == [10.0, 35.0, 55.0]
    assert mixing.goals([(0.5, 10.0), (0.5, 20.0)], 100.0, "refill") == [10.0, 20.0]
    assert mixing.goals([(0.0, 10.0), (1.0, 500.0)], 100.0, "refill") == [0.0, 100.0]
    assert mixing.goals([(0.5, 10.0), (0.5, 20.0)], 100.0, "shrink") == [10.0, 10.0]
