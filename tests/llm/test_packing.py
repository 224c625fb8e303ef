import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.packing import pack, plan, sized_documents


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_places_every_rank_once_within_capacity(histogram):
    used, seen = {}, {}
    for length, first, count, container in plan(histogram, 40):
        for k in range(count):
            used[container + k] = used.get(container + k, 0) + length
            seen.setdefault(length, []).append(first + k)
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert all(u <= 40 for u in used.values()) and set(used) == set(range(len(used)))
    # two containers can't both be at most half full
    assert sum(2 * u <= 40 for u in used.values()) <= 1


def containers(spark, sizes, capacity=100):
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, length string").persist()
    return pack(df, "doc_id", "n_tokens", capacity).collect()


def test_whole_and_split_items(spark):
    rng = random.Random(6)
    sizes = [rng.choice([1, 3, 7, 30, 30, 30, 50, 99, 100, 101, 250, 1000, 0, None]) for _ in range(3000)]
    out = containers(spark, sizes)
    fill, of = {}, {}
    for r in out:
        of.setdefault(r["doc_id"], []).append(r)
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
    assert max(fill.values()) <= 100 and set(of) == set(range(3000))
    for i, s in enumerate(sizes):
        ps = sorted(of[i], key=lambda r: r["piece"])
        assert sum(p["length"] for p in ps) == (s or 0)
        assert len(ps) == max(1, -(-(s or 0) // 100)) and all(p["n_pieces"] == (len(ps) if s else 0) for p in ps)
        assert [p["piece"] for p in ps] == list(range(len(ps)))
        assert all(p["length"] == 100 for p in ps[:-1])
    # little unused space: within 1 % of the least possible number of containers
    assert len(fill) <= 1.01 * sum(s or 0 for s in sizes) / 100 + 1


def test_edges(spark):
    assert containers(spark, []) == []
    assert [r["container"] for r in containers(spark, [0, None])] == [None, None]
    assert [(r["length"], r["container"]) for r in containers(spark, [100])] == [(100, 0)]


def test_token_counts_of_whole_texts(spark):
    words = "alpha " * 5_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, words), (5, "ü" * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in sized_documents(df, tokens.token_count(F.col("text"))).collect()}
    encode = tokens.encoder(tokens.default_path()).encode_ordinary
    assert got == {1: 0, 2: 0, 3: len(encode("hello world")), 4: len(encode(words)), 5: len(encode("ü" * 20_000))}
