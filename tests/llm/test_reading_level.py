import random

import numpy as np
import pytest

from quillon.llm import reading_level as R


def features(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["x"] for r in R.with_features(df, "t").orderBy("i").collect()]


def test_sentences_and_abbreviations(spark):
    names = R.NAMES[:-1]
    got = features(
        spark, "The cat sat. The dog ran approx. 3.75 km cf. No. 12 here! Yes", "- one two\n- three four", "one two. Three four.", "one two\nthree four", None, "", "123 ... <b></b>",
        "word " * 200_000, "<i class='" + "x" * 500 + "'>one</i> two", "He left, because it rained.",
    )
    x = dict(zip(names, got[0], strict=True))
    assert np.expm1(x["words_a_sentence"]) == pytest.approx((3 + 8 + 1) / 3, abs=0.5)
    # list items and empty lines end sentences, wrapped lines don't
    assert got[1][0] == got[2][0] == pytest.approx(np.log1p(2.0)) and got[3][0] == pytest.approx(np.log1p(4.0))
    assert got[4] == got[5] == got[6] == [0.0] * len(names)
    assert np.expm1(got[7][0]) == pytest.approx(200_000)
    # tags of any length are no words
    assert np.expm1(got[8][0]) == pytest.approx(2)
    last = dict(zip(names, got[9], strict=True))
    assert last["subordinations_a_sentence"] == last["clauses_a_sentence"] == 1 and np.expm1(last["words_a_clause"]) == pytest.approx(2.5)


def test_language_and_rare_words(spark):
    docs = [(i, "the cat and the dog", "en") for i in range(40)] + [(i, "der Hund und die Katze", "de") for i in range(40, 60)] + [(60, "the dog and the zyzzyva", "de"), (61, "und der Hund", None), (62, "???", "xx"), (63, "the cat", "xx")]
    df = spark.createDataFrame(docs, "id long, t string, l string")
    vocab = R.vocabulary(df, "t", "l", 0.1)
    got = {r["id"]: (r["language"], r["x"][-1]) for r in R.featured(df, "id", "t", vocab).collect()}
    assert got[0] == ("en", 0.0) and got[45] == ("de", 0.0) and got[61] == ("de", 0.0) and got[62] == (None, 0.0) and got[63][0] == "en"
    # a wrong code doesn't tell the language, and one word of four is rare
    assert got[60] == ("en", pytest.approx(0.25))


def test_isotonic_is_the_best_monotone_fit():
    starts, values = R.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0, 1, 0, 1, 1, 0]))
    assert list(starts) == [1.0, 2.0, 4.0] and list(values) == pytest.approx([0, 0.5, 2 / 3])
    assert (np.diff(R.isotonic(np.random.default_rng(0).random(200), np.random.default_rng(1).integers(0, 2, 200))[1]) > 0).all()


def test_ranker_orders_pairs_of_one_group():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(R.NAMES)))
    grade = (x[:, 0] - 0.5 * x[:, 2] > 0).astype(float) + (x[:, 0] - 0.5 * x[:, 2] > 1)
    w = R.rank_weights(x, grade, np.array(["a", "b"] * 250))
    s = x @ w
    assert np.corrcoef(s, x[:, 0] - 0.5 * x[:, 2])[0, 1] > 0.98
    assert not R.rank_weights(x[:0], grade[:0], grade[:0]).any()


def corpus(spark, n=600):
    rng = random.Random(3)
    easy = ["The cat sees the dog.", "My friend has a red ball.", "We like the sea."]
    hard = ["The institutional reorganisation presupposes an epistemological differentiation of responsibilities, insofar as the jurisdictional interpretation undermines it, while the administration necessitates commercialisation."]
    docs, labels = [], []
    for i in range(n):
        level = rng.choice(["basic", "advanced"])
        docs.append((i, " ".join(rng.choice(easy if level == "basic" else hard) for _ in range(rng.randrange(1, 4))), "en", 7))
        if i % 4 == 0:
            noisy = level if rng.random() > 0.05 else "intermediate"
            labels += [(i, "a", noisy), (i, "b", None if i % 8 else level)]
    return docs, labels


def levels(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, level long")
    lb = spark.createDataFrame(labels, "doc_id long, reader string, level string")
    return {r["doc_id"]: r["level"] for r in R.reading_levels(d, lb).collect()}


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(spark)
    got = levels(spark, [*docs, (-1, None, "en", 0), (-2, "", None, 0), (-3, "42", "xx", 0)], labels)
    unseen = [d for d in docs if d[0] % 4]
    assert np.mean([(got[i] == "advanced") == ("institutional" in t) for i, t, *_ in unseen]) > 0.98
    assert got[-1] == got[-2] == got[-3] == "basic" and len(got) == len(docs) + 3


def test_without_labels_or_documents(spark):
    docs, _ = corpus(spark, 30)
    assert set(levels(spark, docs, []).values()) == {"basic"}
    assert levels(spark, [], []) == {}


def test_levels_of_held_out_labels(spark, sf):
    """Labels of documents kept out of the fit are met on the test tables."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/level_labels.parquet")
    out = R.reading_levels(docs, labels.filter("doc_id % 3 <> 0"))
    held = out.withColumnRenamed("level", "told").join(labels.filter("doc_id % 3 = 0 AND level IS NOT NULL"), "doc_id").collect()
    assert len(held) > 10
    assert np.mean([(r["told"] == "advanced") == (r["level"] == "advanced") for r in held]) >= 0.9
