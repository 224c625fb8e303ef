"""Reading level of each document.

Method: a linear pairwise ranker learns from pairs of graded documents of one
language which of two is harder, from syntax and vocabulary features of the
whole text; its scores are calibrated into levels by isotonic regression.

Two passes over all documents: the first counts in how many documents of each
language code a word occurs; the second computes the features, on the JVM but
for the lookup of words, which runs on Arrow batches.  Features are taken
relative to their language (mean and spread over the whole corpus), so scores
compare within a language.  The language is told from the text itself by a
naive Bayes model of those counts, because the codes of documents may be wrong
or missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import durable, quoted

LEVELS = ("basic", "intermediate", "advanced")
#: Most graded documents the ranker is fitted on, and pairs of them.
MAX_GRADED = 20_000
MAX_PAIRS = 200_000
#: A word is common in a language if it occurs in this share of its documents.
#: With d distinct words a document there are at most d / share of them in each
#: language, whatever the corpus: the bound of what is broadcast.
COMMON = 0.002
#: Documents that the distribution over all languages counts for in the model of each:
#: a code that few documents bear says little about words.
SHRINK = 50.0

NAMES = (
    "words_a_sentence", "longest_sentence", "clauses_a_sentence", "letters_a_word", "long_words", "very_long_words", "longest_words", "long_words_a_sentence", "variety",
    "words_a_clause", "subordinations_a_sentence", "rare_words",
)

# Words that begin subordinate clauses in English, German, French, Spanish and Russian
SUBORDINATORS = (
    "although because before if since that though unless until when whereas whether which while who whom whose"
    " als bevor dass damit falls indem nachdem obwohl ob sodass sobald solange während weil wenn"
    " afin bien comme dont lorsque parce puisque quand que quoique qui tandis"
    " aunque como cuando mientras porque pues quien si sino cuyo"
    " если когда который которая которое которые чтобы что хотя пока поскольку потому"
).split()

_MARK = "\u00b6"
_WORD = r"\p{L}++(?:['’]\p{L}++)*+"
_TAG = r"<[^<>]++>|&[A-Za-z]++;|&#\d++;"
# a line that starts a list item or follows an empty line starts a sentence
_BREAK = r"\n\s*(?=[-*•—–\d]+[\s.)])|\n\s*\n"
_DASH = r"(?<=[.!?…])\s+[—–-]\s+"
# a full stop ends a sentence after a word of three letters, a number or a
# bracket if a capital follows that doesn't begin another abbreviation; other
# end marks always do
_CLOSE = "[\"'”“»’)\\]]*"
_OPEN = "[\"'„“«‘(¿¡\\[]*"
_END = (
    rf"(?=[.!?…])(?:(?<=[\p{{L}}\p{{N}}_)\]]{{3}})[.]+{_CLOSE}\s+(?={_OPEN}[A-ZÀ-ÖØ-ÞА-ЯЁ])(?!{_OPEN}[\p{{L}}\p{{N}}_]{{1,3}}\.)|[!?…]+{_CLOSE}\s+"
    "|[.]+[\"'”“»’)\\]]+\\s+(?=[\"'„“«‘(¿¡]))"
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _replaced(text: Column, pattern: str, to: str, *needs: str) -> Column:
    """``regexp_replace``, left out for texts without any of the characters that a match needs."""
    return F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in needs]), F.regexp_replace(text, pattern, to)).otherwise(text)


def plain_text(text: Column) -> Column:
    """The text without markup."""
    return _replaced(F.coalesce(text, F.lit("")), _TAG, " ", "<", "&")


def base_code(lang: Column) -> Column:
    """``en`` for ``EN``, ``en-X`` and ``eng`` alike: the first two letters."""
    return F.substring(F.lower(F.trim(lang)), 1, 2)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """Add ``x``, the features but for the last, and ``w``, the distinct words in lower case; all 0 for a text without words."""
    d = docs.withColumn("__p", plain_text(F.col(quoted(text)))).withColumn("__p", _replaced(F.col("__p"), _BREAK, f" {_MARK} ", "\n")).withColumn("__p", _replaced(F.col("__p"), _DASH, f" {_MARK} ", "-", "–", "—"))
    d = d.withColumn("__s", F.split(F.regexp_replace(F.translate("__p", "\n", " "), _END, _MARK), _MARK))
    # words are cut out once, sentence by sentence
    parts = F.transform("__s", lambda s: F.struct(_words(F.lower(s)).alias("w"), (F.length(s) - F.length(F.translate(s, ",;:", ""))).alias("c")))
    d = d.withColumn("__s", F.filter(parts, lambda s: F.size(s["w"]) > 0)).withColumn("__w", F.flatten(F.transform("__s", lambda s: s["w"])))
    d = d.withColumn("w", F.array_distinct("__w")).withColumn("__l", F.array_sort(F.transform("__w", F.length))).withColumn("__n", F.array_sort(F.transform("__s", lambda s: F.size(s["w"]))))
    sentences, words = F.size("__n").cast("double"), F.size("__w").cast("double")
    clauses = F.aggregate("__s", F.lit(0), lambda a, s: a + s["c"]).cast("double")
    letters = F.length(F.concat_ws("", "__w")).cast("double")
    long_ = F.size(F.filter("__l", lambda v: v >= 10)).cast("double")
    subordinate = F.size(F.filter("__w", lambda v: v.isin(SUBORDINATORS))).cast("double")
    at = lambda c, i: F.coalesce(F.get(c, i.cast("int")).cast("double"), F.lit(0.0))
    x = [
        F.log1p(_ratio(words, sentences)),
        F.log1p(at("__n", F.least(sentences - 1, F.floor(sentences * 0.9)))),
        _ratio(clauses, sentences),
        _ratio(letters, words),
        _ratio(long_, words),
        _ratio(F.size(F.filter("__l", lambda v: v >= 13)).cast("double"), words),
        at("__l", F.floor((words - 1) * 0.9)),
        F.log1p(_ratio(long_, sentences)),
        _ratio(F.size("w").cast("double"), F.sqrt(words)),
        F.log1p(_ratio(words, clauses + sentences)),
        _ratio(subordinate, sentences),
    ]
    return d.withColumn("x", F.array(*x)).drop("__p", "__s", "__w", "__l", "__n")


@dataclass
class Vocabulary:
    """Languages, their common words, and per word and language the log probability and whether it is common."""

    codes: list[str]
    prior: np.ndarray
    words: pa.Array
    weights: np.ndarray
    common: np.ndarray

    def tell(self, lists: pa.ListArray) -> tuple[list[str | None], np.ndarray]:
        """Language of each list of distinct words (None if none of them is known), and its share of words that aren't common there."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], lists.flatten()
        rows = len(offsets) - 1
        if not self.codes or not len(self.words):
            return [None] * rows, np.zeros(rows)
        at = pc.index_in(flat, value_set=self.words).fill_null(len(self.words)).to_numpy(zero_copy_only=False)

        def per_row(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
            return upto[offsets[1:]] - upto[offsets[:-1]]

        found = per_row((at < len(self.words)).astype(float)[:, None])[:, 0]
        best = (per_row(self.weights[at]) + self.prior).argmax(axis=1)
        common = per_row(self.common[at])[np.arange(rows), best]
        n = np.diff(offsets)
        rare = np.where((n > 0) & (found > 0), 1 - common / np.maximum(n, 1), 0.0)
        return [self.codes[b] if f else None for b, f in zip(best, found, strict=True)], rare


def vocabulary(docs: DataFrame, text: str, lang: str, common: float = COMMON) -> Vocabulary:
    """Counts of all documents whose language code isn't null: no code and no document is left out."""
    rows = docs.select(base_code(F.col(quoted(lang))).alias("c"), F.col(quoted(text)).alias("t")).filter("c is not null and t is not null")
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()}  # pairs of letters
    codes = list(sizes)
    if not codes:
        return Vocabulary([], np.zeros(0), pa.array([], pa.string()), np.zeros((1, 0)), np.zeros((1, 0)))
    words = rows.select("c", F.explode(F.array_distinct(_words(F.lower(plain_text(F.col("t")))))).alias("w"))
    counts = words.groupBy("w").agg(*[F.count_if(F.col("c") == c).alias(f"n{i}") for i, c in enumerate(codes)])
    known = counts.filter(F.greatest(*[F.col(f"n{i}") / n for i, n in enumerate(sizes.values())], F.lit(0.0)) >= common).toArrow()
    n = np.array([sizes[c] for c in codes], dtype=float)
    k = np.stack([known.column(f"n{i}").to_numpy() for i in range(len(codes))], axis=1).astype(float).reshape(known.num_rows, len(codes))
    everywhere = (k.sum(axis=1) / n.sum())[:, None]
    weights = np.log((k + SHRINK * everywhere) / (n + SHRINK))
    zero = np.zeros((1, len(codes)))  # words that no language knows
    return Vocabulary(codes, np.log(n / n.sum()), known.column("w").combine_chunks(), np.concatenate([weights, zero]), np.concatenate([(k >= common * n).astype(float), zero]))


def featured(docs: DataFrame, ident: str, text: str, vocab: Vocabulary) -> DataFrame:
    """``(<ident>, language, x)`` of every document, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # bounded by the share that makes a word common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = shared.value.tell
        width = len(NAMES)
        for b in batches:
            language, rare = tell(b.column(2))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rare), width - 1)
            values = pa.array(np.concatenate([x, rare[:, None]], axis=1).ravel())
            offsets = pa.array(np.arange(0, width * len(rare) + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(language, pa.string()), pa.ListArray.from_arrays(offsets, values)], names=["i", "language", "x"])

    kind = dict(docs.dtypes)[ident]
    d = with_features(docs.select(F.col(quoted(ident)).alias("i"), F.col(quoted(text)).alias("t")), "t").select("i", "x", "w")
    return d.mapInArrow(run, f"i {kind}, language string, x array<double>").withColumnRenamed("i", ident)


def scales(feats: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Mean and spread of each feature per language over the whole corpus: one row a language."""
    k = len(NAMES)
    aggs = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    rows = feats.groupBy("language").agg(*aggs).collect()
    return {r["language"]: (np.array([r[f"m{i}"] for i in range(k)]), np.array([max(r[f"s{i}"] or 0.0, 1e-6) for i in range(k)])) for r in rows}


def rank_weights(x: np.ndarray, grade: np.ndarray, group: np.ndarray, seed: int = 7, pairs: int = MAX_PAIRS, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a linear ranker: logistic loss on pairs of one group with different grades."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(x), size=(2, pairs * 3)) if len(x) else np.zeros((2, 0), dtype=int)
    use = (group[a] == group[b]) & (grade[a] > grade[b])
    d = (x[a] - x[b])[use][:pairs]
    w = np.zeros(x.shape[1] if x.ndim == 2 else len(NAMES))
    if not len(d):
        return w
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit: block starts and their values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # first score, mean, weight
    for s, t in zip(score[order], target[order].astype(float), strict=True):
        if blocks and blocks[-1][0] == s:
            last = blocks[-1]
            last[1] = (last[1] * last[2] + t) / (last[2] + 1)
            last[2] += 1
        else:
            blocks.append([s, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, m, n = blocks.pop()
            last = blocks[-1]
            last[1] = (last[1] * last[2] + m * n) / (last[2] + n)
            last[2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


@dataclass
class LevelModel:
    weights: np.ndarray
    scales: dict
    #: for each level above the first, the score from which it is the likelier
    bounds: list[float]


def fit_levels(feats: DataFrame, labels: DataFrame, ident: str, max_graded: int = MAX_GRADED) -> LevelModel:
    """Ranker and calibration from graded documents, at most ``max_graded`` of them.

    A document's grade is the mean of its readers' levels; unknown levels and
    nulls don't count.  The sample takes those with the smallest hash of the id.
    """
    grade = F.when(F.col("level") == LEVELS[0], 0.0).when(F.col("level") == LEVELS[1], 1.0).when(F.col("level") == LEVELS[2], 2.0)
    graded = labels.select(ident, grade.alias("g")).filter("g is not null").groupBy(ident).agg(F.avg("g").alias("g"))
    rows = graded.join(feats, ident).orderBy(F.xxhash64(ident), ident).limit(max_graded).collect()
    sc = scales(feats)
    model = LevelModel(np.zeros(len(NAMES)), sc, [])
    x = np.array([(np.array(r["x"]) - sc[r["language"]][0]) / sc[r["language"]][1] for r in rows]).reshape(len(rows), len(NAMES))
    g = np.array([r["g"] for r in rows])
    model.weights = rank_weights(x, g, np.array([r["language"] or "" for r in rows]))
    s = x @ model.weights
    for level in range(1, len(LEVELS)):
        starts, values = isotonic(s, g >= level - 0.25)
        likely = starts[values >= 0.5] if len(starts) else starts
        if not len(likely):
            model.bounds.append(math.inf)
            continue
        # halfway to the next easier graded document
        below = s[s < likely[0]]
        model.bounds.append(float(likely[0] + below.max()) / 2 if len(below) else -math.inf)
    return model


def levels(feats: DataFrame, model: LevelModel, ident: str) -> DataFrame:
    """``(<ident>, language, score, level)`` of every document."""
    # a row a language: the score is linear in the features themselves
    rows = [(lang, (model.weights / s).tolist(), float(-(m / s) @ model.weights)) for lang, (m, s) in model.scales.items()]
    of = F.broadcast(feats.sparkSession.createDataFrame(rows, "__of string, __w array<double>, __b double"))
    products = F.zip_with("x", "__w", lambda a, b: a * b)
    score = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.col("__b")
    d = feats.join(of, F.col("language").eqNullSafe(F.col("__of"))).withColumn("score", score)
    # a text without words is as easy as can be
    level = F.when(~F.exists("x", lambda v: v != 0), F.lit(LEVELS[0]))
    for name, bound in reversed([*zip(LEVELS[1:], model.bounds, strict=False)]):
        level = level.when(F.col("score") >= F.lit(bound), F.lit(name))
    return d.select(F.col(quoted(ident)), "language", "score", level.otherwise(F.lit(LEVELS[0])).alias("level"))


def reading_levels(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Difficulty of every document: ``(<ident>, language, score, level)``.

    ``level`` is one of ``LEVELS``; scores compare within a language.  Null,
    empty and wordless texts get ``basic`` and no language.  Without any usable
    label all scores are 0 and every level is ``basic``.  An empty table gives
    no rows; other columns aren't read.
    """
    feats = durable(featured(docs, ident, text, vocabulary(docs, text, lang)))
    return levels(feats, fit_levels(feats, labels, ident), ident)
