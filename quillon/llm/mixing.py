"""Mixing sources to target weights.

Method: cube-method balanced sampling.  A source must contribute its share of
the total tokens, so each of its documents is used ``k`` times or ``k + 1``
times; the extra use is an inclusion probability.  The flight phase moves the
probabilities of three documents at a time along the null space of the two
constraints (tokens, documents) until each is 0 or 1; it runs in shards of a
source in parallel and then over the few undecided documents the shards
leave.  The landing phase decides the last two of a source.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import durable

#: Documents in one shard of a source.
SHARD = 20_000
_EPS = 1e-9


def flight(sizes: np.ndarray, probs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping their sum and that of sizes times
    them, until at most two are undecided.  In expectation none changes."""
    p = probs.astype(float).copy()
    open_ = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    draws = rng.random(len(open_) + 1).tolist()
    size, val = sizes.astype(float).tolist(), p.tolist()
    live, nxt, turn = open_[:3], 3, 0
    while len(live) == 3:
        a, b, c = live
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1, 1, 1) and to the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - val[i]) / d), min(down, val[i] / d)
            elif d < 0:
                up, down = min(up, val[i] / -d), min(down, (1 - val[i]) / -d)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        rest = []
        for i, d in zip(live, u, strict=True):
            val[i] += step * d
            if val[i] <= _EPS or val[i] >= 1 - _EPS:
                val[i] = round(val[i])
            else:
                rest.append(i)
        while len(rest) < 3 and nxt < len(open_):
            rest.append(open_[nxt])
            nxt += 1
        live = rest
    return np.array(val)


def land(sizes: np.ndarray, probs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the at most two documents that the flight leaves, each with its own probability.

    Of all joint distributions with these probabilities the one that misses
    the balanced token sum least on average is drawn from (a linear program
    with one free number, so an end of its range is best).
    """
    p = probs.astype(float).copy()
    open_ = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    if len(open_) == 1:
        p[open_[0]] = float(rng.random() < p[open_[0]])
    elif open_:
        a, b = open_
        want = p[a] * sizes[a] + p[b] * sizes[b]
        miss = lambda x, y: abs(x * sizes[a] + y * sizes[b] - want)
        apart = miss(1, 1) + miss(0, 0) > miss(1, 0) + miss(0, 1)
        both = max(0.0, p[a] + p[b] - 1) if apart else min(p[a], p[b])
        u = rng.random()
        first = u < p[a]
        second = u < both if first else u < p[a] + p[b] - both
        p[a], p[b] = float(first), float(second)
    return np.round(p)


def goals(targets: list[tuple[float, float]], size: float, on_capped: str) -> list[float]:
    """Tokens each source is to give, from ``(target share, most tokens it can give)``.

    ``leave``: its share of ``size`` or all it can give; ``refill``: what capped
    sources lack is handed to the others in proportion to their shares;
    ``shrink``: the largest mix, up to ``size``, in which every share is reached.
    """
    if on_capped == "leave":
        return [min(share * size, cap) for share, cap in targets]
    if on_capped == "shrink":
        size = min([size, *[cap / share for share, cap in targets if share > 0]])
        return [share * size for share, _ in targets]
    if on_capped != "refill":
        raise ValueError(f"no way {on_capped} to treat capped sources")
    goal: dict[int, float] = {}
    while True:
        left = size - sum(goal.values())
        free = {i: share for i, (share, _) in enumerate(targets) if i not in goal and share > 0}
        total = sum(free.values())
        full = [i for i, share in free.items() if left * share / total > targets[i][1]]
        if not full:
            return [goal.get(i, left * free[i] / total if i in free else 0.0) for i in range(len(targets))]
        goal |= {i: targets[i][1] for i in full}


def plan_shares(sized: DataFrame, targets: DataFrame, size: int | None = None, on_capped: str = "leave") -> DataFrame:
    """How often each source has to be used: one row per row of ``targets``.

    ``sized``: ``(doc_id, source, tokens)``, ``targets``: ``(source,
    target_share, max_repeats)``, one row per source; a plan of a few rows that
    the driver works out.  ``size`` is the number of tokens of the mix, by
    default that of all documents together.  ``need`` is the source's share of
    it, ``capped`` tells that the source can't give that; ``on_capped`` says
    what then happens to the mix (see ``goals``).  ``uses`` is the mean number of
    uses of a document, at most ``max_repeats``, 0 for a source without tokens.
    """
    per = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    everything = per.agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("long"))).scalar()
    zero = F.lit(0).cast("long")
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    rows = targets.join(per.filter("source is not null"), "source", "left").select("source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"), everything.alias("all")).collect()
    want = size if size is not None else (rows[0]["all"] if rows else 0)
    limits = [(float(r["target_share"]), float(r["tokens"] * r["max_repeats"])) for r in rows]
    plan = []
    for r, (share, cap), goal in zip(rows, limits, goals(limits, float(want), on_capped), strict=True):
        uses = min(goal / r["tokens"], float(r["max_repeats"])) if r["tokens"] else 0.0
        plan.append((r["source"], r["target_share"], r["max_repeats"], r["docs"], r["tokens"], share * want, uses, cap < share * want))
    schema = f"source {kinds['source']}, target_share {kinds['target_share']}, max_repeats {kinds['max_repeats']}, docs long, tokens long, need double, uses double, capped boolean"
    return sized.sparkSession.createDataFrame(plan, schema)


def mix(sized: DataFrame, shares: DataFrame, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """Number of uses of each document of the planned sources.

    Result: ``(doc_id, source, tokens, copies)``, documents with 0 copies
    included; documents of other sources or without source aren't part of the
    mix.  Token and document totals of a source miss their targets by less
    than the sizes of two documents.  The same seed gives the same mix.
    ``sized`` should be materialised.  What the shards of one round leave
    undecided, at most two documents each, goes to the shards of the next, so
    no task ever gets more than about ``shard`` documents of a source.
    """
    part = sized.join(F.broadcast(shares.select("source", "uses", "docs")), "source")  # a row a source
    whole = F.floor("uses").cast("int")
    part = part.select("doc_id", "source", "tokens", whole.alias("whole"), (F.col("uses") - whole).alias("prob"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.ceil(F.col("docs") / shard), F.lit(1))).cast("long").alias("shard"))

    def fly(turn: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
            mark = f"{pdf['source'].iloc[0]}:{int(pdf['shard'].iloc[0])}:{turn}"
            sizes = pdf["tokens"].to_numpy(dtype=float)
            rng = np.random.default_rng([seed, zlib.crc32(mark.encode())])
            prob = flight(sizes, pdf["prob"].to_numpy(dtype=float), rng)
            pdf["prob"] = land(sizes, prob, rng) if last else prob
            return pdf

        return run

    schema = "doc_id long, source string, tokens long, whole int, prob double, shard long"
    open_ = (F.col("prob") > _EPS) & (F.col("prob") < 1 - _EPS)
    flown = durable(part.groupBy("source", "shard").applyInPandas(fly(0, False), schema))
    done, turn = flown.filter(~open_), 1
    shards = -(-(shares.agg(F.max("docs")).first()[0] or 0) // shard)
    while (shards := -(-2 * shards // shard)) > 1:
        again = flown.filter(open_).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + turn)), F.lit(shards)))
        flown = durable(again.groupBy("source", "shard").applyInPandas(fly(turn, False), schema))
        done, turn = done.unionAll(flown.filter(~open_)), turn + 1
    landed = flown.filter(open_).withColumn("shard", F.lit(0).cast("long")).groupBy("source").applyInPandas(fly(turn, True), schema)
    return done.unionAll(landed).select("doc_id", "source", "tokens", (F.col("whole") + F.round("prob").cast("int")).alias("copies"))


def report(mixture: DataFrame, shares: DataFrame) -> DataFrame:
    """Shares really reached: one row per planned source.

    ``actual_share`` is of the mixed tokens; ``missing`` is what the source
    lacks of its ``need``; ``exhausted``: every document is used as often as
    allowed and the need still not met.
    """
    used = mixture.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"), F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies")
    )
    total = used.agg(F.sum("mixed_tokens")).scalar()
    out = shares.select("source", "target_share", "max_repeats", "docs", "tokens", "need").join(used, "source", "left")
    got = F.coalesce("mixed_tokens", F.lit(0).cast("long"))
    out = out.withColumn("mixed_tokens", got).withColumn("actual_share", F.when(total > 0, got / total).otherwise(F.lit(0.0)))
    short = F.col("mixed_tokens") < F.col("need")
    out = out.withColumn("missing", F.when(short, F.col("need") - F.col("mixed_tokens")).otherwise(F.lit(0.0)))
    return out.withColumn("exhausted", short & (F.coalesce("least_copies", "max_repeats") >= F.col("max_repeats")))
