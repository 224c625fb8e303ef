"""Filling fixed-capacity containers with items.

Method: length-histogram planning.  Best fit, longest first, is run over the
histogram of lengths instead of over documents: containers with the same
space left are one entry with a count, so the plan needs as many steps as
there are lengths and kinds of space left, whatever the number of documents.
It says which ranks of each length go to which run of containers; the
documents then take their slots by joining on length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import durable

#: Shards in which ranks within a length are counted.
SHARDS = 64


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots ``(length, first rank, count, first container)``: the items of
    a length with ranks from the first on take consecutive containers.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first container, count)
    kinds: list[int] = []  # the spaces left, sorted
    slots, opened = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left not in space:
            space[left] = []
            insort(kinds, left)
        space[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(kinds, length)
            if at == len(kinds):
                fresh = -(-todo // (capacity // length))
                put(capacity, opened, fresh)
                opened += fresh
                continue
            left = kinds[at]
            first, count = space[left].pop()
            if not space[left]:
                del space[left]
                kinds.pop(at)
            used = min(count, todo)
            slots.append((length, rank, used, first))
            if left > length:
                put(left - length, first, used)
            if count > used:
                put(left, first + used, count - used)
            rank += used
            todo -= used
    return slots


def pieces(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """Items as pieces ``(<ident>, piece, length)`` of at most ``capacity``.

    Only an item larger than a container is split: into full containers and
    a rest.  Items of size 0 or null give no piece.
    """
    full = F.floor((F.col(size) - 1) / capacity).cast("int")
    length = F.when(F.col("piece") < full, F.lit(capacity)).otherwise((F.col(size) - full.cast("long") * capacity).cast("int"))
    return items.filter(F.col(size) > 0).select(ident, F.explode(F.sequence(F.lit(0), full)).alias("piece"), size).select(ident, "piece", length.alias("length"))


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """Containers for all items: ``(<ident>, piece, n_pieces, length, container)``.

    ``items`` should be materialised, it is read twice.  Every piece appears
    once, no container holds more than ``capacity``, and an item is split only
    if it alone exceeds a container.  Items of size 0 or null need no space:
    they come out with ``piece`` 0, ``n_pieces`` 0, length 0 and no container.
    Repeated idents are items of their own as long as they differ in size;
    idents should be unique.  An empty table gives no rows.

    The driver receives at most ``capacity * SHARDS`` counts, the plan has at
    most some thousand slots; both depend on the capacity alone.
    """
    spark = items.sparkSession
    own = pieces(items.select(ident, size), ident, size, capacity).withColumn("shard", F.pmod(F.xxhash64(ident, "piece"), F.lit(SHARDS)).cast("int"))
    counts = own.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).collect()
    per_shard: dict[int, dict[int, int]] = {}
    for r in counts:
        per_shard.setdefault(r["length"], {})[r["shard"]] = r["n"]
    offsets = []
    for length, of in per_shard.items():
        before = 0
        for shard in sorted(of):
            offsets.append((length, shard, before))
            before += of[shard]
    slots = plan({length: sum(of.values()) for length, of in per_shard.items()}, capacity)

    starts = F.broadcast(spark.createDataFrame(offsets, "length int, shard int, before long"))
    runs = F.broadcast(spark.createDataFrame(slots, "length int, first_rank long, n_slots long, first_container long"))
    in_shard = F.row_number().over(Window.partitionBy("length", "shard").orderBy(ident, "piece"))
    ranked = own.join(starts, ["length", "shard"]).select(ident, "piece", "length", (in_shard - 1 + F.col("before")).alias("rank"))
    fits = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_slots"))
    placed = ranked.join(runs, "length").filter(fits).select(ident, "piece", "length", (F.col("first_container") + F.col("rank") - F.col("first_rank")).alias("container"))
    n_pieces = (F.floor((F.col(size) - 1) / capacity) + 1).cast("int")
    sized = items.filter(F.col(size) > capacity).select(F.col(ident).alias("__of"), n_pieces.alias("n_pieces"))
    split = placed.join(sized, placed[ident] == sized["__of"], "left").select(ident, "piece", F.coalesce("n_pieces", F.lit(1)).alias("n_pieces"), "length", "container")
    none = items.filter(F.coalesce(F.col(size), F.lit(0)) <= 0).select(ident, F.lit(0).alias("piece"), F.lit(0).alias("n_pieces"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("container"))
    return split.unionAll(none)


def sized_documents(docs: DataFrame, tokens, ident: str = "doc_id") -> DataFrame:
    """``(<ident>, n_tokens)`` of all documents, counted once and kept."""
    return durable(docs.select(ident, tokens.alias("n_tokens")))
