"""Totals per key when a few keys hold most records.

Method: dense accumulator arrays.  Every input split, whatever its keys,
dictionary-encodes its keys to dense codes and scatter-reduces its rows into
numpy arrays indexed by code.  The split then hands over its dictionary and
arrays, cut into blocks by a hash of the key, and a distributed reduction adds
the blocks: each of its tasks encodes the keys of its blocks once more and adds
array to array.  Work per task depends on the size of the split alone: no task
ever receives "all rows of a key", and a key that holds a third of the rows
reaches the reduction as one number a split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks into which keys are hashed, and keys in one row of a block.
BLOCKS = 1024
BLOCK_KEYS = 4096
_PARTS = "block int, keys array<string>, ns array<bigint>, seen array<bigint>, his array<bigint>, los array<bigint>, sums array<double>"
_TOTALS = "key string, n bigint, n_values bigint, hi bigint, lo bigint, s double"


class _Arrays:
    """Keys with dense codes, and accumulators indexed by code: rows, values, high and low halves of whole sums, float sums."""

    def __init__(self) -> None:
        self.codes: dict[str | None, int] = {}
        self.whole = np.zeros((4, 1024), dtype=np.int64)
        self.float = np.zeros(1024)

    def encode(self, keys: pa.Array) -> np.ndarray:
        encoded = keys.dictionary_encode()
        own = np.array([self.codes.setdefault(k, len(self.codes)) for k in [*encoded.dictionary.to_pylist(), *([None] if encoded.null_count else [])]], dtype=np.int64)
        while len(self.codes) > self.whole.shape[1]:
            self.whole = np.concatenate([self.whole, np.zeros_like(self.whole)], axis=1)
            self.float = np.concatenate([self.float, np.zeros_like(self.float)])
        return own[encoded.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)] if len(keys) else np.zeros(0, dtype=np.int64)


def _accumulate(floats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Arrays()
        for batch in batches:
            at = acc.encode(batch.column(0))
            width = len(acc.codes)
            value = batch.column(1)
            valid = value.is_valid().to_numpy(zero_copy_only=False)
            v = value.fill_null(0).to_numpy(zero_copy_only=False)
            acc.whole[0, :width] += np.bincount(at, minlength=width)
            acc.whole[1, :width] += np.bincount(at[valid], minlength=width)
            if floats:
                acc.float[:width] += np.bincount(at, weights=v, minlength=width)
            else:
                # high and low halves: neither sum can overflow
                np.add.at(acc.whole[2], at, v >> 32)
                np.add.at(acc.whole[3], at, v & 0xFFFFFFFF)
        keys = np.array(list(acc.codes), dtype=object)
        block = np.array([zlib.crc32(k.encode()) % BLOCKS if k is not None else 0 for k in keys], dtype=np.int64)
        order = np.argsort(block, kind="stable")
        if len(order):
            # one row a block, cut where it has more than BLOCK_KEYS keys
            starts = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1])
            cuts = np.concatenate([np.arange(a, b, BLOCK_KEYS) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)])
            offsets = pa.array(np.concatenate([cuts, [len(order)]]), pa.int32())
            lists = [pa.array(keys[order].tolist(), pa.string()), *[pa.array(acc.whole[r, order]) for r in range(4)], pa.array(acc.float[order])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[order][cuts], pa.int32()), *[pa.ListArray.from_arrays(offsets, values) for values in lists]], names=["block", "keys", "ns", "seen", "his", "los", "sums"]
            )

    return run


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the blocks of one partition; all parts of a key are in it."""
    acc = _Arrays()
    for batch in batches:
        at = acc.encode(batch.column(1).flatten())
        for r in range(4):
            np.add.at(acc.whole[r], at, batch.column(2 + r).flatten().to_numpy())
        np.add.at(acc.float, at, batch.column(6).flatten().to_numpy())
    keys = list(acc.codes)
    for i in range(0, len(keys), 1 << 16):
        part = slice(i, min(i + (1 << 16), len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.string()), *[pa.array(acc.whole[r, part]) for r in range(4)], pa.array(acc.float[part])], names=["key", "n", "n_values", "hi", "lo", "s"])


def keyed_totals(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Rows, non-null values and sum of ``value`` for every value of ``key``.

    Result: ``(key string, n bigint, n_values bigint, total)``, one row per
    distinct key; the null key is a row of its own.  Null adds nothing; a key
    with only null values has total null.  Whole numbers add up exactly, beyond
    64 bits, to a decimal(38,0); floats add up to a double, NaN to NaN; other
    types, decimals among them, are refused: count them in whole minor units.
    An empty table gives no rows.  Other columns of ``df`` aren't read, so their
    names don't matter.
    """
    rows = df.select(key.cast("string").alias("k"), value.alias("v"))
    kind = rows.schema["v"].dataType
    floats = isinstance(kind, (T.FloatType, T.DoubleType))
    if not floats and not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"no totals of {kind.simpleString()}")
    v = F.col("v").cast("double" if floats else "long")
    blocks = rows.select("k", v.alias("v")).mapInArrow(_accumulate(floats), _PARTS)
    sums = blocks.repartition("block").mapInArrow(_reduce, _TOTALS)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    exact = (wide("hi") * F.lit(1 << 32).cast("decimal(11,0)") + wide("lo")).cast("decimal(38,0)")
    return sums.select("key", "n", "n_values", F.when(F.col("n_values") > 0, F.col("s") if floats else exact).alias("total"))


def dominant_keys(totals: DataFrame, percent: int) -> DataFrame:
    """Keys (not null) that hold at least ``percent`` % of all rows counted in ``totals``."""
    return totals.filter(F.col("key").isNotNull() & (F.col("n") * 100 >= totals.agg(F.sum("n")).scalar() * percent))
