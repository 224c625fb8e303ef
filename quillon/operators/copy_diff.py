"""Differences between two copies of one dataset.

Method: a checksum matrix of key buckets by columns.  Every row adds a wide
hash of (key, field value) to the cell of its key bucket and field, one copy
with a plus and the other with a minus sign, so a cell that sums to zero is
equal in both copies.  Integer keys take two levels: coarse buckets of
neighbouring keys first, then fine ones inside the unequal coarse ones; other
keys take one level of hash buckets.  Only rows of unequal cells are then read,
brought together by key and compared field by field.

The unequal buckets of a level are a bitmap of bounded size, whatever the
tables: beyond it buckets share bits, so that a few more rows are compared.  No
full table is ever shuffled: a matrix is one aggregation with map-side combine,
and the rows of unequal buckets are one further aggregation by key, in which
repeated deliveries of a key collapse.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.runtime import durable, quoted

#: Words of 64 buckets in a bitmap, which is broadcast: a word has a mask for the
#: keys and one for each field.
MAX_WORDS = 1 << 18
#: 2**bits neighbouring integer keys a bucket, level by level.
LEVELS = (13, 3)
#: 2**bits buckets of keys that are no single integer.
HASH_BITS = 18
_LANE = 0xFFFFFFFF


def plain(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Only the columns that count, as ``k0, ..., v0, v1, ...``: no name can clash."""
    k = [F.col(quoted(x)).alias(f"k{i}") for i, x in enumerate(keys)]
    v = [F.col(quoted(f)).alias(f"v{i}") for i, f in enumerate(fields)]
    return df.select(*k, *v).dropna(subset=[f"k{i}" for i in range(len(keys))])


def key_buckets(left: DataFrame, right: DataFrame, n_keys: int, levels: tuple[int, ...] = LEVELS) -> list[Column]:
    """The bucket of a row at each level.

    Neighbouring integer keys share a bucket (rows lie roughly in key order, so
    map-side combine works); other keys are spread by hash.
    """
    if n_keys == 1 and all(isinstance(d.schema["k0"].dataType, T.IntegralType) for d in (left, right)):
        return [F.shiftright(F.col("k0").cast("long"), bits) for bits in levels]
    return [F.shiftrightunsigned(F.xxhash64(*[f"k{i}" for i in range(n_keys)]), 64 - HASH_BITS)]


def _canonical(name: str, kind: T.DataType, tolerance: float | None) -> Column:
    """Value to hash: equal canonical values are equal within the tolerance."""
    c = F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        if tolerance:
            d = F.rint(d / F.lit(tolerance))
        return F.when(F.isnan(d), F.lit(float("nan"))).otherwise(d + F.lit(0.0))
    return c


def _differs(a: Column, b: Column, kind: T.DataType, tolerance: float | None) -> Column:
    """Null against a value differs, null against null doesn't, and so NaN."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) and tolerance:
        plain = ~F.isnan(a) & ~F.isnan(b)
        near = F.coalesce(plain & (F.abs(a - b) <= F.lit(tolerance)), F.lit(False))
        return ~(a.eqNullSafe(b) | near)
    return ~a.eqNullSafe(b)


def unequal_buckets(left: DataFrame, right: DataFrame, tolerance: list[float | None], bucket: Column) -> DataFrame:
    """Rows ``(bucket, f_key, f_0, f_1, ...)``: unequal buckets and their unequal columns.

    ``left`` and ``right`` as ``plain`` gives them.
    """
    keys = [c for c in left.columns if c.startswith("k")]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        hashes = [F.xxhash64(F.lit(17), *keys)] + [F.xxhash64(F.lit(i), *keys, _canonical(f"v{i}", df.schema[f"v{i}"].dataType, t)) for i, t in enumerate(tolerance)]
        d = df.select(bucket.alias("bucket"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
        # two 32-bit lanes a hash: their sums can't overflow a bigint
        lanes = [x for i in range(len(hashes)) for x in (F.col(f"h{i}").bitwiseAND(F.lit(_LANE)) * sign, F.shiftrightunsigned(F.col(f"h{i}"), 32) * sign)]
        return d.select("bucket", *[x.alias(f"l{i}") for i, x in enumerate(lanes)])

    n = len(tolerance) + 1
    sums = signed(left, 1).unionAll(signed(right, -1)).groupBy("bucket").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(2 * n)])
    flags = [((F.col(f"l{2 * i}") != 0) | (F.col(f"l{2 * i + 1}") != 0)) for i in range(n)]
    return sums.select("bucket", *[f.alias(f"f_{'key' if i == 0 else i - 1}") for i, f in enumerate(flags)]).filter(
        reduce(or_, [F.col("f_key"), *[F.col(f"f_{i}") for i in range(len(tolerance))]])
    )


def bitmap(left: DataFrame, right: DataFrame, tolerance: list[float | None], bucket: Column, max_words: int) -> DataFrame:
    """Unequal buckets as ``(__word, __key, __0, __1, ...)``, a mask of 64 bits
    each; at most ``max_words`` rows, and written once."""
    bit = F.expr("shiftleft(1L, cast(bucket & 63 as int))")
    marks = ["key", *range(len(tolerance))]
    return durable(
        unequal_buckets(left, right, tolerance, bucket)
        .groupBy(_word(F.col("bucket"), max_words).alias("__word"))
        .agg(*[F.bit_or(F.when(F.col(f"f_{m}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"__{m}") for m in marks])
    )


def _word(bucket: Column, max_words: int) -> Column:
    return F.pmod(F.shiftright(bucket, 6), F.lit(max_words))


def marked(df: DataFrame, words: DataFrame, bucket: Column, n_fields: int, max_words: int) -> DataFrame:
    """Rows in unequal buckets, with ``__on_key, __on_0, ...``: what is unequal there."""
    marks = ["key", *range(n_fields)]
    # at most max_words rows
    d = df.select("*", bucket.alias("__b")).withColumn("__word", _word(F.col("__b"), max_words)).join(F.broadcast(words), "__word")
    on = {m: F.expr(f"(shiftright(__{m}, cast(__b & 63 as int)) & 1) = 1") for m in marks}
    return d.filter(reduce(or_, on.values())).select(*df.columns, *[c.alias(f"__on_{m}") for m, c in on.items()])


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    fields: list[str],
    tolerance: dict[str, float] | None = None,
    levels: tuple[int, ...] = LEVELS,
    names: tuple[str, str] = ("left", "right"),
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """All differences of two copies, one row each.

    Result: ``(<key columns>, what, left_value, right_value)``; ``what`` is
    ``only_<name>`` for a key that the other copy lacks (values null), else the
    name of the field that differs, with both values as strings.

    The key is one column or several, of any type.  Rows with a null in the key
    can't be matched and are left out.  Rows that repeat a key count once;
    should repeats disagree, the smallest non-null value of each field stands
    for the key (NaN is the largest).  Empty tables are valid: every key of the
    other copy then comes out.  Columns other than the key and ``fields`` are
    never read.  ``tolerance``: floats of a field that are no farther apart are
    equal.  ``levels``: smaller buckets cost a larger matrix, larger ones more
    rows read again per difference.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for c in (*keys, *fields):
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"{c} has different types in the two copies")
    near = [(tolerance or {}).get(f) for f in fields]
    sides = [plain(left, keys, fields), plain(right, keys, fields)]
    columns, n = sides[0].columns, len(fields)
    for bucket in key_buckets(*sides, len(keys), levels):
        # each level reads the tables again, but only what the one before left open
        words = bitmap(*[s.select(*columns) for s in sides], near, bucket, max_words)
        sides = [marked(s.select(*columns), words, bucket, n, max_words) for s in sides]

    def suspects(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            *[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))],
            F.lit(side).alias("__side"),
            *[F.when(F.col("__on_key") | F.col(f"__on_{i}"), F.col(f"v{i}")).alias(f"__v{i}") for i in range(n)],
        )

    both = suspects(sides[0], 0).unionAll(suspects(sides[1], 1))
    aggs = [F.max(F.col("__side") == s).alias(f"__in{s}") for s in (0, 1)]
    for i in range(n):
        aggs += [F.min(F.when(F.col("__side") == s, F.col(f"__v{i}"))).alias(f"__v{i}_{s}") for s in (0, 1)]
    own = [f"__k{i}" for i in range(len(keys))]
    g = both.groupBy(*own).agg(*aggs)

    text = lambda c: c.cast("string")
    null = F.lit(None).cast("string")
    entry = lambda what, a, b: F.struct(F.lit(what).alias("what"), a.alias("left_value"), b.alias("right_value"))
    cells = [
        F.when(~F.col("__in1"), entry(f"only_{names[0]}", null, null)),
        F.when(~F.col("__in0"), entry(f"only_{names[1]}", null, null)),
    ]
    in_both = F.col("__in0") & F.col("__in1")
    for i, f in enumerate(fields):
        a, b = F.col(f"__v{i}_0"), F.col(f"__v{i}_1")
        cells.append(F.when(in_both & _differs(a, b, left.schema[f].dataType, near[i]), entry(f, text(a), text(b))))
    return (
        g.select(*own, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("__d"))
        .select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "__d.what", "__d.left_value", "__d.right_value")
    )
