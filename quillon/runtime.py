"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key for one task; a key with more is cut into pieces of that size.
PIECE_ROWS = 1 << 18
#: Most keys that can be large enough to be cut.
MAX_BIG_KEYS = 1 << 16


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session
    (tests, notebooks) may leave it unset and uses a folder of this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    folder = named or os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Later reads survive the loss of any executor and don't repeat the work.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(name: str, case: str) -> Column:
    """Key spelling: blanks trimmed, case ignored (``case`` is upper or lower)."""
    trimmed = F.trim(F.col(quoted(name)))
    return F.upper(trimmed) if case == "upper" else F.lower(trimmed)


def quoted(name: str) -> str:
    """A column name usable in F.col whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def key_pieces(rows: DataFrame, keys: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Keys with more rows than one piece holds: ``(keys..., __pieces)``.

    Exact counts.  A piece has ``piece_rows`` rows, or more where the table is
    so large that over ``MAX_BIG_KEYS`` keys could exceed it; so the result has
    at most ``MAX_BIG_KEYS`` rows whatever the table and may be broadcast.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    size = F.greatest(F.lit(piece_rows).cast("long"), F.ceil(counts.agg(F.sum("__n")).scalar() / MAX_BIG_KEYS))
    return counts.filter(F.col("__n") > size).select(*keys, F.ceil(F.col("__n") / size).cast("int").alias("__pieces"))


def with_pieces(rows: DataFrame, keys: list[str], ident: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``__piece``: rows of large keys are spread by ``ident``, others have piece 0.

    Keys must not be null.  (keys, __piece) is then a layout in which no task
    gets more than about one piece of any key.
    """
    cut = rows.join(F.broadcast(key_pieces(rows, keys, piece_rows)), keys, "left")
    return cut.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(ident), F.col("__pieces")).cast("int"), F.lit(0))).drop("__pieces")
