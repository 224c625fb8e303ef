"""Stage pipelines over streams.

The stages are plain DataFrame functions, so one pipeline runs on a bounded
frame and on an unbounded stream; row-local stages keep no state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.expr import AGGREGATES, ORDERED, RESHAPING, Expr, contains
from quillon.frame import Frame
from quillon.runtime import ensure_checkpoint_dir, quoted

Stage = Callable[[DataFrame], DataFrame]


def _row_local(*exprs: Expr) -> None:
    if any(contains(e, AGGREGATES | ORDERED | RESHAPING | {"over"}) for e in exprs):
        raise ValueError("a stage sees one batch at a time: only row-local expressions")


def filter_stage(pred: Expr) -> Stage:
    _row_local(pred)
    return lambda df: Frame(df).filter(pred).df


def project_stage(*exprs: Expr) -> Stage:
    _row_local(*exprs)
    return lambda df: Frame(df).select(*exprs).df


def with_columns_stage(*exprs: Expr) -> Stage:
    _row_local(*exprs)
    return lambda df: Frame(df).with_columns(*exprs).df


def rename_stage(old: str, new: str) -> Stage:
    return lambda df: Frame(df).rename(old, new).df


def drop_stage(*names: str) -> Stage:
    return lambda df: df.drop(*names)


def map_stage(f: Callable, schema: T.StructType | str) -> Stage:
    """Host function on Arrow batches, in parallel."""
    return lambda df: df.mapInArrow(f, schema)


def window_stage(ts: str, width: str, keys: Iterable[str], aggs: dict[str, F.Column] | dict, late: str = "10 minutes", slide: str | None = None) -> Stage:
    """Aggregates per event-time window and keys; rows later than ``late`` are dropped."""

    def run(df: DataFrame) -> DataFrame:
        timed = df.withColumn("__ts", F.col(quoted(ts)).cast("timestamp"))
        timed = timed.withWatermark("__ts", late) if df.isStreaming else timed
        w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
        g = timed.groupBy(w.alias("__w"), *[F.col(quoted(k)) for k in keys]).agg(*[c.alias(n) for n, c in aggs.items()])
        return g.select(F.col("__w.start").cast("timestamp_ntz").alias("window_start"), *keys, *aggs)

    return run


def session_stage(ts: str, gap: str, keys: Iterable[str], aggs: dict, late: str = "10 minutes") -> Stage:
    """Aggregates per session: rows of a key no farther apart than ``gap``."""

    def run(df: DataFrame) -> DataFrame:
        timed = df.withColumn("__ts", F.col(quoted(ts)).cast("timestamp"))
        timed = timed.withWatermark("__ts", late) if df.isStreaming else timed
        g = timed.groupBy(F.session_window("__ts", gap).alias("__w"), *[F.col(quoted(k)) for k in keys]).agg(*[c.alias(n) for n, c in aggs.items()])
        return g.select(F.col("__w.start").cast("timestamp_ntz").alias("session_start"), *keys, *aggs)

    return run


class Pipeline:
    """Source, stages, sink."""

    def __init__(self, source: DataFrame, *stages: Stage):
        self.source, self.stages = source, stages

    def frame(self) -> DataFrame:
        df = self.source
        for stage in self.stages:
            df = stage(df)
        return df

    def start(self, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
        """Write what is there as Parquet; progress and state live in ``checkpoint``."""
        return self.frame().writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

    def collect(self, name: str, mode: str = "append") -> DataFrame:
        """Run over what is there and keep the result in the shared folder, as a table."""
        spark, df = self.source.sparkSession, self.frame()
        folder = f"{state_folder(spark, name)}-{uuid.uuid4().hex}"
        rows, progress = f"{folder}/rows", f"{folder}/progress"
        # Parquet has no type for columns of nulls alone
        kinds = {f.name: f.dataType for f in df.schema.fields}
        kept = df.select(*[F.col(quoted(n)).cast("string").alias(n) if isinstance(k, T.NullType) else F.col(quoted(n)) for n, k in kinds.items()])
        writer = kept.writeStream.queryName(name).option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            q = writer.format("parquet").option("path", rows).start()
        else:
            # a complete result replaces the one before; a batch that is run again replaces its own
            q = writer.foreachBatch(lambda part, batch: part.write.mode("overwrite").parquet(f"{rows}/{'all' if mode == 'complete' else batch}")).start()
        q.awaitTermination()
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(progress), True)
        reader = spark.read.schema(kept.schema)
        if mode != "append":
            reader = reader.option("recursiveFileLookup", True)
        got = reader.parquet(rows) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(rows)) else spark.createDataFrame([], kept.schema)
        got.select(*[F.lit(None).alias(n) if isinstance(k, T.NullType) else F.col(quoted(n)) for n, k in kinds.items()]).createOrReplaceTempView(name)
        return spark.table(name)

    def slice(self, sink: str, checkpoint: str, offset: int, length: int) -> StreamingQuery:
        """Rows [offset, offset + length) across batches, as Parquet.

        Each batch's number of rows is written beside the result, so a batch
        that is run again, or runs after a restart, starts at the same row.
        """
        out, spark = sink.rstrip("/"), self.source.sparkSession
        counts = f"{out}-counts"

        def run(df: DataFrame, batch: int) -> None:
            rows = df.persist()
            spark.range(1).select(F.lit(rows.count()).alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={batch}")
            start = spark.read.parquet(counts).filter(F.col("batch") < batch).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            low, high = max(offset - start, 0), offset + length - start
            if high > 0:
                rows.offset(low).limit(max(high - low, 0)).write.mode("overwrite").parquet(f"{out}/batch={batch}")
            rows.unpersist()

        return self.frame().writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1000, pattern: str | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def state_folder(spark: SparkSession, name: str) -> str:
    """Folder for a stream's checkpoint below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}"
