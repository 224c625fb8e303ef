"""Readers and writers.

File formats that Spark knows are read and written by Spark, with its
pushdown; Arrow IPC is a Python data source that reads record batches on the
executors.  A URL is fetched once by the driver and then read as a file.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import tempfile
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from quillon.frame import Frame
from quillon.runtime import ensure_checkpoint_dir, quoted


def in_file_order(df: DataFrame, position: Column) -> Frame:
    """Frame whose rows lie in the order of file names and of ``position`` within a file.

    Spark reads the largest pieces first, so several files need the order said
    in hidden columns; they are pruned where no order is asked for.  A single
    file lies in order as it is.
    """
    if len(df.inputFiles()) < 2:
        return Frame(df)
    at = df.select("*", F.col("_metadata.file_path").alias("__o0"), F.col("_metadata.file_block_start").alias("__o1"), position.alias("__o2"))
    return Frame(at, tuple((f"__o{i}", False, False) for i in range(3)))


# --- CSV


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, delimiter: str = ",", null_values: Iterable[str] = (), columns: Iterable[str] = (), multi_line: bool = True) -> Frame:
    """CSV file or folder.  Without a schema types are inferred, which reads the data twice.

    ``multi_line``: quoted fields may hold line ends; a file is then read by one
    task.  Without it large files are split.
    """
    reader = spark.read.option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    nulls = list(null_values)
    if not nulls:
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
        if schema is None:  # whole numbers are 64 bits wide
            df = df.withColumns({f.name: F.col(quoted(f.name)).cast("long") for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)})
    else:
        # several null spellings: read text, blank them, then give types
        text = reader.csv(path)
        text = text.select(*[F.when(~F.col(quoted(c)).isin(nulls), F.col(quoted(c))).alias(c) for c in text.columns])
        kinds = inferred(text) if schema is None else {f.name: f.dataType for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields}
        df = text.select(*[F.col(quoted(c)).try_cast(kinds[c]).alias(c) for c in text.columns])
    names = list(columns)
    f = in_file_order(df, F.monotonically_increasing_id())
    return f.select(*names) if names else f


def read_csv_chunks(spark: SparkSession, path: str, rows: int, **options) -> Iterator[pa.RecordBatch]:
    """A CSV file as Arrow batches of at most ``rows`` rows, in row order, a partition at a time."""
    return read_csv(spark, path, **options).iter_batches(rows)


def inferred(text: DataFrame) -> dict[str, T.DataType]:
    """Narrowest of bigint, double, boolean and string for text columns, in one pass."""
    tries = [("bigint", T.LongType()), ("double", T.DoubleType()), ("boolean", T.BooleanType())]
    c = lambda n: F.col(quoted(n))
    checks = [F.coalesce(F.bool_and(c(n).try_cast(k).isNotNull() | c(n).isNull()), F.lit(False)).alias(f"{i}_{k}") for i, n in enumerate(text.columns) for k, _ in tries]
    got = text.agg(*checks).first()
    return {n: next((t for k, t in tries if got[f"{i}_{k}"]), T.StringType()) for i, n in enumerate(text.columns)}


def write_csv(f: Frame, path: str, delimiter: str = ",") -> None:
    f.to_df(ordered=True).write.mode("overwrite").option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)


# --- Parquet


def read_parquet(spark: SparkSession, path: str) -> Frame:
    df = spark.read.parquet(path)
    return in_file_order(df, F.col("_metadata.row_index"))


def write_parquet(f: Frame, path: str, compression: str = "snappy", row_group_bytes: int | None = None) -> None:
    writer = f.to_df(ordered=True).write.mode("overwrite").option("compression", compression)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


# --- JSON


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Frame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return in_file_order(reader.json(path), F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str) -> Frame:
    """A JSON document: an array of objects, or one object of equally long arrays."""
    df = spark.read.option("multiLine", True).json(path)
    kinds = [f.dataType for f in df.schema.fields]
    if kinds and all(isinstance(k, T.ArrayType) for k in kinds) and df.limit(2).count() == 1:
        row = F.explode(F.arrays_zip(*[F.col(quoted(c)) for c in df.columns])).alias("r")
        df = df.select(row).select(*[F.col("r").getField(c).alias(c) for c in df.columns])
    return Frame(df)


def write_ndjson(f: Frame, path: str) -> None:
    f.to_df(ordered=True).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(f: Frame, path: str) -> None:
    """One JSON array in one file, written by the driver row by row."""
    rows = f.to_df(ordered=True)
    names = rows.columns
    text = rows.select(F.to_json(F.struct(*[F.col(quoted(c)) for c in names]), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, r in enumerate(text.toLocalIterator(prefetchPartitions=True)):
            out.write((",\n" if i else "\n") + r["j"])
        out.write("\n]\n")


# --- Arrow IPC


def _files(path: str) -> list[str]:
    p = Path(path)
    return sorted(str(x) for x in p.iterdir() if x.is_file() and not x.name.startswith(("_", "."))) if p.is_dir() else [path]


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    """Batches of an IPC file or stream, one in memory at a time."""
    with pa.memory_map(path) as m:
        if m.read(6) == b"ARROW1":
            m.seek(0)
            with pa.ipc.open_file(m) as reader:
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)
        else:
            m.seek(0)
            with pa.ipc.open_stream(m) as reader:
                yield from reader


def ipc_schema(path: str) -> pa.Schema:
    with pa.memory_map(_files(path)[0]) as m:
        opened = pa.ipc.open_file if m.read(6) == b"ARROW1" else pa.ipc.open_stream
        m.seek(0)
        with opened(m) as reader:
            return reader.schema


#: Bytes of record batches for one task.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class Piece:
    """A record batch where it lies: the ``at``-th of an IPC file, or the message from byte ``at`` on of a stream.

    ``head``: first and last bytes of the stream's schema and of the
    dictionaries that hold for the batch; None for a file.  ``rows`` is None
    where only reading the batch tells.
    """

    path: str
    at: int
    size: int
    rows: int | None
    head: tuple[tuple[int, int], ...] | None


def _field(meta: bytes, table: int, slot: int) -> int | None:
    """Place of a field of a flatbuffer table, or None if it has its default."""
    vtable = table - struct.unpack_from("<i", meta, table)[0]
    at = 4 + 2 * slot
    offset = struct.unpack_from("<H", meta, vtable + at)[0] if at < struct.unpack_from("<H", meta, vtable)[0] else 0
    return table + offset if offset else None


def _value(meta: bytes, table: int, slot: int, form: str) -> int:
    at = _field(meta, table, slot)
    return 0 if at is None else struct.unpack_from(form, meta, at)[0]


_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3


def pieces(path: str) -> Iterator[Piece]:
    """The record batches of an IPC file or stream; of a stream only the messages' metadata is read."""
    with open(path, "rb") as f:
        if f.read(6) == b"ARROW1":
            with pa.memory_map(path) as m, pa.ipc.open_file(m) as reader:
                n = reader.num_record_batches
            yield from (Piece(path, i, os.path.getsize(path) // n, None, None) for i in range(n))
            return
        f.seek(0)
        schema: tuple[int, int] = (0, 0)
        dictionaries: dict[int, list[tuple[int, int]]] = {}
        head: tuple[tuple[int, int], ...] = ()
        total = os.path.getsize(path)
        while len(word := f.read(4)) == 4:
            start, (n,) = f.tell() - 4, struct.unpack("<I", word)
            if n == 0xFFFFFFFF:  # streams before Arrow 0.15 have no such mark
                n = int.from_bytes(f.read(4), "little")
            if not n:
                return
            meta = f.read(n)
            if len(meta) < n:
                raise pa.ArrowInvalid(f"{path} ends within a message")
            root = struct.unpack_from("<I", meta)[0]
            kind, end = _value(meta, root, 1, "<B"), f.tell() + _value(meta, root, 3, "<q")
            if end > total:
                raise pa.ArrowInvalid(f"{path} ends within a message")
            f.seek(end)
            header = _field(meta, root, 2)
            header += struct.unpack_from("<I", meta, header)[0]
            if kind == _BATCH:
                yield Piece(path, start, end - start, _value(meta, header, 0, "<q"), head)
                continue
            if kind == _SCHEMA:
                schema = (start, end)
            elif kind == _DICTIONARY:
                ident, delta = _value(meta, header, 0, "<q"), _value(meta, header, 2, "<B")
                before = dictionaries.pop(ident, []) if not delta else dictionaries.setdefault(ident, [])
                dictionaries[ident] = [*before, (start, end)] if delta else [(start, end)]
            head = (schema, *(x for d in dictionaries.values() for x in d))


def _tasks(found: Iterable[Piece]) -> list[list[Piece]]:
    """Pieces in order for one task each."""
    out: list[list[Piece]] = [[]]
    size = 0
    for p in found:
        if out[-1] and size + p.size > PART_BYTES:
            out.append([])
            size = 0
        out[-1].append(p)
        size += p.size
    return out


def _piece_batches(found: Iterable[Piece], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of pieces as ``schema`` says, one in memory at a time."""
    for (path, of_file), run in itertools.groupby(found, lambda p: (p.path, p.head is None)):
        if of_file:
            with pa.memory_map(path) as m, pa.ipc.open_file(m) as reader:
                for p in run:
                    yield _as(reader.get_batch(p.at), schema)
            continue
        with open(path, "rb") as f:
            part = lambda a, b: f.seek(a) >= 0 and f.read(b - a)  # noqa: E731, B023
            for p in run:
                with pa.ipc.open_stream(b"".join([*(part(*x) for x in p.head), part(p.at, p.at + p.size)])) as reader:
                    yield from (_as(b, schema) for b in reader)


def _as(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema)


class Landed(Frame):
    """A frame of record batches on shared storage.

    It holds where they lie, not their rows; the plan is made when it is asked
    for, one scan for any number of batches, so thousands can be put together.
    """

    pieces: tuple[Piece, ...] = ()

    @classmethod
    def of_pieces(cls, spark: SparkSession, kind: T.StructType, found: Iterable[Piece]) -> Landed:
        f = cls.__new__(cls)
        f.spark, f.kind, f.pieces, f.order, f.dense = spark, kind, tuple(found), None, False
        return f

    @cached_property
    def df(self) -> DataFrame:
        tasks, target = _tasks(self.pieces), to_arrow_schema(self.kind)
        return from_source(self.spark, self.kind, len(tasks), lambda part: _piece_batches(tasks[part], target)).df

    def height(self) -> int:
        known = [p.rows for p in self.pieces]
        return sum(known) if known and None not in known else super().height()

    def vstack(self, *others: Frame) -> Frame:
        if self.pieces and all(isinstance(o, Landed) and o.pieces and o.kind == self.kind for o in others):
            return Landed.of_pieces(self.spark, self.kind, (p for f in (self, *others) for p in f.pieces))
        return super().vstack(*others)

    extend = vstack


class _IpcPart(InputPartition):
    def __init__(self, found: list[Piece], index: int):
        super().__init__(index)
        self.pieces = found


class _IpcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.target = path, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [_IpcPart(t, i) for i, t in enumerate(_tasks(x for p in _files(self.path) for x in pieces(p)))]

    def read(self, partition: _IpcPart) -> Iterator[pa.RecordBatch]:
        yield from _piece_batches(partition.pieces, self.target)


class IpcSource(DataSource):
    """Arrow IPC files or streams: ``spark.read.format("arrow_ipc").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        return from_arrow_schema(ipc_schema(self.options["path"]), prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _IpcReader(self.options["path"], schema)


def read_ipc(spark: SparkSession, path: str) -> Frame:
    spark.dataSource.register(IpcSource)
    return Frame(spark.read.format("arrow_ipc").load(path))


def write_ipc(f: Frame, path: str) -> None:
    """One IPC file, filled batch by batch in row order."""
    _write(f, path, pa.ipc.new_file)


def write_ipc_stream(path: str, frames: list[Frame]) -> None:
    """Frames of one schema into one IPC stream."""
    schema = _plain(to_arrow_schema(frames[0].to_df().schema))
    with pa.OSFile(path, "wb") as out, pa.ipc.new_stream(out, schema) as writer:
        for f in frames:
            for b in arrow_batches(f):
                writer.write_batch(b.cast(schema))


def _plain(schema: pa.Schema) -> pa.Schema:
    return schema.remove_metadata()


def arrow_batches(f: Frame) -> Iterator[pa.RecordBatch]:
    """Batches of a frame in row order, a partition at a time."""
    df = f.to_df(ordered=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({"b": [sink.getvalue().to_pybytes()]})

    for row in df.mapInArrow(pack, "b binary").toLocalIterator():
        with pa.ipc.open_stream(bytes(row["b"])) as reader:
            yield from reader


def _write(f: Frame, path: str, new) -> None:
    schema = _plain(to_arrow_schema(f.to_df().schema))
    with pa.OSFile(path, "wb") as out, new(out, schema) as writer:
        for b in arrow_batches(f):
            writer.write_batch(b.cast(schema))


def read_ipc_stream(spark: SparkSession, path: str) -> Iterator[Frame]:
    """A frame per batch of an IPC stream on shared storage; the rows stay there."""
    kind = from_arrow_schema(ipc_schema(path), prefer_timestamp_ntz=True)
    for p in pieces(path):
        yield Landed.of_pieces(spark, kind, [p])


# --- databases and URLs


def read_jdbc(spark: SparkSession, url: str, query: str, fetch_size: int = 8192, partition: tuple[str, int, int, int] | None = None, **options: str) -> Frame:
    """Result of a query on a database; times come as UTC microseconds (bigint).

    ``partition``: numeric column, lowest and highest value and number of
    parallel reads; without it one task reads everything.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    if partition:
        c, low, high, n = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", c).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    else:
        reader = reader.option("query", query)
    return Frame(database_types(reader.load()))


def database_types(df: DataFrame) -> DataFrame:
    """Column types of database results: bigint, double, boolean, microseconds or string."""

    def one(f: T.StructField):
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_micros(c.cast("timestamp"))
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("long")
        if isinstance(f.dataType, T.NumericType):
            return c.cast("double")
        return c if isinstance(f.dataType, T.BooleanType) else c.cast("string")

    return df.select(*[one(f).alias(f.name) for f in df.schema.fields])


def read_cursor(spark: SparkSession, cursor, schema: T.StructType | str, batch_rows: int = 8192) -> Iterator[Frame]:
    """Frames of at most ``batch_rows`` rows of an open DB-API cursor.

    The driver holds one batch: each is written to an IPC stream in the shared
    folder, of which the frames are parts.  A shared folder that isn't mounted
    as a path leaves the rows at the driver.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    folder = ensure_checkpoint_dir(spark)
    if urllib.parse.urlparse(folder).scheme not in ("", "file"):
        while rows := cursor.fetchmany(batch_rows):
            yield Frame(spark.createDataFrame([tuple(r) for r in rows], kind).coalesce(1))
        return
    path = f"{urllib.parse.urlparse(folder).path.rstrip('/')}/cursors/{uuid.uuid4().hex}.arrow"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    target, check = to_arrow_schema(kind), T._make_type_verifier(kind)
    with open(path, "wb") as out:
        head = ((0, out.write(target.serialize())),)
        while rows := [tuple(r) for r in cursor.fetchmany(batch_rows)]:
            for r in rows:
                check(r)
            for b in LocalDataToArrowConversion.convert(rows, kind, False).cast(target).combine_chunks().to_batches():
                start = out.tell()
                size = out.write(b.serialize())
                out.flush()
                yield Landed.of_pieces(spark, kind, [Piece(path, start, size, b.num_rows, head)])
        out.write(b"\xff\xff\xff\xff\0\0\0\0")  # the end of an IPC stream


def write_jdbc(f: Frame, url: str, table: str, mode: str = "append", **options: str) -> None:
    f.to_df().write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def fetch(url: str, timeout: float = 60.0) -> str:
    """Download to a file of the driver; its path."""
    suffix = os.path.splitext(urllib.parse.urlparse(url).path)[1]
    handle, path = tempfile.mkstemp(suffix=suffix)
    with urllib.request.urlopen(url, timeout=timeout) as r, os.fdopen(handle, "wb") as out:  # noqa: S310
        while chunk := r.read(1 << 20):
            out.write(chunk)
    return path


def local_table(path: str) -> pa.Table:
    """A file of the driver as an Arrow table."""
    import pyarrow.csv
    import pyarrow.json
    import pyarrow.parquet

    kind = os.path.splitext(path)[1].lower()
    if kind in (".csv", ".tsv"):
        return pyarrow.csv.read_csv(path, parse_options=pyarrow.csv.ParseOptions(delimiter="\t" if kind == ".tsv" else ",", newlines_in_values=True))
    if kind in (".parquet", ".pq"):
        return pyarrow.parquet.read_table(path)
    if kind in (".ndjson", ".jsonl"):
        return pyarrow.json.read_json(path)
    if kind == ".json":
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return pa.table(data) if isinstance(data, dict) else pa.Table.from_pylist(data)
    return pa.Table.from_batches(list(_batches(path)))


def read_url(spark: SparkSession, url: str) -> Frame:
    """CSV, Parquet, JSON, NDJSON or IPC from a URL, by its extension.

    The driver fetches the file and hands its rows over, for executors don't
    see the driver's disk; a file beyond the driver's memory belongs into
    shared storage and ``scan``.
    """
    path = fetch(url)
    try:
        return Frame.from_arrow(spark, local_table(path))
    finally:
        os.unlink(path)


def from_source(spark: SparkSession, schema: T.StructType | str, parts: int, read: Callable[[int], Iterable[pa.RecordBatch]]) -> Frame:
    """A lazy frame over a source of one's own.

    ``read(part)`` yields the Arrow batches of a part, from 0 to ``parts`` - 1;
    it runs on the executors, when the frame does, and may run again if one is
    lost.  Rows lie in the order of parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                yield from read(part)

    return Frame(spark.range(0, parts, 1, parts).mapInArrow(run, schema))


def scan(spark: SparkSession, path: str, **options) -> Frame:
    """Lazy read by extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {".csv": read_csv, ".tsv": read_csv, ".parquet": read_parquet, ".pq": read_parquet, ".json": read_json, ".ndjson": read_ndjson, ".jsonl": read_ndjson, ".arrow": read_ipc, ".ipc": read_ipc, ".feather": read_ipc}
    if kind not in readers:
        raise ValueError(f"no reader for {kind or path}")
    if kind == ".tsv":
        options = {"delimiter": "\t", **options}
    return readers[kind](spark, path, **options)


def save(f: Frame, path: str) -> None:
    """Write by extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    writers = {".csv": write_csv, ".parquet": write_parquet, ".pq": write_parquet, ".json": write_json, ".ndjson": write_ndjson, ".jsonl": write_ndjson, ".arrow": write_ipc, ".ipc": write_ipc}
    if kind == ".tsv":
        return write_csv(f, path, "\t")
    if kind not in writers:
        raise ValueError(f"no writer for {kind or path}")
    return writers[kind](f, path)
