import datetime as dt
import json
import sqlite3

import pyarrow as pa
import pytest

from quillon import Frame, concat
from quillon.sources import files


@pytest.fixture(scope="module")
def f(spark):
    return Frame.from_map(spark, {"i": [1, None, 3], "x": [1.5, float("nan"), None], "s": ['a "q", b', "línea\nzwei", None], "t": [dt.datetime(2026, 1, 2, 3, 4, 5, 6), None, None], "l": [[1, 2], [], None]})


def same(a, b):
    return [repr(tuple(r)) for r in a.collect()] == [repr(tuple(r)) for r in b.collect()]


@pytest.mark.parametrize("kind", ["parquet", "ndjson", "json", "arrow", "csv", "tsv"])
def test_round_trips(spark, f, tmp_path, kind):
    if kind != "arrow" and kind != "parquet":
        f = f.select("i", "s")
    path = str(tmp_path / f"f.{kind}")
    files.save(f, path)
    assert same(files.scan(spark, path).select(*f.columns), f)


def test_csv_options(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a;b;c\n1;NA;x\n2;3.5;-\n")
    g = files.read_csv(spark, str(p), delimiter=";", null_values=["NA", "-"])
    assert [tuple(r) for r in g.collect()] == [(1, None, "x"), (2, 3.5, None)] and g.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert files.read_csv(spark, str(p), delimiter=";", columns=["c"]).columns == ["c"]
    assert files.read_csv(spark, str(p), schema="a string, b string, c string", delimiter=";", header=False).height() == 3


def test_json_documents(spark, tmp_path):
    (tmp_path / "rows.json").write_text('[{"a": 1, "b": "x"}, {"a": 2.5, "b": null}]')
    (tmp_path / "cols.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "rows.json")).collect()] == [(1.0, "x"), (2.5, None)]
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "cols.json")).collect()] == [(1, "x"), (2, "y")]


def test_written_json_is_one_document(f, tmp_path):
    files.write_json(f.select("i", "s"), str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text())[1] == {"i": None, "s": "línea\nzwei"}


def test_ipc_streams(spark, f, tmp_path):
    path = str(tmp_path / "s.arrow")
    files.write_ipc_stream(path, [f, f])
    assert files.read_ipc(spark, path).height() == 6
    assert sum(g.height() for g in files.read_ipc_stream(spark, path)) == 6
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        with pa.OSFile(str(folder / f"{k}.arrow"), "wb") as out, pa.ipc.new_file(out, pa.schema([("n", pa.int64())])) as w:
            w.write_table(pa.table({"n": [k]}))
    assert sorted(r[0] for r in files.read_ipc(spark, str(folder)).collect()) == [0, 1, 2]


def test_database_cursor_and_types(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE n (n INTEGER)")
    db.executemany("INSERT INTO n VALUES (?)", [(i,) for i in range(2500)])
    parts = list(files.read_cursor(spark, db.execute("SELECT n FROM n ORDER BY n"), "n long", 1000))
    assert [p.height() for p in parts] == [1000, 1000, 500]
    df = spark.sql("SELECT CAST(1 AS INT) AS i, CAST(1.5 AS DECIMAL(5,2)) AS d, true AS b, TIMESTAMP'1970-01-01 00:00:01Z' AS t, 'x' AS s")
    assert tuple(files.database_types(df).first()) == (1, 1.5, True, 1_000_000, "x")


def test_url_of_a_file(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a,b\n1,x\n")
    assert [tuple(r) for r in files.read_url(spark, (tmp_path / "u.csv").as_uri()).collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        files.scan(spark, "x.unknown")


def test_frames_of_a_stream_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "many.arrow")
    kind = pa.schema([("n", pa.int64()), ("d", pa.dictionary(pa.int32(), pa.string())), ("t", pa.timestamp("us"))])
    with pa.OSFile(path, "wb") as out, pa.ipc.new_stream(out, kind, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)) as w:
        for k in range(300):
            # dictionaries grow, and are replaced
            words = [f"w{i}" for i in range(k % 50 + 1)]
            w.write_batch(pa.record_batch([pa.array([2 * k, None]), pa.DictionaryArray.from_arrays(pa.array([0, k % 50], pa.int32()), words), pa.array([dt.datetime(2026, 1, 1), None])], schema=kind))
        w.write_batch(pa.record_batch([pa.array([], pa.int64()), pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), ["w0"]), pa.array([], pa.timestamp("us"))], schema=kind))
    frames = list(files.read_ipc_stream(spark, path))
    assert len(frames) == 301 and [g.height() for g in frames[-2:]] == [2, 0]
    assert [tuple(r) for r in frames[7].collect()] == [(14, "w0", dt.datetime(2026, 1, 1)), (None, "w7", None)]
    whole = concat(*frames)
    assert whole.df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [(v, w, t) for k in range(300) for v, w, t in ((2 * k, "w0", dt.datetime(2026, 1, 1)), (None, f"w{k % 50}", None))]
    assert [tuple(r) for r in whole.collect()] == want and [tuple(r) for r in files.read_ipc(spark, path).collect()] == want
    with open(path, "rb") as f, open(tmp_path / "cut.arrow", "wb") as out:
        out.write(f.read()[:-500])
    with pytest.raises(pa.ArrowInvalid):
        list(files.read_ipc_stream(spark, str(tmp_path / "cut.arrow")))


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 100)
    for kind, new in (("s", pa.ipc.new_stream), ("f", pa.ipc.new_file)):
        path = str(tmp_path / f"{kind}.arrow")
        with pa.OSFile(path, "wb") as out, new(out, pa.schema([("n", pa.int64())])) as w:
            for k in range(5):
                w.write_batch(pa.record_batch({"n": [k]}))
        assert len(files._tasks(files.pieces(path))) == 5
        assert [r[0] for g in files.read_ipc_stream(spark, path) for r in g.collect()] == list(range(5))


def test_cursor_rows_are_parts_of_one_file(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE n (n INTEGER, x REAL, s TEXT)")
    db.executemany("INSERT INTO n VALUES (?, ?, ?)", [(i, i / 2, None if i % 7 else f"é{i}") for i in range(5000)])
    parts = list(files.read_cursor(spark, db.execute("SELECT * FROM n ORDER BY n"), "n long, x double, s string", 10))
    assert len(parts) == 500 and {p.height() for p in parts} == {10}
    whole = concat(*parts)
    assert whole.df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in whole.collect()] == [(i, i / 2, None if i % 7 else f"é{i}") for i in range(5000)]
    # a batch can be used while the cursor is read
    seen = [tuple(p.collect()[0]) for p in files.read_cursor(spark, db.execute("SELECT n FROM n WHERE n < 3 ORDER BY n"), "n long", 1)]
    assert seen == [(0,), (1,), (2,)]
    when = dt.datetime(2026, 1, 2, 3, 4, 5, 6)

    class Cursor:
        left = [[(when, when, [1, None], (1, "x"), {"a": 1.5}, dt.date(2026, 1, 2), b"\x00")]]

        def fetchmany(self, n):
            return self.left.pop() if self.left else []

    kind = "t timestamp, u timestamp_ntz, l array<long>, r struct<a: long, b: string>, m map<string, double>, d date, b binary"
    want = spark.createDataFrame(Cursor.left[0], kind).collect()
    assert next(files.read_cursor(spark, Cursor(), kind)).collect() == want
    with pytest.raises(TypeError):
        next(files.read_cursor(spark, db.execute("SELECT s FROM n"), "s long"))
