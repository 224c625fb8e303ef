"""Read-only tool calls over files, with plain JSON values in and out."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, islice
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Row, SparkSession

from quillon import cli
from quillon.frame import Frame
from quillon.order import BLOCK_ROWS
from quillon.sources.files import scan

#: Rows of one answer; ``next`` then says where the following page begins.
PAGE_ROWS = 1000
#: More rows than any answer has.
_FAR = 1 << 62


#: Answers that are kept open, so that their next page goes on where the last one ended.
OPEN_ANSWERS = 8
_open: OrderedDict[tuple[str, int], Iterator[Row]] = OrderedDict()


@cache
def _hadoop(spark: SparkSession) -> tuple:
    return spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()


def _state(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """Files below paths with their sizes and times of change; None for what can't be listed."""
    (fs_path, conf), found = _hadoop(spark), []
    try:
        for p in paths:
            at = fs_path(p)
            each = at.getFileSystem(conf).listFiles(at, True)
            while each.hasNext():
                found.append(re.sub(r"access_time=\d+", "", each.next().toString()))
    except Py4JJavaError:
        return None
    return repr(sorted(found))


def _rows_from(f: Frame, offset: int) -> Iterator[Row]:
    """Rows in order from ``offset`` on, a partition at a time at the driver."""
    if offset < 0:
        raise ValueError("the offset is negative")
    if offset > BLOCK_ROWS:
        return f.slice(offset, _FAR).to_df(ordered=True).toLocalIterator()
    return islice(f.to_df(ordered=True).toLocalIterator(), offset, None)


def _page(spark: SparkSession, asked: tuple, paths: Iterable[str], make: Callable[[], Frame], offset: int = 0) -> dict:
    """Rows from ``offset`` on, and the offset of the next page or null.

    A page that follows another of the same answer, over unchanged files, reads
    on; any other begins anew.
    """
    state = _state(spark, paths)
    key = repr((spark.sparkContext.applicationId, asked, state))
    rows = _open.pop((key, offset), None) if state else None
    keep = state is not None
    if rows is None:
        f = make()
        if offset == 0 and f.order is not None:  # a top-n needs no sort of all rows
            rows, keep = iter(f.slice(0, PAGE_ROWS + 1).collect()), False
        else:
            rows = _rows_from(f, offset) if keep else iter(f.slice(offset, PAGE_ROWS + 1).collect())
    got = [r.asDict(True) for r in islice(rows, PAGE_ROWS)]
    after = list(islice(rows, 1))
    if after and keep:
        _open[key, offset + PAGE_ROWS] = chain(after, rows)
        while len(_open) > OPEN_ANSWERS:
            _open.popitem(last=False)
    return {"rows": json.loads(json.dumps(got, default=str)), "next": offset + PAGE_ROWS if after else None}


TOOLS = {
    "schema": lambda spark, path: [{"name": n, "type": t} for n, t in scan(spark, path).dtypes],
    "rows": lambda spark, path, offset=0: _page(spark, ("rows", path), [path], lambda: scan(spark, path), offset),
    "head": lambda spark, path, n=10, offset=0: _page(spark, ("head", path, n), [path], lambda: scan(spark, path).head(n), offset),
    "describe": lambda spark, path: _page(spark, ("describe", path), [path], lambda: scan(spark, path).describe()),
    "sql": lambda spark, query, paths, offset=0: _page(spark, ("sql", query, *paths), paths, lambda: cli.sql(spark, query, *paths), offset),
    "row_count": lambda spark, path: scan(spark, path).height(),
    "null_counts": lambda spark, path: _page(spark, ("null_counts", path), [path], lambda: scan(spark, path).null_count())["rows"][0],
}


def call(spark: SparkSession, tool: str, **arguments: Any) -> Any:
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool}")
    return TOOLS[tool](spark, **arguments)
