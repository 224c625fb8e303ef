"""Command line: ``python -m quillon.cli <command> ...`` over files."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce
from operator import and_

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import introspect
from quillon.frame import Frame, concat
from quillon.runtime import quoted
from quillon.script import Interpreter, prompt_loop, transpile
from quillon.sources import files
from quillon.sql import Session


def sql(spark: SparkSession, query: str, *paths: str) -> Frame:
    """SQL over files; a table has the name of its file without extension."""
    session = Session(spark)
    for p in paths:
        session.register(os.path.splitext(os.path.basename(p.rstrip("/")))[0], files.scan(spark, p))
    return session.query(query)


def diff(left: Frame, right: Frame, key: list[str] | None = None) -> Frame:
    """Rows added, removed and changed, by key or by position: ``(change, <key>, left, right)``."""
    if left.columns != right.columns:
        raise ValueError("the frames have different columns")
    if not key:
        key = ["row"]
        left, right = left.with_row_index("row"), right.with_row_index("row")
    rest = [c for c in left.columns if c not in key]
    side = lambda f, n: f.df.select(*[F.col(quoted(k)).alias(f"__{n}{i}") for i, k in enumerate(key)], F.struct(*[F.col(quoted(c)) for c in rest] or [F.lit(0).alias("none")]).alias(n))
    a, b = side(left, "left"), side(right, "right")
    j = a.join(b, reduce(and_, [a[f"__left{i}"].eqNullSafe(b[f"__right{i}"]) for i in range(len(key))]), "full")
    change = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").when(~F.col("left").eqNullSafe(F.col("right")), "changed")
    keys = [F.coalesce(f"__left{i}", f"__right{i}").alias(k) for i, k in enumerate(key)]
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return Frame(j.withColumn("change", change).filter(F.col("change").isNotNull()).select("change", *keys, text("left"), text("right")))


def convert(spark: SparkSession, source: str, target: str) -> None:
    files.save(files.scan(spark, source), target)


def cat(spark: SparkSession, *paths: str) -> Frame:
    return concat(*[files.scan(spark, p) for p in paths])


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *more in (("schema",), ("stats",), ("nulls",), ("count",), ("head", "n"), ("tail", "n"), ("peek", "n"), ("sample", "n")):
        q = sub.add_parser(name)
        q.add_argument("path")
        for m in more:
            q.add_argument(m, nargs="?", type=int, default=10)
    q = sub.add_parser("sql")
    q.add_argument("query")
    q.add_argument("paths", nargs="+")
    q = sub.add_parser("diff")
    q.add_argument("left")
    q.add_argument("right")
    q.add_argument("--key", default="")
    q = sub.add_parser("convert")
    q.add_argument("source")
    q.add_argument("target")
    q = sub.add_parser("cat")
    q.add_argument("paths", nargs="+")
    sub.add_parser("transpile").add_argument("path")
    q = sub.add_parser("run")
    q.add_argument("path")
    q.add_argument("--profile", action="store_true", help="print the time of every statement")
    q.add_argument("--trace", action="store_true", help="print what each operator of the last frame did")
    sub.add_parser("prompt")
    q = sub.add_parser("explain")
    q.add_argument("path")
    q.add_argument("--form", choices=("text", "tree", "mermaid"), default="text")
    a = p.parse_args(argv)

    if a.command == "transpile":
        with open(a.path, encoding="utf-8") as f:
            print(transpile(f.read()), end="")
        return 0
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    s = Interpreter(spark, print)
    if a.command == "run":
        s.timing = a.profile
        f = s.run_file(a.path)
        if a.trace and f is not None:
            print(introspect.format_traces(introspect.traced(f)))
    elif a.command == "prompt":
        prompt_loop(s)
    elif a.command == "explain":
        f = Interpreter(spark).run_file(a.path)
        print({"text": introspect.explain, "tree": introspect.explain_tree, "mermaid": introspect.mermaid}[a.form](f))
    elif a.command == "convert":
        convert(spark, a.source, a.target)
    elif a.command in ("sql", "diff", "cat"):
        f = sql(spark, a.query, *a.paths) if a.command == "sql" else cat(spark, *a.paths) if a.command == "cat" else diff(files.scan(spark, a.left), files.scan(spark, a.right), [k for k in a.key.split(",") if k])
        s.table(f)
    else:
        f = files.scan(spark, a.path)
        if a.command == "schema":
            print("\n".join(f"{n}: {t}" for n, t in f.dtypes))
        elif a.command == "count":
            print(f.height())
        else:
            forms = {"stats": lambda: f.describe(), "nulls": lambda: f.null_count(), "head": lambda: f.head(a.n), "peek": lambda: f.head(a.n), "tail": lambda: f.tail(a.n), "sample": lambda: f.sample(a.n)}
            s.table(forms[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
