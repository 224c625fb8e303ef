"""Rolling totals over trailing periods, as a stored, versioned daily state.

State: one row ``(entity, day, qty, n, total_a, total_b, ..., until, version)``
per entity and calendar day.  A day follows from the day before:

    total(day) = total(day - 1) + arrivals(day) - amounts(day - period)

``advance`` adds the next days: it joins the totals of the last known day with
the arrivals of the new days and the amounts that expire in them; nothing
older than the longest period is read.  A daily run adds one day, a first load
some weeks at a time.  ``correct`` recomputes the dates that late or corrected
amounts touch, as rows of a new version, and ``current`` reads the newest
version of each row.

Arrivals, corrections and state lie in one table of the shared folder, bucketed
by entity: once staged there, all of these run where the rows are, without a
shuffle.  Rows are summed to days before any of this: an entity is never larger
than its calendar.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.runtime import PIECE_ROWS, ensure_checkpoint_dir, with_pieces

#: Rows for one bucket, and fewest and most buckets of a table.
BUCKET_ROWS = 1 << 19
BUCKETS = (8, 1 << 16)


@contextmanager
def _buckets_kept(spark: SparkSession) -> Iterator[None]:
    """Plans made inside use the buckets of every table they read."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Bucketed:
    """A table of the shared folder, bucketed by entity; survives lost executors."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.name = spark, buckets, f"quillon_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark)}/tables/{self.name}"

    def append(self, rows: DataFrame) -> None:
        with _buckets_kept(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "entity").mode("append").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def buckets_for(rows: int) -> int:
    return min(max(-(-rows // BUCKET_ROWS), BUCKETS[0]), BUCKETS[1])


def partial_amounts(df: DataFrame, entity: Column, day: Column, ident: str, fields: dict[str, Column], sums: dict[str, Column], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Sums per entity, day and piece ``(entity, day, <sums>)``, repeats of a record counted once.

    ``fields`` are taken from each record, ``sums`` are bigint expressions over
    them to add up per day, null adding nothing.  Rows without entity, day or
    ``ident`` are left out.  A record is known by entity, day and ``ident``;
    should repeats disagree, the smallest value of each field counts.  Entities
    with more than ``piece_rows`` rows are spread over pieces, of which each
    day then has at most one row each, to be added by ``RollingState.stage``.
    """
    rows = df.select(entity.alias("entity"), day.cast("date").alias("day"), F.col(ident).alias("__id"), *[f.alias(n) for n, f in fields.items()])
    rows = rows.filter(F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("__id").isNotNull())
    rows = with_pieces(rows, ["entity"], "__id", piece_rows)
    records = rows.repartition("entity", "__piece").groupBy("entity", "__piece", "day", "__id").agg(*[F.min(f).alias(f) for f in fields])
    return records.groupBy("entity", "__piece", "day").agg(*[F.sum(s).alias(n) for n, s in sums.items()]).drop("__piece")


def _rolled(changes: DataFrame, periods: tuple[int, ...], last: Column, *extra: str) -> DataFrame:
    """Dense rows from change points ``(entity, day, qty, n, c<period>..., until, <extra>...)``.

    Each amount enters on its day and leaves ``period`` days later, so the
    running sum of what enters and leaves is yesterday's total plus today's
    change; days without change carry the totals on, up to ``last`` or
    ``until``.  ``extra`` columns stay on their own day.
    """
    zero = F.lit(0).cast("long")
    days = changes.groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in ("qty", "n", *[f"c{p}" for p in periods])], F.max("until").alias("until"), *[F.max(x).alias(x) for x in extra])
    by = Window.partitionBy("entity").orderBy("day")
    run = days.select(
        "entity", "day", "qty", "n", F.max("until").over(Window.partitionBy("entity")).alias("until"), *extra,
        *[F.sum(f"c{p}").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"total_{p}") for p in periods],
        F.lead("day").over(by).alias("__next"),
    )
    end = F.least(last, F.coalesce(F.col("until"), last))
    run = run.filter(F.col("day") <= end)
    spread = run.select("*", F.explode(F.sequence("day", F.least(end, F.coalesce(F.date_sub("__next", 1), end)))).alias("__at"))
    own = F.col("__at") == F.col("day")
    return spread.select("entity", F.col("__at").alias("day"), F.when(own, F.col("qty")).otherwise(zero).alias("qty"), F.when(own, F.col("n")).otherwise(zero).alias("n"), *[f"total_{p}" for p in periods], "until", *[F.when(own, F.col(x)).alias(x) for x in extra])


def _entering(periods: tuple[int, ...], first: Column, last: Column, *more: Column) -> Column:
    """Change points of an amount within ``first`` to ``last``: it enters on its
    day, if that is not before ``first``, and leaves after each period."""
    zero = F.lit(0).cast("long")
    enters = F.col("day") >= first
    point = lambda day, qty, n, c: F.struct(day.alias("day"), qty.alias("qty"), n.alias("n"), *[x.alias(f"c{p}") for p, x in zip(periods, c, strict=True)])
    points = [F.when(enters, point(F.col("day"), F.col("qty"), F.col("n"), [F.col("qty")] * len(periods)))]
    for p in periods:
        day = F.date_add("day", p)
        points.append(F.when((F.col("qty") != 0) & (day >= first) & (day <= last), point(day, zero, zero, [-F.col("qty") if q == p else zero for q in periods])))
    return F.filter(F.array(*points, *more), lambda x: x.isNotNull())


class RollingState:
    """Versioned daily state of many entities in a bucketed table.

    Rows of version v >= 0 are state; the amounts it is made from are staged
    beside it as version -1 - v.
    """

    def __init__(self, spark: SparkSession, periods: tuple[int, ...] = (7, 30), buckets: int = BUCKETS[0]):
        self.spark, self.periods = spark, periods
        self.totals = [f"total_{p}" for p in periods]
        self.table = Bucketed(spark, buckets)
        self.last: dt.date | None = None

    def _append(self, rows: DataFrame, version: Column) -> None:
        kinds = {"entity": None, "day": "date", "qty": "long", "n": "long", **dict.fromkeys(self.totals, "long"), "until": "date"}
        self.table.append(rows.select(*[F.col(c).cast(k) if k else F.col(c) for c, k in kinds.items()], version.cast("int").alias("version")))

    def stage(self, amounts: DataFrame, ends_known: bool = False) -> None:
        """Take in amounts ``(entity, day, version, qty, n)``, any number of rows a day.

        Version 0 are arrivals, each higher one corrections to be applied as
        that version.  ``ends_known``: these are all arrivals there will be (a
        first load), so an entity's state ends on its last day; else it goes on.
        """
        summed = amounts.repartition(self.table.buckets, "entity").groupBy("entity", "day", "version").agg(F.sum("qty").alias("qty"), F.sum("n").alias("n"))
        none = F.lit(None).cast("long")
        end = F.max(F.when(F.col("version") == 0, F.col("day"))).over(Window.partitionBy("entity")) if ends_known else F.lit(None)
        self._append(summed.select("*", *[none.alias(t) for t in self.totals], end.alias("until")), -1 - F.col("version"))

    def staged_days(self, version: int = 0) -> list[dt.date]:
        """Days with staged amounts, sorted: at most the days of the calendar."""
        rows = self.table.read().filter(F.col("version") == -1 - version)
        return [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()]

    def _days(self, rows: DataFrame) -> DataFrame:
        """``(entity, day, s, qty, n, until)``: newest state row of each day, and what is staged for it."""
        held = F.struct("version", "qty", "n", *self.totals, "until")
        staged = F.col("version") < 0
        return rows.groupBy("entity", "day").agg(
            F.max(F.when(~staged, held)).alias("s"), F.sum(F.when(staged, F.coalesce("qty", F.lit(0)))).alias("qty"), F.sum(F.when(staged, F.coalesce("n", F.lit(0)))).alias("n"), F.max("until").alias("until")
        )

    def advance(self, first: dt.date, last: dt.date, version: int = 0) -> None:
        """Add the days ``first`` to ``last``, which must follow the last known day.

        Every entity known the day before or arriving gets a row for each day
        from its first on.  Read are the staged arrivals of these days, the
        totals of the day before and the amounts that expire in these days.
        """
        if self.last is not None and first != self.last + dt.timedelta(days=1):
            raise ValueError(f"the state ends on {self.last}")
        a, b = F.lit(first), F.lit(last)
        known = (F.col("version") >= 0) & (F.col("day") >= F.lit(first - dt.timedelta(days=max(self.periods)))) & (F.col("day") < a)
        arriving = (F.col("version") == -1 - version) & F.col("day").between(a, b)
        rows = self.table.read().filter((known & (F.col("until").isNull() | (F.col("until") >= a))) | arriving)
        days = self._days(rows)
        amounts = days.select("entity", "day", "until", *[F.coalesce(F.col(f"s.{c}"), F.col(c), F.lit(0)).alias(c) for c in ("qty", "n")], *[F.col(f"s.{t}").alias(t) for t in self.totals])
        zero = F.lit(0).cast("long")
        carry = F.struct(a.alias("day"), zero.alias("qty"), zero.alias("n"), *[F.col(t).alias(f"c{p}") for p, t in zip(self.periods, self.totals, strict=True)])
        points = _entering(self.periods, a, b, F.when(F.col("day") == F.date_sub(a, 1), carry))
        with _buckets_kept(self.spark):
            self._append(_rolled(amounts.select("entity", "until", F.explode(points).alias("c")).select("entity", "until", "c.*"), self.periods, b), F.lit(version))
        self.last = last

    def correct(self, version: int) -> None:
        """Apply the amounts staged as ``version``, negative ones to take away.

        The dates from an entity's first corrected day on are recomputed from
        the amounts back to the longest period before it; rows that change, and
        those that fill a span that grew, are stored with ``version``.  A
        correction never removes days, so the span of an entity doesn't shrink.
        """
        longest = max(self.periods)
        days = self._days(self.table.read().filter((F.col("version") >= 0) | (F.col("version") == -1 - version)))
        days = days.select(
            "entity", "day", *[(F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("qty", "n")],
            F.when(F.col("s").isNotNull(), F.struct("s.qty", "s.n", *[f"s.{t}" for t in self.totals])).alias("was"), F.col("qty").isNotNull().alias("fix"),
        )
        whole = Window.partitionBy("entity")
        day_if = lambda c: F.when(c, F.col("day"))
        days = days.select(
            "*", F.min(day_if(F.col("fix"))).over(whole).alias("__from"), F.max(day_if(F.col("was").isNotNull())).over(whole).alias("__end"), F.max("day").over(whole).alias("until"),
        ).filter(F.col("__from").isNotNull())
        # where the span grows at its end, the days between are new as well
        since = F.least("__from", F.date_add("__end", 1))
        near = days.filter(F.col("day") >= F.date_sub(since, longest)).select("entity", "day", "qty", "n", "was", since.alias("since"), "until")
        far = F.lit(dt.date(9999, 12, 31))
        # a day of the old state is a change point of its own, for its old totals
        points = near.select("entity", "until", "since", "was", F.col("day").alias("__own"), F.explode(_entering(self.periods, F.col("day"), far)).alias("c"))
        changes = points.select("entity", "until", "since", "c.*", F.when(F.col("__own") == F.col("c.day"), F.col("was")).alias("was"))
        new = _rolled(changes, self.periods, F.col("until"), "was", "since")
        # filled days have no row of their own before and are new
        new = new.withColumn("since", F.max("since").over(whole)).filter((F.col("day") >= F.col("since")) & ~F.col("was").eqNullSafe(F.struct("qty", "n", *self.totals)))
        with _buckets_kept(self.spark):
            self._append(new, F.lit(version))

    def current(self) -> DataFrame:
        """Newest version of each (entity, day): ``(entity, day, version, qty, n, <totals>)``."""
        return current(self.table.read().filter(F.col("version") >= 0).drop("until"))


def current(self) -> DataFrame:
        """Newest version of each (entity, day)."""
        return current(self.table.read())


def current(self) -> DataFrame:
        """Newest version of each (entity, day)."""
        return current(self.table.read())


def _struct(periods: tuple[int, ...]) -> str:
    return "struct<day:date,qty:bigint,n:bigint," + ",".join(f"c{p}:bigint" for p in periods) + ">"


def current(state: DataFrame) -> DataFrame:
    """Newest version of each (entity, day)."""
    rest = [c for c in state.columns if c not in ("entity", "day", "version")]
    newest = state.groupBy("entity", "day").agg(F.max(F.struct("version", *rest)).alias("s"))
    return newest.select("entity", "day", "s.version", *[F.col("s")[c].alias(c) for c in rest])


def day_blocks(days: list[dt.date], block_days: int) -> list[tuple[dt.date, dt.date]]:
    """Consecutive stretches from the first to the last of sorted days, each of
    ``block_days`` days or up to the next day that occurs."""
    out: list[tuple[dt.date, dt.date]] = []
    for i, d in enumerate(days):
        if not out or d > out[-1][1]:
            first = out[-1][1] + dt.timedelta(days=1) if out else d
            out.append((first, max(d, first + dt.timedelta(days=block_days - 1))))
        if i + 1 == len(days):
            out[-1] = (out[-1][0], d)
    return out
