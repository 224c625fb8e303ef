"""Rows that fail to parse: separate faulty raw records, load the rest.

Method: parsed cells are exploded into (record, column, value), joined with a
rule table, validated by the rules' parameters and aggregated to errors per
record; the clean records are the anti-join with these errors.  Everything is
row-local but the aggregation of the (few) errors and the anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A field is quoted as a whole, with doubled quotes inside, or has no quote.
# Possessive quantifiers: no backtracking and no recursion on long records.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


@dataclass(frozen=True)
class Rule:
    """A validation of one column of one feed.

    ``kind``: ``decimal`` (ASCII digits with at most one point) or ``integer``
    (ASCII digits that fit a signed 64-bit number).  Blanks around a value are
    ignored.  ``required``: an empty value is an error.  ``above`` and
    ``at_most`` bound the value, the first exclusively.
    """

    feed: str
    position: int
    column: str
    kind: str
    required: bool = True
    above: float | None = None
    at_most: float | None = None


def split_records(raw: DataFrame, line: str = "line") -> DataFrame:
    """Add ``well_quoted`` and ``cells`` (null if not well quoted) to raw records."""
    c = F.col(line)
    well = F.coalesce(c.rlike(_RECORD), F.lit(True))
    # with a leading comma no match is empty, so none is skipped
    cells = F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(f",({_FIELD})"), 1)
    plain = F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return raw.withColumn("well_quoted", well).withColumn("cells", F.when(well, plain))


def _fails(value: Column) -> Column:
    """Whether a value breaks the rule joined to it."""
    empty = value == ""
    digits = value.rlike(r"\A[0-9]+\z")
    decimal = value.rlike(r"\A[0-9]*\.?[0-9]*\z") & value.rlike("[0-9]")
    number = F.when(F.col("kind") == "integer", F.when(digits, F.expr("try_cast(trim(BOTH ' \t' FROM value) AS BIGINT)")).cast("double")).otherwise(F.when(decimal, value.cast("double")))
    bad = number.isNull() | F.coalesce(number <= F.col("above"), F.lit(False)) | F.coalesce(number > F.col("at_most"), F.lit(False))
    return F.when(empty, F.col("required")).otherwise(bad)


def record_errors(raw: DataFrame, rules: list[Rule], widths: dict[str, int], ident: str = "line_id", feed: str = "feed", line: str = "line") -> DataFrame:
    """One row per faulty record: ``(<ident>, reason, columns)``.

    ``reason`` is the first that applies: ``quoting`` (a double quote that does
    not stand around a whole field or doubled inside one), ``columns`` (not the
    feed's number of fields; a null record has none, an empty one has one) or
    ``value`` (a rule is broken); ``columns`` lists the columns with broken
    rules.  Records of feeds without a width are checked for quoting only.
    Records that repeat an ``ident`` share one row, with the first reason of any.
    """
    spark = raw.sparkSession
    parsed = split_records(raw.select(ident, feed, line), line)
    width = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]) if widths else F.lit(None)
    wanted = F.try_element_at(width, F.col(feed)) if widths else F.lit(None).cast("int")
    found = F.when(F.col(line).isNull(), F.lit(0)).otherwise(F.size("cells"))
    shape = F.when(~F.col("well_quoted"), F.lit("quoting")).when(found != wanted, F.lit("columns"))
    shaped = parsed.withColumn("shape", shape)
    misshapen = shaped.filter(F.col("shape").isNotNull()).select(ident, F.when(F.col("shape") == "quoting", 1).otherwise(2).alias("rank"), F.lit(None).cast("string").alias("column"))
    cells = shaped.filter(F.col("shape").isNull()).select(ident, F.col(feed).alias("__feed"), F.posexplode("cells").alias("__position", "value"))
    broken = (
        cells.join(F.broadcast(rule_table(spark, rules)), ["__feed", "__position"])
        .withColumn("value", F.trim(F.col("value"), F.lit(" \t")))
        .filter(_fails(F.col("value")))
        .select(ident, F.lit(3).alias("rank"), "column")
    )
    errors = misshapen.unionAll(broken).groupBy(ident).agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("column")).alias("columns"))
    names = F.when(F.col("rank") == 1, F.lit("quoting")).when(F.col("rank") == 2, F.lit("columns")).otherwise(F.lit("value"))
    return errors.select(ident, names.alias("reason"), "columns")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table; its size is that of the list, not of the data."""
    schema = "__feed string, __position int, column string, kind string, required boolean, above double, at_most double"
    return spark.createDataFrame([(r.feed, r.position, r.column, r.kind, r.required, r.above, r.at_most) for r in rules], schema)


def clean_records(raw: DataFrame, errors: DataFrame, ident: str = "line_id", line: str = "line") -> DataFrame:
    """Records without an error, with their ``cells``."""
    return split_records(raw.join(errors.select(ident), ident, "left_anti"), line).drop("well_quoted")


def typed(clean: DataFrame, feed: str, columns: list[tuple[str, str]], feed_column: str = "feed", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of one feed as typed columns.

    Empty cells and, for other types than string, cells that can't be
    converted become null; blanks around numbers and times are ignored.
    """

    def cell(i: int, name: str, kind: str) -> Column:
        c = F.get("cells", F.lit(i))
        if kind == "string":
            return F.when(c != "", c).alias(name)
        return F.trim(c, F.lit(" \t")).try_cast(kind).alias(name)

    return clean.filter(F.col(feed_column) == feed).select(*keep, *[cell(i, n, k) for i, (n, k) in enumerate(columns)])
