"""Journal abbreviations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.normalize import present, strip

#: A list of journals up to this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def read_journals(spark: SparkSession, *paths: str) -> DataFrame:
    """``(full, short, priority, row_no)`` of CSV lists; a later list has priority over an earlier one.

    Cells are stripped; rows with fewer than two cells or a blank one are left out.
    ``row_no`` grows in the order of a list's rows, with gaps, however many splits it is read in.
    """
    out = None
    for priority, path in enumerate(paths):
        raw = spark.read.schema("full string, short string").csv(path).withColumn("row_no", F.monotonically_increasing_id() + 1)
        rows = raw.select(strip("full").alias("full"), strip("short").alias("short"), F.lit(priority).alias("priority"), "row_no")
        rows = rows.where((F.col("full") != "") & (F.col("short") != ""))
        out = rows if out is None else out.unionByName(rows)
    return out


def lookup_table(journals: DataFrame) -> DataFrame:
    """One short form for each lower-cased full name: highest priority, then last row."""
    ranked = F.struct(F.coalesce("priority", F.lit(0)), "row_no")
    return journals.where("full IS NOT NULL AND short IS NOT NULL").groupBy(F.lower("full").alias("name")).agg(F.max_by("short", ranked).alias("short"))


def heuristic_abbreviation(journal: Column, abbreviate: Callable[[Column], Column] | None = None) -> Column:
    """Names with a full stop or of a single word stay; others go through ``abbreviate``, if one is given."""
    words = F.size(F.filter(F.split(journal, r"(?U)\s+"), lambda w: w != ""))
    other = abbreviate(journal) if abbreviate else journal
    return F.when(F.contains(journal, F.lit(".")) | (words < 2), journal).otherwise(F.coalesce(present(other), journal))


def abbreviate(entries: DataFrame, journals: DataFrame, fallback: Callable[[Column], Column] | None = None) -> DataFrame:
    """entries with the short form of their journal, and ``changed``, 1 where the list or the fallback had one.

    The list is matched without case; a hit counts even if nothing changes by it.
    """
    table = lookup_table(journals)
    small = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    own = present(F.col("fields")["journal"])
    joined = entries.withColumn("_name", F.lower(own)).join(small.withColumnRenamed("name", "_name"), "_name", "left")
    joined = joined.withColumn("_value", F.coalesce("short", heuristic_abbreviation(own, fallback)))
    changed = F.when(own.isNull(), 0).when(F.col("short").isNotNull() | (F.col("_value") != own), 1).otherwise(0)
    fields = F.when(changed == 1, F.transform_values("fields", lambda k, v: F.when(k == "journal", F.col("_value")).otherwise(v))).otherwise(F.col("fields"))
    return joined.withColumns({"changed": changed, "fields": fields}).drop("_name", "short", "_value")
