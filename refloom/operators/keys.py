"""Stable citation keys for entries.

Keys are given out by one routine: the distinct old keys of a wanted name are
numbered, the first takes the name itself, the others the name and their number.
A name that two of them would get, or that is cited without an entry, is told
apart by a digest of the old key. Old keys that differ never end up alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.keys import citation_key, sanitized
from refloom.functions.normalize import present
from refloom.operators.skew import join_even

PLACE = ["project", "file", "pos"]


def allocate(rows: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """``(project, file, pos, new_key)`` for rows ``(project, file, pos, key, base)``; copies of one key and base share their name.

    Numbers follow file and position; an old key that is the base itself comes
    first. They are counted over files in two levels, so no base, however common,
    makes one task order all its rows. ``reserved`` holds ``(project, key)`` that nothing may be named.
    """
    rows = rows.select(*PLACE, "key", "base").distinct()
    old = rows.groupBy("project", "base", "key").agg(F.min(F.struct("file", "pos")).alias("at"), F.count(F.lit(1)).alias("rows"))
    # The empty file name sorts first, so an old key that is the base itself does.
    old = old.withColumn("file", F.when(F.col("key") == F.col("base"), "").otherwise(F.col("at.file"))).withColumn("pos", F.col("at.pos"))
    per_file = old.groupBy("project", "base", "file").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("project", "base").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(Window.partitionBy("project", "base", "file").orderBy("pos", "key"))
    numbered = old.withColumn("n", n).join(per_file.withColumn("before", before).drop("c"), ["project", "base", "file"]).withColumn("n", F.col("n") + F.col("before") - 1)
    # Behind a digit a number could be read as part of the base.
    number = F.concat(F.when(F.col("base").rlike("[0-9]$"), "_").otherwise(""), F.col("n").cast("string"))
    named = numbered.withColumn("name", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", number)))
    taken = named.groupBy("project", "name").agg(F.count(F.lit(1)).alias("claims"))
    if reserved is not None:
        held = reserved.select("project", F.col("key").alias("name")).distinct().withColumn("held", F.lit(True))
        taken = taken.join(held, ["project", "name"], "left")
    else:
        taken = taken.withColumn("held", F.lit(None).cast("boolean"))
    taken = taken.where("claims > 1 OR held")
    named = named.join(taken, ["project", "name"], "left")
    stays = F.col("key") == F.col("base")
    apart = ~stays & (F.col("held").isNotNull() | ((F.col("n") > 0) & (F.coalesce("claims", F.lit(0)) > 1)))
    new = F.when(apart, F.concat("base", F.lit("_"), F.substring(F.md5("key"), 1, 8))).otherwise(F.col("name"))
    keyed = named.select(F.struct("project", "base", "key").alias("k"), F.col("rows").alias("n"), new.alias("new_key"))
    return join_even(rows.withColumn("k", F.struct("project", "base", "key")), keyed, "k").select(*PLACE, "new_key")


def renamed(entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the keys of ``(project, file, pos, new_key)``, and the map ``(project, old_key, new_key)`` of those that changed.

    An old key that several entries bear maps to the last of their new keys in order of file and position.
    """
    step = entries.join(names, PLACE, "left")
    key_map = step.where("new_key IS NOT NULL AND new_key <> key").groupBy("project", F.col("key").alias("old_key")).agg(F.max_by("new_key", F.struct("file", "pos")).alias("new_key"))
    out = step.withColumns({"key_raw": F.coalesce("new_key", "key_raw"), "key": F.coalesce("new_key", "key")})
    return out.select(entries.columns), key_map


def _wanted(entries: DataFrame, base: Column) -> DataFrame:
    return entries.where("key IS NOT NULL").select(*PLACE, "key", base.alias("base"))


def sanitized_keys(entries: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """``(project, file, pos, new_key)``: keys without characters that citations can't hold; two old keys never merge."""
    return allocate(_wanted(entries, sanitized(F.col("key"))), reserved)


def sanitize(entries: DataFrame, reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries with clean keys and the map ``(project, old_key, new_key)`` of those that changed."""
    return renamed(entries, sanitized_keys(entries, reserved))


def _in_turn(keys: Iterator[str], bases: Iterator[str]) -> Iterator[str]:
    """A name for each key of a file in turn; every base has a counter of its own, so no number is tried twice."""
    numbers: dict[str, count] = defaultdict(count)
    given: set[str] = set()
    for key, base in zip(keys, bases):
        own = not base or base == key
        names = (key,) if own else (f"{base}{n or ''}" for n in numbers[base])
        name = next(x for x in names if own or x not in given)
        given.add(name)
        yield name


def standardized_by_file(entries: DataFrame, base: Column | None = None) -> DataFrame:
    """D6 as in the original: ``(project, file, pos, new_key)``, keys being unique within what precedes them in their file.

    Sequential by definition; a file's keys meet in one task, as they did when the file was parsed.
    """
    rows = _wanted(entries, citation_key(F.col("fields")) if base is None else base).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        return pdf.assign(new_key=list(_in_turn(pdf["key"], pdf["base"])))[[*PLACE, "new_key"]]

    return rows.groupBy("project", "file").applyInPandas(run, "project string, file string, pos int, new_key string")


def standardized(entries: DataFrame, reserved: DataFrame | None = None, base: Column | None = None) -> DataFrame:
    """D6 for whole projects: ``(project, file, pos, new_key)``, no two entries of different old keys in a project alike.

    ``base`` is the wanted key, by default the one generated from the fields; a blank one leaves the old key.
    """
    base = citation_key(F.col("fields")) if base is None else base
    return allocate(_wanted(entries, F.coalesce(present(base), F.col("key"))), reserved)


def standardize(entries: DataFrame, parity: bool = False, reserved: DataFrame | None = None, base: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries with generated keys, and the map ``(project, old_key, new_key)``; ``parity`` allocates file by file."""
    return renamed(entries, standardized_by_file(entries, base) if parity else standardized(entries, reserved, base))
