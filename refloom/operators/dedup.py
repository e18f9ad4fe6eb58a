"""Duplicate entries: finding groups, choosing survivors, consolidating.

Groups are aggregates with partial sums before the shuffle; no group is collected
but where its members are the result asked for. Members get their group's
outcome back by joins that stay even under hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.normalize import entry_score, key_score, lookup, normalize_doi, normalize_title, present
from refloom.operators.skew import join_even


def live(entries: DataFrame) -> DataFrame:
    """Entries that are no comments."""
    return entries.where("NOT is_commented")


def with_doi(entries: DataFrame) -> DataFrame:
    """Live entries with ``doi_norm``; those without a DOI are left out."""
    return live(entries).withColumn("doi_norm", normalize_doi(lookup("fields", "doi", "DOI", "Doi"))).where("doi_norm <> ''")


def with_title(entries: DataFrame) -> DataFrame:
    """Live entries with ``title_norm``; those without a title are left out."""
    return live(entries).withColumn("title_norm", normalize_title(F.col("fields")["title"])).where("title_norm <> ''")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """``(project, key, n)`` of keys with more than one entry, after NFC."""
    return live(entries).where("key IS NOT NULL").groupBy("project", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_dois(entries: DataFrame) -> DataFrame:
    """A2, A10: ``(project, doi_norm, n, n_keys)`` of DOIs under more than one key; a missing key is a key of its own."""
    g = with_doi(entries).groupBy("project", "doi_norm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("key", F.lit(""))).alias("n_keys"))
    return g.where("n_keys > 1")


def duplicate_titles(entries: DataFrame) -> DataFrame:
    """``(project, title_norm, n)`` of titles with more than one entry, equal keys or not."""
    return with_title(entries).groupBy("project", "title_norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def best_entries(df: DataFrame, by: list[str]) -> DataFrame:
    """``(by, score, file, pos, key, fields, n_fields, entry_type, n)`` of the best entry of each group of ``n``; ties go to the first.

    First the first entry of each score, then the highest score: both are
    aggregates with partial results, so a group of any size shrinks where it lies.
    """
    scored = df.withColumn("score", entry_score("fields", "n_fields"))
    first = F.min_by(F.struct("score", "file", "pos", "key", "fields", "n_fields", "entry_type"), F.struct("file", "pos"))
    firsts = scored.groupBy(*by, "score").agg(first.alias("b"), F.count(F.lit(1)).alias("c"))
    return firsts.groupBy(*by).agg(F.max_by("b", "score").alias("b"), F.sum("c").alias("n")).select(*by, "b.*", "n")


def best_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """A5: ``(by, best_key)``: the key with the highest score; of equals the smallest."""
    keys = df.where("key IS NOT NULL").select(*by, "key").withColumn("s", key_score("key"))
    return keys.groupBy(*by, "s").agg(F.min("key").alias("k")).groupBy(*by).agg(F.max_by("k", "s").alias("best_key"))


def synchronize(entries: DataFrame) -> DataFrame:
    """Every entry of a key that occurs twice gets the best entry's type and fields; no row goes."""
    rows = live(entries).where("key IS NOT NULL").withColumn("k", F.struct("project", "key"))
    best = best_entries(rows, ["k"]).where("n > 1").select("k", "n", F.struct("entry_type", "fields", "n_fields").alias("best"))
    out = join_even(rows, best, "k", how="left")
    take = lambda c: F.coalesce(F.col("best")[c], F.col(c)).alias(c)
    columns = [take(c) if c in ("entry_type", "fields", "n_fields") else F.col(c) for c in entries.columns]
    rest = entries.where("is_commented OR key IS NULL")
    return out.select(*columns).unionByName(rest.select(entries.columns))


def _consolidate(entries: DataFrame, grouped: DataFrame, by: str, groups: DataFrame, own_key: bool) -> tuple[DataFrame, DataFrame]:
    grouped = grouped.withColumn("g", F.struct("project", by))
    best = best_entries(grouped, ["g"]).join(groups.select(F.struct("project", by).alias("g")), "g").withColumnRenamed("key", "best_key")
    chosen = best if own_key else best.drop("best_key").join(best_keys(grouped, ["g"]), "g", "left")
    # One member stands for the group: the first that bears the best key.
    bearers = grouped.where("key IS NOT NULL").groupBy("g", F.col("key").alias("best_key")).agg(F.min(F.struct("file", "pos")).alias("at"))
    chosen = chosen.join(bearers, ["g", "best_key"]).select("g", "n", "best_key", "at", F.struct("entry_type", "fields", "n_fields").alias("best"))
    roles = join_even(grouped.select("g", "file", "pos", "key"), chosen.drop("best"), "g").select(
        F.col("g.project").alias("project"), "g", "file", "pos", "key", "best_key", (F.struct("file", "pos") == F.col("at")).alias("stands")
    )
    # An entry is in one group at most, as it has one DOI and one title; rows that repeat an entry share its role.
    role = roles.groupBy("project", "file", "pos").agg(F.max("stands").alias("stands"))
    kept = entries.join(role, ["project", "file", "pos"], "left").where("stands IS NULL OR stands OR is_commented")
    # The best content goes to the rows that stand, and to no others.
    content = chosen.select(F.col("g.project").alias("project"), "at.file", "at.pos", "best")
    kept = kept.join(content, ["project", "file", "pos"], "left")
    take = lambda c: F.coalesce(F.col("best")[c], F.col(c)).alias(c)
    columns = [take(c) if c in ("entry_type", "fields", "n_fields") else F.col(c) for c in entries.columns]
    key_map = roles.where("key IS NOT NULL AND key <> best_key").select("project", F.col("key").alias("old_key"), F.col("best_key").alias("new_key"))
    return kept.select(*columns), key_map.groupBy("project", "old_key").agg(F.min("new_key").alias("new_key"))


def consolidate_dois(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with one row for each DOI of several keys, and the map from the other keys to the one kept.

    Best key and best content are chosen independently. Only rows of the group go.
    """
    return _consolidate(entries, with_doi(entries), "doi_norm", duplicate_dois(entries), own_key=False)


def consolidate_titles(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: entries with one row for each repeated title, and the key map; the best entry gives key and content."""
    keyed = with_title(entries).where("key IS NOT NULL")
    groups = keyed.groupBy("project", "title_norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _consolidate(entries, keyed, "title_norm", groups, own_key=True)


def drop_cross_file(entries: DataFrame) -> DataFrame:
    """Of each key only the first entry of the file with the smallest base name stays."""
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    rows = live(entries).where(present("key_raw").isNotNull())
    first = rows.groupBy("project", "key_raw").agg(F.min(F.struct(base.alias("base"), "file", "pos")).alias("at"))
    kept = rows.join(first.select("project", "key_raw", F.col("at.file").alias("file"), F.col("at.pos").alias("pos")), ["project", "key_raw", "file", "pos"], "left_semi")
    return kept.select(entries.columns).unionByName(entries.where(F.col("is_commented") | present("key_raw").isNull()))
