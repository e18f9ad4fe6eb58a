"""Enrichment from outside and the guards around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.normalize import lookup, normalize_doi, present
from refloom.operators.skew import join_even


def _doi(df: DataFrame, name: str) -> DataFrame:
    return df.where("key IS NOT NULL").groupBy("project", "file", "key").agg(F.max(normalize_doi(lookup("fields", "doi", "DOI", "Doi"))).alias(name))


def changed_dois(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(project, file, key, before, after)`` of keys whose DOI isn't what it was; DOIs that are new are no change."""
    j = _doi(before, "before").join(_doi(after, "after"), ["project", "file", "key"])
    return j.where("before <> '' AND after <> '' AND before <> after")


def guarded(before: DataFrame, after: DataFrame) -> DataFrame:
    """G1, K6: the later version of each file, but the earlier one of files in which any DOI changed."""
    bad = changed_dois(before, after).select("project", "file").distinct()
    on = ["project", "file"]
    return after.join(bad, on, "left_anti").select(before.columns).unionByName(before.join(bad, on, "left_semi").select(before.columns))


def unparsable(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``(project, file)`` of files with an @ in their text but no entry that can be read."""
    seen = entries.where("NOT is_commented").select("project", "file").distinct()
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where(F.contains(text, F.lit("@"))).select("project", "file").join(seen, ["project", "file"], "left_anti")


def format_warnings(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(project, check, file, key, message)`` for titles and DOIs that a formatter changed."""
    title = lambda df, n: df.where("key IS NOT NULL").groupBy("project", "file", "key").agg(F.max(F.col("fields")["title"]).alias(n))
    t = title(before, "b").join(title(after, "a"), ["project", "file", "key"]).where("NOT b <=> a")
    row = lambda df, check, text: df.select("project", F.lit(check).alias("check"), "file", "key", F.concat(F.lit(text), F.col("key")).alias("message"))
    return row(t, "title_changed", "title changed: ").unionByName(row(changed_dois(before, after), "doi_changed", "DOI changed: "))


def enrich(entries: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Entries with fields from ``(doi, fields)``, a table the user supplies; own non-empty values win, and the DOI guard holds.

    Without a table nothing is looked up: workers don't use the network.
    """
    if metadata is None:
        return entries
    known = metadata.select(normalize_doi("doi").alias("_doi"), F.col("fields").alias("_more")).where("_doi <> ''").groupBy("_doi").agg(F.min_by("_more", F.to_json("_more")).alias("_more"))
    marked = entries.withColumn("_doi", F.nullif(normalize_doi(lookup("fields", "doi", "DOI", "Doi")), F.lit("")))
    # Entries without a DOI don't take part in the join, and a common DOI is met where its entries lie.
    named, bare = marked.where("_doi IS NOT NULL"), marked.where("_doi IS NULL")
    sizes = named.groupBy("_doi").agg(F.count(F.lit(1)).alias("_n")).join(known, "_doi")
    j = join_even(named, sizes, "_doi", count="_n", how="left").unionByName(bare.withColumn("_more", F.lit(None).cast(sizes.schema["_more"].dataType)))
    own = F.map_filter("fields", lambda _, v: present(v).isNotNull())
    more = F.map_filter("_more", lambda k, _: ~F.array_contains(F.map_keys(own), k))
    merged = F.when(F.col("_more").isNull() | F.col("fields").isNull(), F.col("fields")).otherwise(F.map_concat(own, more))
    after = j.withColumn("fields", merged).withColumn("n_fields", F.when(F.col("fields").isNotNull(), F.size("fields") + 2)).select(entries.columns)
    return guarded(entries, after)
