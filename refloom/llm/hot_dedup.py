"""Problem 5: records that differ only in their formatting.

Two records are copies if their types and all non-blank fields agree once case,
blanks, punctuation, DOI prefixes and the order of fields are disregarded. Each
record gets a 128-bit digest of that canonical form; groups are found on the
digest.

Skew: exact counts of the digests (combined before the shuffle) name the hot
ones: those with ``hot_rows`` records or more, the ``max_hot`` largest of them at
most, so their list is small and may be broadcast. Hot records are aggregated in
two levels over a salt; all others need one shuffle, in which no group exceeds
``hot_rows`` or a ``max_hot``-th of all records.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.normalize import strip
from refloom.operators.skew import hot_keys

MAX_HOT = 1000
HOT_ROWS = 10_000
SALTS = 64
NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: How a DOI may be prefixed in the data, after lower-casing and stripping.
DOI_PREFIX = r"^(?:(?:doi:|https?://(?:dx\.)?doi\.example/)\s{0,9}){1,9}"


def bare_doi(c: Column) -> Column:
    """The DOI without case, outer blanks and prefixes; '' stays ''."""
    return F.regexp_replace(strip(F.lower(c)), DOI_PREFIX, "")


def squeezed(c: Column) -> Column:
    """Letters and digits of a text, lower-cased."""
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def record_digest(entry_type: Column, fields: Column) -> Column:
    """128-bit digest of a record's canonical form.

    Fields without letters or digits count as absent. Lengths are part of the
    digested text, so values can't run into each other. A field that occurs
    under several spellings of its name keeps all its distinct values.
    """
    pairs = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(
            F.lower(F.trim(e["key"])).alias("k"),
            squeezed(F.when(F.lower(F.trim(e["key"])) == "doi", bare_doi(e["value"])).otherwise(e["value"])).alias("v"),
        ),
    )
    kept = F.array_sort(F.array_distinct(F.filter(pairs, lambda e: F.length(e["v"]) > 0)))
    text = F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["k"], F.length(e["v"]).cast("string"), e["v"])), "|")
    return F.unhex(F.md5(F.concat_ws("|", squeezed(F.coalesce(entry_type, F.lit(""))), text)))


def digests(entries: DataFrame, row_id: str = "entry_id") -> DataFrame:
    """``(row_id, d)`` of each record with fields; records without (commented ones) are none."""
    return entries.where(F.col("fields").isNotNull()).select(F.col(row_id), record_digest(F.col("entry_type"), F.col("fields")).alias("d"))


def copies(canon: DataFrame, row_id: str = "entry_id", hot_rows: int = HOT_ROWS, salts: int = SALTS, max_hot: int = MAX_HOT) -> DataFrame:
    """``(group_id, row_id, n_copies)`` for each row of a group of two or more, its smallest id included.

    ``canon`` holds ``(row_id, d)`` with unique ids. Ties can't arise: the
    representative is the smallest id. An empty table gives no rows.
    """
    canon = canon.persist(StorageLevel.MEMORY_AND_DISK)
    counted = canon.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    hot_list = [bytes(d) for d in hot_keys(counted, "d", "n", hot_rows, max_hot)]  # at most max_hot digests of 16 bytes
    is_hot = F.col("d").isin(hot_list) if hot_list else F.lit(False)

    rest = canon.where(~is_hot)
    found = rest.groupBy("d").agg(F.min(row_id).alias("group_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    cold = rest.join(found, "d").select("group_id", row_id, "n_copies")
    if not hot_list:
        return cold

    # The salt spreads each hot digest over many tasks; the second level sees `salts` rows of it.
    heated = canon.where(is_hot)
    first = heated.groupBy("d", F.pmod(F.xxhash64(row_id), F.lit(salts)).alias("salt")).agg(F.min(row_id).alias("m"), F.count(F.lit(1)).alias("c"))
    second = first.groupBy("d").agg(F.min("m").alias("group_id"), F.sum("c").alias("n_copies"))
    return cold.unionByName(heated.join(F.broadcast(second), "d").select("group_id", row_id, "n_copies"))


def collapse(entries: DataFrame, row_id: str = "entry_id", **params) -> DataFrame:
    """One row for each distinct record: ``(row_id, n_copies)``, the smallest id standing for all."""
    canon = digests(entries, row_id)
    grouped = copies(canon, row_id, **params)
    alone = canon.join(grouped.select(row_id), row_id, "left_anti").select(row_id, F.lit(1).cast("long").alias("n_copies"))
    return alone.unionByName(grouped.where(F.col(row_id) == F.col("group_id")).select(row_id, "n_copies"))
