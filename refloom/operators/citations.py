"""Citations in LaTeX text and their joins with entries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.normalize import present, strip, with_nfc
from refloom.operators.skew import join_even
from refloom.sources.discovery import corresponding_bib

#: What counts as a citation; the broad form also takes optional arguments, stars and capitals.
CITE = r"\\[A-Za-z]*cite[a-zA-Z]*\{([^}]+)\}"
BROAD_CITE = r"\\[A-Za-z]*[Cc]ite[a-zA-Z]*\*?(?:\s*\[[^\]]*\]){0,2}\s*\{([^}]+)\}"
COMMENTED = r"@comment\s*\{@\w+\{([^,}]+)"


def pattern_of(strict: bool = True) -> str:
    """The citation pattern, or the broad one that also sees stars, optional arguments and capitals."""
    return CITE if strict else BROAD_CITE


def citations(tex: DataFrame, pattern: str = CITE) -> DataFrame:
    """``(project, file, cite_pos, key_pos, key_raw, key)`` of each cited key, positions from 0.

    Commented-out citations count, as does the key * of ``nocite``. NULL and empty texts have none.
    """
    groups = tex.select("project", "file", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("cite_pos", "g"))
    keys = groups.select("project", "file", "cite_pos", F.posexplode(F.split("g", ",")).alias("key_pos", "k"))
    keys = keys.select("project", "file", "cite_pos", "key_pos", strip("k").alias("key_raw")).where("key_raw <> ''")
    return with_nfc(keys, "key_raw", "key").select("project", "file", "cite_pos", "key_pos", "key_raw", "key")


def commented_keys(bibs: DataFrame) -> DataFrame:
    """``(project, file, key)`` of commented-out entries in the texts of .bib files."""
    found = bibs.select("project", "file", F.explode(F.regexp_extract_all("content", F.lit(COMMENTED), F.lit(1))).alias("k"))
    return with_nfc(found.select("project", "file", strip("k").alias("k")), "k", "key").where("key IS NOT NULL").select("project", "file", "key").distinct()


def cited_keys(cites: DataFrame) -> DataFrame:
    """The distinct keys of each file."""
    return cites.where("key IS NOT NULL").select("project", "file", "key").distinct()


def missing(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """``(project, file, key)`` cited without an entry in any file of the project."""
    keys = entries.where("key IS NOT NULL").select("project", "key").distinct()
    return cited_keys(cites).join(keys, ["project", "key"], "left_anti").select("project", "file", "key")


def commented(cites: DataFrame, wrapped: DataFrame) -> DataFrame:
    """``(project, file, key)`` cited while an entry of the key is commented out."""
    return cited_keys(cites).join(wrapped.select("project", "key").distinct(), ["project", "key"], "left_semi").select("project", "file", "key")


def target_of(fields: Column) -> Column:
    """What an entry refers to, under either spelling of the field; NULL for nothing."""
    return F.coalesce(present(fields["crossref"]), present(fields["Crossref"]))


def crossrefs(entries: DataFrame) -> DataFrame:
    """``(project, key, target)``: the entry each entry refers to; of equal keys the last in order of file and position."""
    rows = entries.where("key IS NOT NULL").select("project", "key", "file", "pos", target_of(F.col("fields")).alias("t")).where("t IS NOT NULL")
    last = rows.groupBy("project", "key").agg(F.max_by("t", F.struct("file", "pos")).alias("t"))
    return with_nfc(last, "t", "target").select("project", "key", "target")


def missing_crossrefs(entries: DataFrame) -> DataFrame:
    """``(project, key, target)`` whose target has no entry."""
    keys = entries.where("key IS NOT NULL").select("project", F.col("key").alias("target")).distinct()
    return crossrefs(entries).join(keys, ["project", "target"], "left_anti").select("project", "key", "target")


def used_keys(entries: DataFrame, cites: DataFrame) -> DataFrame:
    """``(project, key)`` of what is cited or referred to by any entry."""
    referred = with_nfc(entries.select("project", target_of(F.col("fields")).alias("t")).where("t IS NOT NULL"), "t", "key").select("project", "key")
    return cites.where("key IS NOT NULL").select("project", "key").unionByName(referred).distinct()


def used_entries(entries: DataFrame, cites: DataFrame) -> DataFrame:
    """Entries that are cited or referred to by any entry; entries without a key go. Commented entries stay.

    A star is a key like any other.
    """
    kept = entries.where("NOT is_commented").join(used_keys(entries, cites), ["project", "key"], "left_semi")
    return kept.select(entries.columns).unionByName(entries.where("is_commented"))


def unused_entries(entries: DataFrame, cites: DataFrame) -> DataFrame:
    """``(project, file, pos, key)`` of what J4 drops."""
    return entries.where("NOT is_commented").join(used_keys(entries, cites), ["project", "key"], "left_anti").select("project", "file", "pos", "key")


def correspondence(tex: DataFrame, bibs: DataFrame) -> DataFrame:
    """``(project, ok)``: whether each .tex of a project has a .bib."""
    return corresponding_bib(tex, bibs).groupBy("project").agg(F.bool_and(F.col("bib").isNotNull()).alias("ok"))


def citation_totals(cites: DataFrame, entries: DataFrame, wrapped: DataFrame) -> DataFrame:
    """``(project, file, n_cited, n_missing, n_commented, n_valid)``; a key both missing and commented is taken off twice."""
    n = lambda df, name: df.groupBy("project", "file").agg(F.count(F.lit(1)).alias(name))
    out = n(cited_keys(cites), "n_cited").join(n(missing(cites, entries), "n_missing"), ["project", "file"], "left").join(n(commented(cites, wrapped), "n_commented"), ["project", "file"], "left").fillna(0, ["n_missing", "n_commented"])
    return out.withColumn("n_valid", F.col("n_cited") - F.col("n_missing") - F.col("n_commented"))


def _set_list(keys: list[str], mapping: dict[str, str]) -> str:
    """The keys of a citation by their new names, each once, as they are set."""
    return ", ".join(dict.fromkeys(mapping.get(unicodedata.normalize("NFC", k), k) for k in keys if k))


def rewrite_text(text: str | None, mapping: dict[str, str], pattern: re.Pattern) -> str | None:
    """A text with its citations' keys mapped, repeated keys of one citation dropped, and lists set with a comma and a blank."""
    if not text:
        return text
    out, at = [], 0
    for m in pattern.finditer(text):
        out += text[at : m.start(1)], _set_list([k.strip() for k in m[1].split(",")], mapping)
        at = m.end(1)
    return "".join(out) + text[at:]


def rewrite_citations(tex: DataFrame, key_map: DataFrame, pattern: str = CITE) -> DataFrame:
    """``(project, file, content, changed)`` with cited keys replaced by ``(project, old_key, new_key)``.

    Only the keys that a file cites travel to it: cites join the map, and each
    file gets its own small map. Files of projects without a map stay as they are.
    """
    cited = cited_keys(citations(tex, pattern)).withColumn("k", F.struct("project", "key"))
    renamed = key_map.select(F.struct("project", F.col("old_key").alias("key")).alias("k"), "new_key").distinct()
    hits = join_even(cited, cited.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(renamed, "k"), "k")
    maps = hits.groupBy("project", "file").agg(F.map_from_entries(F.collect_set(F.struct("key", "new_key"))).alias("m"))
    any_map = key_map.select("project").distinct().withColumn("has_map", F.lit(True))
    joined = tex.select("project", "file", "content").join(maps, ["project", "file"], "left").join(any_map, "project", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        for b in batches:
            at = b.schema.get_field_index
            texts, maps_, has = (b.column(at(c)).to_pylist() for c in ("content", "m", "has_map"))
            out = [rewrite_text(t, dict(m or ()), compiled) if h else t for t, m, h in zip(texts, maps_, has)]
            yield pa.RecordBatch.from_arrays(
                [b.column(at("project")), b.column(at("file")), pa.array(out, pa.string()), pa.array([a != t for a, t in zip(out, texts)], pa.bool_())], names=["project", "file", "content", "changed"]
            )

    return joined.mapInArrow(run, "project string, file string, content string, changed boolean")


def compose_maps(steps: list[DataFrame], keys: DataFrame) -> DataFrame:
    """``(project, old_key, new_key)``: where each of the first keys ``(project, key)`` is after all steps ``(project, old_key, new_key)``.

    A step renames what bears its old key just then, so a name that one step
    gives out and another key had before it can't be mixed up.
    """
    total = keys.where("key IS NOT NULL").select("project", F.col("key").alias("old_key"), F.col("key").alias("now")).distinct()
    for step in steps:
        s = step.select("project", F.col("old_key").alias("now"), F.col("new_key").alias("then"))
        total = total.join(s, ["project", "now"], "left").select("project", "old_key", F.coalesce("then", "now").alias("now"))
    return total.where("old_key <> now").select("project", "old_key", F.col("now").alias("new_key"))
