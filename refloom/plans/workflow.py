"""The three workflows: validate, curate, polish (section 3 of the survey).

All state is DataFrames; nothing is written until a caller commits. A curation
moves the content of entries twice, at reading and at the end. What lies between
(keys, unused entries, duplicates) runs on thin rows that hold what these steps
compare and a pointer to the content, so their shuffles and checkpoints are small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import iso4
from refloom.functions.keys import citation_key
from refloom.functions.normalize import SCORED_FIELDS, lookup, normalize_doi, normalize_title, present
from refloom.operators import citations as C
from refloom.operators import dedup as D
from refloom.operators import guards as G
from refloom.operators import keys as K
from refloom.operators import repairs as R
from refloom.operators import validation as V
from refloom.operators.skew import join_even
from refloom.runtime import cut_lineage
from refloom.sources import bibtex
from refloom.sources.journals import abbreviate

#: The name under which a thin row's fields keep the place of its content; no field can bear it.
_PLACE = "@"


class Curated:
    """What a curation gives: ``entries``, the composed ``key_map``, what else the files hold (``rest``), and, made when first asked for, the rest."""

    def __init__(self, entries: DataFrame, key_map: DataFrame, rest: DataFrame, files: DataFrame, tex: Callable[[], DataFrame], fixes: Callable[[], DataFrame], skipped: DataFrame):
        self.entries, self.key_map, self.rest, self.files, self.skipped = entries, key_map, rest, files, skipped
        self._tex, self._fixes = tex, fixes

    @cached_property
    def tex(self) -> DataFrame:
        """``(project, file, content)`` of the LaTeX files, their citations rewritten."""
        return self._tex()

    @cached_property
    def fixes(self) -> DataFrame:
        """``(project, file, fixes, step)``: repair counts."""
        return self._fixes()

    def texts(self) -> DataFrame:
        """``(project, file, content)`` of every file that was read, blocks that are no entries included."""
        return bibtex.file_texts(self.entries, self.rest, self.files)

    @cached_property
    def warnings(self) -> DataFrame:
        """Rows of ``schema.ISSUES``: files without a readable entry (G2), and titles and DOIs that writing would change."""
        unread = self.skipped.select("project", F.lit("unparsable").alias("check"), "file", F.lit(None).cast("string").alias("key"), F.concat(F.lit("no readable entry: "), "file").alias("message"))
        return unread.unionByName(G.format_warnings(self.entries, bibtex.read_entries(self.texts())))


def validate(bibs: DataFrame, tex: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(issues, verdict, summary)`` of projects; files are parsed once. Unless ``strict``, citations are seen in their broad form."""
    blocks = cut_lineage(bibtex.parse_files(bibs))
    entries = bibtex.entries(blocks)
    cites = cut_lineage(C.citations(tex, C.pattern_of(strict)))
    found = V.issues(tex, bibs, blocks, entries, cites)
    projects = bibs.select("project").unionByName(tex.select("project")).distinct()
    return found, V.verdict(found, projects), V.summary(tex, bibs, entries, cites)


def repaired(entries: DataFrame, journals: DataFrame | None = None, fallback: Callable[[Column], Column] | None = None) -> DataFrame:
    """F3, F5, F6, F7, F4, F8, F9 in this order, in one pass, with ``fixes``, a map from step to count; F1 and F2 work on files, before parsing."""
    steps = [("html", R.fix_html), ("author", R.fix_authors), ("accents", R.remove_accents)]
    if journals is not None:
        steps.append(("journal", lambda e: abbreviate(e, journals, fallback)))
    steps += [("percent", R.fix_percent), ("year", R.fix_years), ("month", R.fix_months)]
    for name, step in steps:
        entries = step(entries).withColumnRenamed("changed", f"_n_{name}")
    return _counted(entries, [name for name, _ in steps])


def _counted(entries: DataFrame, steps: list[str]) -> DataFrame:
    """``entries`` with its columns ``_n_step`` gathered in the map ``fixes``, added to what is in it."""
    own = F.create_map(*[x for s in steps for x in (F.lit(s), F.col(f"_n_{s}").cast("int"))])
    if "fixes" in entries.columns:
        own = F.map_zip_with("fixes", own, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return entries.withColumn("fixes", own).drop(*[f"_n_{s}" for s in steps])


def _dropped(entries: DataFrame) -> DataFrame:
    return _counted(R.drop_fields(entries).withColumnRenamed("changed", "_n_dropped"), ["dropped"])


def _thin(entries: DataFrame) -> DataFrame:
    """Entries with a digest of their content in place of their fields: what dedup compares and scores, and where the content lies."""
    f = F.col("fields")
    title, doi = normalize_title(f["title"]), normalize_doi(lookup("fields", "doi", "DOI", "Doi"))
    mark = {c: F.when(f[c] != "", "1") for c in SCORED_FIELDS if c not in ("title", "doi")}
    # A title of braces alone is filled, but equal to no other.
    mark["title"] = F.when(f["title"] != "", F.when(title == "", "{}").otherwise(F.md5(title)))
    mark["doi"] = F.when(f["doi"] != "", F.coalesce(F.md5(F.nullif(doi, F.lit(""))), F.lit(" ")))
    mark["DOI"] = F.when(f["doi"].isNull() | (f["doi"] == ""), F.md5(F.nullif(doi, F.lit(""))))
    mark["crossref"] = C.target_of(f)
    mark[_PLACE] = F.concat_ws("\n", "file", F.col("pos").cast("string"))
    digest = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, mark)), F.array(*mark.values())), lambda _, v: v.isNotNull())
    return entries.select("project", "file", "pos", "entry_type", "key_raw", "key", F.when(f.isNotNull(), digest).alias("fields"), "n_fields", "is_commented", F.when(~F.col("is_commented"), citation_key(f)).alias("base"))


def _content(thin: DataFrame, whole: DataFrame) -> DataFrame:
    """Thin rows with the content they point to; content that many rows share stays apart from their rows."""
    at = F.when(F.col("is_commented"), F.concat_ws("\n", "file", F.col("pos").cast("string"))).otherwise(F.col("fields")[_PLACE])
    rows = thin.select("project", "file", "pos", "key_raw", "key", "is_commented", F.struct("project", at.alias("at")).alias("k"))
    own = whole.select(F.struct("project", F.concat_ws("\n", "file", F.col("pos").cast("string")).alias("at")).alias("k"), F.struct("entry_type", "fields", "n_fields", "raw", "fixes").alias("c"))
    out = join_even(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(own, "k"), "k")
    return out.select("project", "file", "pos", "c.entry_type", "key_raw", "key", "c.fields", "c.n_fields", "is_commented", "c.raw", "c.fixes")


def _with_targets(entries: DataFrame, key_map: DataFrame) -> DataFrame:
    """Entries whose cross-references follow the keys they refer to. Entries without one don't take part in the join."""
    target = C.target_of(F.col("fields"))
    linked = entries.where(target.isNotNull()).withColumn("old_key", target).join(key_map, ["project", "old_key"], "left")
    new = F.transform_values("fields", lambda k, v: F.when(F.col("new_key").isNotNull() & F.lower(k).isin("crossref"), F.col("new_key")).otherwise(v))
    return entries.where(target.isNull()).unionByName(linked.withColumn("fields", new).select(entries.columns))


def curate(
    bibs: DataFrame,
    tex: DataFrame,
    journals: DataFrame | None = None,
    metadata: DataFrame | None = None,
    preserve_keys: bool = False,
    enrich: bool = True,
    parity: bool = False,
    strict: bool = True,
    fallback: Callable[[Column], Column] | None = iso4.abbreviation,
) -> Curated:
    """Repairs, stable keys, unused and duplicate entries; ``metadata`` and ``journals`` stand for the outside services.

    A journal that the list lacks goes through ``fallback``. Unless ``strict``,
    entries cited with stars or optional arguments count as cited too. ``raw`` is
    kept for commented entries only, as that of the others no longer holds.
    """
    pattern = C.pattern_of(strict)
    texts = R.fix_files(bibs)
    blocks = cut_lineage(bibtex.parse_files(texts, decode=True))
    read = bibtex.entries(blocks).withColumn("raw", F.when(F.col("is_commented"), F.col("raw")))
    skipped = G.unparsable(bibs, read)
    live = read.where("NOT is_commented")
    if enrich:
        live = G.enrich(live, metadata)
    opened = R.opened(read.where("is_commented"), decode=True).withColumnRenamed("changed", "_n_uncommented")
    opened = _counted(opened, ["uncommented"]).withColumn("raw", F.when(F.col("is_commented"), F.col("raw")))
    whole = cut_lineage(_dropped(repaired(live, journals, fallback)).unionByName(opened))

    thin = cut_lineage(_thin(whole))
    first = thin.where("key IS NOT NULL").select("project", "key").distinct()
    cites = cut_lineage(C.citations(tex, pattern).where("key IS NOT NULL").select("project", "key").distinct())
    used = cut_lineage(C.used_keys(thin, cites))
    maps = []
    if not preserve_keys:
        reserved = cites.join(first, ["project", "key"], "left_anti")
        thin, m1 = K.renamed(thin, cut_lineage(K.sanitized_keys(thin, reserved)))
        # Keys are generated only in projects whose main.tex is known.
        chosen = thin.join(tex.where("file = 'main.tex'").select("project").distinct(), "project", "left_semi")
        names = K.standardized_by_file(chosen, F.col("base")) if parity else K.standardized(chosen, reserved, F.col("base"))
        thin, m2 = K.renamed(thin, cut_lineage(names))
        thin = cut_lineage(thin)
        maps = [m1, m2]
        now = C.compose_maps(maps, first).select("project", F.col("old_key").alias("key"), "new_key")
        used = used.join(now, ["project", "key"], "left").select("project", F.coalesce("new_key", "key").alias("key"))
    thin = thin.withColumn("fields", F.map_filter("fields", lambda k, _: k != "crossref")).drop("base")
    thin = cut_lineage(D.synchronize(cut_lineage(C.used_entries(thin, used))))
    if not preserve_keys:
        for step in (D.consolidate_dois, D.consolidate_titles):
            thin, m = step(thin)
            thin = cut_lineage(thin)
            maps.append(cut_lineage(m))
    key_map = cut_lineage(C.compose_maps(maps, first))
    # The closing pass: what was recovered from comments or taken over from other entries is repaired too.
    merged = _content(thin, whole).withColumn("fixes", F.create_map().cast("map<string,int>"))
    if maps:
        merged = _with_targets(merged, key_map)
    steps = repaired(_dropped(merged).withColumnRenamed("fixes", "_before"), journals, fallback)
    closed = steps.withColumn("fixes", F.map_zip_with("fixes", "_before", lambda _, a, b: F.coalesce(a, b))).drop("_before")

    def rewritten() -> DataFrame:
        return C.rewrite_citations(tex, key_map, pattern).drop("changed") if maps else tex

    def counts() -> DataFrame:
        # Outer, as else a filter would be made of the whole chain of repairs.
        rows = [df.select("project", "file", F.explode_outer("fixes").alias("step", "n")) for df in (whole, closed)]
        rows.append(texts.select("project", "file", F.lit("text").alias("step"), F.coalesce(F.col("changed").cast("int"), F.lit(0)).alias("n")))
        all_rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("step IS NOT NULL")
        return all_rows.groupBy("project", "file", "step").agg(F.sum("n").cast("long").alias("fixes")).select("project", "file", "fixes", "step")

    return Curated(closed.drop("fixes"), key_map, bibtex.others(blocks), bibs.select("project", "file"), rewritten, counts, skipped)


def polish(bibs: DataFrame, tex: DataFrame, **options) -> tuple[DataFrame, Curated, DataFrame]:
    """Validation, curation, validation: ``(verdict before, outcome, verdict after)``."""
    strict = options.get("strict", True)
    before = validate(bibs, tex, strict)[1]
    done = curate(bibs, tex, **options)
    after = validate(done.texts(), done.tex, strict)[1]
    return before, done, after
