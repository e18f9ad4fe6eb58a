"""Checks, counts and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.normalize import present, strip
from refloom.operators import citations as C
from refloom.operators import dedup as D

LINE_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def lines(content: Column) -> Column:
    """The lines of a text or of a file's bytes, at every line end that Python knows."""
    return F.split(F.make_valid_utf8(content.cast("string")), LINE_ENDS)


def bib_stats(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``(project, file, n_entries, n_doi, n_title, n_author, n_year)``; files without entries show zeros."""
    filled = lambda f: F.count_if(present(F.col("fields")[f]).isNotNull()).alias(f"n_{f}")
    g = D.live(entries).groupBy("project", "file").agg(F.count(F.lit(1)).alias("n_entries"), *[filled(f) for f in ("doi", "title", "author", "year")])
    return files.select("project", "file").join(g, ["project", "file"], "left").fillna(0)


def report(stats: DataFrame) -> DataFrame:
    """``(project, file, n_entries, doi_share)``; the share with one decimal, N/A for files without entries."""
    share = F.format_string("%.1f%%", 100.0 * F.col("n_doi") / F.col("n_entries"))
    return stats.select("project", "file", "n_entries", F.when(F.col("n_entries") > 0, share).otherwise("N/A").alias("doi_share"))


def percent_lines(files: DataFrame) -> DataFrame:
    """``(project, file, n_lines)``: lines with a percent sign that isn't escaped; comment lines don't count."""
    bad = lambda x: ~F.startswith(strip(x), F.lit("%")) & x.rlike(r"(?<!\\)(?:\\\\)*%")
    n = F.size(F.filter(lines(F.col("content")), bad))
    return files.select("project", "file", F.when(F.col("content").isNull(), 0).otherwise(n).alias("n_lines"))


def syntax_errors(blocks: DataFrame) -> DataFrame:
    """``(project, file, pos, error)`` of blocks that can't be read; ``pos`` counts the entries before it. Comments that never close are errors too."""
    return blocks.where("error IS NOT NULL").select("project", "file", F.col("at").alias("pos"), "error")


def unbalanced(files: DataFrame) -> DataFrame:
    """``(project, file, n_open, n_close)`` of files whose braces don't balance: a second opinion that owes nothing to the parser."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    n = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
    return files.select("project", "file", n("{").alias("n_open"), n("}").alias("n_close")).where("n_open <> n_close")


def malformed_authors(entries: DataFrame) -> DataFrame:
    """``(project, n)``: none are looked for, as in the original."""
    return entries.select("project").distinct().select("project", F.lit(0).cast("long").alias("n"))


def summary(tex: DataFrame, bibs: DataFrame, entries: DataFrame, cites: DataFrame) -> DataFrame:
    """``(project, n_tex, n_bib, n_keys, n_cited)``."""
    n = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    u = lambda df, name: df.where("key IS NOT NULL").groupBy("project").agg(F.count_distinct("key").alias(name))
    out = n(tex, "n_tex")
    for other in (n(bibs, "n_bib"), u(D.live(entries), "n_keys"), u(cites, "n_cited")):
        out = out.join(other, "project", "full")
    return out.fillna(0)


def missing_preview(cites: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """``(project, n_missing, preview)``: how many keys are missing and the first ten of them in order.

    The ten smallest come from a ranked pass, so a project with very many missing keys is never gathered in one place.
    """
    keys = C.missing(cites, entries).select("project", "key").distinct()
    n = keys.groupBy("project").agg(F.count(F.lit(1)).alias("n_missing"))
    top = keys.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy("key"))).where(F.col("r") <= k)
    shown = top.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("preview"))
    tail = F.when(F.col("n_missing") > k, F.lit(" ...")).otherwise("")
    return n.join(shown, "project").select("project", "n_missing", F.concat("preview", tail).alias("preview"))


def issues(tex: DataFrame, bibs: DataFrame, blocks: DataFrame, entries: DataFrame, cites: DataFrame) -> DataFrame:
    """All findings as rows of ``schema.ISSUES``."""
    wrapped = C.commented_keys(bibs.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))))
    has_bib = C.corresponding_bib(tex, bibs).where("bib IS NOT NULL").select("project", "file")
    scoped = cites.join(has_bib, ["project", "file"], "left_semi")
    base = F.regexp_extract("file", r"([^/]*)$", 1)

    def rows(df: DataFrame, check: str, file, key, message) -> DataFrame:
        return df.select("project", F.lit(check).alias("check"), file.alias("file"), key.alias("key"), message.alias("message"))

    f, k, none = F.col("file"), F.col("key"), F.lit(None).cast("string")
    out = [
        rows(C.corresponding_bib(tex, bibs).where("bib IS NULL"), "no_bib", f, none, F.concat(base, F.lit(": no bib file"))),
        rows(C.missing(scoped, entries), "missing", f, k, F.concat(base, F.lit(": missing "), k)),
        rows(C.commented(scoped, wrapped), "commented", f, k, F.concat(base, F.lit(": commented "), k)),
        rows(C.missing_crossrefs(entries), "crossref", none, k, F.concat(F.lit("missing crossref: "), k, F.lit(" -> "), F.col("target"))),
        rows(D.duplicate_keys(entries), "duplicate_key", none, k, F.concat(F.lit("duplicate key: "), k)),
        rows(D.duplicate_dois(entries), "duplicate_doi", none, none, F.concat(F.lit("duplicate DOI: "), F.col("doi_norm"))),
        rows(D.duplicate_titles(entries), "duplicate_title", none, none, F.concat(F.lit("duplicate title: "), F.col("title_norm"))),
        rows(percent_lines(bibs).where("n_lines > 0"), "percent", f, none, F.concat(base, F.lit(": unescaped % in lines: "), F.col("n_lines").cast("string"))),
        rows(syntax_errors(blocks), "syntax", f, none, F.concat(base, F.lit(": "), F.col("error"))),
    ]
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def verdict(found: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project, ok)``: no finding but duplicate keys."""
    bad = found.where("check <> 'duplicate_key'").select("project").distinct().withColumn("bad", F.lit(True))
    return projects.select("project").distinct().join(bad, "project", "left").select("project", F.col("bad").isNull().alias("ok"))
