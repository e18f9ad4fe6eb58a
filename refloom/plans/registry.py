"""Queries of the core, by operator of the survey, and the SQL that gives the same rows.

Each query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom import schema
from refloom.functions import keys as key_functions
from refloom.functions import normalize as N
from refloom.functions import repair as R
from refloom.operators import citations as C
from refloom.operators import dedup as D
from refloom.operators import guards as G
from refloom.operators import keys as K
from refloom.operators import packed_fields
from refloom.operators import repairs
from refloom.operators import validation as V
from refloom.plans import workflow
from refloom.runtime import cut_lineage, ensure_checkpoint_dir, table
from refloom.sources import bibtex, discovery, journals, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can say it, its oracle."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _values(sf: str, spark: SparkSession, field: str) -> DataFrame:
    """``(entry_id, v)`` of one spelling of a field, where it occurs."""
    return table(spark, sf, "entries").select("entry_id", F.col("fields")[field].alias("v")).where("v IS NOT NULL")


# SQL fragments ---------------------------------------------------------------

#: Blanks as in ``normalize.BLANK``, in the syntax of the oracle's patterns.
_B = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"regexp_replace(%s, '^{_B}+|{_B}+$', '', 'g')"
_FIELD = "SELECT entry_id, fields['%s'] AS v FROM entries WHERE fields['%s'] IS NOT NULL"


def _field(name: str) -> str:
    return _FIELD % (name, name)


def _doi(v: str) -> str:
    x = f"lower({_STRIP % v})"
    for p in ("doi:", r"http://dx\.doi\.org/", r"https://doi\.org/"):
        x = f"regexp_replace({x}, '^{p}', '')"
    return f"CASE WHEN {_STRIP % v} = '' THEN NULL ELSE {_STRIP % x} END"


def _title(v: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({v}, ''), '[{{}}]', '', 'g'), '[-–—]+', ' ', 'g'), '{_B}+', ' ', 'g')))"


_ANY_DOI = "coalesce(nullif(fields['doi'], ''), nullif(fields['DOI'], ''), nullif(fields['Doi'], ''))"
_LIVE = "(SELECT * FROM entries WHERE NOT is_commented)"
_SCORE = "(" + " + ".join(f"CASE WHEN coalesce(fields['{f}'], '') <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for f in N.SCORED_FIELDS) + ") + 0.1::DOUBLE * coalesce(n_fields, 0)::DOUBLE"
_KEY_SCORE = (
    r"(CASE WHEN regexp_matches(key, '^\p{Lu}') THEN 10.0::DOUBLE ELSE 0.0 END) + (CASE WHEN regexp_matches(key, '^[A-Z][a-z]+[0-9]{4}') THEN 20.0::DOUBLE ELSE 0.0 END)"
    " + (CASE WHEN contains(key, '_') THEN 0.0::DOUBLE ELSE 5.0 END) - 0.1::DOUBLE * length(key)::DOUBLE"
)
_DISTINCT_CITES = "(SELECT DISTINCT project, file, key FROM citations WHERE key IS NOT NULL)"
_TARGET = "coalesce(nullif(fields['crossref'], ''), nullif(fields['Crossref'], ''))"


# Flagship ---------------------------------------------------------------------


@query(
    "flagship_missing_by_file",
    f"""SELECT c.project, c.file, count(*) AS n_missing FROM {_DISTINCT_CITES} c
        WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.key = c.key) GROUP BY c.project, c.file""",
)
def missing_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing(table(spark, sf, "citations"), table(spark, sf, "entries")).groupBy("project", "file").agg(F.count(F.lit(1)).alias("n_missing"))


# Normalisers (N1-N6, N10, N11) ---------------------------------------------------


@query("n1_nfc", f"SELECT entry_id, nullif(nfc_normalize(v), '') AS nfc FROM ({_field('title')})")
def n1(spark: SparkSession, sf: str) -> DataFrame:
    return _values(sf, spark, "title").select("entry_id", N.normalize_unicode("v").alias("nfc"))


@query("n2_doi", f"SELECT entry_id, {_doi(_ANY_DOI)} AS doi FROM entries WHERE {_ANY_DOI} IS NOT NULL")
def n2(spark: SparkSession, sf: str) -> DataFrame:
    v = N.lookup("fields", "doi", "DOI", "Doi")
    return table(spark, sf, "entries").where(v.isNotNull()).select("entry_id", N.normalize_doi(v).alias("doi"))


@query(
    "n3_url",
    rf"""SELECT entry_id, nullif(lower(regexp_extract({_STRIP % 'v'}, '^[A-Za-z]+://')) || regexp_replace({_STRIP % 'v'}, '^[A-Za-z]+://', ''), '') AS url FROM ({_field('url')})""",
)
def n3(spark: SparkSession, sf: str) -> DataFrame:
    return _values(sf, spark, "url").select("entry_id", N.normalize_url("v").alias("url"))


@query(
    "n4_keywords",
    rf"""SELECT entry_id, nullif(array_to_string(list_filter(list_transform(string_split(v, ','), lambda p: lower({_STRIP % 'p'})), lambda p: p <> ''), ','), '') AS keywords FROM ({_field('keywords')})""",
)
def n4(spark: SparkSession, sf: str) -> DataFrame:
    return _values(sf, spark, "keywords").select("entry_id", N.normalize_keywords("v").alias("keywords"))


@query("n5_title", f"SELECT entry_id, {_title('v')} AS title FROM ({_field('title')})")
def n5(spark: SparkSession, sf: str) -> DataFrame:
    return _values(sf, spark, "title").select("entry_id", N.normalize_title("v").alias("title"))


_BW = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_FIRST = _STRIP % "split_part(coalesce(fields['author'], ''), ' and ', 1)"
_KEY = rf"""
  SELECT entry_id, key, project, file, pos, CASE WHEN k <> '' AND NOT regexp_matches(k, '^\p{{L}}') THEN 'k' || k ELSE k END AS base FROM (
    SELECT entry_id, key, project, file, pos,
      regexp_replace(CASE WHEN contains(f, ',') THEN split_part(f, ',', 1) ELSE coalesce(list_filter(regexp_split_to_array(f, '{_BW}'), lambda w: w <> '')[-1], '') END, '[^A-Za-z]', '', 'g')
      || regexp_replace(coalesce(fields['year'], ''), '[^0-9]', '', 'g')
      || array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(fields['journal'], ''), '{_BW}'), lambda w: w[1:1]), lambda c: regexp_matches(c, '^\p{{L}}')), '')
      || regexp_replace(coalesce(list_filter(regexp_split_to_array(coalesce(fields['title'], ''), '{_BW}'), lambda w: w <> '')[1], ''), '[^A-Za-z0-9]', '', 'g') AS k
    FROM (SELECT *, {_FIRST} AS f FROM {_LIVE}))"""


@query("n6_citation_key", f"SELECT entry_id, base FROM ({_KEY})")
def n6(spark: SparkSession, sf: str) -> DataFrame:
    return D.live(table(spark, sf, "entries")).select("entry_id", key_functions.citation_key(F.col("fields")).alias("base"))


@query("n10_entry_score", f"SELECT entry_id, {_SCORE} AS score FROM {_LIVE}")
def n10(spark: SparkSession, sf: str) -> DataFrame:
    return D.live(table(spark, sf, "entries")).select("entry_id", N.entry_score("fields", "n_fields").alias("score"))


@query("n11_key_score", f"SELECT entry_id, {_KEY_SCORE} AS score FROM entries WHERE key IS NOT NULL")
def n11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").where("key IS NOT NULL").select("entry_id", N.key_score("key").alias("score"))


@query("n8_field_transform", "SELECT project, file, sum(n)::BIGINT AS fixes FROM (SELECT project, file, CASE WHEN fields IS NULL THEN 0 ELSE len(list_filter(map_values(fields), lambda v: v <> upper(v))) END + CASE WHEN entry_type <> upper(entry_type) THEN 1 ELSE 0 END + CASE WHEN key_raw <> upper(key_raw) THEN 1 ELSE 0 END AS n FROM entries) GROUP BY project, file")
def n8(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.count_changes(repairs.field_transform(table(spark, sf, "entries"), F.upper))


@query(
    "n9_walk_fields",
    """SELECT field, count(*) AS n, count(DISTINCT value) AS n_values FROM (
         SELECT unnest(map_keys(fields)) AS field, unnest(map_values(fields)) AS value FROM entries WHERE fields IS NOT NULL
         UNION ALL SELECT 'ID', coalesce(key_raw, '') FROM entries WHERE fields IS NOT NULL UNION ALL SELECT 'ENTRYTYPE', entry_type FROM entries WHERE fields IS NOT NULL) GROUP BY field""",
)
def n9(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.walk_fields(table(spark, sf, "entries")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


# Sources and extraction (S1-S9, X1-X4) ----------------------------------------------


@query(
    "s1_parse_bibtex",
    """SELECT DISTINCT project, file, pos, entry_type, key_raw, coalesce(n_fields, 0) AS n_fields, is_commented, raw, array_to_string(list_sort(list_transform(map_entries(fields), lambda e: e.key || '=' || e.value)), '|') AS body FROM entries""",
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    e = bibtex.read_entries(table(spark, sf, "bib_files"))
    body = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda x: F.concat_ws("=", x["key"], x["value"]))), "|")
    return e.select("project", "file", "pos", "entry_type", "key_raw", F.coalesce("n_fields", F.lit(0)).alias("n_fields"), "is_commented", "raw", body.alias("body"))


#: Files that begin with a line of their writer's.
_HEAD = r"regexp_matches(replace(content::VARCHAR, '\x00', ''), '^(\\xEF\\xBB\\xBF|\\xFF\\xFE|\\xFE\\xFF)?%')"
_UNCLOSED = "length(raw) - length(replace(raw, '{', '')) <> length(raw) - length(replace(raw, '}', ''))"


@query(
    "s3_blocks",
    f"""SELECT project, file, CASE WHEN is_commented THEN 'commented' ELSE 'entry' END AS kind, count(*) AS n, count(CASE WHEN is_commented AND {_UNCLOSED} THEN 1 END) AS n_errors
        FROM (SELECT DISTINCT project, file, pos, is_commented, raw FROM entries) GROUP BY ALL
        UNION ALL SELECT project, file, 'text', 1, 0 FROM bib_files WHERE {_HEAD}""",
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return bibtex.parse_files(table(spark, sf, "bib_files")).groupBy("project", "file", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"))


@query("s4_tex_files", r"SELECT project, file FROM tex_files WHERE regexp_full_match(file, 'sections/[^/]+\.tex') OR file = 'main.tex'")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.tex_files(table(spark, sf, "tex_files").select("project", "file"))


_KNOWN_BIB = r"(regexp_full_match(file, 'sections/[^/]+\.bib') OR file IN ('references.bib', 'bibliography.bib'))"


@query(
    "s5_bib_files",
    rf"""SELECT project, file FROM (SELECT *, {_KNOWN_BIB} AS k, bool_or({_KNOWN_BIB}) OVER (PARTITION BY project) AS any_known FROM bib_files WHERE regexp_full_match(file, '(sections/)?[^/]+\.bib')) WHERE k OR NOT any_known""",
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.bib_files(table(spark, sf, "bib_files").select("project", "file"))


_DIR = "regexp_extract(file, '^(.*/)?[^/]*$', 1)"
_STEM = r"regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\.[^.]*$', '')"
_CORRESPONDING = f"""
  SELECT t.project, t.file, coalesce(s.bib, CASE WHEN t.stem = 'main' THEN p.bib END) AS bib
  FROM (SELECT project, file, {_DIR} AS d, {_STEM} AS stem FROM tex_files) t
  LEFT JOIN (SELECT project, file AS bib, {_DIR} AS d, {_STEM} AS stem FROM bib_files) s USING (project, d, stem)
  LEFT JOIN (SELECT project, d, arg_min(file, (CASE stem WHEN 'references' THEN '0' WHEN 'bibliography' THEN '1' ELSE '2' END) || file) AS bib
             FROM (SELECT project, file, {_DIR} AS d, {_STEM} AS stem FROM bib_files) GROUP BY project, d) p USING (project, d)"""


@query("s6_corresponding_bib", _CORRESPONDING)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.corresponding_bib(table(spark, sf, "tex_files"), table(spark, sf, "bib_files"))


@query("s7_journal_table", """SELECT lower("full") AS name, arg_max(short, priority * 1000000 + row_no) AS short FROM journals GROUP BY lower("full")""")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return journals.lookup_table(table(spark, sf, "journals"))


@query(
    "x1_citations",
    r"""WITH g AS (SELECT project, file, regexp_extract_all(content, '\\[A-Za-z]*cite[a-zA-Z]*\{([^}]+)\}', 1) AS gs FROM tex_files),
          h AS (SELECT project, file, unnest(gs) AS g, unnest(range(len(gs))) AS cite_pos FROM g),
          k AS (SELECT project, file, cite_pos, unnest(string_split(g, ',')) AS k, unnest(range(len(string_split(g, ',')))) AS key_pos FROM h)
        SELECT project, file, cite_pos::INT AS cite_pos, key_pos::INT AS key_pos, """
    + (_STRIP % "k")
    + " AS key_raw, nfc_normalize("
    + (_STRIP % "k")
    + ") AS key FROM k WHERE "
    + (_STRIP % "k")
    + " <> ''",
)
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return C.citations(table(spark, sf, "tex_files"))


def _bib_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bib_files").withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


@query("x2_commented_keys", r"SELECT DISTINCT project, file, nfc_normalize(trim(regexp_extract(raw, '@comment\s*\{@\w+\{([^,}]+)', 1))) AS key FROM entries WHERE is_commented")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return C.commented_keys(_bib_text(spark, sf))


# Joins (J1-J9) ------------------------------------------------------------------------


@query("j1_missing", f"SELECT c.* FROM {_DISTINCT_CITES} c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.key = c.key)")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing(table(spark, sf, "citations"), table(spark, sf, "entries"))


_WRAPPED = r"SELECT DISTINCT project, trim(regexp_extract(raw, '@comment\s*\{@\w+\{([^,}]+)', 1)) AS key FROM entries WHERE is_commented"


@query("j2_commented", f"SELECT c.* FROM {_DISTINCT_CITES} c WHERE EXISTS (SELECT 1 FROM ({_WRAPPED}) w WHERE w.project = c.project AND nfc_normalize(w.key) = c.key)")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return C.commented(table(spark, sf, "citations"), C.commented_keys(_bib_text(spark, sf)))


# No entry has a crossref in the given tables, so one is made from its key.
def _with_crossref(entries: DataFrame) -> DataFrame:
    other = F.concat(F.regexp_replace("key_raw", "_dup$", ""), F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.lit("x")))
    return entries.withColumn("fields", F.when(F.col("fields").isNotNull(), F.map_concat("fields", F.create_map(F.lit("crossref"), other))))


@query(
    "j3_missing_crossrefs",
    """WITH r AS (SELECT project, key, nfc_normalize(arg_max(regexp_replace(key_raw, '_dup$', '') || CASE WHEN pos % 3 = 0 THEN '' ELSE 'x' END, file || printf('%012d', pos))) AS target
                  FROM entries WHERE key IS NOT NULL AND fields IS NOT NULL GROUP BY project, key)
       SELECT project, key, target FROM r WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = r.project AND e.key = r.target)""",
)
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing_crossrefs(_with_crossref(table(spark, sf, "entries")))


@query("j4_unused", f"""SELECT e.project, e.file, e.pos, e.key FROM {_LIVE} e WHERE e.key IS NULL OR NOT EXISTS (SELECT 1 FROM citations c WHERE c.project = e.project AND c.key = e.key)""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return C.unused_entries(table(spark, sf, "entries"), table(spark, sf, "citations"))


_LOOKUP = """(SELECT lower("full") AS name, arg_max(short, priority * 1000000 + row_no) AS short FROM journals GROUP BY lower("full"))"""


@query("j5_journal_lookup", f"SELECT entry_id, coalesce(j.short, fields['journal']) AS journal, CASE WHEN j.short IS NULL THEN 0 ELSE 1 END AS changed FROM entries LEFT JOIN {_LOOKUP} j ON lower(nullif(fields['journal'], '')) = j.name")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    out = journals.abbreviate(table(spark, sf, "entries"), table(spark, sf, "journals"))
    return out.select("entry_id", F.col("fields")["journal"].alias("journal"), "changed")


@query("j7_changed_dois", f"""
   WITH b AS (SELECT project, file, key, max({_doi(_ANY_DOI)}) AS before, max({_doi("CASE WHEN pos % 7 = 0 THEN " + _ANY_DOI + " || 'x' ELSE " + _ANY_DOI + " END")}) AS after FROM entries WHERE key IS NOT NULL GROUP BY project, file, key)
   SELECT project, file, key, before, after FROM b WHERE before <> '' AND after <> '' AND before <> after""")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "entries")
    changed = F.transform_values("fields", lambda k, v: F.when((F.lower(k) == "doi") & (v != "") & (F.col("pos") % 7 == 0), F.concat(v, F.lit("x"))).otherwise(v))
    return G.changed_dois(before, before.withColumn("fields", changed))


@query("g1_guarded", f"""
   WITH b AS (SELECT project, file, key, max({_doi(_ANY_DOI)}) AS before, max({_doi("CASE WHEN pos % 50 = 0 THEN " + _ANY_DOI + " || 'x' ELSE " + _ANY_DOI + " END")}) AS after FROM entries WHERE key IS NOT NULL GROUP BY project, file, key),
        bad AS (SELECT DISTINCT project, file FROM b WHERE before <> '' AND after <> '' AND before <> after)
   SELECT e.entry_id, {_ANY_DOI} || CASE WHEN b.file IS NULL AND pos % 50 = 0 AND {_ANY_DOI} <> '' THEN 'x' ELSE '' END AS doi FROM entries e LEFT JOIN bad b ON e.project = b.project AND e.file = b.file""")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "entries")
    changed = F.transform_values("fields", lambda k, v: F.when((F.lower(k) == "doi") & (v != "") & (F.col("pos") % 50 == 0), F.concat(v, F.lit("x"))).otherwise(v))
    return G.guarded(before, before.withColumn("fields", changed)).select("entry_id", N.lookup("fields", "doi", "DOI", "Doi").alias("doi"))


@query("g2_unparsable", r"SELECT project, file FROM bib_files WHERE starts_with(file, 'sections/') AND contains(content::VARCHAR, '@')")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    """With the braces of all files in the sections folder gone, so that none of these can be read."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = table(spark, sf, "bib_files").withColumn("content", F.when(F.startswith("file", F.lit("sections/")), F.translate(text, "{}()", "")).otherwise(text).cast("binary"))
    return G.unparsable(files, bibtex.read_entries(files))


@query("g3_format_warnings", f"""
   SELECT project, 'title_changed' AS "check", file, key, 'title changed: ' || key AS message FROM entries WHERE key IS NOT NULL GROUP BY project, file, key
   HAVING max(fields['title']) IS DISTINCT FROM max(trim(fields['title']))
   UNION ALL SELECT project, 'doi_changed', file, key, 'DOI changed: ' || key FROM (
     SELECT project, file, key, max({_doi(_ANY_DOI)}) AS before, max({_doi("CASE WHEN pos % 7 = 0 THEN " + _ANY_DOI + " || 'x' ELSE " + _ANY_DOI + " END")}) AS after FROM entries WHERE key IS NOT NULL GROUP BY project, file, key)
   WHERE before <> '' AND after <> '' AND before <> after""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    """A formatter that trims titles and spoils every seventh DOI."""
    before = table(spark, sf, "entries")
    value = lambda k, v: F.when(k == "title", F.trim(v)).when((F.lower(k) == "doi") & (v != "") & (F.col("pos") % 7 == 0), F.concat(v, F.lit("x"))).otherwise(v)
    return G.format_warnings(before, before.withColumn("fields", F.transform_values("fields", value)))


@query("j9_correspondence", f"SELECT project, bool_and(bib IS NOT NULL) AS ok FROM ({_CORRESPONDING}) GROUP BY project")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return C.correspondence(table(spark, sf, "tex_files"), table(spark, sf, "bib_files"))


# Repairs (F1-F12) ----------------------------------------------------------------------


#: Bytes as the oracle writes them: what isn't printable ASCII as \xNN, the backslash too.
_SEQ = r"\\x(?:C[2-9A-F]|D[0-9A-F])\\x[89AB][0-9A-F]|\\xE0\\x[AB][0-9A-F]\\x[89AB][0-9A-F]|\\x(?:E[1-9A-CEF])(?:\\x[89AB][0-9A-F]){2}|\\xED\\x[89][0-9A-F]\\x[89AB][0-9A-F]|\\xF0\\x[9AB][0-9A-F](?:\\x[89AB][0-9A-F]){2}|\\xF[123](?:\\x[89AB][0-9A-F]){3}|\\xF4\\x8[0-9A-F](?:\\x[89AB][0-9A-F]){2}"
_VALID = rf"replace(decode(regexp_replace(content::VARCHAR, '({_SEQ})|\\x[89A-F][0-9A-F]', '\1', 'g')::BLOB), chr(65533), '')"
_F1 = "t"
for _o, _n in (("chr(776)", "'\"'"), ("chr(769)", r"'\'''"), ("'ś'", r"'\''{s}'"), ("'ł'", r"'\l{}'")):
    _F1 = rf"replace({_F1}, '\\' || {_o}, {_n})"
_F2 = rf"array_to_string(list_transform(string_split({_F1}, chr(10)), lambda x: CASE WHEN starts_with({_STRIP % 'x'}, '%') THEN x ELSE regexp_replace(replace(x, chr(9472), '--'), '(\p{{L}})\x{{301}}', '\\''{{\1}}', 'g') END), chr(10))"


@query("f1_f2_files", f"SELECT project, file, f AS content, f <> t AS changed FROM (SELECT *, {_F2} AS f FROM (SELECT project, file, {_VALID} AS t FROM bib_files))")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.fix_files(table(spark, sf, "bib_files"))


def _body(df: DataFrame) -> DataFrame:
    """``(entry_id, key_raw, entry_type, body, changed)``: all fields in order of name as one text."""
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return df.select("entry_id", "key_raw", "entry_type", F.array_join(pairs, "|").alias("body"), "changed")


def _body_sql(value: str, where: str = "true", also: str = "") -> str:
    """The oracle's ``_body`` with ``value``, an expression of x, for each value whose field name k meets a condition."""
    new = f"CASE WHEN {where} THEN {value.replace('@x', 'e.value')} ELSE e.value END".replace("@k", "e.key")
    n = f"len(list_filter(map_entries(fields), lambda e: ({new}) <> e.value))"
    keys = f"{value.replace('@x', 'key_raw')} AS key_raw, {value.replace('@x', 'entry_type')} AS entry_type" if also else "key_raw, entry_type"
    more = f" + CASE WHEN ({value.replace('@x', 'key_raw')}) <> key_raw THEN 1 ELSE 0 END + CASE WHEN ({value.replace('@x', 'entry_type')}) <> entry_type THEN 1 ELSE 0 END" if also else ""
    return f"""SELECT entry_id, {keys}, array_to_string(list_sort(list_transform(map_entries(fields), lambda e: e.key || '=' || {new})), '|') AS body,
               (CASE WHEN fields IS NULL THEN 0 ELSE {n} END{more})::INT AS changed FROM entries"""


# The oracle's patterns have no look-behind: escaped ampersands are set aside first. After the entities none stand.
_HTML = "@x"
for _o, _n in (("&amp;", r"\&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
    _HTML = f"replace({_HTML}, '{_o}', '{_n}')"
_HTML = rf"replace(replace(replace({_HTML}, '\&', chr(1)), '&', '\&'), chr(1), '\&')"
_PCT = r"regexp_replace(%s, '(^|[^\\])((?:\\\\)*)%%', '\1\2\\%%', 'g')"
_AUTHOR = "@x"
for _o, _n in ((r"([A-Za-z])\\{4,}([a-z]+)", r'\1{\\"u}\2'), (r"\\{4,}", r"\\"), (r",\s*\\+\s*([,}])", r",\1"), (r"([A-Za-z])\s*\\+\s*$", r"\1")):
    _AUTHOR = f"regexp_replace({_AUTHOR}, '{_o}', '{_n}', 'g')"
for _o, _n in ((r"\ν", "n"), (r"\μ", "u"), (r"\149", "n"), ("ń", "n"), ("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u")):
    _AUTHOR = rf"replace({_AUTHOR}, '{_o}', '\''{{{_n}}}')"
for _o, _n in (("ü", r"\"{u}"), ("ö", r"\"{o}"), ("ł", r"\l{}"), ("ć", r"\''{c}"), ("ś", r"\''{s}"), ("ź", r"\''{z}"), ("ą", r"\''{a}"), ("ę", r"\''{e}")):
    _AUTHOR = f"replace({_AUTHOR}, '{_o}', '{_n}')"


@query("f3_html", _body_sql(_HTML))
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.fix_html(table(spark, sf, "entries")))


@query("f4_percent", _body_sql(_PCT % (_PCT % "@x"), also="ID and type"))
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.fix_percent(table(spark, sf, "entries")))


@query("f5_author", _body_sql(_AUTHOR, "@k = 'author'"))
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.fix_authors(table(spark, sf, "entries")))


_PLAIN = "@x"
for _cmd in (r"\\['\x22`^~=]\{([^}]+)\}", r"\\.\{([^}]+)\}"):
    _PLAIN = "regexp_replace(" + _PLAIN + ", '" + _cmd.replace("'", "''") + "', '\\1', 'g')"
_PLAIN = f"nfc_normalize(strip_accents({_PLAIN}))"


@query("f6_accents", _body_sql(_PLAIN, "@k IN ('author', 'editor', 'translator', 'title', 'booktitle', 'journal')"))
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.remove_accents(table(spark, sf, "entries")))


def _spelling_sql(names: tuple[str, ...], value: str) -> str:
    """The first spelling of a field that an entry has, mapped by an expression of @x; blank values stay."""
    first = "CASE " + " ".join(f"WHEN fields['{n}'] IS NOT NULL THEN '{n}'" for n in names) + " END"
    inner = _body_sql(f"CASE WHEN @x = '' THEN @x ELSE {value} END", "@k = spelling")
    return inner.replace("FROM entries", f"FROM (SELECT *, {first} AS spelling FROM entries)")


_UNBRACED = f"regexp_replace({_STRIP % '@x'}, '^[{{}}]+|[{{}}]+$', '', 'g')"
_MONTH_SQL = f"coalesce(CASE lower({_UNBRACED}) " + " ".join(
    f"WHEN '{w}' THEN '{n}'"
    for n, ws in {
        1: "jan january", 2: "feb february", 3: "mar march", 4: "apr april", 5: "may", 6: "jun june", 7: "jul july", 8: "aug august", 9: "sep sept september",
        10: "oct october", 11: "nov november", 12: "dec december",
    }.items() for w in ws.split()
) + " END, @x)"


@query("f8_year", _spelling_sql(("year", "Year", "YEAR"), f"CASE WHEN regexp_matches({_UNBRACED}, '^[0-9]{{4}}[-/]') THEN {_UNBRACED}[1:4] ELSE @x END"))
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.fix_years(table(spark, sf, "entries")))


@query("f9_month", _spelling_sql(("month", "Month", "MONTH"), _MONTH_SQL))
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return _body(repairs.fix_months(table(spark, sf, "entries")))


@query("f7_abbreviate", f"SELECT project, file, sum(CASE WHEN j.short IS NULL THEN 0 ELSE 1 END)::BIGINT AS fixes FROM entries LEFT JOIN {_LOOKUP} j ON lower(nullif(fields['journal'], '')) = j.name GROUP BY project, file")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.count_changes(journals.abbreviate(table(spark, sf, "entries"), table(spark, sf, "journals")))


@query(
    "f10_uncomment",
    r"""SELECT DISTINCT project, file, pos, regexp_extract(raw, '^@comment\{@(\w+)\{', 1) AS entry_type, trim(regexp_extract(raw, '^@comment\{@\w+\{([^,]*),', 1)) AS key_raw, len(regexp_extract_all(raw, '\n\s*[\w-]+ = \{'))::INT AS n FROM entries WHERE is_commented""",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.uncomment(table(spark, sf, "entries")).select("project", "file", "pos", "entry_type", "key_raw", F.size("fields").alias("n")).distinct()


_DROPPED = ", ".join(f"'{x.lower()}'" for x in schema.DROPPED_FIELDS)


@query("f11_drop_fields", f"SELECT entry_id, len(list_filter(map_keys(fields), lambda k: lower(k) IN ({_DROPPED})))::INT AS changed, (2 + len(list_filter(map_keys(fields), lambda k: lower(k) NOT IN ({_DROPPED}))))::INT AS n_fields FROM {_LIVE}")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.drop_fields(D.live(table(spark, sf, "entries"))).select("entry_id", "changed", "n_fields")


@query("k1_file_texts", "SELECT project, count(DISTINCT file || '|' || pos) AS n, count(DISTINCT file || '|' || pos) AS n_same FROM entries GROUP BY project")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    """Files written and read again: entries survive the round trip."""
    e = table(spark, sf, "entries").dropDuplicates(["project", "file", "pos"])
    again = bibtex.read_entries(bibtex.file_texts(e))
    same = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c)))
    j = e.select("project", "file", "pos", "key_raw", "fields").join(again.select("project", "file", "pos", F.col("key_raw").alias("k"), F.col("fields").alias("f")), ["project", "file", "pos"], "full")
    ok = F.col("key_raw").eqNullSafe(F.col("k")) & F.to_json(same("fields")).eqNullSafe(F.to_json(same("f")))
    return j.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_same"))


_EXTRA = "@string{own = {words}}\n@preamble{p}\n@comment{free}\nloose words\n@misc{unreadable title={x}}\n"


@query("k2_whole_files", f"""
   SELECT b.project, b.file, coalesce(e.n_entry, 0) AS n_entry, coalesce(e.n_commented, 0) AS n_commented, 1::BIGINT AS n_string, 1::BIGINT AS n_preamble, 1::BIGINT AS n_comment, CASE WHEN {_HEAD} THEN 2::BIGINT ELSE 1 END AS n_text, 1::BIGINT AS n_unreadable
   FROM bib_files b LEFT JOIN (SELECT project, file, count(DISTINCT pos) FILTER (WHERE NOT is_commented) AS n_entry, count(DISTINCT pos) FILTER (WHERE is_commented) AS n_commented FROM entries GROUP BY ALL) e USING (project, file)""")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every kind put before each file's own, all written and read again."""
    files = table(spark, sf, "bib_files")
    own = bibtex.parse_files(files)
    extra = bibtex.parse_files(files.withColumn("content", F.lit(_EXTRA).cast("binary")))
    back = bibtex.parse_files(bibtex.file_texts(bibtex.entries(own), bibtex.others(own).unionByName(bibtex.others(extra)), files))
    n = lambda name, condition: F.count_if(F.expr(condition)).alias(f"n_{name}")
    kinds = [n("entry", "kind = 'entry' AND error IS NULL"), n("unreadable", "kind = 'entry' AND error IS NOT NULL"), *[n(k, f"kind = '{k}'") for k in ("commented", "string", "preamble", "comment", "text")]]
    return back.groupBy("project", "file").agg(*kinds)


@query("k3_backups", "SELECT project, file || suffix AS file, md5(content) AS digest FROM tex_files, (VALUES (''), ('.backup')) s(suffix)")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K3: the files and their backups, written to the shared folder and read from there."""
    root = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    files = table(spark, sf, "tex_files")
    sinks.write_files(files, root, by_project=True)
    sinks.create_backup(files, root, by_project=True)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_extract("path", r"/written-[0-9a-f]+/(.*)$", 1)
    return read.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("project"), F.regexp_replace(path, "^[^/]+/", "").alias("file"), F.md5("content").alias("digest"))


@query("n7_heuristic_abbreviation", f"SELECT entry_id, CASE WHEN contains(v, '.') OR len(list_filter(regexp_split_to_array(v, '{_BW}'), lambda w: w <> '')) < 2 THEN v ELSE coalesce(nullif(upper(v), ''), v) END AS value FROM ({_field('journal')})")
def n7(spark: SparkSession, sf: str) -> DataFrame:
    """With upper case standing for the abbreviating function a caller supplies."""
    return _values(sf, spark, "journal").select("entry_id", journals.heuristic_abbreviation(F.col("v"), F.upper).alias("value"))


@query("e1_enrich", f"""
   SELECT entry_id, CASE WHEN {_doi(_ANY_DOI)} <> '' THEN coalesce(nullif(fields['publisher'], ''), 'supplied') ELSE fields['publisher'] END AS publisher FROM entries""")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata for every DOI of the table itself, with a publisher that fills the gaps."""
    e = table(spark, sf, "entries")
    dois = e.select(N.normalize_doi(N.lookup("fields", "doi", "DOI", "Doi")).alias("doi")).where("doi <> ''").distinct()
    meta = dois.withColumn("fields", F.create_map(F.lit("publisher"), F.lit("supplied")))
    return G.enrich(e, meta).select("entry_id", F.col("fields")["publisher"].alias("publisher"))


@query("e2_external_abbreviations", """
   SELECT entry_id, CASE WHEN j.name IS NULL THEN fields['journal'] ELSE upper(j.full_name) END AS journal FROM entries
   LEFT JOIN (SELECT lower("full") AS name, arg_max("full", row_no) AS full_name FROM journals GROUP BY 1) j ON lower(nullif(fields['journal'], '')) = j.name""")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    """A second list of higher priority, from outside, over the first."""
    own = table(spark, sf, "journals")
    outside = own.select("full", F.upper("full").alias("short"), F.lit(99).alias("priority"), "row_no")
    return journals.abbreviate(table(spark, sf, "entries"), own.unionByName(outside)).select("entry_id", F.col("fields")["journal"].alias("journal"))


@query("s9_bytes", "SELECT project, file, octet_length(content) AS n_bytes FROM bib_files")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bib_files").select("project", "file", F.octet_length("content").cast("long").alias("n_bytes"))


@query("s8_x4_lines", r"SELECT project, file, len(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'))::INT AS n_lines FROM tex_files")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tex_files").select("project", "file", F.size(V.lines(F.col("content"))).alias("n_lines"))


# Aggregates (A1-A17) ----------------------------------------------------------------------


@query("a1_duplicate_keys", f"SELECT project, key, count(*) AS n FROM {_LIVE} WHERE key IS NOT NULL GROUP BY project, key HAVING count(*) > 1")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_keys(table(spark, sf, "entries"))


_BY_DOI = f"(SELECT *, {_doi(_ANY_DOI)} AS doi_norm FROM {_LIVE})"
_DUP_DOI = f"(SELECT project, doi_norm, count(*) AS n, count(DISTINCT coalesce(key, '')) AS n_keys FROM {_BY_DOI} WHERE doi_norm <> '' GROUP BY project, doi_norm HAVING count(DISTINCT coalesce(key, '')) > 1)"
_BY_TITLE = f"(SELECT *, {_title('''fields['title']''')} AS title_norm FROM {_LIVE})"
_DUP_TITLE = f"(SELECT project, title_norm, count(*) AS n FROM {_BY_TITLE} WHERE title_norm <> '' GROUP BY project, title_norm HAVING count(*) > 1)"


@query("a2_duplicate_dois", f"SELECT * FROM {_DUP_DOI}")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_dois(table(spark, sf, "entries"))


@query("a3_duplicate_titles", f"SELECT * FROM {_DUP_TITLE}")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_titles(table(spark, sf, "entries"))


@query("a4_best_entry", f"""
   SELECT project, key, score, file, pos FROM (SELECT project, key, file, pos, {_SCORE} AS score FROM {_LIVE} WHERE key IS NOT NULL)
   QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY score DESC, file, pos) = 1""")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    e = D.live(table(spark, sf, "entries")).where("key IS NOT NULL").withColumn("k", F.struct("project", "key"))
    return D.best_entries(e, ["k"]).select("k.project", "k.key", "score", "file", "pos")


@query("a5_best_key", f"""
   SELECT project, doi_norm, key AS best_key FROM (SELECT DISTINCT project, doi_norm, key, {_KEY_SCORE} AS s FROM {_BY_DOI} WHERE doi_norm <> '' AND key IS NOT NULL)
   QUALIFY row_number() OVER (PARTITION BY project, doi_norm ORDER BY s DESC, key) = 1""")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return D.best_keys(D.with_doi(table(spark, sf, "entries")), ["project", "doi_norm"])


_STATS = "SELECT f.project, f.file, count(e.file) AS n_entries, " + ", ".join(f"count(CASE WHEN e.fields['{x}'] <> '' THEN 1 END) AS n_{x}" for x in ("doi", "title", "author", "year")) + f" FROM bib_files f LEFT JOIN {_LIVE} e ON e.project = f.project AND e.file = f.file GROUP BY f.project, f.file"


@query("a6_bib_stats", _STATS)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return V.bib_stats(table(spark, sf, "bib_files"), table(spark, sf, "entries"))


@query("a7_report", f"SELECT project, file, n_entries, CASE WHEN n_entries > 0 THEN printf('%.1f%%', 100.0::DOUBLE * n_doi / n_entries) ELSE 'N/A' END AS doi_share FROM ({_STATS})")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return V.report(V.bib_stats(table(spark, sf, "bib_files"), table(spark, sf, "entries")))


@query("a8_a9_a10_counts", f"""
   SELECT p.project, (SELECT count(*) FROM {_DUP_TITLE} t WHERE t.project = p.project) AS n_titles, (SELECT count(*) FROM {_DUP_DOI} t WHERE t.project = p.project) AS n_dois,
          (SELECT count(*) FROM (SELECT project, key FROM {_LIVE} WHERE key IS NOT NULL GROUP BY project, key HAVING count(*) > 1) t WHERE t.project = p.project) > 0 AS any_key
   FROM (SELECT DISTINCT project FROM entries) p""")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entries")
    n = lambda df, c: df.groupBy("project").agg(F.count(F.lit(1)).alias(c))
    out = e.select("project").distinct()
    for df, c in ((D.duplicate_titles(e), "n_titles"), (D.duplicate_dois(e), "n_dois"), (D.duplicate_keys(e), "n_keys")):
        out = out.join(n(df, c), "project", "left")
    return out.fillna(0).select("project", "n_titles", "n_dois", (F.col("n_keys") > 0).alias("any_key"))


_BYTE_LINES = r"regexp_split_to_array(replace(content::VARCHAR, '\x5C', chr(1)), '\\x0D\\x0A|\\x0[ABCD]|\\x1[CDE]|\\xC2\\x85|\\xE2\\x80\\xA[89]')"
_BYTE_BLANK = r"(?: |\\x09|\\x1F|\\xC2\\xA0|\\xE1\\x9A\\x80|\\xE2\\x80\\x8[0-9A]|\\xE2\\x80\\xAF|\\xE2\\x81\\x9F|\\xE3\\x80\\x80)*"
_PERCENT_LINES = rf"SELECT project, file, len(list_filter({_BYTE_LINES}, lambda x: NOT regexp_matches(x, '^{_BYTE_BLANK}%') AND regexp_matches(x, '(^|[^\x01])(\x01\x01)*%')))::INT AS n_lines FROM bib_files"


@query("a11_percent_lines", _PERCENT_LINES)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return V.percent_lines(table(spark, sf, "bib_files"))


@query("a12_summary", f"""
   SELECT project, coalesce(t.n, 0) AS n_tex, coalesce(b.n, 0) AS n_bib, coalesce(k.n, 0) AS n_keys, coalesce(c.n, 0) AS n_cited
   FROM (SELECT project FROM tex_files UNION SELECT project FROM bib_files UNION SELECT project FROM {_LIVE} WHERE key IS NOT NULL UNION SELECT project FROM citations WHERE key IS NOT NULL)
   LEFT JOIN (SELECT project, count(*) n FROM tex_files GROUP BY project) t USING (project) LEFT JOIN (SELECT project, count(*) n FROM bib_files GROUP BY project) b USING (project)
   LEFT JOIN (SELECT project, count(DISTINCT key) n FROM {_LIVE} GROUP BY project) k USING (project) LEFT JOIN (SELECT project, count(DISTINCT key) n FROM citations GROUP BY project) c USING (project)""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return V.summary(*(table(spark, sf, t) for t in ("tex_files", "bib_files", "entries", "citations")))


@query("a13_citation_totals", f"""
   WITH c AS {_DISTINCT_CITES}, m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.key = c.key)),
        w AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM ({_WRAPPED}) w WHERE w.project = c.project AND nfc_normalize(w.key) = c.key))
   SELECT project, file, n_cited, coalesce(n_missing, 0) AS n_missing, coalesce(n_commented, 0) AS n_commented, n_cited - coalesce(n_missing, 0) - coalesce(n_commented, 0) AS n_valid
   FROM (SELECT project, file, count(*) AS n_cited FROM c GROUP BY ALL) LEFT JOIN (SELECT project, file, count(*) AS n_missing FROM m GROUP BY ALL) USING (project, file)
   LEFT JOIN (SELECT project, file, count(*) AS n_commented FROM w GROUP BY ALL) USING (project, file)""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return C.citation_totals(table(spark, sf, "citations"), table(spark, sf, "entries"), C.commented_keys(_bib_text(spark, sf)))


@query("a14_missing_preview", f"""
   WITH m AS (SELECT DISTINCT project, key FROM citations c WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.key = c.key))
   SELECT project, count(*) AS n_missing, array_to_string(list_sort(list(key))[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' ...' ELSE '' END AS preview FROM m GROUP BY project""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_preview(table(spark, sf, "citations"), table(spark, sf, "entries"))


@query("a15_malformed_authors", "SELECT DISTINCT project, 0::BIGINT AS n FROM entries")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return V.malformed_authors(table(spark, sf, "entries"))


_SYNTAX = f"SELECT DISTINCT project, file, pos, 'brackets not closed' AS error FROM entries WHERE is_commented AND {_UNCLOSED}"


@query("a16_syntax_errors", _SYNTAX)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return V.syntax_errors(bibtex.parse_files(table(spark, sf, "bib_files")))


@query("e3_unbalanced", """
   SELECT * FROM (SELECT project, file, length(t) - length(replace(t, '{', '')) AS n_open, length(t) - length(replace(t, '}', '')) AS n_close FROM (SELECT project, file, content::VARCHAR AS t FROM bib_files))
   WHERE n_open <> n_close""")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return V.unbalanced(table(spark, sf, "bib_files"))


# Consolidation and keys (D1-D7) ---------------------------------------------------------------


@query("d1_synchronize", f"""
   WITH e AS (SELECT *, {_SCORE} AS s FROM {_LIVE} WHERE key IS NOT NULL), g AS (SELECT project, key FROM e GROUP BY ALL HAVING count(*) > 1),
        b AS (SELECT project, key, entry_type, n_fields, fields['title'] AS title FROM e SEMI JOIN g USING (project, key) QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY s DESC, file, pos) = 1)
   SELECT entry_id, coalesce(b.entry_type, x.entry_type) AS entry_type, coalesce(b.n_fields, x.n_fields, 0) AS n_fields, CASE WHEN b.key IS NULL THEN fields['title'] ELSE b.title END AS title
   FROM entries x LEFT JOIN b ON NOT x.is_commented AND x.project = b.project AND x.key = b.key""")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return D.synchronize(table(spark, sf, "entries")).select("entry_id", "entry_type", F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.col("fields")["title"].alias("title"))


def _consolidated(own_key: bool, by: str, members: str, groups: str) -> str:
    key = "arg_min(key, printf('%020.6f', 1000 - s) || file || printf('%012d', pos))" if own_key else f"arg_min(key, printf('%020.6f', 1000 - ({_KEY_SCORE})) || key)"
    return f"""
      WITH m AS (SELECT *, {_SCORE} AS s FROM {members} SEMI JOIN {groups} USING (project, {by})),
           k AS (SELECT project, {by}, {key} FILTER (WHERE key IS NOT NULL) AS best_key FROM m GROUP BY project, {by}),
           r AS (SELECT m.*, best_key, rank() OVER (PARTITION BY project, {by} ORDER BY CASE WHEN key = best_key THEN 0 ELSE 1 END, file, pos) AS r FROM m JOIN k USING (project, {by}))
      SELECT entry_id, key FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM r WHERE r > 1)"""


@query("d2_consolidate_dois", _consolidated(False, "doi_norm", f"(SELECT * FROM {_BY_DOI} WHERE doi_norm <> '')", _DUP_DOI))
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return D.consolidate_dois(table(spark, sf, "entries"))[0].select("entry_id", "key")


_KEYED_TITLE = f"(SELECT * FROM {_BY_TITLE} WHERE title_norm <> '' AND key IS NOT NULL)"


@query("d3_consolidate_titles", _consolidated(True, "title_norm", _KEYED_TITLE, f"(SELECT project, title_norm FROM {_KEYED_TITLE} GROUP BY ALL HAVING count(*) > 1)"))
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return D.consolidate_titles(table(spark, sf, "entries"))[0].select("entry_id", "key")


@query("d4_cross_file", f"""
   SELECT DISTINCT project, key_raw, file, pos FROM (SELECT * FROM {_LIVE} WHERE coalesce(key_raw, '') <> '' QUALIFY rank() OVER (PARTITION BY project, key_raw ORDER BY regexp_extract(file, '([^/]*)$', 1), file, pos) = 1)
   UNION ALL SELECT DISTINCT project, key_raw, file, pos FROM entries WHERE is_commented OR coalesce(key_raw, '') = ''""")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return D.drop_cross_file(table(spark, sf, "entries")).select("project", "key_raw", "file", "pos").distinct()


def _allocated(base: str) -> str:
    """The oracle's names for keys: numbered within a base, told apart by a digest where two would be alike."""
    return f"""
      SELECT project, base, key, CASE WHEN key <> base AND n > 0 AND count(*) OVER (PARTITION BY project, name) > 1 THEN base || '_' || md5(key)[1:8] ELSE name END AS new_key FROM (
        SELECT *, CASE WHEN n = 0 THEN base ELSE base || CASE WHEN regexp_matches(base, '[0-9]$') THEN '_' ELSE '' END || n END AS name FROM (
          SELECT project, base, key, row_number() OVER (PARTITION BY project, base ORDER BY CASE WHEN key = base THEN '' ELSE file END, pos, key) - 1 AS n
          FROM (SELECT project, base, key, min(struct_pack(f := file, p := pos)).f AS file, min(struct_pack(f := file, p := pos)).p AS pos FROM ({base}) GROUP BY project, base, key)))"""


_SANITIZED = "SELECT project, file, pos, key, CASE WHEN c = '' THEN key ELSE c END AS base FROM (SELECT *, regexp_replace(key, '[^A-Za-z0-9_:-]', '', 'g') AS c FROM entries WHERE key IS NOT NULL)"


@query("d5_sanitize", f"SELECT project, key AS old_key, new_key FROM ({_allocated(_SANITIZED)}) WHERE new_key <> key")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return K.sanitize(table(spark, sf, "entries"))[1]


_WANTED = f"SELECT project, file, pos, key, CASE WHEN base = '' THEN key ELSE base END AS base FROM ({_KEY}) WHERE key IS NOT NULL"
_NEW_KEYS = f"""
  SELECT project, key AS old_key, arg_max(new_key, struct_pack(f := file, p := pos)) AS new_key
  FROM (SELECT w.project, w.file, w.pos, w.key, a.new_key FROM ({_WANTED}) w JOIN ({_allocated(_WANTED)}) a USING (project, base, key)) WHERE new_key <> key GROUP BY project, key"""


@query("d6_standardize", _NEW_KEYS)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return K.standardize(table(spark, sf, "entries"))[1]


# In a file the n-th of equal bases gets n; one that bears the base as its key takes the base, if it comes first.
@query(
    "d6_standardize_by_file",
    f"""SELECT project, key AS old_key, arg_max(new_key, struct_pack(f := file, p := pos)) AS new_key FROM (
          SELECT *, CASE WHEN base = '' OR base = key THEN key WHEN n = 0 THEN base ELSE base || n END AS new_key FROM (
            SELECT *, count(*) FILTER (WHERE key <> base) OVER w + CASE WHEN row_number() OVER w > 1 AND first_value(key = base) OVER w THEN 1 ELSE 0 END - CASE WHEN key <> base THEN 1 ELSE 0 END AS n
            FROM (SELECT DISTINCT project, file, pos, key, base FROM ({_KEY}) WHERE key IS NOT NULL)
            WINDOW w AS (PARTITION BY project, file, base ORDER BY pos ROWS UNBOUNDED PRECEDING))) WHERE new_key <> key GROUP BY project, key""",
)
def d6_parity(spark: SparkSession, sf: str) -> DataFrame:
    return K.standardize(table(spark, sf, "entries"), parity=True)[1]


_CITE = r"\\[A-Za-z]*cite[a-zA-Z]*\{([^}]+)\}"
_REWRITTEN = rf"""
  WITH m AS ({_NEW_KEYS}),
       t AS (SELECT project, file, content, regexp_extract_all(content, '{_CITE}', 0) AS whole, regexp_extract_all(content, '{_CITE}', 1) AS inner_, regexp_split_to_array(content, '{_CITE}') AS between_ FROM tex_files),
       g AS (SELECT project, file, unnest(whole) AS w, unnest(inner_) AS g, unnest(range(len(whole))) AS i FROM t),
       k AS (SELECT project, file, i, unnest(string_split(g, ',')) AS raw, unnest(range(len(string_split(g, ',')))) AS j FROM g),
       n AS (SELECT k.project, k.file, i, j, coalesce(new_key, {_STRIP % "raw"}) AS key FROM k LEFT JOIN m ON m.project = k.project AND m.old_key = nfc_normalize({_STRIP % "raw"}) WHERE {_STRIP % "raw"} <> ''),
       o AS (SELECT project, file, i, key, min(j) AS j FROM n GROUP BY ALL),
       l AS (SELECT project, file, i, string_agg(key, ', ' ORDER BY j) AS keys FROM o GROUP BY ALL),
       s AS (SELECT g.project, g.file, i, w[1:strpos(w, '{{')] || coalesce(keys, '') || '}}' AS set_ FROM g LEFT JOIN l USING (project, file, i)),
       c AS (SELECT t.project, t.file, string_agg(set_ || between_[i + 2], '' ORDER BY i) AS tail FROM t JOIN s USING (project, file) GROUP BY ALL)
  SELECT t.project, t.file, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.project = t.project) AND tail IS NOT NULL THEN between_[1] || tail ELSE content END AS content
  FROM t LEFT JOIN c USING (project, file)"""


@query("d7_rewrite_citations", f"SELECT r.project, r.file, r.content, r.content <> t.content AS changed FROM ({_REWRITTEN}) r JOIN tex_files t USING (project, file)")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return C.rewrite_citations(table(spark, sf, "tex_files"), cut_lineage(K.standardize(table(spark, sf, "entries"))[1]))


@query("k4_changed_files", f"SELECT r.project, r.file, r.content FROM ({_REWRITTEN}) r JOIN tex_files t USING (project, file) WHERE r.content <> t.content")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    tex = table(spark, sf, "tex_files")
    return sinks.changed_files(tex, C.rewrite_citations(tex, cut_lineage(K.standardize(table(spark, sf, "entries"))[1])))


# Workflows --------------------------------------------------------------------------------------


_BASE = "regexp_extract(file, '([^/]*)$', 1)"
_E = "(SELECT DISTINCT project, file, pos, entry_type, key, fields, n_fields, raw, is_commented FROM entries)"
_E_LIVE = f"(SELECT * FROM {_E} WHERE NOT is_commented)"
_ISSUES = f"""
  WITH bib AS ({_CORRESPONDING}), cited AS (SELECT DISTINCT c.project, c.file, c.key FROM citations c JOIN bib USING (project, file) WHERE bib IS NOT NULL AND key IS NOT NULL)
  SELECT project, 'no_bib' AS "check", file, NULL::VARCHAR AS key, {_BASE} || ': no bib file' AS message FROM bib WHERE bib IS NULL
  UNION ALL SELECT project, 'missing', file, key, {_BASE} || ': missing ' || key FROM cited c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.project = c.project AND e.key = c.key)
  UNION ALL SELECT project, 'commented', file, key, {_BASE} || ': commented ' || key FROM cited c WHERE EXISTS (SELECT 1 FROM ({_WRAPPED}) w WHERE w.project = c.project AND nfc_normalize(w.key) = c.key)
  UNION ALL SELECT project, 'duplicate_key', NULL, key, 'duplicate key: ' || key FROM {_E_LIVE} WHERE key IS NOT NULL GROUP BY project, key HAVING count(*) > 1
  UNION ALL SELECT project, 'duplicate_doi', NULL, NULL, 'duplicate DOI: ' || d FROM (SELECT project, key, {_doi(_ANY_DOI)} AS d FROM {_E_LIVE}) WHERE d <> '' GROUP BY project, d HAVING count(DISTINCT coalesce(key, '')) > 1
  UNION ALL SELECT project, 'duplicate_title', NULL, NULL, 'duplicate title: ' || t FROM (SELECT project, {_title("fields['title']")} AS t FROM {_E_LIVE}) WHERE t <> '' GROUP BY project, t HAVING count(*) > 1
  UNION ALL SELECT project, 'percent', file, NULL, {_BASE} || ': unescaped % in lines: ' || n_lines FROM ({_PERCENT_LINES}) WHERE n_lines > 0
  UNION ALL SELECT project, 'syntax', file, NULL, {_BASE} || ': ' || error FROM ({_SYNTAX})"""


@query("g4_verdict", f"SELECT project, bool_and(i.project IS NULL) AS ok FROM (SELECT project FROM bib_files UNION SELECT project FROM tex_files) p LEFT JOIN (SELECT project FROM ({_ISSUES}) WHERE \"check\" <> 'duplicate_key') i USING (project) GROUP BY project")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.validate(table(spark, sf, "bib_files"), table(spark, sf, "tex_files"))[1]


@query("v_issues", _ISSUES)
def v_issues(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.validate(table(spark, sf, "bib_files"), table(spark, sf, "tex_files"))[0]


@query("w_curate")
def w_curate(spark: SparkSession, sf: str) -> DataFrame:
    done = workflow.curate(table(spark, sf, "bib_files"), table(spark, sf, "tex_files"), journals=table(spark, sf, "journals"))
    return done.entries.select("project", "file", "pos", "entry_type", "key", "n_fields")


# Problem 6 ----------------------------------------------------------------------------------------


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_fields.unpack(table(spark, sf, "entries"), least=2)
