"""The pN_ queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import canonical_list, hot_dedup, look_alike, mojibake, name_variants, packing, reading_level, survivor, token_ids
from refloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repair_entries(table(spark, sf, "entries")).select("entry_id", "field")


@query("p1_repaired")
def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "entries")
    return mojibake.restore_lost(mojibake.repair_entries(entries), mojibake.text_values(entries).select("v"))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike.unify_entries(table(spark, sf, "entries")).select("entry_id", "field")


@query("p4_forms")
def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike.unify_entries(table(spark, sf, "entries"))


_CANON = r"""WITH pairs AS (
          SELECT entry_id, entry_type, lower(trim(kv.key)) AS k, kv.value AS v
          FROM (SELECT entry_id, entry_type, unnest(map_entries(fields)) AS kv FROM entries WHERE fields IS NOT NULL)),
        clean AS (
          SELECT entry_id, k, regexp_replace(CASE WHEN k = 'doi'
            THEN regexp_replace(regexp_replace(lower(v), '^\s+|\s+$', '', 'g'), '^((doi:|https?://(dx\.)?doi\.example/)\s*)+', '')
            ELSE lower(v) END, '[^\p{L}\p{N}]+', '', 'g') AS v FROM pairs),
        canon AS (
          SELECT e.entry_id, regexp_replace(lower(e.entry_type), '[^\p{L}\p{N}]+', '', 'g') AS t,
                 list_sort(list_distinct(list(c.k || ':' || c.v) FILTER (WHERE c.v <> ''))) AS body
          FROM (SELECT entry_id, entry_type FROM entries WHERE fields IS NOT NULL) e LEFT JOIN clean c USING (entry_id)
          GROUP BY e.entry_id, e.entry_type)"""


@query(
    "p5_found",
    _CANON + """,
        firsts AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY t, body) AS group_id FROM canon)
        SELECT group_id, entry_id FROM firsts WHERE entry_id <> group_id""",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = hot_dedup.copies(hot_dedup.digests(table(spark, sf, "entries")))
    return found.where("entry_id <> group_id").select("group_id", "entry_id")


@query("p5_copies", _CANON + " SELECT min(entry_id) AS entry_id, count(*) AS n_copies FROM canon GROUP BY t, body")
def p5_copies(spark: SparkSession, sf: str) -> DataFrame:
    return hot_dedup.collapse(table(spark, sf, "entries"))


@query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, sf, "author_names"))


@query("p7_entities")
def p7_entities(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.entity_sizes(table(spark, sf, "author_names"))


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids.encode_corpus(table(spark, sf, "documents"))


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_list.map_journals(table(spark, sf, "entries"), table(spark, sf, "journals"))


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STANDS_IN = """'', '-', '--', '---', '?', '??', '???', '.', '...', 'n/a', 'na', 'n.a.', 'n.n.', 'nn', 'n.d.', 'none', 'null', 'nil', 'unknown', 'tba', 'tbd', 't.b.a.',
    'in press', 'to appear', 'forthcoming', 'missing', 'xxx'"""


def _get(name: str) -> str:
    return f"list_sort(list_filter(map_entries(fields), lambda x: lower(trim(x.key)) = '{name}'))[1].value"


def _filled(v: str) -> str:
    return f"""coalesce(lower(regexp_replace({v}, '^[{_BLANK[1:-1]}{{"]+|[{_BLANK[1:-1]}}}"]+$', '', 'g')) NOT IN ({_STANDS_IN}), false)"""


def _words(v: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({v}, '')), '[\p{{Cf}}{{}}]+', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda w: w <> '' AND w <> 'and')"


def _cut(words: str) -> str:
    return f"""EXISTS (SELECT 1 FROM m o WHERE o.doi = m.doi AND len(o.{words}) > 1 AND list_contains(list_transform(range(1, len(o.{words})), lambda n: array_to_string(o.{words}[1:n], '')), array_to_string(m.{words}, '')))"""


_WHOLE = " UNION ALL ".join(
    f"SELECT g.group_id, '{f}' AS field, m.entry_id, m.modified_at FROM m JOIN g USING (doi) WHERE {w}"
    for f, w in {
        "ID": "regexp_matches(key_raw, '^[A-Z][a-z]+[0-9]{4}[A-Za-z0-9]*$')",
        "author": _filled("author") + rf""" AND NOT regexp_matches(author, '(?i)(\bet\s*\.?\s*al\b\.?|\bu\.\s*a\.|\band\s+others\b|\bothers\b|\.\.\.|…)[{_BLANK[1:-1]}}}".,;]*$') AND NOT """ + _cut("aw"),
        "title": _filled("title") + rf""" AND NOT regexp_matches(title, '(\.{{3,}}|…)[{_BLANK[1:-1]}}}"]*$') AND NOT """ + _cut("tw"),
        **{f: _filled(f) for f in ("journal", "pages", "volume", "year")},
    }.items()
)


@query(
    "p3_found",
    rf"""WITH raw AS (SELECT entry_id, modified_at, key_raw, {", ".join(f"{_get(f)} AS {f}" for f in ("author", "journal", "pages", "title", "volume", "year", "doi"))} FROM entries WHERE fields IS NOT NULL),
        d AS (SELECT * EXCLUDE (doi), regexp_replace(regexp_replace(lower(doi), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '^((doi:|https?://(dx\.)?doi\.example/)\s*)+', '') AS doi FROM raw),
        m AS (SELECT *, {_words("title")} AS tw, {_words("author")} AS aw FROM d WHERE {_filled("doi")}),
        g AS (SELECT doi, min(entry_id) AS group_id FROM m GROUP BY doi HAVING count(*) > 1)
        SELECT group_id, field, entry_id FROM ({_WHOLE})
        QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY modified_at DESC NULLS LAST, entry_id DESC) = 1""",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.best_values(table(spark, sf, "entries"))


@query("p3_survivors")
def p3_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.records(table(spark, sf, "entries")).withColumn("fields", F.to_json("fields"))


#: Limits that act on these texts: a share below that of tokens in lines with letters (0.389 at sf0.01), and
#: a segment for each so many tokens, where a text has 1,142 on average (sf0.1) and most have fewer.
LIMITS = {"segment_tokens": 512, "loss_share": 0.375}
LOSS_SHARE = LIMITS["loss_share"]


@query("p9_containers")
def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"), **LIMITS)


@query("p9_report")
def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    packs = table(spark, sf, "pack_sizes")
    return packing.packing_report(packing.fill_containers(table(spark, sf, "documents"), packs, **LIMITS), packs, **LIMITS)


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.estimate(table(spark, sf, "documents"), table(spark, sf, "reading_labels")).select("doc_id", "level")


@query("p10_profile")
def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    levels = reading_level.estimate(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
    return table(spark, sf, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"))
