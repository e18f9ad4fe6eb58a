"""Problem 3: the best representative of each group of entries with one DOI.

A member is described by the set of its whole values (a mask with a bit for
each field), by its recency, the pair of last edit and entry id, and by the trust
put in it. A member dominates another if its mask holds the other's and it is
neither less trusted nor older. Members of one mask and trust are one profile, of
which only the most recent can be undominated; they are combined by (DOI, profile)
before the shuffle, so a group shrinks to 2^7 profiles for each level of trust,
however many members it has. A profile's layer is the length of the longest chain of
profiles above it: 1 on the skyline, 2 on the skyline of what that leaves, and so on.

For each judged field the policy is lexicographic: whole values first, then the
layer, then the last edit, then the largest id. What a group's first layer leaves
null, because no member there says anything, is filled from the second and so on,
for every field name there is; a stand-in is taken only where no layer says more.

A value is whole if it is neither blank nor a stand-in nor cut short. A title or
author list is cut short if it ends in a mark for more, or if its words are the
first words of a longer value in its group. The second test is an equality join
of hashes of word prefixes, taken only in groups whose values differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.normalize import BLANKS
from refloom.llm.hot_dedup import bare_doi
from refloom.operators.skew import join_even

FIELDS = ("ID", "author", "journal", "pages", "title", "volume", "year")
#: Names of the key and the entry type among fields, whose own names are in lower case.
KEY, TYPE = "ID", "ENTRYTYPE"
#: Words that stand in for a missing value.
STAND_INS = (
    "", "-", "--", "---", "?", "??", "???", ".", "...", "n/a", "na", "n.a.", "n.n.", "nn", "n.d.", "none", "null", "nil",
    "unknown", "tba", "tbd", "t.b.a.", "in press", "to appear", "forthcoming", "missing", "xxx",
)
_ELLIPSIS = r"(?U)(?:\.{3,}|…)[\s}\"]*$"
_OTHERS = r"(?iU)(?:\bet\s*\.?\s*al\b\.?|\bu\.\s*a\.|\band\s+others\b|\bothers\b|\.\.\.|…)[\s}\".,;]*$"
_KEY_SHAPE = r"^[A-Z][a-z]+[0-9]{4}[A-Za-z0-9]*$"


def field(fields: Column, name: str) -> Column:
    """A field's value whatever the case of its name; of several spellings the first in order of name."""
    hits = F.array_sort(F.filter(F.map_keys(fields), lambda k: F.lower(F.trim(k)) == name))
    return F.when(F.size(hits) > 0, F.element_at(fields, F.element_at(hits, 1)))


def bare(c: Column) -> Column:
    """A value without outer blanks, braces and quotes."""
    return F.rtrim(F.ltrim(c, F.lit(BLANKS + '{"')), F.lit(BLANKS + '}"'))


def filled(c: Column) -> Column:
    """Whether a value is there: not NULL, not blank, no stand-in word."""
    return F.coalesce(~F.lower(bare(c)).isin(*STAND_INS), F.lit(False))


def words(c: Column) -> Column:
    """The words of a value, lower-cased, without the word that joins names; format characters and braces vanish."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\p{Cf}{}]+", "")
    return F.filter(F.split(x, r"[^\p{L}\p{N}\p{M}]+"), lambda w: (w != "") & (w != "and"))


def chained(ws: Column) -> Column:
    return F.xxhash64(F.array_join(ws, ""))


#: What a member's row carries to its group.
_CARRIED = ("entry_id", "modified_at", "key_raw", "entry_type", "fields")


def members(entries: DataFrame, trust: Column) -> DataFrame:
    """``(doi, tw, aw, mask, trust)`` and what is carried along, for each entry with a DOI: the mask knows nothing of the group yet."""
    m = F.col("fields")
    e = entries.where(m.isNotNull()).select(
        *_CARRIED,
        trust.alias("trust"),
        bare_doi(field(m, "doi")).alias("doi"),
        F.col("key_raw").alias("ID"),
        *[field(m, f).alias(f) for f in FIELDS if f != "ID"],
    )
    e = e.where(filled(F.col("doi")))
    ok = {f: filled(F.col(f)) for f in FIELDS}
    ok["ID"] = F.coalesce(F.col("ID").rlike(_KEY_SHAPE), F.lit(False))
    ok["title"] = ok["title"] & ~F.col("title").rlike(_ELLIPSIS)
    ok["author"] = ok["author"] & ~F.col("author").rlike(_OTHERS)
    mask = sum((F.when(F.coalesce(ok[f], F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    return e.select("doi", *_CARRIED, "trust", words(F.col("title")).alias("tw"), words(F.col("author")).alias("aw"), mask.cast("int").alias("mask"))


def cut_short(variants: DataFrame, ws: str, h: str) -> DataFrame:
    """``(doi, h)`` of word lists that begin a longer one of the same DOI.

    One word of a longer list may be cut inside, so prefixes end at word ends only.
    """
    v = variants.groupBy("doi", h).agg(F.first(ws).alias("ws"))
    begun = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda n: chained(F.slice("ws", 1, n)))
    shorter = v.where(F.size("ws") > 1).select("doi", F.explode(begun).alias(h))
    return v.select("doi", h).join(shorter.distinct(), ["doi", h], "left_semi")


def layered(rows: Column, dims: tuple[str, ...] = ()) -> Column:
    """Structs (x, layer) of an array of structs (mask, modified_at, entry_id, ...), the most recent first.

    One dominates another if its mask holds the other's, it is more recent (a NULL
    edit is the oldest, equal edits go by id) and no less in any of ``dims``. All that dominate a
    struct come before it in order of recency, so one pass gives the longest chains.
    """
    recent = F.reverse(F.array_sort(F.transform(rows, lambda x: F.struct(x["modified_at"].alias("m"), x["entry_id"].alias("e"), x.alias("x")))))

    def place(acc: Column, r: Column) -> Column:
        above = F.filter(acc, lambda y: reduce(lambda c, d: c & (y["x"][d] >= r["x"][d]), dims, y["x"]["mask"].bitwiseAND(r["x"]["mask"]) == r["x"]["mask"]))
        layer = F.coalesce(F.array_max(F.transform(above, lambda y: y["layer"])), F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(r["x"].alias("x"), layer.alias("layer"))))

    none = F.slice(F.transform(rows, lambda x: F.struct(x.alias("x"), F.lit(0).alias("layer"))), 1, 0)
    return F.aggregate(recent, none, place)


def layers(rows: Column, depth: int) -> Column:
    """An array with the first ``depth`` dominance layers; layer n is the skyline of what the first n-1 leave."""
    ranked = layered(rows)
    layer = lambda n: F.transform(F.filter(ranked, lambda y: y["layer"] == n), lambda y: y["x"])
    return F.array(*[layer(n + 1) for n in range(depth)])


def skyline(rows: Column) -> Column:
    """The undominated structs of an array of (mask, modified_at, entry_id)."""
    return layers(rows, 1)[0]


def prompt() -> Column:
    """The default trust: 1 for a record that arrived within a year of its last edit, 0 for one that came later or says nothing of it."""
    return F.coalesce((F.col("ingested_at") <= F.col("modified_at") + F.expr("INTERVAL 366 DAYS")).cast("int"), F.lit(0))


def profiles(entries: DataFrame, trust: Column | None = None) -> DataFrame:
    """``(doi, group_id, th, ah, base, trust, c, mask, top)`` of the groups of two or more: how many rows share what a member shows, its mask in the group, and the latest of them."""
    e = _shown(entries, trust)
    pre = (
        e.groupBy("doi", "th", "ah", "base", "trust")
        .agg(
            F.max(F.struct("modified_at", "entry_id")).alias("top"),
            F.min("entry_id").alias("low"),
            F.count(F.lit(1)).alias("c"),
            F.first("tw").alias("tw"),
            F.first("aw").alias("aw"),
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    groups = pre.groupBy("doi").agg(
        F.sum("c").alias("members"), F.count(F.lit(1)).alias("n"), F.min("low").alias("group_id"),
        (F.min("th") != F.max("th")).alias("titles_differ"), (F.min("ah") != F.max("ah")).alias("authors_differ"),
    ).where("members > 1").persist(StorageLevel.MEMORY_AND_DISK)
    grouped = join_even(pre, groups.select("doi", "n", "group_id", "titles_differ", "authors_differ"), "doi")
    cut_t = cut_short(grouped.where("titles_differ"), "tw", "th").withColumn("cut_t", F.lit(True))
    cut_a = cut_short(grouped.where("authors_differ"), "aw", "ah").withColumn("cut_a", F.lit(True))
    bit = {f: 1 << i for i, f in enumerate(FIELDS)}
    drop = F.when(F.col("cut_t"), bit["title"]).otherwise(0) + F.when(F.col("cut_a"), bit["author"]).otherwise(0)
    return (
        grouped.select("doi", "group_id", "th", "ah", "base", "trust", "c", "top")
        .join(cut_t, ["doi", "th"], "left")
        .join(cut_a, ["doi", "ah"], "left")
        .select("doi", "group_id", "th", "ah", "base", "trust", "c", F.col("base").bitwiseAND(F.bitwise_not(drop)).alias("mask"), "top")
    )


def _shown(entries: DataFrame, trust: Column | None) -> DataFrame:
    e = members(entries, prompt() if trust is None else trust)
    return e.withColumns({"th": chained(F.col("tw")), "ah": chained(F.col("aw"))}).withColumnRenamed("mask", "base")


def group_layers(shown: DataFrame) -> DataFrame:
    """``(group_id, ranked)``: the profiles of each group and their layers; ``trust`` should have few levels."""
    best = shown.groupBy("group_id", "mask", "trust").agg(F.max("top").alias("top"))
    rows = F.collect_list(F.struct("mask", F.col("top.modified_at").alias("modified_at"), F.col("top.entry_id").alias("entry_id"), "trust"))
    return best.groupBy("group_id").agg(rows.alias("rows")).select("group_id", layered(F.col("rows"), ("trust",)).alias("ranked"))


def _pick(able: Column) -> Column:
    """The entry id of the most recent of the first layer that an array of ranked members reaches; NULL for none."""
    first = F.array_min(F.transform(able, lambda y: y["layer"]))
    there = F.filter(able, lambda y: y["layer"] == first)
    return F.array_max(F.transform(there, lambda y: F.struct(y["x"]["modified_at"], y["x"]["entry_id"])))["entry_id"]


def _picks(g: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """``(group_id, field, entry_id)`` of ranked groups: the member with the best whole value of each field, and what else is asked for.

    The latest member whole in a field can't be dominated (who did would be whole
    in it and later), so the first layer holds it whatever the trust.
    """
    whole = lambda i: F.filter(F.col("ranked"), lambda y: y["x"]["mask"].bitwiseAND(F.lit(1 << i)) != 0)
    picks = F.array(*[F.struct(F.lit(f).alias("field"), _pick(whole(i)).alias("entry_id")) for i, f in enumerate(FIELDS)], *more)
    return g.select("group_id", F.explode(picks).alias("p")).select("group_id", "p.field", "p.entry_id").where("entry_id IS NOT NULL")


def best_values(entries: DataFrame, trust: Column | None = None) -> DataFrame:
    """``(group_id, field, entry_id)``: the member whose value of a field the surviving record takes.

    No row where no member has a whole value. Blank, NULL and stand-in DOIs form
    no group; copies of one record are members in their own right; equal edits go
    to the larger id, and a NULL edit is the oldest.
    """
    return _picks(group_layers(profiles(entries, trust)))


def best_there_is(entries: DataFrame, shown: DataFrame, ranked: DataFrame, trust: Column | None = None) -> DataFrame:
    """``(group_id, field, value)``: the best value of every field name of each group, of the key and of the entry type.

    Values that say something come before stand-ins, then the first layer that
    has one fills the field, and in a layer the last edit and the largest id decide. Titles
    and author lists are asked for here only where all are cut short, so of these the one
    with the most words is the best. Blank values are none.
    """
    at = ranked.select("group_id", F.explode("ranked").alias("y")).select("group_id", F.col("y.x.mask").alias("mask"), F.col("y.x.trust").alias("trust"), F.col("y.layer").alias("layer"))
    keys = ("doi", "th", "ah", "base", "trust")
    seen = shown.join(at, ["group_id", "mask", "trust"]).select(F.struct(*keys).alias("k"), F.col("c").alias("n"), "group_id", "layer")
    e = join_even(_shown(entries, trust).withColumn("k", F.struct(*keys)).select("k", *_CARRIED), seen, "k")
    own = F.array(*[F.struct(F.lit(name).alias("key"), F.col(c).alias("value")) for name, c in ((KEY, "key_raw"), (TYPE, "entry_type"))])
    named = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.struct(F.lower(F.trim(x["key"])).alias("key"), x["value"].alias("value")))
    rows = e.select("group_id", "entry_id", "modified_at", "layer", F.posexplode(F.concat(own, named)).alias("at", "f"))
    rows = rows.select("group_id", "entry_id", "modified_at", "layer", "at", F.col("f.key").alias("field"), F.col("f.value").alias("value")).where(bare(F.col("value")) != "")
    said = filled(F.col("value"))
    length = F.when(said & F.col("field").isin("title", "author"), F.size(words(F.col("value")))).otherwise(0)
    best = F.max(F.struct(said.alias("said"), length.alias("length"), (-F.col("layer")).alias("layer"), "modified_at", "entry_id", (-F.col("at")).alias("at"), "value"))
    return rows.groupBy("group_id", "field").agg(best.alias("best")).select("group_id", "field", F.col("best.value").alias("value"))


def records(entries: DataFrame, trust: Column | None = None) -> DataFrame:
    """``(group_id, key, entry_type, fields)``: one whole record for each group, with the best value of every field name of its members.

    The entry type is that of the member of the first layer with the most whole
    values, then the last edit and the largest id. What no member has whole is
    filled layer by layer, see ``best_there_is``. ``trust`` is a Column of few levels, the higher the better.
    """
    shown = profiles(entries, trust).persist(StorageLevel.MEMORY_AND_DISK)
    ranked = group_layers(shown).persist(StorageLevel.MEMORY_AND_DISK)
    first = F.filter("ranked", lambda y: y["layer"] == 1)
    most = F.array_max(F.transform(first, lambda y: F.bit_count(y["x"]["mask"])))
    richest = _pick(F.filter(first, lambda y: F.bit_count(y["x"]["mask"]) == most))
    picks = _picks(ranked, (F.struct(F.lit(TYPE).alias("field"), richest.alias("entry_id")),))
    values = entries.where("fields IS NOT NULL").select("entry_id", "key_raw", "entry_type", "fields")
    f = F.col("fields")
    value = reduce(lambda acc, n: acc.when(F.col("field") == n, field(f, n)), FIELDS[1:], F.when(F.col("field") == KEY, F.col("key_raw")).when(F.col("field") == TYPE, F.col("entry_type")))
    whole = picks.join(values, "entry_id").select("group_id", "field", value.alias("value")).where(filled(F.col("value")) | (F.col("field") == KEY)).distinct()
    both = whole.withColumn("whole", F.lit(1)).unionByName(best_there_is(entries, shown, ranked, trust).withColumn("whole", F.lit(0)))
    best = both.groupBy("group_id", "field").agg(F.max(F.struct("whole", "value"))["value"].alias("value"))
    return best.groupBy("group_id").agg(
        F.max(F.when(F.col("field") == KEY, F.col("value"))).alias("key"),
        F.max(F.when(F.col("field") == TYPE, F.col("value"))).alias("entry_type"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("field").isin(KEY, TYPE), F.struct("field", "value"))))).alias("fields"),
    )


def survivors(entries: DataFrame) -> DataFrame:
    """``(group_id, key, fields)``: ``records`` with the judged fields only."""
    return records(entries).select("group_id", "key", F.map_filter("fields", lambda k, _: k.isin(*FIELDS)).alias("fields"))
