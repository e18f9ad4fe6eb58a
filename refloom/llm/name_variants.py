"""Problem 7: spellings that mean the same person or organisation.

Merge-and-rematch resolution. Names are parsed into surname, given name (nicknames
resolved), initials; organisations into place and subject. Equal parses are one
node, and a node's profile is all that its entity has gathered. Profiles merge
along equality joins only:

* middle initials that continue one another under one surname and given name;
* one typing error in the given name: (surname, deletion key of the given name);
* one typing error in the surname or place: (deletion key of the surname, given name);
* a particle written together with the surname.

Where the middle initials under a surname and given name contradict, there are
several people: each initial is one of them, and a bare name says which of them
only once they have merged. Such names, those with initials only and nicknames of several names are
loose: one joins a profile if it is the only one of its surname (any spelling
the profile has gathered) that it fits. Merging unions spellings, given names and
middle initials, so in every round all profiles enter the blocking again, first along typing
errors, then the loose ones, until a round merges nothing.

Typing errors are looked for among distinct pairs of surname and given name, so a key
holds only words within one deletion of each other, whose number the alphabet
bounds, however many middle initials or spellings a pair has; people are then
met by their first middle initial. Components come from minimum labels with
pointer jumping, checkpointed to the shared folder.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.operators.skew import join_even
from refloom.runtime import cut_lineage

#: Short forms of given names and the names they stand for, several where usage differs.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew andreas ondrej anders", "drew": "andrew", "toni": "antonia", "tonya": "antonia",
    "tony": "anthony antonio", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "bernie": "bernard", "cathy": "catherine", "carmina": "carmen", "chuck": "charles", "charlie": "charles",
    "chris": "christopher christian christine", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "lola": "dolores", "lolita": "dolores", "don": "donald", "doug": "douglas",
    "ed": "edward", "eddie": "edward", "ted": "edward theodore", "ned": "edward", "nell": "eleanor", "nora": "eleanor", "ellie": "eleanor", "liz": "elizabeth", "beth": "elizabeth",
    "lisa": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "eva": "ewa", "paco": "francisco", "pancho": "francisco", "curro": "francisco", "fred": "frederick", "freddy": "frederick",
    "fritz": "frederick", "gabe": "gabriel", "jerry": "gerald jerome", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "greg": "gregory", "harry": "harold henry", "jim": "james",
    "jimmy": "james", "jeff": "jeffrey", "jenny": "jennifer", "hans": "johannes", "hannes": "johannes", "jan": "johannes", "johnny": "john", "jo": "josephine", "josie": "josephine",
    "joe": "joseph", "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "ken": "kenneth", "larry": "lawrence", "leo": "leonard",
    "len": "leonard", "lenny": "leonard", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael",
    "nick": "nicholas", "klaus": "nicholas", "niko": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip",
    "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert albert",
    "ron": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "steven stephen", "sue": "susanna", "susie": "susanna", "dora": "theodora", "thea": "theodora", "tom": "tomas thomas",
    "tommy": "tomas thomas", "tim": "timothy", "uli": "ulrich", "vic": "victoria victor", "vicky": "victoria", "tori": "victoria", "walt": "walter", "wendy": "wanda", "bill": "william",
    "will": "william", "billy": "william", "liam": "william", "quin": "quentin", "jurg": "jurgen",
}
PARTICLES = frozenset("van von der den de la le di da du del ten ter zu d".split())
#: Words and short forms by which organisations are told from persons.
ORG_WORDS = {
    "acad": "academy", "lab": "laboratory", "labs": "laboratory", "obs": "observatory", "inst": "institute", "dept": "department", "dep": "department", "univ": "university",
    "ctr": "center", "centre": "center", "soc": "society", "assoc": "association", "coll": "college", "fac": "faculty", "found": "foundation",
    **{w: w for w in "academy laboratory observatory institute department university center society association college faculty foundation agency bureau council school".split()},
}
_DROPPED = frozenset("the of at and for in on".split())
#: Letters without a canonical decomposition.
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
SALTS = 16
#: A given name is common if so many names have it where only given names stand.
COMMON = 3
#: Up to so many common given names are sent to the workers; more are joined to the names' words.
BROADCAST_ROWS = 200_000


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower()).translate(_PLAIN)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*\.?", text)


def parse(name: str | None, given_lexicon: frozenset[str] | set[str] = frozenset()) -> tuple[str, str, str, str, str]:
    """(surname, given, initial, middle, surname with particles) of a name; an organisation gives (place, subject, "#", "", place).

    NULL and names without letters give empty parts and link to nothing.
    """
    text = fold((name or "").replace("&", " and "))
    text = text.strip("{}\" \t\n")
    words = [w.rstrip(".") for w in _words(text)]
    if any(w in ORG_WORDS for w in words) and (len(words) > 2 or " of " in text):
        kept = [ORG_WORDS.get(w, w) for w in words if w not in _DROPPED]
        comma = text.rpartition(",")[2].split() if "," in text else []
        at = re.search(r"\bat\s+(\S+)\s*$", text)
        place = at[1] if at else (comma[-1] if len(comma) == 1 else (kept[0] if kept and kept[0] not in ORG_WORDS.values() else ""))
        subject = sorted(w for w in kept if w != place)
        return place, " ".join(subject), "#", "", place
    left, comma, right = text.partition(",")
    if comma and right.strip():
        last, given = left, right
    else:
        parts = text.rstrip(",").split()
        raw = (name or "").strip("{}\" \t\n").rstrip(",").split()
        if len(parts) > 1 and re.fullmatch(r"[^\W\d_]{1,3}", parts[-1]) and raw[-1].isupper() and len(parts[-1].rstrip(".")) <= 3 and not _initial(parts[0]) and parts[0] not in given_lexicon:
            last, given = " ".join(parts[:-1]), " ".join(parts[-1])
        elif len(parts) > 1 and _known(parts[-1], given_lexicon) and not _known(parts[0], given_lexicon) and not _initial(parts[0]):
            last, given = " ".join(parts[:-1]), parts[-1]
        else:
            # Initials and the first full word lead; the rest is the surname with its particles.
            n = 0
            while n < len(parts) - 1 and (n == 0 or _initial(parts[n]) or (_known(parts[n], given_lexicon) and n < len(parts) - 1)):
                n += 1
            last, given = " ".join(parts[n:]), " ".join(parts[:n])
            glued = re.match(r"^((?:[^\W\d_]\.)+)([^\W\d_]{3,}.*)$", last)
            if glued:
                given, last = f"{given} {glued[1]}", glued[2]
    whole = "".join(re.findall(r"[^\W\d_]+", last))
    surname = "".join(w for w in re.findall(r"[^\W\d_]+", last.replace("'", " ").replace("’", " ")) if w not in PARTICLES) or whole
    tokens = re.findall(r"[^\W\d_]+", re.sub(r"\.", ". ", given))
    if not tokens:
        return surname, "", "", "", whole
    first, rest = tokens[0], tokens[1:]
    meant = NICKNAMES.get(first, first)
    full = "" if len(first) == 1 else first if " " in meant else meant
    return surname, full, (full or first)[0], "".join(t[0] for t in rest), whole


def _initial(token: str) -> bool:
    return bool(re.fullmatch(r"(?:[^\W\d_]\.?-?)|(?:[^\W\d_]\.)+", token))


def _known(token: str, lexicon) -> bool:
    return token in lexicon or token in NICKNAMES


def given_lexicon(names: DataFrame) -> DataFrame:
    """``(g, n)``: common given names, those that stand behind the comma or first in ``COMMON`` names or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                text = fold(name or "").strip("{}\" ")
                left, comma, right = text.partition(",")
                t = (right if comma else "").split()
                if t and len(t[0].rstrip(".")) > 1 and not any(w.rstrip(".") in ORG_WORDS for w in text.split()):
                    out.append(t[0].rstrip("."))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["g"])

    return names.select("name").mapInArrow(run, "g string").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)


def _words_asked(name: str | None) -> list[str]:
    """The words that ``parse`` may look up in the lexicon."""
    words = re.findall(r"[^\W\d_]+", fold(name or "")) + fold(name or "").strip("{}\" \t\n").rstrip(",").split()
    return list({*words, *(NICKNAMES[w] for w in words if w in NICKNAMES)})


def parsed(names: DataFrame, lexicon: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``(name_id, sur, given, fi, mid, whole, common)``; names that parse to nothing are left out.

    A lexicon of more than ``most`` rows is joined to the words of the names, with the same outcome.
    """
    names = names.select(F.col("name_id").cast("long").alias("name_id"), "name")
    lexicon = cut_lineage(lexicon)
    small = lexicon.count() <= most
    if small:
        asked = names.withColumn("known", F.array().cast("array<string>"))
        shared = names.sparkSession.sparkContext.broadcast(frozenset(r["g"] for r in lexicon.select("g").toLocalIterator()))
    else:
        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_words_asked(n) for n in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["name_id", "name", "ws"])

        each = names.mapInArrow(words, "name_id long, name string, ws array<string>").select("name_id", "name", F.explode_outer("ws").alias("g"))
        uses = each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(lexicon.select("g", F.lit(True).alias("hit")), "g")
        asked = join_even(each, uses, "g", how="left").groupBy("name_id", "name").agg(F.collect_set(F.when(F.col("hit"), F.col("g"))).alias("known"))
        shared = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [shared.value if small else set(k) for k in known]
            rows = [parse(n, k) for n, k in zip(texts, own)]
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(5)]
            common = pa.array([r[1] in k for r, k in zip(rows, own)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, common], names=["name_id", "sur", "given", "fi", "mid", "whole", "common"])

    return asked.mapInArrow(run, "name_id long, sur string, given string, fi string, mid string, whole string, common boolean").where("sur <> '' OR fi = '#'")


def deletion_keys(c: Column) -> Column:
    """A word and all words with one letter less: two words within one edit or swap share one."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 3, shorter).otherwise(F.array().cast("array<string>"))))


def one_error(a: Column, b: Column) -> Column:
    """At most one edit, or one swap of neighbours."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (letters(a) == letters(b)))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, label)``: each node's smallest label reachable over ``(a, b)``, starting from the labels given."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(heard, "node", "left").select("node", "label", F.least("label", "low").alias("new"))
        # Pointer jumping: what a label's own node has just heard counts as well.
        up = step.where("new < label").select(F.col("node").alias("new"), F.col("new").alias("up"))
        done = cut_lineage(step.join(up, "new", "left").select("node", "label", F.least("new", "up").alias("new")))
        labels = done.select("node", F.col("new").alias("label"))
        if done.where("new < label").isEmpty():
            return labels


def _mids_fit(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


#: What names have in common before middle initials are looked at.
PAIR = ["sur", "given", "fi"]


def _people(nodes: DataFrame) -> DataFrame:
    """Nodes with ``m1``, ``low`` and ``loose``: the smallest node of their person, by middle initials alone.

    The middle initials under a surname and given name are one person's if all
    continue one another; else each first initial is a person, unless its own contradict, and bare names are loose.
    """
    x = nodes.withColumn("m1", F.substring("mid", 1, 1)).withColumn("k", F.struct(*PAIR, "m1"))
    c = x.groupBy("k").agg(F.max_by("mid", F.struct(F.length("mid"), "mid")).alias("longest"), F.min("node").alias("low1"), F.count(F.lit(1)).alias("n"))
    x = join_even(x, c, "k").withColumn("fits", F.startswith("longest", F.col("mid")))
    c = x.groupBy("k").agg(F.bool_and("fits").alias("ok"), F.min("node").alias("low1"), F.count(F.lit(1)).alias("n"))
    g = c.groupBy(*[F.col(f"k.{p}").alias(p) for p in PAIR]).agg((F.bool_and("ok") & (F.count_if(F.col("k.m1") != "") <= 1)).alias("one"), F.min("low1").alias("low"))
    both = c.select("k", "n", "ok", "low1", *[F.col(f"k.{p}").alias(p) for p in PAIR]).join(g, PAIR).select("k", "n", "ok", "low1", "one", "low")
    x = join_even(x.drop("low1", "longest", "fits"), both, "k")
    low = F.when(F.col("one"), F.col("low")).when((F.col("m1") != "") & F.col("ok"), F.col("low1")).otherwise(F.col("node"))
    several = F.col("given").isin(*[n for n, v in NICKNAMES.items() if " " in v])
    loose = F.when(F.col("fi") == "#", False).otherwise((F.col("given") == "") | several | (~F.col("one") & (F.col("m1") == "")))
    return x.select("node", *PAIR, "mid", "whole", "common", "m1", low.alias("low"), loose.alias("loose"))


def _typing_edges(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a, b)``: labels of profiles one typing error apart, or apart by a particle written together with the surname."""
    glued = F.regexp_replace("sur", "^(?:vander|vanden|van|vonder|von|dela|della|del|de|di|du|d)(?=.{4})", "")
    by_sur = F.array_union(F.array_union(deletion_keys(F.col("sur")), deletion_keys(F.col("whole"))), F.array(glued))
    by_given = F.when(F.col("fi") != "#", deletion_keys(F.col("given"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.transform(by_given, lambda k: F.concat(F.lit("g|"), F.col("sur"), F.lit("|"), k)), F.transform(by_sur, lambda k: F.concat(F.lit("s|"), F.col("given"), F.lit("|"), k)))
    n = nodes.where("given <> '' AND NOT loose").join(labels, "node")
    forms = n.groupBy(*PAIR, "whole").agg(F.bool_or("common").alias("common")).withColumn("glued", glued)
    keyed = forms.select(F.explode(keys).alias("key"), F.struct(*PAIR, "whole", "glued", "common").alias("x"))
    pairs = keyed.withColumnRenamed("x", "l").join(keyed.withColumnRenamed("x", "r"), "key").where(F.struct("l.sur", "l.given", "l.whole") < F.struct("r.sur", "r.given", "r.whole"))
    same_given = (F.col("l.given") == F.col("r.given")) & (
        one_error(F.col("l.sur"), F.col("r.sur")) | one_error(F.col("l.whole"), F.col("r.whole")) | (F.col("l.glued") == F.col("r.sur")) | (F.col("l.sur") == F.col("r.glued"))
    )
    # Two given names that are both common are two names, however near.
    same_sur = (F.col("l.sur") == F.col("r.sur")) & one_error(F.col("l.given"), F.col("r.given")) & ~(F.col("l.common") & F.col("r.common"))
    apart = (F.col("l.sur") != F.col("r.sur")) | (F.col("l.given") != F.col("r.given"))
    near = pairs.where(apart & (same_given | same_sur)).select(F.struct("l.sur", "l.given").alias("p"), F.struct("r.sur", "r.given").alias("q")).distinct()
    # A pair that has become one profile meets others whatever their initials, several are met by their first middle initial.
    own = n.groupBy(F.struct("sur", "given").alias("p"), "label", "m1").agg(F.max_by("mid", F.struct(F.length("mid"), "mid")).alias("mid"))
    one = own.groupBy("p").agg((F.min("label") == F.max("label")).alias("one"))
    own = own.join(one, "p")
    whole = own.where("one").groupBy("p", "label").agg(F.max_by("mid", F.struct(F.length("mid"), "mid")).alias("mid")).withColumn("by", F.lit("*"))
    people = whole.unionByName(own.where("m1 <> ''").select("p", "label", "mid", F.col("m1").alias("by")))
    left = near.join(people, "p").select("q", "by", F.col("label").alias("a"), F.col("mid").alias("mid_a"))
    met = left.join(people.select(F.col("p").alias("q"), "by", F.col("label").alias("b"), "mid"), ["q", "by"])
    return met.where(_mids_fit(F.col("mid_a"), F.col("mid"))).where("a <> b").select("a", "b").distinct()


def _loose_edges(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a, b)``: the label of each loose node and the one profile of its surname that fits it.

    Two that fit are none, unless only one of them bears the node's own middle
    initial. A surname with a single error will do where no profile has the very one.
    """
    n = nodes.join(labels, "node")
    longest = F.max_by("mid", F.struct(F.length("mid"), "mid"))
    profiles = n.where("given <> '' AND fi <> '#' AND NOT loose").groupBy("label").agg(longest.alias("pmid"), F.collect_set(F.struct("sur", "fi", "given")).alias("forms"))
    profiles = profiles.select(F.col("label").alias("to"), "pmid", F.explode("forms").alias("f")).select("to", "pmid", F.col("f.sur").alias("psur"), "f.fi", F.col("f.given").alias("pgiven"), F.explode(deletion_keys(F.col("f.sur"))).alias("k"))
    several = F.create_map(*[F.lit(x) for n_, v in NICKNAMES.items() if " " in v for x in (n_, v)])
    means = F.split(F.coalesce(F.try_element_at(several, F.col("given")), F.col("given")), " ")
    mine = n.where("loose").withColumn("means", means).select("node", "label", "sur", "mid", "means", F.explode(F.array_distinct(F.transform("means", lambda g: F.when(g == "", F.col("fi")).otherwise(F.substring(g, 1, 1))))).alias("fi"))
    mine = mine.withColumn("k", F.explode(deletion_keys(F.col("sur"))))
    same = F.col("sur") == F.col("psur")
    named = F.array_contains("means", F.lit("")) | F.array_contains("means", F.col("pgiven"))
    hits = mine.join(profiles, ["k", "fi"]).where(named & (same | ((F.length("sur") >= 5) & one_error(F.col("sur"), F.col("psur")))))
    each = hits.groupBy("node", "label", "to").agg(
        F.max(same.cast("int")).alias("same"), F.max(_mids_fit(F.col("mid"), F.col("pmid")).cast("int")).alias("fits"), F.max(((F.col("mid") != "") & (F.col("pmid") != "")).cast("int")).alias("named")
    )

    def only(condition: str) -> Column:
        c = F.expr(f"fits = 1 AND {condition}")
        return F.when(F.count_if(c) == 1, F.min(F.when(c, F.col("to"))))

    exact = F.coalesce(only("same = 1"), only("same = 1 AND named = 1"))
    near = F.when(F.max("same") == 0, F.coalesce(only("true"), only("named = 1")))
    return each.groupBy("node", "label").agg(F.coalesce(exact, near).alias("b")).where("b IS NOT NULL AND label <> b").select(F.col("label").alias("a"), "b")


def resolve(names: DataFrame) -> DataFrame:
    """``(name_id, entity)``: the smallest node id of the entity each name belongs to.

    NULL, empty and letterless names belong to no entity and are left out. Equal
    names, should an id repeat, meet in one node. An empty table gives no rows.
    """
    names = names.select("name_id", "name")
    p = cut_lineage(parsed(names, given_lexicon(names)))
    nodes = p.groupBy(*PAIR, "mid", "whole").agg(F.min("name_id").alias("node"), F.bool_or("common").alias("common"))
    nodes = cut_lineage(_people(cut_lineage(nodes)))
    labels = cut_lineage(nodes.select("node", F.col("low").alias("label")))
    merged = True
    while merged:
        merged = False
        for edges in (_typing_edges, _loose_edges):
            fresh = cut_lineage(edges(nodes, labels))
            if fresh.isEmpty():
                continue
            # Whole profiles merge: labels are joined, not only the nodes that were matched.
            joined = components(fresh, labels.select(F.col("label").alias("node"), "label").distinct())
            labels = cut_lineage(labels.withColumnRenamed("label", "l").join(joined.select(F.col("node").alias("l"), "label"), "l").select("node", "label"))
            merged = True
    keyed = p.join(nodes.select("node", *PAIR, "mid", "whole"), [*PAIR, "mid", "whole"]).select("name_id", "node")
    return keyed.join(labels, "node").select("name_id", F.col("label").alias("entity"))


def entity_sizes(names: DataFrame) -> DataFrame:
    """``(name_id, entity, n_links)``: each name, its entity and how many other names that has."""
    r = resolve(names).persist(StorageLevel.MEMORY_AND_DISK)
    return join_even(r, r.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("n_links", F.col("n") - 1), "entity")


def variant_pairs(names: DataFrame) -> DataFrame:
    """``(name_id_a, name_id_b)``, a < b: each pair of names of one entity. All pairs of an entity are the result asked for."""
    r = resolve(names).persist(StorageLevel.MEMORY_AND_DISK)
    # Each left side of an entity is spread over salts, so that a large entity isn't one task's.
    salt = F.pmod(F.xxhash64("name_id"), F.lit(SALTS))
    a = r.select("entity", F.col("name_id").alias("name_id_a"), salt.alias("salt"))
    b = r.join(r.groupBy("entity").agg(F.collect_set(salt).alias("salts")), "entity").select("entity", F.col("name_id").alias("name_id_b"), F.explode("salts").alias("salt"))
    return a.join(b, ["entity", "salt"]).where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
