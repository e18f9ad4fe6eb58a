"""Problem 2: free-entered journal names mapped to the list they should come from.

All of it is SQL expressions and equality joins. Names are first brought to a
list of bare words: case, braces, quotes, articles, joining words, remarks in
brackets, volume, year and publisher notes don't count, and inverted titles
("Zoology, Annals of") are turned back. Then, on distinct names only:

1. equal words: a join on the word list, for full and short forms alike;
2. abbreviations: each word begins the listed word; a join on the first letters
   of all words, verified word by word;
3. typing errors: a partition-based pigeonhole join. Each listed name is cut
   into k+1 segments. A name within k edits keeps one segment whole, shifted by
   k places at most, so names join on (length, segment number, substring) and
   every candidate is verified with the built-in bounded levenshtein, over the
   whole name and word by word, or without blanks where an edit touched one. Short
   forms are cut and joined likewise. A word that the list itself knows is never taken
   for a misspelling of another one, so another form of title is another journal.

Names that match nothing are found by anti-join and get -1. The listed names are
the side that is cut and may be broadcast: a reference list doesn't grow with the
data, and past ``BROADCAST_ROWS`` rows the join shuffles instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.name_variants import deletion_keys, one_error
from refloom.operators.skew import join_even
from refloom.runtime import cut_lineage, spread

K = 4
BROADCAST_ROWS = 50_000
#: Words that carry no meaning in a title, in the languages seen.
JOINING = ("of", "in", "on", "for", "the", "and", "und", "u", "et", "de", "der", "a la")
#: Kinds of periodical; in an inverted title one of them stands last or first.
KINDS = ("journal", "international journal", "advances", "bulletin", "proceedings", "transactions", "annals", "archives", "letters", "reviews")


def bare_words(c: Column) -> Column:
    """The words of a journal name that carry its meaning, in the order of the plain title."""
    x = F.lower(c)
    x = F.regexp_replace(x, r"\\&|&amp;|&", " and ")
    x = F.regexp_replace(x, r"[{}\"“”„‘’`']|\p{Cf}", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.trim(x)
    kinds = "|".join(KINDS)
    # Inverted titles: "x, kind of", "x (kind of)", "kind: x".
    x = F.regexp_replace(x, rf"^(.*?)\s*[,(]\s*(?:the )?((?:{kinds})(?: (?:of|in|on|for))?)\s*\)?((?: [a-z])?)\s*[.,;]?$", "$2 $1$3")
    x = F.regexp_replace(x, rf"^((?:{kinds}))\s*:\s*", "$1 ")
    # Remarks behind the title.
    x = F.regexp_replace(x, r"\s*[\[(][^\])]*[\])]", " ")
    x = F.regexp_replace(x, r"\s+:\s.*$|\s+[-–—]\s.*$|\s*;.*$", "")
    x = F.regexp_replace(x, r",?\s*\b(?:vol|volume|no|nr|band|bd|issue)\b\.?\s*\d+.*$", "")
    x = F.regexp_replace(x, r"[\s,(]*\b(?:1[89]|20)\d\d\b\)?\s*$", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")
    words = F.filter(F.split(F.trim(x), " "), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*JOINING))


def listed(journals: DataFrame) -> DataFrame:
    """``(row_no, words, form)``: each listed journal once, by its best row, with the words of all its forms."""
    best = journals.where("full IS NOT NULL").groupBy("full").agg(F.max(F.struct("priority", "row_no"))["row_no"].alias("row_no"))
    j = journals.select("full", "short").join(best, "full")
    full = j.select("row_no", bare_words(F.col("full")).alias("words"), F.lit("full").alias("form"))
    short = j.where("short IS NOT NULL").select("row_no", bare_words(F.col("short")).alias("words"), F.lit("short").alias("form"))
    return full.unionByName(short).distinct().where(F.size("words") > 0)


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _segments(text: Column, k: int) -> Column:
    """k+1 segments of a text as structs (i, start, seg), sizes as even as can be."""
    n, parts = F.length(text), k + 1
    start = lambda i: F.floor(i * n / F.lit(parts)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.cast("int").alias("i"), text.substr(start(i) + 1, start(i + 1) - start(i)).alias("seg")))


def _probes(text: Column, k: int) -> Column:
    """For each length within k and each segment, the substrings of a text where the segment may stand."""
    n = F.length(text)

    def at(ln: Column, i: Column) -> Column:
        begin = F.floor(i * ln / F.lit(k + 1)).cast("int")
        size = F.floor((i + 1) * ln / F.lit(k + 1)).cast("int") - begin
        # At most i edits lie left of the first unbroken segment i and k-i right of it, which bounds its shift from either end.
        shift = n - ln
        low = F.greatest(F.lit(0), begin - i, begin + shift - (F.lit(k) - i))
        high = F.least(n - size, begin + i, begin + shift + (F.lit(k) - i))
        spots = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda p: F.struct(ln.alias("ln"), i.cast("int").alias("i"), text.substr(p + 1, size).alias("seg")))

    lengths = F.sequence(F.greatest(F.lit(1), n - F.lit(k)), n + F.lit(k))
    return F.array_distinct(F.flatten(F.flatten(F.transform(lengths, lambda ln: F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: at(ln, i))))))


def _near(q: Column, r: Column, known: Column, close: Column) -> Column:
    """Word by word: equal, or a misspelling that the list doesn't know itself.

    Where some listed word is a single error away it must be one of these (``close``
    holds "word|listed word"); else two edits may part the words, three in long ones.
    """

    def word(a: Column, b: Column) -> Column:
        slack = F.when(F.length(b) >= 9, 3).when(F.length(b) >= 4, 2).otherwise(0)
        has_close = F.exists(close, lambda c: F.startswith(c, F.concat(a, F.lit("|"))))
        meant = F.when(has_close, F.array_contains(close, F.concat_ws("|", a, b))).otherwise(F.levenshtein(a, b) <= slack)
        # A joining word may have run into its neighbour.
        glued = F.exists(F.array(*map(F.lit, JOINING)), lambda j: (a == F.concat(b, j)) | (a == F.concat(j, b)))
        return (a == b) | (~F.array_contains(known, a) & (meant | glued))

    return F.forall(F.zip_with(q, r, lambda a, b: word(a, b)), lambda x: x)


def _parted(q: Column, r: Column) -> Column:
    """Words that run together or are broken apart: without blanks the same letters, but for one that may be another."""
    a, b = F.array_join(q, ""), F.array_join(r, "")
    return (F.abs(F.size(q) - F.size(r)) == 1) & (F.length(a) == F.length(b)) & (F.levenshtein(a, b) <= 1)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def match_names(names: DataFrame, journals: DataFrame, k: int = K) -> DataFrame:
    """``(name, row_no)`` of the distinct non-blank names in ``name`` that mean a listed journal.

    Among candidates the fewest edits win, then the smallest row number; exact
    words come before abbreviations and those before misspellings. Names of an
    empty list match nothing.
    """
    refs = cut_lineage(listed(journals))
    n_refs = refs.count()
    q = names.select("name", bare_words(F.col("name")).alias("qw")).where(F.size("qw") > 0).withColumn("qt", _text(F.col("qw")))
    q = cut_lineage(q)
    texts = cut_lineage(q.select("qt", "qw").distinct())

    exact = texts.join(_maybe_broadcast(refs.select(_text(F.col("words")).alias("qt"), "row_no", "form"), n_refs), "qt")
    exact = cut_lineage(exact.groupBy("qt").agg(F.max_by("row_no", F.struct(F.when(F.col("form") == "full", 1).otherwise(0), "row_no")).alias("row_no")))

    left = texts.join(exact, "qt", "left_anti").withColumn("key", _initials(F.col("qw")))
    full = refs.where("form = 'full'").select("row_no", F.col("words").alias("rw"), _text(F.col("words")).alias("rt"))
    begun = F.forall(F.zip_with("qw", "rw", lambda a, b: F.startswith(b, a)), lambda x: x)
    short = left.join(_maybe_broadcast(full.withColumn("key", _initials(F.col("rw"))), n_refs), "key").where((F.size("qw") == F.size("rw")) & begun)
    # Left-over letters decide between journals that an abbreviation may mean.
    short = cut_lineage(short.groupBy("qt").agg(F.min_by("row_no", F.struct(F.length("rt"), "row_no")).alias("row_no")))

    # Short forms are cut like full names; in these few letters a single edit or swap is all that may part them.
    short_forms = refs.where("form = 'short'").select("row_no", F.col("words").alias("rw"), _text(F.col("words")).alias("rt"))
    forms = full.withColumn("most", F.lit(k)).unionByName(short_forms.withColumn("most", F.lit(1)))
    cut = forms.select("row_no", "rw", "rt", "most", F.length("rt").alias("ln"), F.explode(_segments(F.col("rt"), k)).alias("s")).select("row_no", "rw", "rt", "most", "ln", "s.i", "s.seg")
    open_names = cut_lineage(texts.join(exact, "qt", "left_anti").join(short, "qt", "left_anti"))
    vocabulary = forms.select(F.explode("rw").alias("w")).distinct()
    used = open_names.select("qt", F.explode("qw").alias("w")).distinct()
    # Listed words a single error away, by equality of deletion keys.
    v = vocabulary.where(F.length("w") >= 4).select(F.col("w").alias("listed"), F.explode(deletion_keys(F.col("w"))).alias("k"))
    strange = used.select("w").distinct().where(F.length("w") >= 4).join(_maybe_broadcast(vocabulary, n_refs), "w", "left_anti")
    close = strange.select("w", F.explode(deletion_keys(F.col("w"))).alias("k")).join(_maybe_broadcast(v, 20 * n_refs), "k").where(one_error(F.col("w"), F.col("listed")))
    close = close.groupBy("w").agg(F.collect_set(F.concat_ws("|", "w", "listed")).alias("c"))
    notes = used.join(_maybe_broadcast(vocabulary.withColumn("in_list", F.lit(True)), n_refs), "w", "left").join(close, "w", "left")
    notes = notes.groupBy("qt").agg(F.collect_set(F.when(F.col("in_list"), F.col("w"))).alias("own"), F.flatten(F.collect_list("c")).alias("close"))
    open_names = cut_lineage(open_names.join(notes, "qt"))
    # Few bytes, but much work: over all cores.
    probes = spread(open_names.select("qt")).select("qt", F.explode(_probes(F.col("qt"), k)).alias("p")).select("qt", "p.ln", "p.i", "p.seg")
    pairs = probes.join(_maybe_broadcast(cut.select("ln", "i", "seg", "row_no", "rt", "most"), n_refs * (k + 1)), ["ln", "i", "seg"]).withColumn("d", F.levenshtein("qt", "rt", k)).where((F.col("d") >= 0) & ((F.col("d") <= F.col("most")) | ((F.col("d") == 2) & one_error(F.col("qt"), F.col("rt")))))
    near = pairs.select("qt", "row_no", "rt", "most", "d").distinct().join(open_names, "qt").join(_maybe_broadcast(forms.select("row_no", "rt", "rw"), n_refs), ["row_no", "rt"])
    by_word = (F.size("qw") == F.size("rw")) & _near(F.col("qw"), F.col("rw"), F.col("own"), F.col("close"))
    near = near.where(by_word | _parted(F.col("qw"), F.col("rw")))
    # A full name comes before a short form, so that of equal edits the longer text decides.
    near = cut_lineage(near.groupBy("qt").agg(F.min_by("row_no", F.struct("d", -F.col("most"), "row_no")).alias("row_no")))
    found = exact.unionByName(short).unionByName(near)
    return q.select("name", "qt").join(found, "qt").select("name", "row_no")


def journal_of(entries: DataFrame) -> DataFrame:
    """``(entry_id, name)`` of the entries with a non-blank journal."""
    hits = F.array_sort(F.filter(F.map_keys("fields"), lambda k: F.lower(F.trim(k)) == "journal"))
    value = F.when(F.size(hits) > 0, F.element_at("fields", F.element_at(hits, 1)))
    return entries.where("fields IS NOT NULL").select("entry_id", value.alias("name")).where(F.length(F.regexp_replace("name", r"(?U)\s+", "")) > 0)


def map_journals(entries: DataFrame, journals: DataFrame, k: int = K) -> DataFrame:
    """``(entry_id, row_no)`` of the entries whose journal isn't written as listed; -1 if no listed journal is meant.

    NULL and blank journals are no cases; repeated rows come out repeated; an
    empty list leaves all unmatched.
    """
    e = journal_of(entries)
    forms = journals.select(F.explode(F.array("full", "short")).alias("name")).where("name IS NOT NULL").distinct()
    free = e.join(_maybe_broadcast(forms, 2 * journals.count()), "name", "left_anti")
    names = cut_lineage(free.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    found = match_names(names.select("name"), journals, k)
    unmatched = names.join(found, "name", "left_anti").select("name", F.lit(-1).alias("row_no"))
    mapped = cut_lineage(names.join(found.unionByName(unmatched), "name"))
    return join_even(free, mapped, "name").select("entry_id", F.col("row_no").cast("int").alias("row_no"))
