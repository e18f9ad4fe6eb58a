"""Problem 6: several values packed in one field.

A field is cut at delimiters, but not at those inside legitimate values. Which
values are legitimate is learned from the data: pieces that quotes, braces or
unambiguous delimiters set apart are counted over all rows, and the frequent
ones become a dictionary. A multi-pattern automaton finds its entries in a
field; dynamic programming then picks the most likely cover of the field by
pieces, known ones at their frequency, unknown ones by their shape.

Pieces with two occurrences or more are known. Those with a share of e^-11 of all
or more, at most e^11 in number whatever the data's size, are sent to all workers.
A rarer one only matters where its shape alone would cost it (a delimiter inside, a
single word for a name): no other can score above an unknown piece. These are
joined to the values they stand in, on the word before their first delimiter, and
travel with the rows. So a value's pieces don't depend on which way they came.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.runtime import cut_lineage, spread

#: No more pieces than this can have a share that outweighs UNKNOWN.
DICTIONARY = 59_875
#: Up to so many rare pieces, or values with some in them, are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000
FIELDS = ("author", "keywords")
#: An unknown piece spans so many cuts at most, as each costs it CROSSED; known ones have no such bound.
NEAR = 6
UNKNOWN, MALFORMED, CROSSED = -11.0, -30.0, -20.0

#: Delimiters outside quotes and braces; the word between names and the sign for it need blanks around them.
_DELIMITER = re.compile(r"[;|\n\t\r,/]|(?<=\s)[&\u00b7\u2022](?=\s)|(?<=\s)(?:and|AND|And)(?=\s|$)|^(?:and|AND)(?=\s)")
_CLOSING = re.compile(r"[\s,;/|&]*(?:(?:\b(?:and|AND|And)\b|&)\s*)?\b(?:others|et\s*\.?\s*al\b\.?|u\.\s*a\.)[\s.,;]*$", re.IGNORECASE)
_INITIAL = re.compile(r"^(?:[^\W\d_]\.?-?)+$|^(?:[^\W\d_]\.)+$")
_PARTICLES = frozenset("van von der den de la le di da du del ten ter zu zur af al el bin ibn st st.".split())
_ORG_PHRASE = re.compile(r"([^\W\d_][\w'’.\-]*)\s+(?:and|&)\s+([^\W\d_][\w'’\-]*)")


def normal(piece: str) -> str:
    """A piece as the dictionary knows it."""
    return " ".join(piece.lower().split())


def unwrap(piece: str) -> str:
    """A piece without outer blanks and without the quotes or braces around all of it."""
    piece = piece.strip()
    while len(piece) > 1:
        if piece[0] == piece[-1] == '"' and '"' not in piece[1:-1]:
            piece = piece[1:-1].strip()
        elif piece[0] == "{" and _closes(piece) == len(piece) - 1:
            piece = piece[1:-1].strip()
        else:
            break
    return piece


def _closes(text: str) -> int:
    """Where the brace that opens the text closes, or -1."""
    depth = 0
    for m in re.finditer(r"[{}]", text):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


def _pairs(text: str) -> dict[int, int]:
    """Each brace that closes, and where; one pass, however the braces nest."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _guarded(text: str) -> list[tuple[int, int]]:
    """Stretches inside quotes and braces. A quote counts only at the start of a piece; what never closes guards nothing."""
    out, i, fresh = [], 0, True
    if "{" not in text and '"' not in text:
        return out
    braces, last_quote = _pairs(text), text.rfind('"')
    while i < len(text):
        c = text[i]
        end = -1
        if c == "{":
            end = braces.get(i, -1)
        elif c == '"' and fresh and i < last_quote:
            end = text.find('"', i + 1)
        if end > i:
            out.append((i, end))
            i, fresh = end + 1, False
            continue
        if not c.isspace():
            fresh = c in ",;|/&" or text[max(0, i - 3) : i + 1].lower() == " and"
        i += 1
    return out


def _short(token: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d_]\.?(?:-?[^\W\d_]\.)*", token))


def _tokens(part: str) -> list[str]:
    return [t for t in part.split() if t]


def full_name(part: str) -> bool:
    """Two parts of a name at least, one of them more than an initial: "Ada M. Byron", "Byron AM"."""
    ts = _tokens(part)
    solid = [t for t in ts if not _short(t) and t.lower() not in _PARTICLES]
    return len(solid) >= 2 or (len(solid) == 1 and len(ts) >= 2 and _short(ts[0]))


def given_names(part: str) -> bool:
    """A given name with initials, or initials alone."""
    ts = _tokens(part)
    return 0 < len(ts) <= 4 and sum(not _short(t) for t in ts) <= 1


def last_name(part: str) -> bool:
    ts = _tokens(part)
    return bool(ts) and sum(t.lower() not in _PARTICLES for t in ts) == 1 and not _short(ts[-1])


def plausible(value: str, field: str) -> bool:
    """Whether a counted piece can be one value: lists that could not be told apart were counted too."""
    if any(c in value for c in '"{}') or value[0] in ",&/" or value[-1] in ",&/" or re.search(r"^and\b|\band$|\bet al\b|\bothers$", value):
        return False
    if field != "author" or re.search(r"\bof\b", value):
        return True
    left, comma, right = value.partition(",")
    return not comma or ("," not in right and not (full_name(left) and full_name(right)))


def _sheltered(piece: str, field: str) -> bool:
    """Whether a known piece has delimiters to protect. Of names only those with a joining word inside do; their commas are told by shape."""
    return bool(re.search(r"\s(?:and|&)\s" if field == "author" else _DELIMITER.pattern, piece))


class Segmenter:
    """Cuts fields with the help of a dictionary of known values; ``totals`` are the occurrences of all known pieces by field."""

    def __init__(self, counts: dict[str, dict[str, int]], phrases: set[str] = frozenset(), totals: dict[str, int] | None = None):
        import ahocorasick

        counts = {f: {v: n for v, n in c.items() if plausible(v, f)} for f, c in counts.items()}
        self.counts, self.phrases = counts, phrases
        self.total = {f: max(1, (totals or {}).get(f, sum(c.values()))) for f, c in counts.items()} | {f: max(1, n) for f, n in (totals or {}).items()}
        self.rare: dict[str, int] = {}
        self.automata = {}
        for f, c in counts.items():
            a = ahocorasick.Automaton()
            for v in [v for v in c if _sheltered(v, f)] + (list(phrases) if f == "author" else []):
                a.add_word(v, v)
            if len(a):
                a.make_automaton()
                self.automata[f] = a

    def protected(self, text: str, field: str) -> list[tuple[int, int]]:
        """Where known values with delimiters inside stand, at word ends only."""
        a = self.automata.get(field)
        low = text.lower()
        if len(low) != len(text):
            return []
        out = []
        spots = [(end, v) for end, v in a.iter(low)] if a is not None else []
        for v, n in self.rare.items():
            if not n or _sheltered(v, field):
                spots += [(m.end() - 1, v) for m in re.finditer(re.escape(v), low)]
        for end, v in spots:
            start = end - len(v) + 1
            if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                out.append((start, end + 1))
        return out

    def _score(self, field: str, piece: str, crossed: list[str], shielded: list[bool], wrapped: bool) -> float:
        if not piece:
            return 0.0
        if crossed and not wrapped and re.search(r'["{}]', piece):
            return UNKNOWN + CROSSED * len(crossed)
        own = normal(unwrap(piece))
        n = self.counts.get(field, {}).get(own, 0) or self.rare.get(own, 0)
        known = math.log((n + 0.1) / self.total.get(field, 1)) if n else None
        if field == "author":
            shape = self._author_shape(piece, crossed, shielded, wrapped)
        else:
            # Slash, ampersand and "and" belong to a term unless blanks part them; all else cuts.
            shape = UNKNOWN + sum(0.0 if d in ("and", "&", "in/") else CROSSED for d, s in zip(crossed, shielded) if not s)
        return max(known, shape) if known is not None else shape

    def _author_shape(self, piece: str, crossed: list[str], shielded: list[bool], wrapped: bool) -> float:
        if wrapped:
            return UNKNOWN
        hard = sum(1 for d, s in zip(crossed, shielded) if d != "," and not s)
        commas = sum(1 for d in crossed if d == ",")
        if hard:
            return UNKNOWN + (hard + commas) * CROSSED
        if any(shielded) or re.search(r"\bof\b", piece):
            return UNKNOWN + (0.0 if commas <= 1 else CROSSED)
        if commas == 0:
            return UNKNOWN if full_name(piece) else UNKNOWN - 6.0
        if commas > 1:
            return UNKNOWN + CROSSED * commas
        left, _, right = piece.partition(",")
        if last_name(left) and given_names(right):
            return UNKNOWN
        if full_name(left) and full_name(right):
            return MALFORMED
        return UNKNOWN - 4.0

    def split(self, text: str | None, field: str, rare: dict[str, int] | None = None) -> list[str]:
        """The values of a field in order. NULL and blank fields hold none; empty pieces and closing marks are none.

        ``rare`` holds known pieces beyond the dictionary and their counts, 0 for a phrase.
        """
        self.rare = {v: n for v, n in (rare or {}).items() if not n or plausible(v, field)}
        if not text or not text.strip():
            return []
        if field == "author":
            # A closing mark is short, so only the end is searched for it.
            text = text.rstrip()
            text = text[:-60] + _CLOSING.sub("", text[-60:])
        guards = _guarded(text)
        starts = [g[0] for g in guards]
        cuts: list[tuple[int, int, str]] = []
        at = 0
        while m := _DELIMITER.search(text, at):
            g = bisect.bisect_right(starts, m.start()) - 1
            if g >= 0 and m.start() <= guards[g][1]:
                at = guards[g][1] + 1
                continue
            at = m.end()
            kind = {"and": "and", "&": "&", ",": ","}.get(m[0].lower(), "hard")
            if m[0] == "/" and field != "author" and not (text[m.start() - 1 : m.start()].isspace() or text[at : at + 1].isspace()):
                kind = "in/"
            cuts.append((m.start(), at, kind))
        if not cuts:
            one = unwrap(text)
            return [one] if any(c.isalnum() for c in one) else []
        # Of the protected stretches that begin before a cut, the one that reaches farthest decides.
        safe = sorted(self.protected(text, field))
        begins, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
        shields = [(k := bisect.bisect_right(begins, s) - 1) >= 0 and reach[k] >= e for s, e, _ in cuts]
        edges = [(0, 0), *[(s, e) for s, e, _ in cuts], (len(text), len(text))]
        # A known value may reach over any number of cuts: from the last edge before it to the first one behind it.
        far: dict[int, set[int]] = {}
        ends, heads = [e for _, e in edges], [s for s, _ in edges]
        for a, b in safe:
            i, j = bisect.bisect_right(ends, a) - 1, bisect.bisect_left(heads, b, lo=1)
            if 0 <= i < j < len(edges) and j - i > NEAR:
                far.setdefault(j, set()).add(i)
        best: list[float] = [0.0]
        back: list[int] = [0]
        for j in range(1, len(edges)):
            top, arg = -math.inf, j - 1
            for i in (*range(j - 1, max(-1, j - NEAR - 1), -1), *sorted(far.get(j, ()), reverse=True)):
                piece = text[edges[i][1] : edges[j][0]].strip()
                kinds = [cuts[k][2] for k in range(i, j - 1)]
                held = [shields[k] for k in range(i, j - 1)]
                wrapped = bool(piece) and unwrap(piece) != piece
                value = best[i] + self._score(field, piece, kinds, held, wrapped)
                if field == "keywords" and j < len(edges) - 1 and cuts[j - 1][2] in ("and", "&", "in/"):
                    value += UNKNOWN / 2  # cutting there needs known values on both sides
                if value > top:
                    top, arg = value, i
            best.append(top)
            back.append(arg)
        out, j = [], len(edges) - 1
        while j > 0:
            i = back[j]
            out.append(unwrap(text[edges[i][1] : edges[j][0]]))
            j = i
        return [v for v in reversed(out) if v and any(c.isalnum() for c in v)]


def field_values(entries: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(entry_id, field, v)`` of the named fields, whatever the case of their names."""
    pairs = F.explode(F.filter(F.map_entries("fields"), lambda e: F.lower(F.trim(e["key"])).isin(*names)))
    return entries.where("fields IS NOT NULL").select("entry_id", pairs.alias("e")).select("entry_id", F.lower(F.trim("e.key")).alias("field"), F.col("e.value").alias("v")).where(F.trim("v") != "")


_WRAPPED = r'(?:\{([^{}]+)\}|"([^"]+)")'


def _pieces(v: Column, field: Column) -> Column:
    """Pieces that can be told without a dictionary: wrapped ones, and those between plain delimiters."""
    braced = F.regexp_extract_all(v, F.lit(r"\{([^{}]+)\}"), F.lit(1))
    quoted = F.regexp_extract_all(v, F.lit(r'"([^"]+)"'), F.lit(1))
    rest = F.regexp_replace(v, _WRAPPED, ";")
    names = F.split(rest, r"(?iU)[;|\n\t]|\s/\s|\s&\s|\sand\s")
    terms = F.split(rest, r"(?U)[;|\n\t,]|\s/\s|\s·\s")
    return F.concat(braced, quoted, F.when(field == "author", names).otherwise(terms))


def _tidy(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def known_pieces(values: DataFrame) -> DataFrame:
    """``(field, p, n, phrase)`` of the pieces with two occurrences or more, and of the phrases with a joining word inside wrapped names."""
    pieces = values.select("field", F.explode(_pieces(F.col("v"), F.col("field"))).alias("p")).select("field", _tidy(F.col("p")).alias("p"), F.lit(False).alias("phrase"))
    orgs = values.where("field = 'author'").select("field", F.explode(F.regexp_extract_all("v", F.lit(r"\{([^{}]+)\}"), F.lit(1))).alias("p"))
    phrases = orgs.select("field", _tidy(F.regexp_extract("p", r"(?U)(\w[\w'’.-]*\s+(?:and|&)\s+\w[\w'’-]*)", 1)).alias("p"), F.lit(True).alias("phrase"))
    return pieces.unionByName(phrases).where("p <> ''").groupBy("field", "p", "phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


#: A word and the delimiter behind it; and a word alone between delimiters.
_STEP = r"([^\s,;|/&{}\"]+)(?:\s*([,;|/·•])|\s+(and|&)\s)"
_ALONE = r"(?:^|[;,|/&]|\sand\s)\s*([^\s,;|/&{}\"]+)\s*(?=$|[;,|/&]|\sand\s)"


def _steps(text: Column) -> Column:
    """The words of a text before its delimiters, with the delimiter."""
    return F.transform(F.regexp_extract_all(text, F.lit(_STEP), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))


def _costly(piece: str, field: str) -> bool:
    """Whether a piece's shape alone would score it below an unknown value, so that knowing it matters."""
    if not plausible(piece, field):
        return False
    kinds = [m[0] for m in _DELIMITER.finditer(piece)]
    if field != "author":
        return any(k not in ("and", "&", "/") for k in kinds)
    return any(k != "," for k in kinds) or Segmenter._author_shape(None, piece, kinds, [False] * len(kinds), False) < UNKNOWN


def rare_in(values: DataFrame, rare: DataFrame) -> DataFrame:
    """``(field, v, rare)``: the values in which rare known pieces stand, and these as a map to their counts, 0 for a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(ph) or _costly(p, f) for f, p, ph in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    costly = rare.select("field", "p", "phrase", F.when(F.col("phrase"), 0).otherwise(F.col("n")).cast("long").alias("n"))
    costly = costly.mapInArrow(run, costly.schema).withColumn("s", _steps(F.col("p")))
    keyed = cut_lineage(costly.select("field", "p", "n", F.coalesce(F.try_element_at("s", F.lit(1)), F.concat(F.lit("="), "p")).alias("k")))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed
    low = F.regexp_replace(F.lower("v"), r"(?U)\s+", " ")
    alone = F.when(F.col("field") == "author", F.transform(F.regexp_extract_all(low, F.lit(_ALONE), F.lit(1)), lambda x: F.concat(F.lit("="), x))).otherwise(F.array().cast("array<string>"))
    probes = values.select("field", "v", F.explode(F.array_distinct(F.concat(_steps(low), alone))).alias("k"))
    hits = probes.join(keyed, ["field", "k"]).where(F.contains(low, F.col("p")))
    return hits.groupBy("field", "v").agg(F.map_from_entries(F.collect_set(F.struct("p", "n"))).alias("rare"))


def split_values(values: DataFrame, size: int = DICTIONARY, of: Column | None = None) -> DataFrame:
    """``(entry_id, field, vs, n)``: the values of each field in order, and how many; the dictionary is learned from all of ``values``, and those of ``of`` are split."""
    known = known_pieces(values).persist()
    totals = {r["field"]: r["n"] for r in known.where("NOT phrase").groupBy("field").agg(F.sum("n").alias("n")).collect()}
    least = math.ceil(sum(totals.values()) / size)
    counts: dict[str, dict[str, int]] = {}
    phrases: set[str] = set()
    for r in known.where(F.col("n") >= least).collect():
        if r["phrase"]:
            phrases.add(r["p"])
        else:
            counts.setdefault(r["field"], {})[r["p"]] = r["n"]
    values = values if of is None else values.where(of)
    rows = spread(values.select("entry_id", "field", "v"))
    if least > 2:
        found = cut_lineage(rare_in(values, known.where(F.col("n") < least)))
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        rows = rows.join(found, ["field", "v"], "left").select("entry_id", "field", "v", "rare")
    else:
        rows = rows.withColumn("rare", F.lit(None).cast("map<string,bigint>"))
    known.unpersist()
    shared = values.sparkSession.sparkContext.broadcast((counts, phrases, totals))
    made: list[Segmenter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Segmenter(*shared.value))
        seg = made[0]
        for batch in batches:
            fields, texts, rare = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = [seg.split(v, f, dict(r) if r else None) for f, v, r in zip(fields, texts, rare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["entry_id", "field", "vs"])

    schema = T.StructType([values.schema["entry_id"], T.StructField("field", T.StringType()), T.StructField("vs", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, schema).select("entry_id", "field", "vs", F.size("vs").alias("n"))


def unpack(entries: DataFrame, names: tuple[str, ...] = FIELDS, least: int = 1) -> DataFrame:
    """``(entry_id, field, pos, value)``: one row for each value of the named fields that hold ``least`` values or more.

    NULL and blank fields give no rows; repeated rows come out repeated; an
    empty table gives no rows. Very long fields are taken whole.
    """
    values = field_values(entries, names)
    several = F.col("v").rlike(r"(?iU)[,;|/\n\t\r·&•]|\sand\s") if least > 1 else F.lit(True)
    rows = split_values(values, of=several).where(F.col("n") >= least)
    return rows.select("entry_id", "field", F.posexplode("vs").alias("p", "value")).select("entry_id", "field", (F.col("p") + 1).alias("pos"), "value")
