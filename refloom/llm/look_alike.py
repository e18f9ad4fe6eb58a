"""Problem 4: text that looks the same but differs in its characters.

A transducer with longest match over grapheme clusters rewrites widths, styled
letters, ligatures, blanks, invisible characters, combining accents and look-alike
letters in one pass. Its tables are computed once and checked: no key has two
results, and every result is stable. Widths, accents, blanks and what is invisible
come from the Unicode character data; look-alikes of Latin letters from the two
rows below and, for all other scripts, from the published confusables data that the
cluster's own libraries carry. As look-alikes depend on their word, there is one
table for each script that a word may be brought to, and a word picks its table
before it is rewritten: with letters that only its own script has it takes all its
look-alikes into that script; a word of look-alikes alone follows the text.

Left alone: texts that keep to Cyrillic, Greek or Japanese, single Greek
letters, typographic quotes and dashes, and values that were decoded wrongly.
"""

from __future__ import annotations

import functools
import re
import string
import sys
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm import mojibake
from refloom.runtime import spread

#: Pairs of letters drawn alike, other script first, then Latin.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅҮԌԚԜ", "aeopcyxijsdhqwABEKMHOPCTYXIJSYGQW"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικυαχγ", "ABEZHIKMNOPTYXovpikuaxy"))
INVISIBLE = {0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)}


@functools.cache
def build_table() -> dict[str, str]:
    """Cluster to consistent form, from the Unicode character data; raises on a conflict."""
    table: dict[str, str] = {}

    def add(key: str, value: str) -> None:
        if key == value:
            return
        if table.setdefault(key, value) != value:
            raise ValueError(f"two forms for {key!r}: {table[key]!r} and {value!r}")

    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if n in INVISIBLE:
            add(c, "")
        elif category == "Zs":
            add(c, " ")
        else:
            kind, _, rest = unicodedata.decomposition(c).partition(" ")
            if kind in ("<wide>", "<narrow>", "<font>") or (kind == "<compat>" and 0xFB00 <= n <= 0xFB06):
                plain = unicodedata.normalize("NFKC", c)
                if all(unicodedata.category(x)[0] in "LN" for x in plain):
                    add(c, plain)
            elif unicodedata.normalize("NFC", c) != c:
                add(c, unicodedata.normalize("NFC", c))
            else:
                base, *marks = unicodedata.normalize("NFD", c)
                if marks and len(marks) <= 3:
                    for order in set(permutations(marks)):
                        if unicodedata.normalize("NFC", base + "".join(order)) == c:
                            add(base + "".join(order), c)
                    head = unicodedata.normalize("NFC", base + "".join(marks[:-1]))
                    if len(marks) > 1 and len(head) == 1:
                        add(head + marks[-1], c)
    for key, value in table.items():
        if any(v in table for v in value) and value not in ("",):
            raise ValueError(f"{key!r} leads to {value!r}, which isn't stable")
    return table


#: Published look-alikes that are ordinary letters of living Latin alphabets, by code point.
ORDINARY = {0x131, 0x138, 0x18D, 0x196, 0x1A6, 0x1BD, 0x1C0, 0x263, 0x269, 0x26F, 0x28B}


@functools.cache
def published_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter to the ASCII letter it is drawn like, from the confusables data of the session's own libraries, for all scripts but Greek and Cyrillic."""
    letters = [chr(n) for n in range(0x80, 0x20000) if unicodedata.category(chr(n))[0] == "L" and not unicodedata.decomposition(chr(n)) and _script_of(chr(n)) in SCRIPTS and n not in ORDINARY]
    plain = string.ascii_letters
    checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    forms = checker.getSkeleton("\n".join([*letters, *plain])).split("\n")
    drawn: dict[tuple[str, bool], str] = {}
    for c, form in zip(plain, forms[len(letters) :]):
        drawn.setdefault((form, c.isupper()), c)
        drawn.setdefault((form, not c.isupper()), c)
    out = {c: drawn[form, c.isupper()] for c, form in zip(letters, forms) if (form, True) in drawn}
    # The capital of a listed small letter, where the data don't list it.
    return out | {c: out[c.lower()].upper() for c in letters if c not in out and c.isupper() and c.lower() in out}


#: Scripts whose published look-alikes are taken, by the first word of their letters' names.
SCRIPTS = ("LATIN", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")


@functools.lru_cache(maxsize=1 << 16)
def _script_of(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def _merged(table: dict[str, str], twins: dict[str, str]) -> dict[str, str]:
    """A table whose results are brought to one script, with the look-alikes as keys; raises on a conflict."""
    out = {k: "".join(twins.get(c, c) for c in v) for k, v in table.items()}
    for k, v in twins.items():
        if out.setdefault(k, v) != v:
            raise ValueError(f"two forms for {k!r}: {out[k]!r} and {v!r}")
    for k, v in out.items():
        if any(c in out for c in v):
            raise ValueError(f"{k!r} leads to {v!r}, which isn't stable")
    return out


class Transducer:
    """The tables as tries, "" for words as they are and one for each script a word may be brought to; each step takes the longest key."""

    def __init__(self, table: dict[str, str] | None = None, published: dict[str, str] | None = None):
        table = build_table() if table is None else table
        self.table, latin = table, CYRILLIC | GREEK | {k: v for k, v in (published or {}).items() if k not in table}
        self.twins = latin
        to = {"": {}, "L": latin}
        for script, own in (("C", CYRILLIC), ("G", GREEK)):
            # Latin letters, and what is drawn like them in a third script, become the script's own.
            back = {v: k for k, v in reversed(own.items())}
            to[script] = back | {k: back[v] for k, v in latin.items() if v in back and k not in own}
        self.tries = {script: self._trie(_merged(table, twins)) for script, twins in to.items()}
        # ASCII is only a key's start before a mark, so plain stretches are skipped by pattern.
        firsts = "".join(re.escape(c) for c in self.tries[""] if c and ord(c) > 0x7F)
        self._stop = re.compile(f"[{firsts}]|[^\x00-\x7f]|[A-Za-z](?=[\u0300-\u036f\u1dc4-\u1dff])")
        self._mixable = re.compile("[\u0370-\u052f\u1f00-\u1fff\U0001d6a8-\U0001d7cb" + "".join(re.escape(c) for c in (published or {})) + "]")
        self._kinds: dict[str, tuple[str, bool]] = {}

    @staticmethod
    def _trie(table: dict[str, str]) -> dict:
        trie: dict = {}
        for key, value in table.items():
            node = trie
            for c in key:
                node = node.setdefault(c, {})
            node[None] = value
        return trie

    def rewrite(self, text: str) -> str:
        """The consistent form of a text, left to right in one pass."""
        if not self._mixable.search(text):
            return self._walk(text, self.tries[""])
        home, out, at = None, [], 0
        for m in _UNIT.finditer(text):
            letters = [k for c in m[0] for x in self.table.get(c, c) if (k := self._kind(x))[0]]
            to = self._target(letters, None)
            if to is None:
                home = self._home(text) if home is None else home
                to = self._target(letters, home)
            if to:
                out += self._walk(text[at : m.start()], self.tries[""]), self._walk(m[0], self.tries[to])
                at = m.end()
        return "".join(out) + self._walk(text[at:], self.tries[""])

    def _walk(self, text: str, trie: dict) -> str:
        plain = trie is self.tries[""]
        out, at, n = [], 0, len(text)
        while at < n:
            if plain:
                stop = self._stop.search(text, at)
                if not stop:
                    break
                out.append(text[at : stop.start()])
                at = stop.start()
            i, node, best, end = at, trie, None, at
            while i < n and text[i] in node:
                node = node[text[i]]
                i += 1
                if None in node:
                    best, end = node[None], i
            if best is None:
                best, end = text[at], at + 1
            at = end
            # Marks beyond the longest key, or out of canonical order, belong to the same cluster.
            while at < n and best and unicodedata.combining(text[at]):
                best, at = unicodedata.normalize("NFC", best + text[at]), at + 1
            out.append(best)
        out.append(text[at:])
        return "".join(out)

    def _kind(self, c: str) -> tuple[str, bool]:
        """Script of a letter ("" for none), and whether it is drawn like one of another script or like a plain one."""
        kind = self._kinds.get(c)
        if kind is None:
            name = _script_of(c) if c.isalpha() else ""
            script = {"": "", "LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name, name if name in SCRIPTS else "-")
            kind = self._kinds[c] = (script, c in self.twins or (c.isascii() and c in _DRAWN))
        return kind

    def _home(self, text: str) -> str:
        """The script in which a text has most letters that no other script has; "" if it has none."""
        strong: dict[str, int] = {}
        for c in text:
            for x in self.table.get(c, c):
                script, twin = self._kind(x)
                if script and not twin:
                    strong[script] = strong.get(script, 0) + 1
        return max(("L", "C", "G", *SCRIPTS), key=lambda s: strong.get(s, 0)) if any(strong.values()) else ""

    def _target(self, letters: list[tuple[str, bool]], home: str | None) -> str | None:
        """The script to bring a word to, "" if it stays; None if the text must be asked for its home."""
        scripts = {k for k, _ in letters}
        own = {k for k, twin in letters if not twin}
        if scripts <= {"L", "-"}:
            return "L" if scripts else ""  # Latin throughout: only letters drawn like plain ones change
        if len(letters) == 1 and scripts == {"G"}:
            return ""  # a single Greek letter
        if len(own) > 1:
            # Words joined without a blank aside, this is no disguise of one script.
            own = {"L"} if "L" in own and own <= {"L", "-"} else own
            if len(own) > 1:
                return ""
        if own:
            to = next(iter(own))
            return "" if len(scripts) == 1 else to if to in self.tries else ""
        if home is None:
            return None
        if len(scripts) == 1 and (not home or home in scripts):
            return ""
        return (home or "L") if (home or "L") in self.tries else ""


_DRAWN = frozenset((CYRILLIC | GREEK).values())
_MARKS = "\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
#: A run of letters with their marks, and with what is invisible between them.
_UNIT = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[" + _MARKS + "".join(map(chr, sorted(INVISIBLE))) + "])*")
_TRANSDUCERS: dict[int, Transducer] = {}


def transducer(table: dict[str, str] | None = None, published: dict[str, str] | None = None) -> Transducer:
    """A transducer, made once in a process for the same look-alikes."""
    key = hash(frozenset((published or {}).items()))
    if key not in _TRANSDUCERS:
        _TRANSDUCERS[key] = Transducer(table, published)
    return _TRANSDUCERS[key]


def consistent(text: str | None, published: dict[str, str] | None = None) -> str | None:
    """The consistent form of a text. NULL and ASCII texts are their own form; idempotent."""
    if not text or text.isascii():
        return text
    return transducer(None, published).rewrite(text)


def plain_pattern(table: dict[str, str]) -> str:
    """A pattern of the texts that are in their form whatever their words: ASCII, Latin letters and punctuation that are no keys."""
    fine = [n for n in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2060), 0x20AC) if chr(n) not in table and n not in INVISIBLE and not unicodedata.combining(chr(n))]
    starts = [n for n in fine if n - 1 not in fine]
    ends = [n for n in fine if n + 1 not in fine]
    return r"^[\x00-\x7F" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]*$"


def unify(values: DataFrame, model: mojibake.Model | None = None, keys: tuple[str, ...] = ("entry_id", "field")) -> DataFrame:
    """``(keys, v, form)`` of the values that aren't in their consistent form.

    With a model, values decoded wrongly are no cases. An ID can't be such a case.
    Values of Latin letters and punctuation without a key among them don't leave generated code.
    """
    table, published = build_table(), published_look_alikes(values.sparkSession)
    shared = values.sparkSession.sparkContext.broadcast((model, table, published))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own, more = shared.value
        rewrite = transducer(own, more).rewrite
        for batch in batches:
            texts = batch.column("v").to_pylist()
            fields = batch.column("field").to_pylist() if "field" in keys else [None] * len(texts)
            forms = [rewrite(t) for t in texts]
            hit = [i for i, (t, f) in enumerate(zip(texts, forms)) if f != t and not (m and fields[i] != "ID" and m.garbled(t))]
            kept = batch.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([forms[i] for i in hit], pa.string())], names=[*keys, "v", "form"])

    skipped = plain_pattern({k: v for k, v in (table | published).items() if len(k) == 1})
    wide = spread(values.where(~F.col("v").rlike(skipped)).select(*keys, "v"))
    return wide.mapInArrow(run, T.StructType([*wide.schema.fields, T.StructField("form", T.StringType())]))


def unify_entries(entries: DataFrame) -> DataFrame:
    """``(entry_id, field, v, form)`` for ID, title and author.

    Blank and NULL values are in their form; an empty table gives no rows;
    repeated rows come out repeated.
    """
    texts = mojibake.text_values(entries)
    ids = entries.where("fields IS NOT NULL AND trim(key_raw) <> ''").select("entry_id", F.lit("ID").alias("field"), F.col("key_raw").alias("v"))
    return unify(texts.unionByName(ids), mojibake.fit(texts.select("v")))
