"""Problem 1: text that was decoded with another encoding than it was written in.

Character n-gram counts of the whole corpus (orders 2 to 4, only grams with a
character beyond ASCII, as no chain changes any other) are the model. Words,
not values, are scored: corruption may touch a single word of a value, and a
word's verdict is reused wherever the word occurs.

For each word every chain of "encode as it was read, decode as it was written"
is tried, on the whole word and run by run, up to twice. A candidate's gain is
the difference of smoothed log-likelihoods. The likeliest candidate is accepted
if its gain passes a margin that is validated on all distinct clean words in
steady use, each scored without its own counts, as if it were a word never seen: the
smallest one at which at most ``max_false`` of them would be changed.

The counts are hashed into a table of fixed size (2^18 buckets for each order),
so what is sent to the workers doesn't grow with the data. Clean records are
those without any sign of wrong decoding: no control or replacement character,
no run that is valid UTF-8 when read back, no symbols between letters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.runtime import spread

BUCKETS = 1 << 18
ORDERS = (2, 3, 4)
#: A word is in steady use if it occurs so often; of rarer ones that look clean too many are cases themselves to validate anything.
STEADY = 5
#: The margin where the clean words are too few to validate a rate of ``max_false``: fewer than would show a single false one.
UNVALIDATED = 8.0
#: A pair of characters is known if it has this share of all pairs beyond ASCII, less than a single one of few: below it, in a full table, a count may be another pair's.
KNOWN_SHARE = 1 / (8 * BUCKETS)
#: Encodings as which bytes may have been read, and in which they may have been written.
READ_AS = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp866")
WRITTEN_IN = ("utf-8", "cp1252", "mac_roman", "cp437", "cp1250", "iso8859-2", "cp1251", "koi8-r", "shift_jis", "euc_jp")
_WIDE = re.compile(r"[^\x00-\x7f]")
#: Beyond the scripts that the encodings above were made for: no candidate may hold it.
_FOREIGN = re.compile(r"[^\x00-\x7e\xa0-\u024f\u02c6-\u02dd\u0370-\u052f\u2010-\u2044\u20ac\u2116\u2122\u2200-\u22ff\u3000-\u30ff\u3400-\u9fff\uff01-\uff9f]")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^ \t\r\n]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_BROKEN = re.compile("[\x80-\x9f\ufffd]")
_ODD = re.compile(r"[^\W\d_][^\w\s'.,:;()\[\]{}\"/|&+*!?%\-\xad‐-‟\u200b-\u200f\u202a-\u202e\u2060\ufeff]+[^\W\d_]")


@functools.cache
def _encode_table(name: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; unassigned bytes stand for the control of that number."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def _to_bytes(text: str, read_as: str) -> bytes | None:
    table = _encode_table(read_as)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _rewritten(text: str, read_as: str, written_in: str) -> str | None:
    raw = _to_bytes(text, read_as)
    if raw is None:
        return None
    try:
        out = raw.decode(written_in)
    except UnicodeDecodeError:
        return None
    return out if out != text and not _FOREIGN.search(out) else None


def _single(word: str) -> Iterator[tuple[str, str]]:
    """(chain, text) of each way to decode a word once more."""
    runs = _RUN.findall(word)
    for y in READ_AS:
        for x in WRITTEN_IN:
            if x == y:
                continue
            whole = _rewritten(word, y, x)
            if whole is not None:
                yield f"{y}>{x}", whole
            elif x == "utf-8" and word[-1] in "\xc2\xc3" and (late := _rewritten(word + "\xa0", y, x)):
                yield f"{y}>{x}", late  # the second byte was taken for a blank and lost
            elif x == "utf-8" and len(runs) > 0:
                done = [(_rewritten(r, y, x) or r) for r in runs]
                if done != runs:
                    it = iter(done)
                    yield f"{y}>{x}", _RUN.sub(lambda _: next(it), word)


def one_script(word: str) -> bool:
    """Whether each run of letters keeps to one script."""
    for part in _LETTERS.findall(word):
        if len({_script(c) for c in part} - {""}) > 1:
            return False
    return True


@functools.lru_cache(maxsize=1 << 14)
def _script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK"}.get(name, name) if name in ("LATIN", "GREEK", "CYRILLIC", "CJK", "HIRAGANA", "KATAKANA") else ""


def candidates(word: str) -> dict[str, str]:
    """Text to chain of all candidates of a word; a second round is tried on what UTF-8 gave."""
    out: dict[str, str] = {}
    for chain, text in _single(word):
        out.setdefault(text, chain)
    for text, chain in list(out.items()):
        if chain.endswith("utf-8") and _WIDE.search(text):
            for again, more in _single(text):
                if again.endswith("utf-8") or again.split(">")[0] in ("cp1252", "latin-1"):
                    out.setdefault(more, f"{chain},{again}")
    return {text: chain for text, chain in out.items() if one_script(text)}


#: Cyrillic and Greek letters drawn like Latin ones.
LOOK_ALIKES = "аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικυαχ"


def only_disguised(word: str) -> bool:
    """Latin words in which all that is beyond ASCII are look-alike letters of other scripts: another problem's case."""
    wide = _WIDE.findall(word)
    return bool(re.search("[A-Za-z]", word)) and all(c in LOOK_ALIKES for c in wide)


def looks_clean(word: str) -> bool:
    """No sign of wrong decoding: only such words feed the model."""
    if _BROKEN.search(word) or _ODD.search(word):
        return False
    if not one_script(word):
        return False
    for y in ("latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "cp1250"):
        for run in _RUN.findall(word):
            if len(run) > 1 and _rewritten(run, y, "utf-8"):
                return False
    return True


def _grams(word: str, n: int) -> Iterator[str]:
    w = f"\x02{word}\x03"
    for i in range(len(w) - n + 1):
        g = w[i : i + n]
        if _WIDE.search(g):
            yield g


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


class Model:
    """Smoothed n-gram counts in a table of fixed size."""

    def __init__(self, counts: np.ndarray, margin: float = UNVALIDATED, priors: dict[str, float] | None = None):
        self.counts, self.margin, self.priors = counts, margin, priors or {}
        self.totals = np.maximum(counts.sum(axis=1), 1).astype(float)

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019
    def _log(self, gram: str) -> float:
        k = len(gram) - ORDERS[0]
        return float(np.log((self.counts[k, bucket(gram)] + 0.3) / (self.totals[k] + 1000.0)))

    def score(self, word: str) -> float:
        """Log-likelihood of a word's grams beyond ASCII, averaged over the orders."""
        return sum(self._log(g) for n in ORDERS for g in _grams(word, n)) / len(ORDERS)

    def known(self, text: str) -> bool:
        """Whether clean records hold most of a text's pairs beyond ASCII; what decodes to nonsense doesn't pass."""
        least = self.totals[0] * KNOWN_SHARE
        seen = [self.counts[0, bucket(g)] > least for g in _grams(text, 2)]
        return 2 * sum(seen) >= len(seen) if seen else True

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019
    def best(self, word: str) -> tuple[float, str, str]:
        """(gain, text, chain) of the likeliest candidate; no candidate gives the word itself and no gain."""
        top = (0.0, word, "")
        if only_disguised(word):
            return top
        base = self.score(word)
        for text, chain in candidates(word).items():
            if not self.known(text):
                continue
            gain = self.score(text) - base + self.priors.get(chain, self.priors.get("", 0.0))
            if gain > top[0]:
                top = (gain, text, chain)
        return top

    def wrong(self, word: str) -> bool:
        """Whether a word was decoded wrongly: it holds what no decoding gives, or a candidate passes the margin."""
        return bool(_BROKEN.search(word)) or self.best(word)[0] > self.margin

    def garbled(self, value: str | None) -> bool:
        """Whether any word of a value was decoded wrongly; NULL, empty and ASCII values weren't."""
        return bool(value) and any(self.wrong(w) for w in _WORD.findall(value) if _WIDE.search(w))

    def repaired(self, value: str | None) -> str | None:
        """The value with its wrongly decoded words as first written; what was lost (U+FFFD) stays lost."""
        if not value or not _WIDE.search(value):
            return value

        found = [self.best(w) for w in _WORD.findall(value) if _WIDE.search(w)]
        used = {chain for gain, _, chain in found if gain > self.margin}

        def word(m: re.Match) -> str:
            gain, text, chain = self.best(m[0]) if _WIDE.search(m[0]) else (0.0, m[0], "")
            # A weaker gain is enough for a chain that another word of the value needs.
            return text if gain > self.margin or chain in used else m[0]

        return _WORD.sub(word, value)


def wide_words(values: DataFrame) -> DataFrame:
    """``(word, n)`` of the words beyond ASCII in the column ``v``."""
    w = values.where(F.col("v").rlike(r"[^\x00-\x7F]")).select(F.explode(F.split("v", r"[ \t\r\n]+")).alias("word"))
    return w.where(F.col("word").rlike(r"[^\x00-\x7F]")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def gram_counts(words: DataFrame) -> np.ndarray:
    """Counts of the clean words' grams in a table of len(ORDERS) x BUCKETS, whatever the data's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ORDERS), BUCKETS), dtype=np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if looks_clean(word):
                    for k, order in enumerate(ORDERS):
                        for g in _grams(word, order):
                            counts[k, bucket(g)] += n
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["b", "c"])

    rows = words.mapInArrow(run, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(len(ORDERS) * BUCKETS, dtype=np.int64)
    counts[rows.column("b").to_numpy()] = rows.column("c").to_numpy()
    return counts.reshape(len(ORDERS), BUCKETS)


def chain_priors(words: DataFrame, model, strong: float = 12.0) -> dict[str, float]:
    """Log-priors of the chains from how many words each explains strongly; "" is any chain unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                gain, _, chain = model.value.best(word)
                if gain > strong:
                    seen[chain] = seen.get(chain, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chain", "n"])

    support = {r["chain"]: r["s"] for r in words.select("word").mapInArrow(run, "chain string, n long").groupBy("chain").agg(F.sum("n").alias("s")).collect()}
    total = max(1, sum(support.values()))
    return {k: float(np.log((n + 0.5) / total)) for k, n in support.items()} | {"": float(np.log(0.5 / total))}


def unseen_gain(model: Model, word: str, n: int) -> tuple[float, str]:
    """Gain and text of a word's likeliest candidate, as if its ``n`` occurrences had never been counted."""
    if not candidates(word) or only_disguised(word):
        return 0.0, word
    own = [(k, bucket(g)) for k, order in enumerate(ORDERS) for g in _grams(word, order)]
    for at in own:
        model.counts[at] -= n
    model._log.cache_clear()
    gain, text, _ = Model.best.__wrapped__(model, word)
    for at in own:
        model.counts[at] += n
    return gain, text


def validated_margin(words: DataFrame, model, max_false: float = 0.002) -> float:
    """The smallest margin at which at most ``max_false`` of all distinct clean words in steady use would change.

    Each word is scored without its own counts, as if it had never been seen. A
    word whose candidate is itself a far more frequent word is no evidence: it
    is most likely a case that looks clean. Gains reach the driver as a histogram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        own = Model(m.counts.copy(), priors=m.priors)
        for batch in batches:
            rows, idle = [], 0
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n >= STEADY and looks_clean(word):
                    gain, text = unseen_gain(own, word, n)
                    if gain > 0:
                        rows.append((text, n, gain))
                    else:
                        idle += 1
            rows.append((None, idle, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64()))], names=["word", "own", "gain"])

    scored = words.mapInArrow(run, "word string, own long, gain double")
    evidence = scored.join(words, "word", "left").where("word IS NULL OR n IS NULL OR n < 3 * own")
    bins = evidence.groupBy(F.ceil(F.col("gain") * 100).alias("b")).agg(F.sum(F.when(F.col("word").isNull(), F.col("own")).otherwise(1)).alias("c")).collect()
    total = sum(r["c"] for r in bins)
    if total * max_false < 1:
        return UNVALIDATED
    changed = 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        changed += r["c"]
        if changed > max_false * total:
            return r["b"] / 100
    return 0.0


def fit(values: DataFrame) -> Model:
    """The model of a column ``v`` of values: counts over all rows, priors and margin over all distinct words."""
    words = wide_words(values).persist(StorageLevel.MEMORY_AND_DISK)
    sc = values.sparkSession.sparkContext
    counts = gram_counts(words)
    model = Model(counts, priors=chain_priors(words, sc.broadcast(Model(counts))))
    model.margin = validated_margin(words, sc.broadcast(Model(counts, priors=model.priors)))
    words.unpersist()
    return model


def text_values(entries: DataFrame, names: tuple[str, ...] = ("author", "title")) -> DataFrame:
    """``(entry_id, field, v)`` of the named fields, blank ones left out."""
    pairs = F.explode(F.filter(F.map_entries("fields"), lambda e: F.lower(F.trim(e["key"])).isin(*names)))
    return entries.where("fields IS NOT NULL").select("entry_id", pairs.alias("e")).select("entry_id", F.lower(F.trim("e.key")).alias("field"), F.col("e.value").alias("v")).where(F.trim("v") != "")


def repair_values(values: DataFrame, model: Model, keys: tuple[str, ...] = ("entry_id", "field")) -> DataFrame:
    """``(keys, v, fixed)`` of the garbled values only. ``values`` holds the keys and ``v``; other columns are ignored."""
    shared = values.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("v").to_pylist()
            hit = [i for i, t in enumerate(texts) if m.garbled(t)]
            kept = batch.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([m.repaired(texts[i]) for i in hit], pa.string())], names=[*keys, "v", "fixed"])

    wide = spread(values.where(F.col("v").rlike(r"[^\x00-\x7F]")).select(*keys, "v"))
    return wide.mapInArrow(run, T.StructType([*wide.schema.fields, T.StructField("fixed", T.StringType())]))


def repair_entries(entries: DataFrame) -> DataFrame:
    """``(entry_id, field, v, fixed)`` of each garbled author or title.

    NULL, empty and ASCII values are never garbled; repeated rows come out
    repeated; an empty table gives no rows.
    """
    values = text_values(entries)
    return repair_values(values, fit(values.select("v")))


def restore_lost(repaired: DataFrame, values: DataFrame, keys: tuple[str, ...] = ("entry_id", "field")) -> DataFrame:
    """``repaired`` with words that lost characters (U+FFFD) put back as the corpus knows them.

    A broken word is matched, by equality of masks, with the clean words that have
    some character beyond ASCII where it has lost one; the most frequent wins, of
    equals the smallest. Words nothing matches stay as they are.
    """
    mask = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "\ufffd")
    lost = repaired.where(F.contains("fixed", F.lit("\ufffd"))).select(*keys, "v", "fixed").dropDuplicates([*keys, "fixed"])
    parts = lost.select(*keys, F.posexplode(F.split("fixed", " ")).alias("at", "word"))
    known = wide_words(values.where(~F.col("v").rlike("[\x80-\x9f\ufffd]"))).groupBy(mask(F.col("word")).alias("masked")).agg(F.max_by("word", F.struct("n", F.hash("word"))).alias("clean"))
    # A word of lost characters alone could be anything.
    broken = parts.where(F.contains("word", F.lit("\ufffd")) & F.col("word").rlike("[A-Za-z]")).select(F.col("word").alias("broken"), mask(F.col("word")).alias("masked")).distinct()
    fitting = F.expr("forall(sequence(1, length(broken)), i -> substr(broken, i, 1) = '\ufffd' OR substr(broken, i, 1) = substr(clean, i, 1))")
    found = broken.join(known, "masked").where(fitting).select(F.col("broken").alias("word"), "clean")
    whole = parts.join(found, "word", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("clean", "word").alias("w")))).alias("ws"))
    back = whole.select(*keys, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("restored"))
    return repaired.join(back, list(keys), "left").select(*keys, "v", F.coalesce("restored", "fixed").alias("fixed"))
