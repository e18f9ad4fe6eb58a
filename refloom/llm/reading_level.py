"""Problem 10: how demanding the spoken language of each document is.

A Rasch-style model with latent levels: in a document of level t, each sentence
holds word w with probability sigmoid(c_w + b_w t), where b_w says how strongly the
word marks demanding speech. Levels and word parameters are estimated in turn:

* levels: for fixed words the derivative of a document's likelihood is
  sum_w b_w k_dw - n_d G(t) with G(t) = sum_w b_w sigmoid(c_w + b_w t), a fixed
  increasing function, so each level comes from a table lookup and one sparse dot
  product, in parallel over documents;
* words: a word's likelihood needs the sum of its counts, the sum of its counts
  times level, and how many sentences there are in each small range of levels.
  These are summed over all documents in parallel; Newton steps follow.

A word that occurs four times or more has parameters of its own. Those with a share
of a HEAD-th of their language's words, HEAD of each at most, are numbered, and their
parameters travel between driver and workers; so this never grows with the corpus.
The rarer ones stay in tables: their counts and moments are sums by word, their share
of each document's dot product a join and a sum by document, their share of G a sum
over the table. A word is estimated alike whichever way it goes. Rated documents have
the mean of their ratings as prior level, others the language's mean; this fixes
the scale. Cut points from levels to ratings are fitted on rated documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.runtime import cut_lineage, spread

#: Frequent short words by which the corpus languages are told.
STOP_WORDS = {
    "en": "the and of to is that was you have for not with this are my we it what he she did about had how".split(),
    "de": "der die das und ist nicht ich du wir zu den mit ein eine dass auf war hat sich wo mein ihr dem".split(),
    "fr": "le la les des est et un une que pas je tu vous nous il elle dans pour de ne sur mon avec".split(),
    "es": "el la los las es y un una que no yo se de en con por mi su para lo del está muy".split(),
}
LANGUAGES = (*STOP_WORDS, "other")
#: No more words of a language than this can have a HEAD-th of all its words.
HEAD = 1 << 16
#: A word that occurs more rarely says nothing of a document's level.
LEAST = 4
GRID = np.linspace(-4.0, 4.0, 161)
ROUNDS = 6

_TIME = re.compile(r"-->|^\s*\{\d+\}\{\d+\}|^\s*\d{1,2}:\d\d:\d\d[.,:]\d+[ ,]+\d")
_COUNT = re.compile(r"^\s*\d+\s*$")
_TAG = re.compile(r"<[^<>]{0,80}>|\{\\[^{}]{0,40}\}|\{[yY]:[^{}]*\}|^\s*\{\d+\}\{\d+\}")
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*]{1,60}\*|[♪♫♬#][^♪♫♬#]*[♪♫♬#]|[♪♫♬]+")
_SPEAKER = re.compile(r"^\s*(?:[-–—>]+\s*)+|^\s*[^\W\d_a-z][^\W\d_a-z .'-]{0,20}:\s+")
_ADVERT = re.compile(
    r"https?://|\bwww\.|\S+@\S+\.\w+|\b[\w-]+\.(?:example|test|invalid|com|net|org|tv|info)\b|\bdot\s+(?:example|com|net|org|tv)\b|^\s*-=.*=-\s*$"
    r"|^\s*(?:subtitles?|captions?|captioned|subbed|synced|sync|resync(?:ed)?|ripped|encoded|translated|translation|transcribed|corrected|untertitel|sous-titres|subt[ií]tulos|traducci[oó]n|traduction)\b.{0,40}?(?:\bby\b|\bvon\b|\bpar\b|\bpor\b|:)"
    r"|^\s*r\s?i\s?p\s?p\s?e\s?d\s+b\s?y\b|\badvertise your (?:product|brand)|\bsupport us and become\b|\bwatch (?:it )?free at\b|\bdownload more at\b|^\s*(?:(?:\w )){4,}",
    re.IGNORECASE,
)
_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


_MARKS = re.compile(r"[\[(*♪♫♬#]")
#: What every alternative of the advert pattern but the spaced letters needs, in lower case.
_HINTS = ("://", "www", "@", ".", " dot ", "=-", " by", " von ", " par ", " por ", "advertise", "support us", "free at", "download", "r i p", ":")


def _may_advertise(line: str) -> bool:
    low = line.lower()
    if line[1:2] == " " and line[3:4] == " ":
        return True
    if "." in low and low.find(".") >= len(low) - 1 and not any(h in low for h in _HINTS if h != "."):
        return False
    return any(h in low for h in _HINTS)


def spoken(text: str | None) -> str:
    """What is said in a subtitle file: no times, numbers, tags, sound descriptions, speaker marks or adverts."""
    if not text:
        return ""
    out, cue = [], []

    def close() -> None:
        joined = " ".join(cue)
        if joined and not (_may_advertise(joined) and _ADVERT.search(joined)):
            out.append(joined)
        cue.clear()

    lines = text.lstrip("\ufeff").splitlines()
    last = len(lines) - 1
    for i, line in enumerate(lines):
        line = line.strip()
        if not line:
            close()
            continue
        first = line[0]
        # Each pattern is only tried on lines that hold a character it needs.
        if first.isdigit() or first == "{" or "-->" in line:
            if line.isdigit() and (i == last or "-->" in lines[i + 1] or not lines[i + 1].strip() or _TIME.search(lines[i + 1])):
                close()
                continue
            if "-->" in line:
                close()
                continue
            if _TIME.search(line):
                close()
                if first != "{":
                    continue
        elif first == "W" and line.startswith("WEBVTT") or line.startswith(("NOTE ", "STYLE")):
            continue
        if "<" in line or "{" in line:
            line = _TAG.sub("", line)
        if _may_advertise(line) and _ADVERT.search(line):
            continue
        if _MARKS.search(line):
            line = _SOUND.sub(" ", line)
        if ":" in line or line[:1] in "-–—>":
            line = _SPEAKER.sub("", line)
        line = line.strip()
        if line and (line[0].isalpha() or any(c.isalpha() for c in line)):
            cue.append(line)
    close()
    return "\n".join(out)


def language(words: Counter) -> str:
    """The language whose frequent words a text holds most; "other" for none."""
    scores = {lang: sum(words[w] for w in stop) for lang, stop in STOP_WORDS.items()}
    best = max(scores, key=lambda x: scores[x])
    return best if scores[best] > 0 else "other"


def features(text: str | None) -> tuple[int, int, float, list[str], list[int]] | None:
    """(language, sentences, mean word length, words, sentences with each word); None without spoken text."""
    said = spoken(text)
    if not said:
        return None
    sentences = [s for s in (_WORD.findall(x.lower()) for x in _END.split(said.replace("\n", " "))) if s]
    if not sentences:
        return None
    counts: Counter = Counter()
    for s in sentences:
        counts.update(set(s))
    n = sum(map(len, sentences))
    letters = sum(sum(map(len, s)) for s in sentences)
    size = len(sentences)
    return LANGUAGES.index(language(counts)), size, letters / n + 0.15 * n / size, list(counts), list(counts.values())


def extract(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, n, ease, w, k)`` of the documents with spoken text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = features(t)
                if row:
                    ids.append(i)
                    rows.append(row)
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[j] for r in rows], kinds[j]) for j in range(5)]], names=["doc_id", "lang", "n", "ease", "w", "k"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, lang int, n int, ease double, w array<string>, k array<int>")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(lang, w, n, total)``: how many sentences hold each word, and the sum of that over its language."""
    counted = docs.select("lang", F.explode(F.arrays_zip("w", "k")).alias("x")).groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.k").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST)


def numbered(docs: DataFrame, known: DataFrame, head: int = HEAD) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their frequent words by number, the rows ``(row, lang, w, k, n)`` of the rare ones, and how many numbers there are.

    ``row`` tells documents apart, should an id repeat.
    """
    frequent = F.col("n") * head >= F.col("total")
    tables: list[dict[str, int]] = [{} for _ in LANGUAGES]
    for r in known.where(frequent).select("lang", "w").orderBy("lang", "w").toLocalIterator():
        tables[r["lang"]][r["w"]] = len(tables[r["lang"]])
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            langs, ws, ks = (batch.column(at(c)).to_pylist() for c in ("lang", "w", "k"))
            cols: list[list] = [[], [], [], []]
            for lang, words, counts in zip(langs, ws, ks):
                own = shared.value[lang].get
                ids = [own(w, -1) for w in words]
                rare = [i for i, x in enumerate(ids) if x < 0]
                for c, v in zip(cols, ([x for x in ids if x >= 0], [k for x, k in zip(ids, counts) if x >= 0], [words[i] for i in rare], [counts[i] for i in rare])):
                    c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32())
            kept = [batch.column(at(c)) for c in ("row", "doc_id", "lang", "n", "ease", "rated")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.list_(t)) for c, t in zip(cols, kinds)]], names=["row", "doc_id", "lang", "n", "ease", "rated", "b", "k", "tw", "tk"])

    out = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, lang int, n int, ease double, rated double, b array<int>, k array<int>, tw array<string>, tk array<int>")
    out = cut_lineage(out)
    words = known.where(~frequent).select("lang", "w", F.col("n").alias("total"))
    tail = out.select("row", "lang", F.explode(F.arrays_zip("tw", "tk")).alias("x")).select("row", "lang", F.col("x.tw").alias("w"), F.col("x.tk").alias("k")).join(words, ["lang", "w"])
    return out.drop("tw", "tk"), cut_lineage(tail), max(1, *map(len, tables))


def slopes(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """G on the grid for some words."""
    return np.array([float((b / (1 + np.exp(-np.clip(c + b * t, -500, 500)))).sum()) for t in GRID])


class Words:
    """Parameters of the numbered words of all languages, and ``g``, the function G of each on the grid."""

    def __init__(self, c: np.ndarray, b: np.ndarray):
        self.c, self.b = c, b
        self.g = np.stack([slopes(c[x], b[x]) for x in range(len(LANGUAGES))])

    def levels(self, lang: np.ndarray, n: np.ndarray, dots: np.ndarray, prior: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Where dot - n G(t) - weight (t - prior) = 0 for each document; it falls in t, so the sign changes once."""
        slope = dots[:, None] - n[:, None] * self.g[lang] - weight[:, None] * (GRID[None, :] - prior[:, None])
        at = np.clip((slope > 0).sum(axis=1), 1, len(GRID) - 1)
        row = np.arange(len(at))
        hi, lo = slope[row, at], slope[row, at - 1]
        return GRID[at - 1] + (GRID[1] - GRID[0]) * np.clip(lo / np.where(lo == hi, 1, lo - hi), 0, 1)


def _columns(batch: pa.RecordBatch):
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    lang, n = get("lang").to_numpy(zero_copy_only=False), get("n").to_numpy(zero_copy_only=False).astype(float)
    ease = get("ease").to_numpy(zero_copy_only=False)
    rated, more = get("rated").to_numpy(zero_copy_only=False).astype(float), get("more").to_numpy(zero_copy_only=False)
    b, k = get("b"), get("k")
    offsets = np.asarray(b.offsets, dtype=np.int64)
    return lang, n, ease, rated, more, np.asarray(b.values)[offsets[0] : offsets[-1]], np.asarray(k.values)[offsets[0] : offsets[-1]].astype(float), offsets - offsets[0]


def _dots(weights: np.ndarray, lang: np.ndarray, b: np.ndarray, k: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    per = weights[np.repeat(lang, np.diff(offsets)), b] * k
    sums = np.concatenate([[0.0], np.cumsum(per)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _priors(rated: np.ndarray, tight: float) -> tuple[np.ndarray, np.ndarray]:
    known = ~np.isnan(rated)
    return np.where(known, rated - 2.5, 0.0), np.where(known, tight, 0.3)


def fit(docs: DataFrame, tail: DataFrame, width: int, rounds: int = ROUNDS, tight: float = 6.0) -> tuple[Words, np.ndarray, DataFrame]:
    """Word parameters, the cut points from levels to ratings by language, and the documents with ``more``, what rare words add to their dot products.

    ``docs`` and ``tail`` are as ``numbered`` gives them; ``rated`` is NULL where unknown.
    """
    sc = docs.sparkSession.sparkContext
    n_lang, n_bins = len(LANGUAGES), len(GRID)
    ease = {r["lang"]: (r["m"], r["s"] or 1.0) for r in docs.groupBy("lang").agg(F.avg("ease").alias("m"), F.stddev("ease").alias("s")).collect()}
    model: Words | None = None
    size = n_lang * width
    has_tail = not tail.isEmpty()
    plain = docs.withColumn("more", F.lit(0.0))
    docs = plain
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def levels(lang, n, easy, rated, more, b, k, offsets) -> np.ndarray:
            prior, weight = _priors(rated, tight)
            if shared.value is None:
                start = np.array([(e - ease[x][0]) / max(ease[x][1], 1e-9) for e, x in zip(easy, lang)])
                return np.where(np.isnan(rated), np.clip(start, -2, 2) * 0.8, prior)
            return shared.value.levels(lang, n, _dots(shared.value.b, lang, b, k, offsets) + more, prior, weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stats = np.zeros(2 * size + n_lang * n_bins)
            for batch in batches:
                if not batch.num_rows:
                    continue
                lang, n, easy, rated, more, b, k, offsets = _columns(batch)
                t = levels(lang, n, easy, rated, more, b, k, offsets)
                each = np.diff(offsets)
                at = np.repeat(lang, each).astype(np.int64) * width + b
                stats[:size] += np.bincount(at, weights=k, minlength=size)
                stats[size : 2 * size] += np.bincount(at, weights=k * np.repeat(t, each), minlength=size)
                near = np.clip(np.rint((t - GRID[0]) / (GRID[1] - GRID[0])), 0, n_bins - 1).astype(np.int64)
                stats[2 * size :] += np.bincount(lang.astype(np.int64) * n_bins + near, weights=n, minlength=n_lang * n_bins)
            at = np.flatnonzero(stats)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(stats[at])], names=["i", "v"])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = levels(*_columns(batch)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(t, pa.float64())], names=["row", "t"])

        rows = docs.select("lang", "n", "ease", "b", "k", "rated", "more").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        stats = np.zeros(2 * size + n_lang * n_bins)
        stats[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
        sentences = stats[2 * size :].reshape(n_lang, n_bins)
        new = _word_step(stats[:size].reshape(n_lang, width), stats[size : 2 * size].reshape(n_lang, width), sentences)
        if has_tail:
            at = docs.select("row", "lang", "n", "ease", "b", "k", "rated", "more").mapInArrow(placed, "row long, t double")
            sums = tail.join(at, "row").groupBy("lang", "w").agg(F.first("total").alias("count"), F.sum(F.col("k") * F.col("t")).alias("moment"))
            rare = cut_lineage(_rare_step(sums, sc.broadcast(sentences)))
            for r in rare.mapInArrow(_rare_slopes, "lang int, g array<double>").groupBy("lang").agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(n_bins)]).collect():
                new.g[r["lang"]] += np.array(r[1:])
            dots = tail.join(rare, ["lang", "w"]).groupBy("row").agg(F.sum(F.col("k") * F.col("b")).alias("more"))
            docs = cut_lineage(plain.drop("more").join(dots, "row", "left").fillna(0.0, ["more"]))
        model = new
    return model, _cut_points(docs, model), docs


def _newton(k: np.ndarray, m: np.ndarray, sentences: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps for (c, b) of words from their counts and moments, given how many sentences each range of levels has."""
    total = sentences.sum()
    cc, bb = np.log((k + 0.5) / np.maximum(total - k, 0.5)), np.zeros(len(k))
    bins = np.flatnonzero(sentences)
    t, w = GRID[bins][None, :], sentences[bins][None, :]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(cc[:, None] + bb[:, None] * t, -30, 30)))
        v = w * p * (1 - p)
        g0, g1 = k - (w * p).sum(1) - 1e-3 * cc, m - (w * p * t).sum(1) - ridge * bb
        h00, h01, h11 = v.sum(1) + 1e-3, (v * t).sum(1), (v * t * t).sum(1) + ridge
        det = np.maximum(h00 * h11 - h01 * h01, 1e-9)
        cc = np.clip(cc + np.clip((h11 * g0 - h01 * g1) / det, -2, 2), -14, 6)
        bb = np.clip(bb + np.clip((h00 * g1 - h01 * g0) / det, -1, 1), -5, 5)
    return cc, bb


def _word_step(count: np.ndarray, moment: np.ndarray, sentences: np.ndarray) -> Words:
    """Newton steps for every numbered word from the sums over all documents."""
    c, b = np.full(count.shape, -12.0), np.zeros(count.shape)
    for x in range(count.shape[0]):
        use = np.flatnonzero(count[x] >= LEAST)
        for part in np.array_split(use, max(1, len(use) // 4096)) if sentences[x].sum() > 0 else ():
            if len(part):
                c[x][part], b[x][part] = _newton(count[x][part], moment[x][part], sentences[x])
    return Words(c, b)


def _rare_step(sums: DataFrame, sentences) -> DataFrame:
    """``(lang, w, c, b)`` of ``(lang, w, count, moment)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, k, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            c, b = np.zeros(len(lang)), np.zeros(len(lang))
            for x in np.unique(lang):
                at = np.flatnonzero(lang == x)
                c[at], b[at] = _newton(k[at].astype(float), m[at], sentences.value[x])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c), pa.array(b)], names=["lang", "w", "c", "b"])

    return sums.select("lang", "w", "count", "moment").mapInArrow(run, "lang int, w string, c double, b double")


def _rare_slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        lang, c, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        for x in np.unique(lang):
            total[int(x)] = total.get(int(x), 0) + slopes(c[lang == x], b[lang == x])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "g"])


def _leveled(docs: DataFrame, model: Words, blind: bool) -> DataFrame:
    """``(doc_id, lang, t, rated)``; blind levels don't use the document's own ratings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, n, _, rated, more, b, k, offsets = _columns(batch)
            prior, weight = _priors(np.full_like(rated, np.nan) if blind else rated, 0.3)
            t = shared.value.levels(lang, n, _dots(shared.value.b, lang, b, k, offsets) + more, prior, weight) if len(n) else np.zeros(0)
            at = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays([batch.column(at("doc_id")), batch.column(at("lang")), pa.array(t, pa.float64()), batch.column(at("rated"))], names=["doc_id", "lang", "t", "rated"])

    return docs.mapInArrow(run, "doc_id long, lang int, t double, rated double")


def _cut_points(docs: DataFrame, model: Words, least: int = 40) -> np.ndarray:
    """Three cuts by language that misplace the fewest rated documents; languages with few ratings share one set.

    Sums by small range of levels are enough for it, so what reaches the driver is bounded.
    """
    t = F.round(F.least(F.greatest("t", F.lit(-4.0)), F.lit(4.0)) * 40).cast("int")
    rows = _leveled(docs.where("rated IS NOT NULL"), model, blind=True).groupBy("lang", t.alias("t"), F.round("rated").cast("int").alias("r")).count().collect()
    table = np.zeros((len(LANGUAGES), 321, 5))
    for r in rows:
        table[r["lang"], r["t"] + 160, min(4, max(1, r["r"]))] += r["count"]

    def cuts(tab: np.ndarray) -> np.ndarray:
        below = np.concatenate([np.zeros((1, 5)), np.cumsum(tab, axis=0)])
        # best[j][i]: right placements of the ranges before i when they fall into levels 1..j.
        best, back = below[:, 1], []
        for level in (2, 3, 4):
            gain = best - below[:, level]
            top = np.maximum.accumulate(gain)
            arg = np.array([np.flatnonzero(gain[: i + 1] == top[i]) for i in range(len(gain))], dtype=object)
            back.append([int(a[len(a) // 2]) for a in arg])
            best = top + below[:, level]
        out, i = [], len(below) - 1
        for b in reversed(back):
            i = b[i]
            out.append((i - 160 - 0.5) / 40)
        return np.array(out[::-1])

    shared = cuts(table.sum(axis=0)) if table.sum() else np.array([-1.0, 0.0, 1.0])
    return np.stack([cuts(table[x]) if table[x].sum() >= least else shared for x in range(len(LANGUAGES))])


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with the mean of each document's ratings; repeated ratings count once, NULL ones not at all."""
    mean = labels.where("level IS NOT NULL").select("doc_id", "rater", "level").distinct().groupBy("doc_id").agg(F.avg("level").alias("rated"))
    return docs.join(mean, "doc_id", "left")


def estimate(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """``(doc_id, level, difficulty)`` of each document with spoken text.

    NULL, empty and blank texts and those made of sounds and adverts only give
    no row; repeated rows come out repeated. Without labels the cuts are the
    middle ones of the scale.
    """
    docs = cut_lineage(rated_documents(extract(documents), labels))
    model, cuts, docs = fit(*numbered(docs, vocabulary(docs), head), rounds)
    own = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in cuts])[F.col("lang")]
    level = F.lit(1) + F.aggregate(own, F.lit(0), lambda a, c: a + F.when(F.col("t") > c, 1).otherwise(0))
    return _leveled(docs, model, blind=True).select("doc_id", level.cast("int").alias("level"), F.col("t").alias("difficulty"))
