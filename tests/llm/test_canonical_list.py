import random

import pytest
from helpers import entries
from pyspark.sql import functions as F

from refloom.llm import canonical_list as C

LISTED = [
    ("Journal of Lunar Quarrying", "J. Lunar Quarr.", 0, 1), ("Journal of Polar Quarrying", "J. Polar Quarr.", 0, 2), ("Annals of Tidal Statistics", "Ann. Tidal Stat.", 0, 3),
    ("Annals of Tidal Statistics", "Ann. Tid. Sta.", 1, 9), ("Polar Zoology and Statistics", "Polar Zool. Stat.", 0, 4), ("Magnetic Beekeeping Letters A", "Magn. Bee. Lett. A", 0, 5),
    ("Magnetic Beekeeping Letters B", "Magn. Bee. Lett. B", 0, 6), ("International Journal of Lunar Quarrying", "Int. J. Lunar Quarr.", 0, 7),
]


@pytest.fixture(scope="module")
def journals(spark):
    return spark.createDataFrame(LISTED, "full string, short string, priority int, row_no int")


def test_forms(spark, journals):
    cases = {
        "{journal of lunar quarrying}": 1, "The Journal of Lunar Quarrying.": 1, "Lunar Quarrying, Journal of": 1, "Lunar Quarrying (Journal of)": 1, "Journal: Lunar Quarrying": 1,
        "Journal of Lunar Quarrying [Online]": 1, "journal of lunar quarrying, vol. 3": 1, "Journal of Lunar Quarrying 2003": 1, "Journla of Lunar Quaring": 1, "J Lun Quar": 1,
        "Journ. of Lunar Quarry.": 1, "Journal of Polar Quarrying - Elmgate Press": 2, "annals tidal statistics": 9, "Ann. Tidal Stat": 9, "Polar Zoology \\& Statistics": 4, "Polar Zool. u. Stat.": 4,
        "Polar Zoology and Sattistics": 4, "Polar Zoology and Statitics": 4, "Annals of Tidal Zoolgy": -1, "Jounral of Polar Quarryng": 2,
        "Magnetic Beekeping Letters B": 6, "magn. bee. lett. a (print)": 5, "Letters of Lunar Quarrying": -1, "Journal of Tidal Quarrying": -1, "in press": -1, "-": -1, "Int Journal of Lunar Quarrying": 7,
    }
    e = entries(spark, [(i, "a.bib", "k", {"Journal" if i % 2 else "journal": n}) for i, n in enumerate(cases)])
    got = {r["entry_id"]: r["row_no"] for r in C.map_journals(e.selectExpr("*", "file AS name", "pos AS row_no"), journals).collect()}
    assert {n: got[i] for i, n in enumerate(cases)} == cases


def test_edits_that_touch_a_blank_and_misspelt_short_forms(spark, journals):
    cases = {"Journal of LunarQuarrying": 1, "Journal of Lunar Quar rying": 1, "Journal of LunarQuarying": -1, "Journal of LunarQuarrging": 1, "Polar Zoologyand Statistics": 4, "PolarZoology and Statistics": 4, "Journal of Lunar Quarrying B": -1}
    e = entries(spark, [(i, "a.bib", "k", {"journal": n}) for i, n in enumerate(cases)])
    got = {r["entry_id"]: r["row_no"] for r in C.map_journals(e, journals).collect()}
    assert {n: got[i] for i, n in enumerate(cases)} == cases
    short = spark.createDataFrame([("Acta Quadrata", "Quadr. Geol. Abh.", 0, 5)], "full string, short string, priority int, row_no int")
    e = entries(spark, [(i, "a.bib", "k", {"journal": n}) for i, n in enumerate(["Qudar. Geol. Abh.", "Quadr. Goel. Abh.", "Quadr. Geol. Abx.", "Quxyr. Geol. Abh."])])
    assert {r["entry_id"]: r["row_no"] for r in C.map_journals(e, short).collect()} == {0: 5, 1: 5, 2: -1, 3: -1}


def test_no_cases(spark, journals):
    e = entries(spark, [(1, "a", "k", {"journal": "J. Lunar Quarr."}), (2, "a", "k", {"journal": " "}), (3, "a", "k", None), (4, "a", "k", {"x": "y"}), (5, "a", "k", {"journal": "y" * 20_000})])
    assert [tuple(r) for r in C.map_journals(e, journals).collect()] == [(5, -1)]
    assert C.map_journals(e.limit(0), journals).count() == 0
    assert {r["row_no"] for r in C.map_journals(e, journals.limit(0)).collect()} == {-1}
    assert C.map_journals(e.unionByName(e), journals).count() == 2


def test_pigeonhole_finds_all_within_k(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(3, 16))) for _ in range(60)]
    near = []
    for w in words:
        v = list(w)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(v) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                v.insert(at, rng.choice("abc"))
            elif v and at < len(v):
                v[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
        near.append("".join(v) or "a")
    refs = spark.createDataFrame([(w,) for w in sorted(set(words))], "r string")
    qs = spark.createDataFrame([(w,) for w in sorted(set(near))], "q string")
    k = 4
    cut = refs.select("r", F.length("r").alias("ln"), F.explode(C._segments(F.col("r"), k)).alias("s")).select("r", "ln", "s.i", "s.seg")
    probes = qs.select("q", F.explode(C._probes(F.col("q"), k)).alias("p")).select("q", "p.ln", "p.i", "p.seg")
    got = {tuple(x) for x in probes.join(cut, ["ln", "i", "seg"]).where(F.levenshtein("q", "r", k) >= 0).select("q", "r").distinct().collect()}
    want = {tuple(x) for x in qs.join(refs, F.levenshtein("q", "r") <= k).collect()}
    assert got == want
