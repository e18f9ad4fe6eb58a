import random

import pytest
from helpers import entries

from refloom.llm import mojibake as M

NAMES = ["José Gomez", "Zoë Muñoz", "Jürgen Müller", "Søren Åberg", "Chloé François", "Ondřej Černý", "Kate Łucz", "Renée Brière"]
TITLES = ["Évolution des forêts", "Исследование волн", "Měření a třídění", "潮流の研究", "Plain words only", "a “new” view – again"]


def wrong(text, written, read):
    return text.encode(written).decode(read)


CASES = [
    (wrong("José Gomez", "utf-8", "cp1252"), "José Gomez"),
    (wrong("Zoë Muñoz", "utf-8", "mac_roman"), "Zoë Muñoz"),
    (wrong("Jürgen Müller", "cp1252", "cp437"), "Jürgen Müller"),
    (wrong("Ondřej", "cp1250", "latin-1") + " Černý", "Ondřej Černý"),
    (wrong(wrong("Chloé", "utf-8", "cp1252"), "utf-8", "cp1252") + " Plain", "Chloé Plain"),
    (wrong("Исследование волн", "cp1251", "koi8-r"), "Исследование волн"),
    (wrong("潮流の研究", "utf-8", "cp437"), "潮流の研究"),
]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(i, "a.bib", "k", {"author": " and ".join(rng.sample(NAMES, 3)), "Title": rng.choice(TITLES)}) for i in range(1500)]
    for n, (bad, _) in enumerate(CASES):
        rows += [(2000 + 20 * n + j, "a.bib", "k", {"author": bad}) for j in range(8)]
    rows += [(3000, "a.bib", "k", {"author": "Ren\ufffde"}), (3001, "a.bib", "k", {"author": None, "title": ""}), (3002, "a.bib", "k", None), (3003, "a.bib", "k", {"note": CASES[0][0]})]
    return entries(spark, rows).selectExpr("*", "file AS v", "file AS field")


def test_finds_and_restores(table):
    got = {r["entry_id"]: r["fixed"] for r in M.repair_entries(table).collect()}
    want = {2000 + 20 * n + j: good for n, (_, good) in enumerate(CASES) for j in range(8)}
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(got) == set(want) | {3000}


def test_margin(spark):
    """Few words validate nothing; of many, at most the share asked for would change."""
    import numpy as np

    rng = random.Random(1)
    words = [("".join(rng.choices("bdfgklmnprst", k=3)) + rng.choice("éèüöñ") + "".join(rng.choices("aeiou", k=2)), 6) for _ in range(3000)]
    df = spark.createDataFrame(sorted(dict(words).items()), "word string, n long")
    sc = spark.sparkContext
    counts = M.gram_counts(df)
    model = M.Model(counts)
    assert M.validated_margin(df.limit(100), sc.broadcast(model)) == M.UNVALIDATED
    margin = M.validated_margin(df, sc.broadcast(model), max_false=0.01)
    rows = [(r["word"], r["n"]) for r in df.collect() if M.looks_clean(r["word"])]
    known = dict(rows)
    gains = [(g, t, n) for w, n in rows for g, t in [M.unseen_gain(model, w, n)]]
    evidence = [g for g, t, n in gains if g <= 0 or known.get(t, 0) < 3 * n]
    assert np.mean([g > margin for g in evidence]) <= 0.01 and (margin == 0 or np.mean([g > margin - 0.02 for g in evidence]) > 0.01)


def test_nothing_to_do(table):
    assert M.repair_entries(table.limit(0)).count() == 0
    assert M.repair_entries(table.where("entry_id < 200")).count() == 0


def test_pieces():
    assert M.only_disguised("Frаncisсo") and not M.only_disguised("ChloΘ")
    assert M.looks_clean("L’étude") and not M.looks_clean("JosÃ©")
    assert "José" in M.candidates("JosÃ©")
    assert M._rewritten("abc", "cp1252", "utf-8") is None


def test_lost_characters_come_back(table):
    values = M.text_values(table).select("v")
    got = {r["entry_id"]: r["fixed"] for r in M.restore_lost(M.repair_entries(table), values).collect()}
    assert got[3000] == "Renée" and got[2000] == CASES[0][1]
