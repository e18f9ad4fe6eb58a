import random
import re

from helpers import entries

from refloom.llm import hot_dedup as H


def _canon(r):
    t, f = r["entry_type"], r["fields"]
    out = []
    for k, v in f.items():
        v = (v or "").lower()
        if k.lower() == "doi":
            v = re.sub(r"^((doi:|https?://(dx\.)?doi\.example/)\s*)+", "", v.strip())
        v = "".join(c for c in v if c.isalnum())
        if v:
            out.append((k.lower(), v))
    return t.lower(), tuple(sorted(out))


def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        base = rng.choice(["Peat bogs: a view", "Peat, bogs (a view)", "Clay"])
        style = rng.choice([str.upper, str.lower, lambda s: f" {{{s}}}. "])
        doi = rng.choice(["10.1/X", "doi: 10.1/x", "https://dx.doi.example/10.1/x", "10.1/y"])
        fields = list({"title": style(base), "DOI" if i % 2 else "doi": doi, "note": rng.choice(["", "--", " "])}.items())
        rng.shuffle(fields)
        rows.append({"entry_id": i + 1, "entry_type": rng.choice(["article", "Article"]), "fields": dict(fields)})
    rows.append({"entry_id": 900, "fields": None, "is_commented": True})
    rows += [{"entry_id": 901, "entry_type": "book", "fields": {}}, {"entry_id": 902, "entry_type": "book", "fields": {"x": "?"}}]
    return rows, entries(spark, rows)


def test_against_brute_force_hot_and_cold(spark):
    rows, e = table(spark)
    groups = {}
    for r in rows:
        if r["fields"] is not None:
            groups.setdefault(_canon(r), []).append(r["entry_id"])
    want = {(min(g), i, len(g)) for g in groups.values() if len(g) > 1 for i in g}
    for hot, most in ((10_000, 1000), (20, 1000), (1, 2)):
        got = {tuple(r) for r in H.copies(H.digests(e), hot_rows=hot, max_hot=most, salts=3).select("group_id", "entry_id", "n_copies").collect()}
        assert got == want
    assert H.collapse(e).count() == len(groups)
    assert sum(r["n_copies"] for r in H.collapse(e, hot_rows=5).collect()) == len(rows) - 1


def test_differences_that_count(spark):
    f = {"title": "a b", "year": "2020"}
    e = entries(spark, [(1, "x", "k", f), (2, "y", "l", f | {"year": "2021"}), (3, "z", "m", {"title": "ab", "year": "20 20"}), (4, "z", "m", {"title": "ab2020"})])
    assert [tuple(r) for r in H.copies(H.digests(e)).where("entry_id <> group_id").select("group_id", "entry_id").collect()] == [(1, 3)]
    assert H.copies(H.digests(e.limit(0))).count() == 0


def test_very_long_values(spark):
    long = {"doi": "doi:" * 20_000, "title": " " * 50_000 + "x" + " " * 50_000, "note": "(" * 50_000, "author": "A and " * 20_000}
    e = entries(spark, [(1, "a", "k", long), (2, "b", "l", long | {"title": "X"})])
    assert [tuple(r) for r in H.copies(H.digests(e)).select("group_id", "entry_id", "n_copies").orderBy("entry_id").collect()] == [(1, 1, 2), (1, 2, 2)]
