from helpers import entries

from refloom.operators import packed_fields as P

COUNTS = {
    "keywords": {"kiln": 50, "clay": 50, "water, brackish": 8, "signal/noise ratio": 9, "r&d costs": 9, "salt and pepper noise": 9, "sensors; buried": 5, "chalk": 40},
    "author": {"institute of rivers and shores": 5},
}


def seg():
    return P.Segmenter(COUNTS, {"rivers and shores"})


def test_keywords():
    s = seg()
    assert s.split('kiln; "water, brackish" ;; clay', "keywords") == ["kiln", "water, brackish", "clay"]
    assert s.split("kiln, water, brackish, signal/noise ratio", "keywords") == ["kiln", "water, brackish", "signal/noise ratio"]
    assert s.split("kiln, sensors; buried, R&D costs", "keywords") == ["kiln", "sensors; buried", "R&D costs"]
    assert s.split("kiln / clay / salt and pepper noise", "keywords") == ["kiln", "clay", "salt and pepper noise"]
    assert s.split("{a, b}\tkiln\nclay|chalk \u00b7 kiln", "keywords") == ["a, b", "kiln", "clay", "chalk", "kiln"]
    assert s.split("unknown thing, another one", "keywords") == ["unknown thing", "another one"]


def test_authors():
    s = seg()
    assert s.split("Doe, Jane and John Roe AND {Institute of Rivers and Shores} and others", "author") == ["Doe, Jane", "John Roe", "Institute of Rivers and Shores"]
    assert s.split("Jane Doe, John M. Roe, Ann Poe", "author") == ["Jane Doe", "John M. Roe", "Ann Poe"]
    assert s.split("Jane Doe, John Roe and Ann Poe", "author") == ["Jane Doe", "John Roe", "Ann Poe"]
    assert s.split("Smith, J., Doe, A. B., Roe, C.", "author") == ["Smith, J.", "Doe, A. B.", "Roe, C."]
    assert s.split('"Doe, Jane", "John Roe" et al.', "author") == ["Doe, Jane", "John Roe"]
    assert s.split("Doe, Jane;; {Some Lab} and", "author") == ["Doe, Jane", "Some Lab"] and s.split("Jane Doe and", "author") == ["Jane Doe"]
    assert s.split("van der Berg, Jan", "author") == ["van der Berg, Jan"]
    assert s.split("Institute of Rivers and Shores and Bob Xylo", "author") == ["Institute of Rivers and Shores", "Bob Xylo"]


def test_known_values_of_any_length():
    s = P.Segmenter({"keywords": {"alpha, b, c, d, e, f, g, h": 500, "kiln": 50}})
    assert s.split("Alpha, b, c, d, e, f, g, h; other", "keywords") == ["Alpha, b, c, d, e, f, g, h", "other"]
    assert s.split("kiln, alpha, b, c, d, e, f, g, h, kiln", "keywords") == ["kiln", "alpha, b, c, d, e, f, g, h", "kiln"]
    long = ", ".join(f"w{i}" for i in range(60))
    assert P.Segmenter({"keywords": {long: 2, "x": 9}}).split(f"x; {long}; y", "keywords") == ["x", long, "y"]


def test_rare_pieces_come_by_join(spark):
    """Split alike whether a known piece is in the dictionary or is joined."""
    rows = [(i, "a.bib", "k", {"keywords": "kiln; clay; chalk"}) for i in range(200)]
    rows += [(300 + i, "a.bib", "k", {"keywords": "{water, brackish; deep}; kiln", "author": "{Institute of Rivers and Shores} and {Plato} and Ann Bee"}) for i in range(2)]
    rows += [(400, "a.bib", "k", {"keywords": "clay, water, brackish; deep, kiln", "author": "Plato and Institute of Rivers and Shores and Bob Xylo"})]
    values = P.field_values(entries(spark, rows))
    out = {(r["entry_id"], r["field"]): r["vs"] for r in P.split_values(values).where("entry_id = 400").collect()}
    by_join = {(r["entry_id"], r["field"]): r["vs"] for r in P.split_values(values, size=20).where("entry_id = 400").collect()}
    assert out == by_join == {(400, "keywords"): ["clay", "water, brackish; deep", "kiln"], (400, "author"): ["Plato", "Institute of Rivers and Shores", "Bob Xylo"]}


def test_edges():
    s = seg()
    for v in (None, "", "  ", ";;", '""', "and", "{", '"', ", ,"):
        assert s.split(v, "author") == ([] if v != "and" else ["and"])
        assert s.split(v, "keywords") == ([] if v != "and" else ["and"])
    for hard in ("{" * 50_000, " " * 50_000 + "x; y", '"a, b", ' * 5_000, "{a} and " * 5_000, "and " * 20_000, "&" * 50_000):
        s.split(hard, "author"), s.split(hard, "keywords")
    long = "; ".join(["Jane Doe"] * 5000)
    assert len(s.split(long, "author")) == 5000
    assert s.split("a, {unbalanced; b", "keywords") == ["a", "{unbalanced", "b"]


def test_table(spark):
    rows = [(i, "a.bib", "k", {"Keywords": "kiln; clay", "author": "Jane Doe"}) for i in range(3)] + [(9, "a.bib", "k", None), (10, "a.bib", "k", {"keywords": " "}), (11, "a.bib", "k", {"AUTHOR": "A Bee; C Dee"})]
    e = entries(spark, rows).selectExpr("*", "file AS value", "pos AS vs")  # extra columns with the names of results
    out = {(r["entry_id"], r["field"], r["pos"], r["value"]) for r in P.unpack(e, least=2).collect()}
    assert out == {(i, "keywords", p, v) for i in range(3) for p, v in ((1, "kiln"), (2, "clay"))} | {(11, "author", 1, "A Bee"), (11, "author", 2, "C Dee")}
    assert P.unpack(e).count() == 11 and P.unpack(e.limit(0)).count() == 0
