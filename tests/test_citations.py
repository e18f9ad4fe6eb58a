import re

from helpers import entries

from refloom.operators import citations as C
from refloom.sources import discovery


def tex(spark, *rows):
    return spark.createDataFrame([("p", f, t) for f, t in rows], "project string, file string, content string")


def test_extraction(spark):
    t = tex(spark, ("main.tex", r"\cite{A,B} \parencite{C}, \textcite{ D ,} \nocite{*} %\cite{E} \citep[see]{F} \citet*{G} \Cite{H}"), ("sections/a.tex", None), ("sections/b.tex", ""))
    c = C.citations(t)
    assert sorted((r["cite_pos"], r["key_pos"], r["key"]) for r in c.collect()) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (2, 0, "D"), (3, 0, "*"), (4, 0, "E")]
    assert {r["key"] for r in C.citations(t, C.BROAD_CITE).collect()} >= {"A", "F", "G", "H"}
    assert C.citations(tex(spark, ("x.tex", "\\cite{E\u0301}"))).head()["key"] == "\u00c9"


def test_joins(spark):
    e = entries(spark, [(1, "a.bib", "A", {"crossref": "Z"}), (2, "a.bib", "B", {"Crossref": "A"}), (3, "b.bib", "U", {"title": "t"}), (4, "b.bib", None, {"title": "no key"}), {"is_commented": True, "fields": None, "raw": "@comment{@article{K,"}])
    c = C.citations(tex(spark, ("main.tex", r"\cite{B,M,K,M}")))
    bibs = spark.createDataFrame([("p", "b.bib", "@comment{@article{ K, title={x}}}")], "project string, file string, content string")
    assert [r["key"] for r in C.missing(c, e).orderBy("key").collect()] == ["K", "M"]
    assert [r["key"] for r in C.commented(c, C.commented_keys(bibs)).collect()] == ["K"]
    assert [(r["key"], r["target"]) for r in C.missing_crossrefs(e).collect()] == [("A", "Z")]
    assert sorted(r["entry_id"] for r in C.used_entries(e, c).collect()) == [1, 2, 5]
    assert sorted(r["pos"] for r in C.unused_entries(e, c).collect()) == [2, 3]
    n = C.missing(c, e).count() + c.select("key").distinct().join(e.select("key"), "key", "left_semi").count()
    assert n == c.select("key").distinct().count()
    t = C.citation_totals(c, e, C.commented_keys(bibs)).head()
    assert (t["n_cited"], t["n_missing"], t["n_commented"], t["n_valid"]) == (3, 2, 1, 0)


def test_rewriting(spark):
    m = spark.createDataFrame([("p", "X", "K"), ("p", "Y", "K"), ("p", "cite", "new")], "project string, old_key string, new_key string")
    t = tex(spark, ("main.tex", r"\cite{X,Y,Z} and \cite{cite} \citep{ a , b }"), ("plain.tex", "nothing"), ("null.tex", None))
    out = {r["file"]: (r["content"], r["changed"]) for r in C.rewrite_citations(t, m).collect()}
    assert out["main.tex"] == (r"\cite{K, Z} and \cite{new} \citep{a, b}", True)
    assert out["plain.tex"] == ("nothing", False) and out["null.tex"] == (None, False)
    assert C.rewrite_text("x", {}, re.compile(C.CITE)) == "x"


def test_maps_compose(spark):
    s = "project string, old_key string, new_key string"
    a = spark.createDataFrame([("p", "Bad!Key", "BadKey"), ("p", "same", "other")], s)
    b = spark.createDataFrame([("p", "BadKey", "Smith2020"), ("p", "lone", "Doe1999")], s)
    keys = spark.createDataFrame([("p", k) for k in ("Bad!Key", "same", "lone", "stays", None)], "project string, key string")
    assert {(r["old_key"], r["new_key"]) for r in C.compose_maps([a, b], keys).collect()} == {("Bad!Key", "Smith2020"), ("same", "other"), ("lone", "Doe1999")}
    assert C.compose_maps([], keys).count() == 0
    # A name given out by one step and borne by another key before it.
    a = spark.createDataFrame([("p", "Ab!c", "Abc1")], s)
    b = spark.createDataFrame([("p", "Abc1", "Doe2020"), ("p", "Abc", "Roe2021")], s)
    keys = spark.createDataFrame([("p", "Ab!c"), ("p", "Abc")], "project string, key string")
    assert {(r["old_key"], r["new_key"]) for r in C.compose_maps([a, b], keys).collect()} == {("Ab!c", "Doe2020"), ("Abc", "Roe2021")}


def test_discovery(spark):
    rows = [("p", f) for f in ("main.tex", "other.tex", "sections/sec.tex", "sections/deep/x.tex", "sections/sec.bib", "references.bib", "extra.bib")] + [("q", "mine.bib"), ("q", "main.tex"), ("r", "unknown.tex"), ("r", "sections/chapter1.tex"), ("r", "sections/chapter1.bib")]
    listing = spark.createDataFrame(rows, "project string, file string")
    assert {tuple(r) for r in discovery.tex_files(listing).collect()} == {("p", "main.tex"), ("p", "sections/sec.tex"), ("q", "main.tex"), ("r", "sections/chapter1.tex")}
    bibs = discovery.bib_files(listing)
    assert {tuple(r) for r in bibs.collect()} == {("p", "sections/sec.bib"), ("p", "references.bib"), ("q", "mine.bib"), ("r", "sections/chapter1.bib")}
    got = {(r["project"], r["file"]): r["bib"] for r in discovery.corresponding_bib(listing.where("file LIKE '%.tex'"), listing).collect()}
    assert got[("p", "main.tex")] == "references.bib" and got[("p", "sections/sec.tex")] == "sections/sec.bib" and got[("q", "main.tex")] == "mine.bib" and got[("r", "unknown.tex")] is None
    assert {r["project"]: r["ok"] for r in C.correspondence(discovery.tex_files(listing), bibs).collect()} == {"p": True, "q": True, "r": True}
