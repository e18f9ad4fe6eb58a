from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import entries
from refloom.functions.latex import decode
from refloom.sources import bibtex as B

TEXT = """@string{jacs = {J. Am. Chem. Soc.}}
@comment{free text}
@preamble{"x"}
@article{key1,
  title = {A {Nested} title
    over lines},
  journal = jacs # { B},
  year = 2020,
  author = "Ann {"}quoted{"} Bee"
}
@book(key2, title = {Other})
@comment{@article{X,
  title = {Gone}
}}
@article{A title={MissingEquals}}
@misc{open, title = {never closed
@misc{last, note = {n},}
"""


def test_blocks():
    rows = list(B.parse_blocks(TEXT))
    assert [r["kind"] for r in rows] == ["string", "comment", "preamble", "entry", "entry", "commented", "entry", "entry", "entry"]
    good = {r["key_raw"]: r["fields"] for r in rows if r["kind"] == "entry" and not r["error"]}
    assert good["key1"] == {"title": "A {Nested} title\n    over lines", "journal": "J. Am. Chem. Soc. B", "year": "2020", "author": 'Ann {"}quoted{"} Bee'}
    assert good["key2"] == {"title": "Other"} and good["last"] == {"note": "n"}
    assert [r["error"] is not None for r in rows if r["kind"] == "entry"] == [False, False, True, True, False]


def test_decoding_bytes():
    assert B.decode_text(b"\xef\xbb\xbfa\r\nb") == "a\nb" and B.decode_text("\u00e9".encode("cp1252")) == "\u00e9" and B.decode_text(None) == ""
    assert B.decode_text("\ufeff\u00e9".encode("utf-16-le")) == "\u00e9"


def test_latex():
    assert decode(r"Erd{\H o}s {\"o}ber \'{e}t\'e \c{c}a \ss{} \& 5\% {\o}") == "Erd\u0151s \u00f6ber \u00e9t\u00e9 \u00e7a \u00df & 5% {\u00f8}"
    assert decode(None) is None and decode("plain") == "plain"


def test_files_to_entries_and_back(spark):
    files = spark.createDataFrame([("p", "a.bib", TEXT.encode()), ("p", "empty.bib", b""), ("q", "null.bib", None)], "project string, file string, content binary")
    e = B.read_entries(files).cache()
    assert [(r["pos"], r["key_raw"], r["is_commented"]) for r in e.orderBy("pos").collect()] == [(0, "key1", False), (1, "key2", False), (2, None, True), (3, "last", False)]
    assert e.where("key_raw = 'key1'").head()["n_fields"] == 6
    again = B.read_entries(B.file_texts(e))
    assert {(r["key_raw"], str(sorted((r["fields"] or {}).items()))) for r in again.collect()} == {(r["key_raw"], str(sorted((r["fields"] or {}).items()))) for r in e.collect()}


def test_field_order(spark):
    e = entries(spark, [(1, "a.bib", "K", {"zeta": "1", "doi": "d", "title": "t", "alpha": "2"})])
    assert B.file_texts(e).head()["content"] == "@article{K,\n  title = {t},\n  doi = {d},\n  alpha = {2},\n  zeta = {1}\n}\n"


def test_source_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text("@article{k, title = {T}}\n@comment{@book{c, title={x}}}")
    B.register(spark)
    df = spark.read.format("bibtex").load(str(tmp_path / "in"))
    assert sorted((r["pos"], r["key"], r["n_fields"], r["is_commented"]) for r in df.select("pos", "key", "n_fields", "is_commented").collect()) == [(0, "k", 3, False), (1, None, None, True)]
    e = entries(spark, [{"entry_id": i, "project": f"p{i % 3}", "file": "references.bib", "key_raw": f"K{i}", "fields": {"title": f"T{i}"}, "pos": i} for i in range(24)])
    B.file_texts(e.repartition(4)).write.format("bibtex").mode("append").save(str(tmp_path / "out"))
    for p in range(3):
        text = (tmp_path / "out" / f"p{p}" / "references.bib").read_text()
        assert [r["key_raw"] for r in B.parse_blocks(text)] == [f"K{i}" for i in range(p, 24, 3)]
    try:
        df.write.format("bibtex").mode("append").save(str(tmp_path / "no"))
    except Exception as x:
        assert "file_texts" in str(x)
    else:
        raise AssertionError("entries were written without their files")


def test_whole_files_survive(spark):
    more = TEXT + "loose words\n@article{tail, title={z}}\nend"
    files = spark.createDataFrame([("p", "a.bib", more.encode()), ("q", "a.bib", b"@string{x = {y}}"), ("p", "empty.bib", b""), ("q", "null.bib", None)], "project string, file string, content binary").repartition(3)
    blocks = B.parse_files(files).cache()
    texts = B.file_texts(B.entries(blocks), B.others(blocks), files)
    again = B.parse_files(texts)
    what = lambda df: sorted((r["project"], r["file"], r["pos"], r["kind"], r["key_raw"] or "", r["raw"] if r["kind"] != "entry" or r["error"] else "") for r in df.collect())
    assert what(again) == what(blocks) and {r["kind"] for r in blocks.collect()} == {"string", "comment", "preamble", "entry", "commented", "text"}
    assert {(r["project"], r["file"]) for r in texts.collect()} == {("p", "a.bib"), ("q", "a.bib"), ("p", "empty.bib"), ("q", "null.bib")}
    gone = B.file_texts(B.entries(blocks).limit(0), None, files)
    assert {r["content"] for r in gone.collect()} == {""}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="@{}()\",=#\\ abc\n%", max_size=120))
def test_any_text_parses(text):
    rows = list(B.parse_blocks(text))
    assert [r["pos"] for r in rows] == list(range(len(rows)))
