import itertools

from helpers import entries, one_column
from pyspark.sql import functions as F

from refloom.functions import repair as R
from refloom.operators import guards as G
from refloom.operators import repairs
from refloom.sources import journals


def _percent(v):
    out, run = "", 0
    for c in v:
        out += ("\\" if c == "%" and run % 2 == 0 else "") + c
        run = run + 1 if c == "\\" else 0
    return out


def test_percent_exhaustive_and_idempotent(spark):
    values = ["".join(x) for n in range(7) for x in itertools.product("\\%a", repeat=n)]
    once = one_column(spark, values, R.escape_percent)
    assert once == [_percent(v) for v in values]
    assert one_column(spark, once, R.escape_percent) == once


def test_html(spark):
    given = ["A &amp; B &lt; C &quot;D&quot; & G", r"already \& here", "&amp;lt;", None, "&nbsp;"]
    assert one_column(spark, given, R.fix_html) == [r'A \& B < C "D" \& G', r"already \& here", r"\<", None, r"\&nbsp;"]


def test_file_texts(spark):
    files = spark.createDataFrame([("p", "a", b"Valid\\\\\xcc\x88Text \xff"), ("p", "b", "\u2500 a\u0301\n%a\u0301".encode()), ("p", "c", None)], "project string, file string, content binary")
    out = {r["file"]: (r["content"], r["changed"]) for r in repairs.fix_files(files).collect()}
    assert out["a"] == ('Valid"Text ', True) and out["b"] == ("-- \\'{a}\n%a\u0301", True) and out["c"] == (None, None)
    assert one_column(spark, ["x\\\\\u0308y\\\\\u0142", "none", None], R.count_broken_accents) == [2, 0, None]


def test_author(spark):
    given = ["M\\\\\\\\uller", "Doe, \\,", "Doe \\", "Jos\u00e9 \u0142", None]
    assert one_column(spark, given, R.fix_author) == ['M{\\"u}uller', "Doe,,", "Doe", "Jos\\'{e} \\l{}", None]


def test_accents(spark):
    assert R.plain_letters(r"Fran\c{c}ois Ann\'{a} Jos" + "\u00e9 \u0142 \ud55c") == "Francois Anna Jose \u0142 \ud55c"
    e = entries(spark, [(1, "a.bib", "k", {"author": "Jos\u00e9", "note": "\u00e9", "title": "plain"})])
    r = repairs.remove_accents(e).head()
    assert r["fields"] == {"author": "Jose", "note": "\u00e9", "title": "plain"} and r["changed"] == 1


def test_year_month(spark):
    assert one_column(spark, ["2021-05-17", "{2021/1}", "2021", "+2021", "n.d.", None], R.fix_year) == ["2021", "2021", "2021", "+2021", "n.d.", None]
    assert one_column(spark, ["apr", " {May} ", "7", "Sept", "spring", None], R.fix_month) == ["4", "5", "7", "9", "spring", None]
    e = entries(spark, [(1, "a.bib", "k", {"Year": "2021-05-17", "month": "apr"}), (2, "a.bib", "k", None)])
    assert repairs.count_changes(repairs.fix_years(e)).head()["fixes"] == 1
    assert repairs.fix_months(e).orderBy("entry_id").head()["fields"]["month"] == "4"


def test_transform_counts_and_propagates(spark):
    e = entries(spark, [(1, "a.bib", "k", {"a": "x", "b": "Y"}), (2, "a.bib", None, None)])
    rows = {r["entry_id"]: r for r in repairs.field_transform(e, F.upper).collect()}
    assert rows[1]["fields"] == {"a": "X", "b": "Y"} and rows[1]["changed"] == 3 and rows[1]["key_raw"] == "K"
    assert repairs.walk_fields(e).count() == 4
    bad = repairs.python_transform(e, lambda v: 1 // 0)
    try:
        bad.collect()
    except Exception as x:
        assert "ZeroDivisionError" in str(x)
    else:
        raise AssertionError("the error was swallowed")


def test_uncomment(spark):
    raw = "@comment{@article{X,\n  title = {T}\n  year = {2020}\n}}"
    e = entries(spark, [{"raw": raw, "is_commented": True, "fields": None}, {"raw": "@comment{@x{y,\n title={open}", "is_commented": True, "fields": None}, (3, "a.bib", "k", {"a": "b"})])
    out = {r["pos"]: r for r in repairs.with_uncommented(e).collect()}
    assert out[0]["key"] == "X" and out[0]["fields"] == {"title": "T", "year": "2020"} and not out[0]["is_commented"] and out[0]["n_fields"] == 4
    assert out[1]["fields"] == {"title": "open"} and out[2]["changed"] == 0
    assert R.repair_commented("no comment") is None and R.repair_commented(None) is None


def test_uncomment_takes_the_whole_body(spark):
    lines = "\n".join(f"    line {n}" for n in range(300))
    raw = "@comment{@article{X,\n  abstract = {" + lines + "},\n  title = {T},\n  year = {2020}\n}}"
    e = entries(spark, [{"raw": raw, "is_commented": True, "fields": None}])
    r = repairs.uncomment(e).head()
    assert r["fields"]["title"] == "T" and r["fields"]["year"] == "2020" and r["fields"]["abstract"].endswith("line 299")
    assert R.repair_commented(raw) == raw[len("@comment{") : -1]


def test_drop(spark):
    e = entries(spark, [(1, "a.bib", "k", {"File": "/some/path", "title": "t", "Bdsk-Url-1": "u"})])
    r = repairs.drop_fields(e).head()
    assert r["fields"] == {"title": "t"} and r["changed"] == 2 and r["n_fields"] == 3


def test_journals(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Journal of the American Chemical Society, J. Am. Chem. Soc. \nlonely\n,x\nNature,Nat.\n")
    (tmp_path / "b.csv").write_text("nature,Nat\n")
    j = journals.read_journals(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    (tmp_path / "many").mkdir()
    for i in range(6):
        (tmp_path / "many" / f"{i}.csv").write_text("".join(f"Name {i} {n},N {i} {n}\n" for n in range(50)))
    assert journals.read_journals(spark, str(tmp_path / "many")).select("row_no").distinct().count() == 300
    e = entries(spark, [(i, "a.bib", "k", {"journal": v} if v is not None else {"x": "y"}) for i, v in enumerate(["JOURNAL of the american chemical society", "Nature", "J. Some.", "Unknown Paper", None, ""])])
    out = {r["entry_id"]: (r["fields"].get("journal"), r["changed"]) for r in journals.abbreviate(e, j, lambda c: F.concat(F.substring(c, 1, 2), F.lit("x"))).collect()}
    assert out == {0: ("J. Am. Chem. Soc.", 1), 1: ("Nat", 1), 2: ("J. Some.", 0), 3: ("Unx", 1), 4: (None, 0), 5: ("", 0)}


def test_guards(spark):
    before = entries(spark, [(1, "a.bib", "k", {"doi": "10.1/A", "title": "T"}), (2, "b.bib", "m", {"title": "U"}), (3, "b.bib", "n", {"doi": "10.1/b"})])
    after = entries(spark, [(1, "a.bib", "k", {"doi": "10.1/other", "title": "T2"}), (2, "b.bib", "m", {"title": "U", "doi": "10.1/new"}), (3, "b.bib", "n", {"doi": "doi:10.1/B"})])
    kept = {r["entry_id"]: r["fields"] for r in G.guarded(before, after).collect()}
    assert kept[1]["title"] == "T" and kept[2]["doi"] == "10.1/new"
    assert sorted(r["check"] for r in G.format_warnings(before, after).collect()) == ["doi_changed", "title_changed"]
    assert G.format_warnings(before, before).count() == 0
    meta = spark.createDataFrame([("10.1/a", {"year": "2020", "title": "No", "doi": "10.1/a"})], "doi string, fields map<string,string>")
    out = {r["entry_id"]: r["fields"] for r in G.enrich(before, meta).collect()}
    assert out[1]["year"] == "2020" and out[1]["title"] == "T" and G.enrich(before, None) is before
    files = spark.createDataFrame([("p", "x.bib", b"@article{A title={MissingEquals}}"), ("p", "b.bib", b"@")], "project string, file string, content binary")
    assert [r["file"] for r in G.unparsable(files, before).collect()] == ["x.bib"]
