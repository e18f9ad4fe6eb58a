import os

from refloom import cli
from refloom.operators import keys as K
from refloom.operators import validation as V
from refloom.plans import workflow
from refloom.sources import bibtex, discovery, sinks
from refloom.streaming import incremental


def project(spark, files):
    rows = [("p", f, t.encode()) for f, t in files.items()]
    listing = spark.createDataFrame(rows, "project string, file string, content binary")
    tex = discovery.tex_files(listing)
    return discovery.bib_files(listing), tex.withColumn("content", tex["content"].cast("string"))


def test_verdict_and_issues(spark):
    bib = "@article{A, title={x}}\n@article{B, title={y}}"
    bibs, tex = project(spark, {"main.tex": r"\cite{A}", "references.bib": bib})
    found, ok, summary = workflow.validate(bibs, tex)
    assert ok.head()["ok"] and found.count() == 0
    assert summary.head().asDict() == {"project": "p", "n_tex": 1, "n_bib": 1, "n_keys": 2, "n_cited": 1}
    bibs, tex = project(spark, {"main.tex": r"\cite{A,C}", "references.bib": bib + "\n@article{D, title={x}, note={100% z}}\n@misc{open", "sections/s.tex": "", "sections/t.bib": ""})
    found, ok, _ = workflow.validate(bibs, tex)
    assert not ok.head()["ok"]
    assert {r["check"] for r in found.collect()} == {"missing", "duplicate_title", "percent", "syntax", "no_bib"}
    assert "main.tex: missing C" in {r["message"] for r in found.collect()}


def test_stats(spark):
    files = spark.createDataFrame([("p", "a.bib", b"@a{k, doi={1}, title={t}}@a{l, doi={}}"), ("p", "e.bib", b"")], "project string, file string, content binary")
    rows = {r["file"]: r["doi_share"] for r in V.report(V.bib_stats(files, bibtex.read_entries(files))).collect()}
    assert rows == {"a.bib": "50.0%", "e.bib": "N/A"}
    odd = spark.createDataFrame([("p", "a.bib", b"@a{k, t={x}"), ("p", "b.bib", b"@a{k}"), ("p", "n.bib", None)], "project string, file string, content binary")
    assert [tuple(r) for r in V.unbalanced(odd).collect()] == [("p", "a.bib", 2, 1)]
    lines = spark.createDataFrame([("p", "a", "50% x\n% skip %\n50\\% ok\n\\\\% bad".encode()), ("p", "n", None)], "project string, file string, content binary")
    assert {r["file"]: r["n_lines"] for r in V.percent_lines(lines).collect()} == {"a": 2, "n": 0}


def test_curate(spark):
    bibs, tex = project(spark, {
        "main.tex": r"\cite{oldkey} \cite{KeyA,KeyB}",
        "references.bib": "@article{oldkey, author={Smith, Jane}, year={2021-05-17}, journal={Journal of the American Chemical Society}, title={An x \\& y}, file={/p}}\n@article{unused, title={z}}",
        "sections/s.bib": "@article{KeyA, author={Roe, R}, year={1999}, title={Same Title}}\n@article{KeyB, author={Roe, R}, year={1999}, title={same title}, doi={10.1/x}}",
    })
    j = spark.createDataFrame([("journal of the american chemical society", "J. Am. Chem. Soc.", 0, 1)], "full string, short string, priority int, row_no int")
    done = workflow.curate(bibs, tex, journals=j)
    out = {r["key"]: r["fields"] for r in done.entries.collect()}
    smith = next(k for k in out if k.startswith("Smith2021"))
    assert out[smith]["journal"] == "J. Am. Chem. Soc." and out[smith]["year"] == "2021" and "file" not in out[smith]
    roe = [k for k in out if k.startswith("Roe1999")]
    assert len(out) == 2 and len(roe) == 1 and out[roe[0]]["doi"] == "10.1/x"
    assert done.tex.head()["content"] == f"\\cite{{{smith}}} \\cite{{{roe[0]}}}"
    assert {r["step"]: r["fixes"] for r in done.fixes.groupBy("step").sum("fixes").withColumnRenamed("sum(fixes)", "fixes").collect()}["year"] == 1
    kept = workflow.curate(bibs, tex, preserve_keys=True)
    assert {r["key"] for r in kept.entries.collect()} == {"oldkey", "KeyA", "KeyB"}


def test_closing_pass_repairs_recovered_entries(spark):
    bibs, tex = project(spark, {
        "main.tex": r"\cite{K,L}",
        "references.bib": "@comment{@article{K,\n  title = {Caf\\'{e} \\& 5% &amp; x},\n  year = {2021-05-17},\n  month = {apr},\n  keywords = {a, b},\n  file = {/p}\n}}\n@article{L, title={t}, note={n}}",
    })
    done = workflow.curate(bibs, tex, preserve_keys=True)
    out = {r["key"]: r for r in done.entries.collect()}
    assert out["K"]["fields"] == {"title": "Cafe \\& 5\\% \\& x", "year": "2021", "month": "4"} and out["K"]["n_fields"] == 5
    rows = [(r["step"], r["fixes"]) for r in done.fixes.collect()]
    fixes = dict(rows)
    assert len(rows) == len(fixes) and fixes["uncommented"] == 1 and fixes["year"] == 1 and fixes["month"] == 1 and fixes["percent"] == 1 and fixes["dropped"] == 3


def test_keys_never_mislead(spark):
    bibs, tex = project(spark, {
        "main.tex": r"\cite{Ab!c} and \cite{Abc} and \cite{Gone}",
        "references.bib": "@article{Ab!c, author={Doe, J}, year={2020}, title={First}}\n@article{Abc, author={Roe, J}, year={2021}, title={Second}, crossref={Par!ent}}\n@book{Par!ent, author={Poe, E}, year={1999}, title={Whole}}",
    })
    done = workflow.curate(bibs, tex)
    assert done.tex.head()["content"] == r"\cite{Doe2020First} and \cite{Roe2021Second} and \cite{Gone}"
    out = {r["key"]: r["fields"] for r in done.entries.collect()}
    assert set(out) == {"Doe2020First", "Roe2021Second", "Poe1999Whole"} and out["Roe2021Second"]["crossref"] == "Poe1999Whole"
    # A generated key never takes the name of a cited key that has no entry.
    held = spark.createDataFrame([("p", "Doe2020First")], "project string, key string")
    e = bibtex.read_entries(bibs)
    assert "Doe2020First" not in {r["key"] for r in K.standardize(e, reserved=held)[0].collect()}


def test_curation_keeps_what_is_no_entry(spark):
    bibs, tex = project(spark, {
        "main.tex": r"\cite{K}",
        "references.bib": "@string{s = {X}}\n@preamble{p}\n@comment{free}\n@article{K, title={t}, journal=s}\n@article{broken title={x}}\n@article{unused, title={u}}",
        "sections/all_unused.bib": "@article{U, title={v}}", "sections/bad.bib": "@article{A title={MissingEquals}}",
    })
    done = workflow.curate(bibs, tex, preserve_keys=True)
    texts = {r["file"]: r["content"] for r in done.texts().collect()}
    assert all(x in texts["references.bib"] for x in ("@string{s = {X}}", "@preamble{p}", "@comment{free}", "@article{K,", "@article{broken title={x}}")) and "unused" not in texts["references.bib"]
    assert texts["sections/all_unused.bib"] == "" and texts["sections/bad.bib"] == "@article{A title={MissingEquals}}\n"
    assert {(r["check"], r["file"]) for r in done.warnings.collect()} == {("unparsable", "sections/bad.bib")}


def test_broad_citations(spark):
    bibs, tex = project(spark, {"main.tex": r"\citep[see]{K} \citet*{L}", "references.bib": "@article{K, title={t}}\n@article{L, title={u}}\n@article{M, title={v}}"})
    assert {r["key"] for r in workflow.curate(bibs, tex, preserve_keys=True, strict=False).entries.collect()} == {"K", "L"}


def test_journals_fall_back_word_by_word(spark):
    from helpers import one_column
    from refloom.functions.iso4 import abbreviation

    given = ["Journal of Applied Physics", "Annals of the Royal Society", "Zoology Letters", "Proceedings of the National Academy of Sciences", "Glimmer Reports", None]
    assert one_column(spark, given, abbreviation) == ["J. Appl. Phys.", "Ann. R. Soc.", "Zool. Lett.", "Proc. Natl. Acad. Sci.", "Glimmer Rep.", None]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import pytest
    from refloom import runtime

    class Nothing:
        def __getattr__(self, _):
            return self

        def __call__(self, *a, **k):
            return self

        master = "spark://host:7077"

        def get(self, *a):
            return None

        def isDefined(self):  # noqa: N802
            return False

    class Session:
        sparkContext = conf = Nothing()  # noqa: N815

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session())


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "main.tex").write_text(r"\cite{oldkey}")
    (tmp_path / "references.bib").write_text("@article{oldkey, author={Smith, J}, year={2021}, title={An x}}")
    assert cli.main(["validate", str(tmp_path)]) == 0
    assert cli.main(["polish", str(tmp_path), "--yes"]) == 0
    assert (tmp_path / "main.tex").read_text() == r"\cite{Smith2021An}" and "@article{Smith2021An" in (tmp_path / "references.bib").read_text()
    assert (tmp_path / "references.bib.backup").exists() and "unique keys: 1" in capsys.readouterr().out
    (tmp_path / "list.csv").write_text("Journal of Odd Things,J. Odd\n")
    (tmp_path / "more.json").write_text('{"doi": "10.1/x", "fields": {"publisher": "House"}}\n')
    (tmp_path / "main.tex").write_text(r"\citep[p. 1]{a,b}")
    (tmp_path / "references.bib").write_text("@string{x = {y}}\n@article{a, journal={journal of odd things}, doi={10.1/x}}\n@article{b, journal={Annals of Physics}}")
    assert cli.main(["curate", str(tmp_path), "--yes", "--preserve-keys", "--broad-citations", "--journals", str(tmp_path / "list.csv"), "--metadata", str(tmp_path / "more.json")]) == 0
    text = (tmp_path / "references.bib").read_text()
    assert "J. Odd}" in text and "Ann. Phys.}" in text and "publisher = {House}" in text and "@string{x = {y}}" in text
    assert "@string" in (tmp_path / "references.bib.backup").read_text()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert cli.main(["validate", str(empty)]) == 1


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "project string, file string, content string")
    new = spark.createDataFrame([("p", "a", "x"), ("p", "b", "z"), ("p", "c", "n")], "project string, file string, content string")
    ch = sinks.changed_files(old, new)
    assert {r["file"] for r in ch.collect()} == {"b", "c"}
    sinks.write_files(ch, str(tmp_path))
    assert (tmp_path / "b").read_text() == "z" and not os.path.exists(tmp_path / "a")
    sinks.save_table(new, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text("@article{k, month={apr}}")
    q = incremental.curate_stream(incremental.arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).head()["fields"] == {"month": "4"}
