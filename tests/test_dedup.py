from helpers import entries

from refloom.operators import dedup as D
from refloom.operators import keys as K
from refloom.operators.skew import join_even


def test_best_entry_and_ties(spark):
    e = entries(spark, [(1, "a.bib", "K", {"title": "t"}), (2, "a.bib", "K", {"title": "t", "author": "a"}), (3, "b.bib", "K", {"title": "u", "author": "b"})])
    assert D.best_entries(e, ["key"]).head()["fields"] == {"title": "t", "author": "a"}


def test_synchronize(spark):
    e = entries(spark, [(1, "a.bib", "K", {"title": "t"}), (2, "b.bib", "K", {"title": "t", "author": "a"}), (3, "b.bib", "L", {"title": "z"}), (4, "b.bib", None, {"x": "y"}), {"entry_id": 5, "is_commented": True, "raw": "r", "fields": None}])
    out = {r["entry_id"]: r["fields"] for r in D.synchronize(e).collect()}
    assert out == {1: {"title": "t", "author": "a"}, 2: {"title": "t", "author": "a"}, 3: {"title": "z"}, 4: {"x": "y"}, 5: None}


def test_dois(spark):
    rows = [(1, "a.bib", "A", {"doi": "10.1/x"}), (2, "a.bib", "A", {"DOI": "doi:10.1/X"})]
    assert D.duplicate_dois(entries(spark, rows)).count() == 0 and D.duplicate_keys(entries(spark, rows)).count() == 1
    e = entries(spark, [*rows[:1], (2, "b.bib", "Smith2020", {"Doi": "https://doi.org/10.1/x", "title": "t", "author": "a"}), (3, "b.bib", "A", {"doi": "10.1/other"})])
    kept, m = D.consolidate_dois(e)
    assert {(r["entry_id"], r["key"]) for r in kept.collect()} == {(2, "Smith2020"), (3, "A")}  # an equal key with another DOI stays
    assert [(r["old_key"], r["new_key"]) for r in m.collect()] == [("A", "Smith2020")]


def test_titles(spark):
    e = entries(spark, [(1, "a.bib", "K1", {"title": "Same Title"}), (2, "b.bib", "K2", {"title": "same  {title}", "author": "a"}), (3, "b.bib", "K3", {"title": ""})])
    assert D.duplicate_titles(e).count() == 1
    kept, m = D.consolidate_titles(e)
    assert {(r["entry_id"], r["key"]) for r in kept.collect()} == {(2, "K2"), (3, "K3")}
    assert [(r["old_key"], r["new_key"]) for r in m.collect()] == [("K1", "K2")]


def test_cross_file(spark):
    e = entries(spark, [(1, "z/a.bib", "D", {"t": "1"}), (2, "b.bib", "D", {"t": "2"}), (3, "z/a.bib", "D", {"t": "3"}), (4, "b.bib", "E", {"t": "4"}), (5, "b.bib", "", {"t": "5"})])
    assert sorted(r["entry_id"] for r in D.drop_cross_file(e).collect()) == [1, 4, 5]


def test_empty_tables(spark):
    e = entries(spark, [(1, "a", "k", {"a": "b"})]).limit(0)
    assert D.synchronize(e).count() == 0 and D.consolidate_dois(e)[0].count() == 0 and D.consolidate_titles(e)[1].count() == 0 and K.standardize(e)[0].count() == 0


SMITH = {"author": "Smith, A.", "year": "2021", "journal": "Journal", "title": "An x"}


def test_sanitize(spark):
    out, m = K.sanitize(entries(spark, [(1, "a", "Bad!Key", {"a": "b"}), (2, "a", "good_key", {"a": "b"}), (3, "a", None, None)]))
    assert [(r["old_key"], r["new_key"]) for r in m.collect()] == [("Bad!Key", "BadKey")] and {r["key"] for r in out.collect()} == {"BadKey", "good_key", None}


def test_sanitize_never_merges(spark):
    keys = ["Ab!c", "Abc", "Ab?c", "Abc1", "x!", "x?", "!!", "\u00e9t"]
    e = entries(spark, [(i, f"f{i % 2}", k, {"a": "b"}) for i, k in enumerate(keys)] + [(8, "z", "Ab!c", {"a": "b"})])
    held = spark.createDataFrame([("p", "x")], "project string, key string")
    out, m = K.sanitize(e, held)
    new = {r["old_key"]: r["new_key"] for r in m.collect()}
    by_old = {k: new.get(k, k) for k in keys}
    assert by_old["Abc"] == "Abc" and by_old["!!"] == "!!" and by_old["\u00e9t"] == "t" and by_old["Abc1"] == "Abc1"
    assert len(set(by_old.values())) == len(keys) and "x" not in by_old.values()
    assert sorted(r["key"] for r in out.collect()) == sorted([*by_old.values(), by_old["Ab!c"]])


def test_standardize_by_file(spark):
    e = entries(spark, [(1, "a", "k1", SMITH), (2, "a", "k2", SMITH), (3, "a", "k3", SMITH), (4, "b", "k4", SMITH), (5, "b", "Smith2021JAn", SMITH), (6, "b", "none", {"x": "y"})])
    new = {r["pos"]: r["new_key"] for r in K.standardized_by_file(e).collect()}
    assert new == {0: "Smith2021JAn", 1: "Smith2021JAn1", 2: "Smith2021JAn2", 3: "Smith2021JAn", 4: "Smith2021JAn", 5: "none"}


def test_standardize_is_unique(spark):
    clash = SMITH | {"title": "An1 x"}
    rows = [(i, f"f{i % 3}", f"k{i}", clash if i % 5 == 0 else SMITH) for i in range(40)] + [(40, "f0", "k1", SMITH), (41, "f9", "plain", {"x": "y"})]
    out, m = K.standardize(entries(spark, rows))
    by_old = {}
    for r in out.collect():
        by_old.setdefault(rows[r["pos"]][2], set()).add(r["key"])
    assert all(len(v) == 1 for v in by_old.values())
    new = [next(iter(v)) for v in by_old.values()]
    assert len(set(new)) == len(new) and by_old["plain"] == {"plain"}
    assert m.count() == 40


def test_even_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id int, k string")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "n * 2 AS twice")
    for hot in (10, 10_000):
        out = join_even(rows, groups, "k", hot_rows=hot)
        assert out.count() == 300 and out.where("k = 'hot'").select("twice").distinct().head()[0] == 400
        assert join_even(rows, groups.select("k", "n"), "k", how="left_semi", hot_rows=hot).count() == 300


def test_even_join_on_structs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("p", "hot" if i % 3 else f"k{i}", i) for i in range(300)], "project string, key string, id int").withColumn("k", F.struct("project", "key"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("twice", F.col("n") * 2)
    out = join_even(rows, groups, "k", hot_rows=10)
    assert out.count() == 300 and out.where("key = 'hot'").select("twice").distinct().head()[0] == 400
    assert join_even(rows, groups.select("k", "n"), "k", how="left_semi", hot_rows=10).count() == 300


def test_operators_under_a_hot_key(spark, monkeypatch):
    """The same results whether a key counts as hot or not."""
    from refloom.operators import skew

    e = entries(spark, [(i, f"f{i % 4}", f"K{i % 3}", {"doi": "10.1/hot" if i % 2 else f"10.1/{i}", "title": "Same" if i % 3 else f"t{i}", "author": "Roe, A" if i == 17 else ""}) for i in range(60)])

    def outcome():
        return [sorted((r["entry_id"], r["key"], str(r["fields"])) for r in df.collect()) for df in (D.synchronize(e), D.consolidate_dois(e)[0], D.consolidate_titles(e)[0], K.standardize(e)[0])]

    plain = outcome()
    monkeypatch.setattr(skew.join_even, "__defaults__", ("n", "inner", 5, 1000))
    assert outcome() == plain
