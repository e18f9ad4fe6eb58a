import datetime as dt
import random

from helpers import entries
from pyspark.sql import functions as F

from refloom.llm import survivor as S

T0 = dt.datetime(2020, 1, 1)


def rows_of(spec):
    return [{"entry_id": i, "key_raw": k, "fields": f, "modified_at": t} for i, k, f, t in spec]


def test_fields_come_from_the_latest_whole_value(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    e = entries(spark, rows_of([
        (1, "Smith2020Peat", {"doi": "10.1/x", "title": "Peat bogs in spring", "author": "A Smith and B Roe", "year": "2020", "pages": "1--2"}, day(1)),
        (2, "smith_2020", {"DOI": "doi:10.1/X", "title": "Peat bogs", "author": "A Smith and others", "year": "n/a", "journal": "J"}, day(2)),
        (3, "Smith2020", {"Doi": " https://doi.example/10.1/x ", "title": "peat BOGS...", "author": "A Smith", "pages": "in press", "volume": "7"}, day(3)),
        (4, "Other2020", {"doi": "10.1/y", "title": "alone"}, day(3)),
        (5, "K2020", {"doi": " "}, day(3)), (6, "K2020", {"doi": ""}, day(3)), (7, "K2020", {"doi": "none"}, day(3)), (8, "K2020", {"doi": "none"}, day(3)),
    ]))
    got = {(r["group_id"], r["field"]): r["entry_id"] for r in S.best_values(e.selectExpr("*", "pos AS group_id", "file AS doi")).collect()}
    assert got == {(1, "ID"): 3, (1, "title"): 1, (1, "author"): 1, (1, "year"): 1, (1, "pages"): 1, (1, "journal"): 2, (1, "volume"): 3}
    record = S.survivors(e).head()
    assert record["key"] == "Smith2020" and record["fields"] == {"title": "Peat bogs in spring", "author": "A Smith and B Roe", "year": "2020", "pages": "1--2", "journal": "J", "volume": "7"}


def test_ties_nulls_and_repeated_rows(spark):
    f = {"doi": "10.1/x", "title": "T"}
    e = entries(spark, rows_of([(1, None, f, T0), (2, "", f, T0), (3, "x", f, None), (4, "x", {"doi": "10.1/z", "title": None}, None), (5, "x", {"doi": "10.1/z"}, None)]))
    assert {tuple(r) for r in S.best_values(e).collect()} == {(1, "title", 2)}
    twice = e.unionByName(e)
    assert {tuple(r) for r in S.best_values(twice).collect()} == {(1, "title", 2)}
    assert S.best_values(e.limit(0)).count() == 0


def test_skyline_against_brute_force(spark):
    rng = random.Random(3)
    groups = [[(rng.randrange(8), T0 + dt.timedelta(days=rng.randrange(4)), i) for i in range(12)] for _ in range(20)]
    df = spark.createDataFrame([(g, [x for x in v]) for g, v in enumerate(groups)], "g int, v array<struct<mask:int,modified_at:timestamp,entry_id:int>>")

    def undominated(v):
        return {x[2] for x in v if not any((y[0] & x[0]) == x[0] and (y[1], y[2]) > (x[1], x[2]) for y in v)}

    for r in df.select("g", "v", S.layers(F.col("v"), 3).alias("l")).collect():
        left = groups[r["g"]]
        for layer in r["l"]:
            assert {x["entry_id"] for x in layer} == undominated(left)
            left = [x for x in left if x[2] not in {y["entry_id"] for y in layer}]
        for bit in range(3):
            best = max(((x[1], x[2]) for x in groups[r["g"]] if x[0] >> bit & 1), default=None)
            assert best is None or best[1] in {x["entry_id"] for x in r["l"][0]}


def test_hot_group(spark):
    rows = [(i, f"Key{2000 + i % 9}", {"doi": "10.1/hot" if i % 3 else f"10.1/{i}", "title": "Peat bogs in spring" if i % 2 else "Peat bogs", "year": str(i)}, T0 + dt.timedelta(hours=i)) for i in range(600)]
    got = {r["field"]: r["entry_id"] for r in S.best_values(entries(spark, rows_of(rows))).collect()}
    assert got == {"ID": 599, "title": 599, "year": 599}


def test_very_long_values(spark):
    f = {"doi": " " * 50_000 + "10.1/x", "title": "word " * 5_000 + "end", "author": "A Bee and " * 3_000 + "others", "pages": " " * 50_000}
    e = entries(spark, rows_of([(1, "k", f, T0), (2, "l", f | {"title": "word " * 4_000}, T0 + dt.timedelta(1))]))
    assert {tuple(r) for r in S.best_values(e).collect()} == {(1, "title", 1)}


def test_records_hold_every_field_of_every_group(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    e = entries(spark, [r | {"entry_type": t} for r, t in zip(rows_of([
        (1, "Smith2020Peat", {"doi": "10.1/x", "title": "Peat", "year": "2020", "Keywords": "bog, peat", "note": "old", "url": " "}, day(1)),
        (2, "?", {"DOI": "10.1/X", "title": "Peat", "keywords": "n/a", "note": "new", "month": "tba"}, day(2)),
        (3, "a b", {"doi": "10.1/y", "title": "Bogs in the early ...", "author": "A Roe et al."}, day(1)),
        (4, "-", {"doi": "10.1/y", "title": "Bogs ..."}, day(2)),
        (5, None, {"doi": "10.1/z"}, day(1)), (6, "", {"doi": "10.1/z", "file": "f"}, None),
        (7, "K2020", {"doi": "10.1/alone", "title": "t"}, day(1)),
    ]), ("article", "misc", "book", "misc", None, "thesis", "misc"))])
    got = {r["group_id"]: (r["key"], r["entry_type"], r["fields"]) for r in S.records(e.unionByName(e.where("entry_id = 1"))).collect()}
    assert got == {
        1: ("Smith2020Peat", "article", {"doi": "10.1/X", "title": "Peat", "year": "2020", "keywords": "bog, peat", "note": "new", "month": "tba"}),
        3: ("a b", "misc", {"doi": "10.1/y", "title": "Bogs in the early ...", "author": "A Roe et al."}),
        5: (None, "thesis", {"doi": "10.1/z", "file": "f"}),
    }


def test_later_layers_fill_what_the_first_leaves_null(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        (1, "Smith2020", {"doi": "10.1/x", "title": "Peat", "year": "2020"}, day(9)),  # over all others
        (2, "?", {"doi": "10.1/x", "title": "Peat", "note": "of the second layer", "month": "n/a"}, day(3)),
        (3, "?", {"doi": "10.1/x", "note": "of the third", "month": "may"}, day(2)),
    ]
    r = S.records(entries(spark, rows_of(rows))).head()
    assert r["fields"] == {"doi": "10.1/x", "title": "Peat", "year": "2020", "note": "of the second layer", "month": "may"}
    # A trusted record can't be dominated by one that is less trusted, so its note comes first though it is older.
    late = [dict(x, ingested_at=day(900) if x["entry_id"] < 3 else day(5)) for x in rows_of(rows)]
    assert S.records(entries(spark, late)).head()["fields"]["note"] == "of the third"
    assert {tuple(x) for x in S.best_values(entries(spark, late)).collect()} == {tuple(x) for x in S.best_values(entries(spark, rows_of(rows))).collect()}
    assert S.records(entries(spark, late), trust=F.lit(0)).head()["fields"]["note"] == "of the second layer"
