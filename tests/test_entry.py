import ast
import pathlib

import pytest

import __spark_entry__ as entry_points
import refloom

ROOT = pathlib.Path(refloom.__file__).parent


def test_public_names():
    assert all(callable(getattr(refloom, n)) for n in refloom.__all__ if n != "__version__")
    with pytest.raises(AttributeError):
        refloom.nothing  # noqa: B018


def test_queries_and_sql():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_flagship(spark, sf):
    df = entry_points.entry(spark)
    assert df.columns == ["project", "file", "n_missing"] and df.count() > 0


def test_the_subpackage_is_not_needed():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("refloom.llm" in (n or "") for n in names), path


@pytest.mark.parametrize("name", ["s1_parse_bibtex", "n5_title", "x1_citations", "a2_duplicate_dois", "d3_consolidate_titles", "f4_percent", "j4_unused"])
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    mine = entry_points.queries()[name](spark, sf)
    columns = sorted(mine.columns)
    rows = sorted(tuple(map(str, (r[c] for c in columns))) for r in mine.collect())
    out = con.execute(entry_points.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == columns
    assert rows == sorted(tuple(str(r[at[c]]) for c in columns) for r in out.fetchall())
