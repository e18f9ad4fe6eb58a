import re
import unicodedata

from helpers import one_column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refloom.functions import keys, normalize as N


def test_doi(spark):
    given_ = ["  DOI:10.1000/XYZ ", "doi:10.1/a", "http://dx.doi.org/10.1/a", "https://doi.org/10.1/a", "http://doi.org/10.1/a", "doi:", None, "", "   "]
    assert one_column(spark, given_, N.normalize_doi) == ["10.1000/xyz", "10.1/a", "10.1/a", "10.1/a", "http://doi.org/10.1/a", "", None, None, None]


def test_nfc(spark):
    assert one_column(spark, ["E\u0301", "", None, "a"], N.normalize_unicode) == ["\u00c9", None, None, "a"]


def test_url(spark):
    assert one_column(spark, [" HTTP://EXAMPLE.COM/path ", "", None, "no scheme"], N.normalize_url) == ["http://EXAMPLE.COM/path", None, None, "no scheme"]


def test_keywords(spark):
    assert one_column(spark, ["Physics, Chemistry,  math ", " , ,", None, ""], N.normalize_keywords) == ["physics,chemistry,math", None, None, None]


def test_title(spark):
    given_ = ["{A} Title---with  {Hyphens} and {SPACES}", "A \u2013 Title", None, "", "Dots. Stay!"]
    assert one_column(spark, given_, N.normalize_title) == ["a title with hyphens and spaces", "a title", "", "", "dots. stay!"]


def _python_title(t):
    t = re.sub(r"[{}]", "", t or "")
    t = re.sub("[-\u2013\u2014]+", " ", t)
    return re.sub(r"\s+", " ", t).strip().lower()


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\u0130\u03a3\x00"), max_size=30), min_size=50, max_size=80))
def test_title_against_python_and_idempotent(spark, values):
    out = one_column(spark, values, N.normalize_title)
    assert out == [_python_title(v) for v in values]
    assert one_column(spark, out, N.normalize_title) == [_python_title(v) for v in out]


def test_scores(spark):
    ks = ["smith2020", "X", "a_bad_key", "lowercase", "Uppercase", "Smith2020", "Smith2020long"]
    s = dict(zip(ks, one_column(spark, ks, N.key_score)))
    assert max(ks[:3], key=s.get) == "X" and max(ks[3:5], key=s.get) == "Uppercase" and max(ks[5:], key=s.get) == "Smith2020"
    df = spark.createDataFrame([({"title": "t", "author": "a"}, 4), ({"title": "t", "author": ""}, 4)], "fields map<string,string>, n int")
    assert [r[0] for r in df.select(N.entry_score("fields", "n")).collect()] == [2 + 0.1 * 4, 1 + 0.1 * 4]


def test_citation_key(spark):
    rows = [
        {"author": "Doe, Jane and Roe, R.", "year": "2020", "journal": "Science Advances", "title": "Quantum Mechanics"},
        {"author": "1234"},
        {"author": "", "title": "  "},
        {"year": "2020"},
        {"author": "Jane van Doe", "year": "{2020}", "title": "A-b c"},
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, fields map<string,string>")
    assert [r[1] for r in df.select("i", keys.citation_key(F.col("fields"))).orderBy("i").collect()] == ["Doe2020SAQuantum", "", "", "k2020", "Doe2020Ab"]


def test_sanitized(spark):
    assert one_column(spark, ["Bad!Key", "good_key", "!!", None], keys.sanitized) == ["BadKey", "good_key", "!!", None]


def test_forms_are_stable():
    assert unicodedata.normalize("NFC", "E\u0301") == "\u00c9"
