import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import token_ids as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.default_rank_file()), reason="no rank file here")


@pytest.fixture(scope="module")
def enc():
    return K.encoder(K.default_rank_file())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=200), st.integers(1, 40))
def test_pieces_give_the_ids_of_the_whole(text, size):
    enc = K.encoder(K.default_rank_file())
    assert K.encode_text(enc, text, size) == enc.encode_ordinary(text)


def test_blanks_and_long_text(enc):
    text = ("word  \n\n\t it's  don't 123abc  " * 20_000) + " " * 1000 + "end"
    assert K.encode_text(enc, text, 1000) == enc.encode_ordinary(text)
    assert "".join(K.pieces(text, 1000)) == text


def test_against_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    path = K.default_rank_file().replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in ("Hello, world!", "<|endoftext|>", "Über  façade \U0001f600", "  \n x", ""):
        assert K.encode_text(enc, text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "\U0001f600 é"), (4, "\U0001f600 é"), (5, "a " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS ids", "1 AS k")
    out = K.encode_corpus(df).collect()
    by = {r["doc_id"]: r["ids"] for r in out}
    assert len(out) == 6 and by[2] == [] and by[3] == [] and by[1] == [15496, 995]
    back = {r["doc_id"]: r["text"] for r in K.decode_corpus(K.encode_corpus(df)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "\U0001f600 é", 5: "a " * 100_000}
    assert {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df).collect()} == {i: len(v) for i, v in by.items()}
    assert K.encode_corpus(df.limit(0)).count() == 0
