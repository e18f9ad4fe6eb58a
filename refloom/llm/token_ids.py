"""Problem 8: encoding a corpus with a public tokenizer.

The vocabulary is a local rank file whose path is a parameter. It is read once
in each Python worker. Texts travel as Arrow batches; the ids come back as one
flat buffer with offsets, without a Python object for each row.

Long texts are cut before a blank that follows a non-blank. In the pattern of
the byte-level vocabularies no pre-token crosses such a place (a pre-token may
begin with a blank, but never holds one after a non-blank) and the one
look-ahead of the pattern only looks right of blanks, so the ids of the pieces
joined are the ids of the whole text.

Defined results: the empty text and the NULL text give an empty list.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from refloom.runtime import spread

#: Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 1 << 16
#: So many ids go into one batch at most, far below what its offsets can hold.
BATCH_IDS = 1 << 26
_CUT = re.compile(r"(?<=\S)(?=[ \n\t])")
_CACHE: dict[str, object] = {}


def default_rank_file(name: str = "byte_bpe_50k") -> str:
    """Where the box keeps a public rank file; REFLOOM_TOKENIZERS overrides the folder."""
    return os.path.join(os.environ.get("REFLOOM_TOKENIZERS", "/opt/tokenizers"), f"{name}.tiktoken")


def encoder(rank_file: str):
    """The tokenizer of a rank file, made once in a process."""
    if rank_file not in _CACHE:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
        _CACHE[rank_file] = tiktoken.Encoding(os.path.basename(rank_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[rank_file]


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe places into pieces of about ``piece_chars``."""
    at = 0
    while len(text) - at > piece_chars:
        cut = _CUT.search(text, at + piece_chars)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str | None, piece_chars: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, piece_chars):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def decode_bytes(enc, ids) -> bytes:
    """The raw bytes of ids; a token may hold a part of a character, so bytes come first."""
    return enc.decode_bytes(list(ids))


def _slices(sizes: list[int], most: int = BATCH_IDS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with ``most`` ids together at most, or of a single row."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if sizes:
        yield begin, len(sizes)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    """Lists of ids as one flat buffer with offsets."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a text has more ids than a list of 32-bit offsets can hold")
    flat = np.empty(int(offsets[-1]), dtype=np.int32)
    for r, a in zip(rows, offsets):
        flat[a : a + len(r)] = r
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(key, ids)`` of each row of ``df``: no shuffle, one pass, any other columns are ignored.

    Empty and NULL texts give an empty list; repeated rows come out repeated.
    """
    rank_file = rank_file or default_rank_file()
    source = spread(df.select(df[key].alias("k"), df[text].alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            rows = [encode_text(enc, t, piece_chars) for t in batch.column(1).to_pylist()]
            keys = batch.column(0)
            for begin, end in _slices([len(r) for r in rows]):
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), _lists(rows[begin:end])], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", rank_file: str | None = None) -> DataFrame:
    """``(key, text)`` from ids; bytes that are no UTF-8 (ids cut inside a character) become U+FFFD. NULL ids give NULL."""
    rank_file = rank_file or default_rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            out = [None if x is None else decode_bytes(enc, x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(df[key].alias("k"), df[ids].alias("i")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """``(key, n_tokens)`` of each row; 0 for empty and NULL texts."""
    rank_file = rank_file or default_rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            n = [len(encode_text(enc, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])
    return spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, schema)
