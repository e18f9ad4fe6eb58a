"""Problem 9: filling containers of fixed capacity with documents.

Vector bin packing with the dot-product heuristic: a container has three limits
(tokens, segments, loss-bearing tokens); the next item put in is the one that fits
and whose demands have the largest weighted dot product with the room left, so
items that use what is plentiful come first. An item is cut only if it alone
exceeds the capacity; all its pieces but the last fill containers of their own.
A piece with more loss-bearing tokens than a container may hold is put in one alone.

Items are dealt evenly to shards of bounded size by a hash of their id, so no
source or programme can make a shard large; each shard is packed by itself.
Containers left poorly filled are opened again and their items packed once more
in far fewer, equally bounded shards, which leaves a few poor containers for each
million items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.token_ids import default_rank_file, encode_text, encoder
from refloom.runtime import cut_lineage, spread

SHARD_ITEMS = 4000
#: A container may hold one segment (a document or a piece of one) for each so many tokens of its capacity, two at least.
SEGMENT_TOKENS = 64
POOR = 0.98


def demands(documents: DataFrame, rank_file: str | None = None, capacities: tuple[int, ...] = ()) -> DataFrame:
    """``(doc_id, tokens, loss_tokens)``: loss is borne by tokens of lines that hold letters, not by times and numbers.

    A token belongs to the line in which it begins. With ``capacities`` there is also
    ``pieces``, what a document is cut into for each of them, with the counts of each piece.
    """
    rank_file = rank_file or default_rank_file()
    pieces = pa.list_(pa.struct([(c, pa.int32()) for c in ("capacity", "piece", "tokens", "loss_tokens")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        width = _byte_lengths(enc)
        for batch in batches:
            tokens, loss, cut = [], [], []
            for t in batch.column(1).to_pylist():
                borne = np.concatenate([[0], np.cumsum(_bears_loss(encode_text(enc, t), t, width))])
                n = len(borne) - 1
                tokens.append(n)
                loss.append(int(borne[n]))
                own = []
                for c in capacities:
                    ends = np.minimum(np.arange(-(-n // c) + 1) * c, n)
                    own += [{"capacity": c, "piece": i, "tokens": int(x), "loss_tokens": int(y)} for i, (x, y) in enumerate(zip(np.diff(ends), np.diff(borne[ends])))]
                cut.append(own)
            columns = {"doc_id": batch.column(0), "tokens": pa.array(tokens, pa.int32()), "loss_tokens": pa.array(loss, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | ({"pieces": pa.array(cut, pieces)} if capacities else {}))

    schema = "doc_id long, tokens int, loss_tokens int" + (", pieces array<struct<capacity:int,piece:int,tokens:int,loss_tokens:int>>" if capacities else "")
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def _byte_lengths(enc) -> np.ndarray:
    """The length in bytes of each id of a vocabulary."""
    out = np.zeros(enc.max_token_value + 1, dtype=np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def _bears_loss(ids: list[int], text: str | None, width: np.ndarray) -> np.ndarray:
    """For each token of a text whether it begins in a line with letters."""
    if not ids:
        return np.zeros(0, dtype=bool)
    lines = text.splitlines(keepends=True)
    ends = np.cumsum([len(x.encode()) for x in lines])
    spoken = np.array([any(c.isalpha() for c in x) for x in lines])
    w = width[ids]
    return spoken[np.searchsorted(ends, np.cumsum(w) - w, side="right")]


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item. ``sizes`` is items x 3, each within ``limits``; ties go to the first item.

    Items of equal demands are one kind, so a step costs the number of kinds.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return out
    kinds, inverse = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(kinds)))
    left = np.bincount(inverse, minlength=len(kinds))
    taken = np.zeros(len(kinds), dtype=np.int64)
    share = kinds / limits
    # Scarce dimensions weigh more: their total demand in containers.
    weights = np.maximum((share * left[:, None]).sum(axis=0), 1e-9)
    weights = weights / weights.sum()
    alive = np.arange(len(kinds))
    container = 0
    while len(alive):
        room = limits.astype(float).copy()
        fits = alive
        first = True
        while True:
            fits = fits[(kinds[fits] <= room).all(axis=1) & (left[fits] > 0)]
            if not len(fits):
                break
            gain = (share[fits] * weights) @ (room / limits)
            # The first item of a container is the largest, later ones follow the dot product.
            at = fits[int(np.argmax(share[fits] @ weights if first else gain))]
            first = False
            out[order[starts[at] + taken[at]]] = container
            taken[at] += 1
            left[at] -= 1
            room -= kinds[at]
        container += 1
        alive = alive[left[alive] > 0]
    return out


def limits_of(capacity: int, segment_tokens: int, loss_share: float) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens that a container may hold."""
    return capacity, max(2, capacity // segment_tokens), max(1, math.floor(capacity * loss_share))


def _shards(items: DataFrame, rows: int, name: str) -> DataFrame:
    n = max(1, math.ceil(rows / SHARD_ITEMS))
    return items.withColumn(name, F.pmod(F.xxhash64("doc_id", "piece", "pack_name", F.lit(name)), F.lit(n)).cast("int"))


def _packed(items: DataFrame, shard: str, prefix: str, segment_tokens: int, loss_share: float) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        limits = np.array(limits_of(capacity, segment_tokens, loss_share))
        sizes = np.stack([pdf["tokens"], np.ones(len(pdf), dtype=np.int64), pdf["loss_tokens"]], axis=1).astype(np.int64)
        number = pack(sizes, limits)
        pdf["container"] = [f"{prefix}{capacity}-{key[2]}-{c}" for c in number]
        # A container is as full as the fullest of its limits.
        pdf["filled"] = (pd.DataFrame(sizes).groupby(number).transform("sum").to_numpy() / limits).max(axis=1)
        return pdf[["pack_name", "capacity", "doc_id", "piece", "tokens", "loss_tokens", "container", "filled"]]

    schema = "pack_name string, capacity int, doc_id long, piece int, tokens int, loss_tokens int, container string, filled double"
    return items.groupBy("pack_name", "capacity", shard).applyInPandas(run, schema)


def fill_containers(documents: DataFrame, packs: DataFrame, rank_file: str | None = None, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = 1.0) -> DataFrame:
    """``(pack_name, container, doc_id, piece, start_token, tokens, loss_tokens)``: where each piece of each document goes.

    ``piece`` is 0 unless the document exceeds the capacity; ``start_token`` is
    where the piece begins in the document's ids. Empty and NULL texts have no
    tokens and take no room, so they go nowhere. A container holds one segment for
    each ``segment_tokens`` of its capacity and loss-bearing tokens up to
    ``loss_share`` of it; a piece whose own loss exceeds that has a container to itself (named x), as has
    one of the whole capacity (named w), and its loss is counted in full. Packs of NULL or no capacity are left out; an empty table of documents fills nothing.
    """
    spark = documents.sparkSession
    sizes = [(r["pack_name"], int(r["capacity"])) for r in packs.where("capacity > 0").select("pack_name", "capacity").distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], "pack_name string, container string, doc_id long, piece int, start_token long, tokens int, loss_tokens int")
    measured = cut_lineage(demands(documents, rank_file, tuple(sorted({c for _, c in sizes}))).where("tokens > 0"))
    rows = measured.count()
    named = F.broadcast(spark.createDataFrame(sizes, "pack_name string, capacity int"))
    items = measured.select("doc_id", F.explode("pieces").alias("c")).select("doc_id", "c.*").join(named, "capacity").select("doc_id", "pack_name", "capacity", "piece", "tokens", "loss_tokens")
    alone = lambda kind: F.concat_ws("-", F.concat(F.lit(kind), F.col("capacity").cast("string")), "doc_id", "piece")
    over = F.col("loss_tokens") > F.greatest(F.lit(1), F.floor(F.col("capacity") * F.lit(float(loss_share))))
    single = items.where((F.col("tokens") == F.col("capacity")) | over).withColumn("container", F.when(F.col("tokens") == F.col("capacity"), alone("w")).otherwise(alone("x")))
    first = cut_lineage(_packed(_shards(items.where((F.col("tokens") < F.col("capacity")) & ~over), rows, "s1"), "s1", "a", segment_tokens, loss_share))
    poor = first.where(F.col("filled") < POOR)
    again = _packed(_shards(poor, poor.count(), "s2"), "s2", "b", segment_tokens, loss_share)
    columns = ["pack_name", "container", "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("start_token"), "tokens", "loss_tokens"]
    return single.select(*columns).unionByName(first.where(F.col("filled") >= POOR).select(*columns)).unionByName(again.select(*columns))


def packing_report(filled: DataFrame, packs: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = 1.0) -> DataFrame:
    """``(pack_name, containers, pieces, tokens, fill, at_tokens, at_segments, at_loss)``: how well the containers of each capacity are filled.

    The last three say how many containers come within a fiftieth of each limit, or beyond it.
    """
    held = filled.groupBy("pack_name", "container").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss"))
    named = F.broadcast(packs.select("pack_name", "capacity").distinct())
    c = F.col("capacity")
    most = {"tokens": c, "segments": F.greatest(F.lit(2), F.floor(c / segment_tokens)), "loss": F.greatest(F.lit(1), F.floor(c * loss_share))}
    near = [F.count_if(F.col(n) >= POOR * most[n]).alias(f"at_{n}") for n in most]
    sums = [F.count(F.lit(1)).alias("containers"), F.sum("segments").alias("pieces"), F.sum("tokens").alias("tokens")]
    r = held.join(named, "pack_name").groupBy("pack_name", "capacity").agg(*sums, *near)
    return r.withColumn("fill", F.col("tokens") / (F.col("containers") * c)).drop("capacity")
