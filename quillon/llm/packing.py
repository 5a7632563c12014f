"""Vector best-fit packing of token pieces into sequences.

A document is its token ids and one end token. Only documents longer than a sequence are
cut, from the end, so that the first piece alone may be shorter. Pieces that fill a
sequence are one by themselves. The others are dealt by a hash into shards of a bounded
expected size, largest pieces first within a shard; of the open sequences that have room in
every dimension (tokens, documents, attention cost), a piece goes to the one by which the
weighted norm of the residual capacities becomes smallest (or whose residual vector has the
largest weighted dot product with the piece's needs). A shard holds thousands of pieces,
after which the share of empty places no longer falls with its size.

Edge cases: a null or empty text is one piece of just the end token, null doc_ids are kept,
repeated rows are packed each (row_key tells them apart), extra columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, tidy, written
from .tokenizer import encoder, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(tokenizer: str, end_id: int, room: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).packed(texts(batch.column("text")))):
                ids += end
                n = len(ids) // 4
                start, stop, k = 0, n % room or min(n, room), 0
                while start < n:
                    for column, x in zip(out, (doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(x)
                    start, stop, k = stop, stop + room, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; needs are its tokens, 1 document, tokens squared."""
    order = np.argsort(-lengths, kind="stable")
    cap, weight = np.asarray(capacity, float), np.asarray(weights, float)
    left = np.empty((3, max(1, len(lengths))))
    ids = np.empty(max(1, len(lengths)), np.int64)
    used = np.zeros(max(1, len(lengths)), np.int64)
    sequence, offset, open_n, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, 0
    smallest = lengths.min() if len(lengths) else 0
    least = np.asarray([smallest, 1, smallest * smallest], float)
    for i in order:
        need = np.asarray([lengths[i], 1.0, float(lengths[i]) ** 2])
        now = left[:, :open_n]
        fits = (now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2])
        if fits.any():
            part = now / cap[:, None]
            if by == "norm":
                score = weight @ (part - (need / cap)[:, None]) ** 2
                at = int(np.argmin(np.where(fits, score, np.inf)))
            else:
                score = (weight * need / cap) @ part
                at = int(np.argmax(np.where(fits, score, -np.inf)))
        else:
            at, open_n = open_n, open_n + 1
            left[:, at], ids[at], used[at] = cap, made, 0
            made += 1
        sequence[i], offset[i] = ids[at], used[at]
        used[at] += lengths[i]
        left[:, at] -= need
        if (left[:, at] < least).any():  # no piece of this shard fits any more
            open_n -= 1
            left[:, at], ids[at], used[at] = left[:, open_n], ids[open_n], used[open_n]
    return sequence, offset


def pack_pieces(pieces: DataFrame, room: int = 1024, most_docs: int = 1024, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm", shard_pieces: int = 8192) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset. attention: the most that the squared
    lengths of a sequence may sum to; by default what one whole piece needs."""
    attention = float(room * room) if attention is None else attention
    if attention < room * room or most_docs < 1:
        raise ValueError("a whole piece must fit each capacity")
    shards = max(1, -(-pieces.where(F.col("length") < room).count() // shard_pieces))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
        sequence, pdf["offset"] = best_fit(pdf["length"].to_numpy(), (room, most_docs, attention), weights, by)
        pdf["sequence_id"] = pdf["shard"] * (1 << 32) + sequence
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    whole = pieces.where(F.col("length") >= room)
    whole = whole.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < room)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(shards)))
    return whole.unionByName(dealt.groupBy("shard").applyInPandas(shard, PACKED))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int = 1024) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(tidy(_cut(tokenizer, end_id, room)), PIECES)


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 2, room: int = 1024, **options) -> DataFrame:
    """Cut and pack ``docs``; the pieces are written once, so a lost executor can't deal anew."""
    return pack_pieces(written(cut_pieces(docs, tokenizer, end_id, room), "pieces"), room, **options)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
