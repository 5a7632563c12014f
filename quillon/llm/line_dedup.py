"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last few lines chooses chunk ends, so the same run of
lines is cut alike wherever it stands, but for its first lines. A chunk of two lines or more
whose bytes stood earlier (smaller doc_id, then earlier place) is removed: chunk digests find
the candidates, and each candidate's bytes are then compared with the first occurrence's.

The digests are reduced to a first occurrence by map-side aggregation; the candidates' bytes
meet the one first copy of each digest, written first, in a join that Spark can split where it
is hot.

Edge cases: a null text stays null and has 0 lines; an empty text has one empty line; chunks
without any word are never removed; rows with a null doc_id neither lose lines nor cause
removal; of rows that share a doc_id, equal chunks at the same place are equal occurrences and
stay; a line may be as long as it likes; extra columns are passed through untouched, except
that text is replaced; names that would clash are free to, as the working columns are nested.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, as_bytes, gram_hashes, identity, mix, portions, table, tidy, written

KEY = ["doc_id", "r1", "r2"]
ROW = "doc_id long, r1 long, r2 long"
CHUNKS = f"{ROW}, chunks array<struct<h:long,k:int>>"
LIST = T.ArrayType(T.IntegerType())
_lines = WordHash(seed=1, most=1 << 16)


def chunk_ends(lines: list[bytes], rolling: int, one_in: int, most: int) -> list[int]:
    """Ends (exclusive) of the chunks: after a line where the rolling hash says so, yet not
    after a single line, and after ``most`` lines at the latest (endless equal lines)."""
    if len(lines) <= 2:
        return [len(lines)]
    hashed = mix(gram_hashes(_lines.of(lines), rolling)) if len(lines) >= rolling else np.zeros(0, np.uint64)
    cut = np.flatnonzero(hashed % np.uint64(one_in) == 0) + rolling
    ends, last = [], 0
    for end in [*cut.tolist(), len(lines)]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= 2 or end == len(lines) > last:
            ends.append(end)
            last = end
    return ends


def chunks_of(text: bytes, rolling: int, one_in: int, most: int) -> list[bytes]:
    """The whole text, cut; joined by line ends they give it back."""
    lines, out, start = text.split(b"\n"), [], 0
    for end in chunk_ends(lines, rolling, one_in, most):
        out.append(b"\n".join(lines[start:end]))
        start = end
    return out


def removable(chunk: bytes) -> bool:
    return b"\n" in chunk and not chunk.isspace()


def _hash(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def _digests(how: tuple[int, int, int]):
    def digests(batches):
        for batch in portions(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                out.append([] if doc_id is None else [{"h": _hash(c), "k": k} for k, c in enumerate(chunks_of(text, *how)) if removable(c)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32())])))], [*KEY, "chunks"])

    return digests


def _bytes(how: tuple[int, int, int]):
    def bytes_of(batches):
        for batch in portions(batches):
            out: list[list] = [[], [], [], []]
            for i, (text, ks) in enumerate(zip(as_bytes(batch.column("text")), batch.column("ks").to_pylist())):
                chunks = chunks_of(text, *how)
                for k in ks:
                    for column, x in zip(out, (i, k, _hash(chunks[k]), chunks[k])):
                        column.append(x)
            rows, *columns = (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in KEY), *columns], [*KEY, "k", "h", "chunk"])

    return bytes_of


def _rest(how: tuple[int, int, int]):
    def rest(batches):
        for batch in portions(batches):
            texts, n_lines, gone = [], [], []
            for null, text, ks in zip(batch.column("text").is_null().to_pylist(), as_bytes(batch.column("text")), batch.column("gone").to_pylist()):
                chunks, drop = chunks_of(text, *how), set(ks or ())
                n_lines.append(0 if null else text.count(b"\n") + 1)
                gone.append(sum(chunks[k].count(b"\n") + 1 for k in drop))
                texts.append(None if null else text if not drop else b"\n".join(c for k, c in enumerate(chunks) if k not in drop))
            keep = [batch.column(c) for c in batch.schema.names if c not in ("text", "gone")]
            names = [c for c in batch.schema.names if c not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "text", "n_lines", "n_removed_lines"])

    return rest


def line_dedup(docs: DataFrame, rolling: int = 2, one_in: int = 2, most: int = 64) -> DataFrame:
    """The rows of ``docs`` as doc_id, text, kept (a struct of the other columns), n_lines, n_removed_lines."""
    how = (rolling, one_in, most)
    rows = docs.select("doc_id", *identity(), "text")
    digests = written(rows.mapInArrow(tidy(_digests(how)), CHUNKS), "line-chunks")
    chunks = digests.select(*KEY, F.inline("chunks"))
    first = written(chunks.groupBy("h").agg(F.min(F.struct("doc_id", "k")).alias("at"), F.count("*").alias("n")).where("n > 1").select("h", "at"), "line-first")
    candidates = chunks.join(first, "h").groupBy(*KEY).agg(F.collect_set("k").alias("ks"))
    repeated = written(rows.join(candidates, KEY).mapInArrow(tidy(_bytes(how)), f"{ROW}, k int, h long, chunk binary"), "line-bytes")
    copies = repeated.join(first, "h")
    at = F.struct("doc_id", "k")
    originals = written(copies.where(at == F.col("at")).groupBy("h").agg(F.min("chunk").alias("original")), "line-originals")
    same = copies.where(at > F.col("at")).join(originals, "h").where(F.col("chunk") == F.col("original"))
    gone = same.groupBy(*KEY).agg(F.collect_set("k").alias("gone")).select(F.struct(*KEY).alias("key"), "gone")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias("kept"), F.struct("doc_id", *identity()).alias("key"))
    joined = keyed.join(gone, "key", "left").select("doc_id", "kept", "text", "gone")
    schema = T.StructType([joined.schema["doc_id"], joined.schema["kept"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType())])
    return joined.mapInArrow(tidy(_rest(how)), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and the SHA-256 of what is kept."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
