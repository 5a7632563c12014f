"""What the training-data operators share: words, hashes, the shared scratch folder.

Words are runs of ``[^\\x20\\x09-\\x0D]`` taken from the UTF-8 bytes; ``bytes.split()``
splits at exactly those six bytes, and ``WORD`` is the same rule for Spark's functions.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
_local_root: list[str] = []
_remembered: list[weakref.ref] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets one temporary folder for the process; any
    other master is refused, because a machine-local folder isn't seen by its executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="quillon-"))
    return _local_root[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own under this application's part of the shared folder. The caller's
    results may read it lazily, so it stays until ``drop_scratch`` or until the owner of the
    folder empties it."""
    return f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, and no other's; its results that are not yet
    written are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most_bytes`` of a text column, or one text.

    What a task holds in Python at a time is bounded by the bytes, not by the rows; the batches
    themselves are bounded by spark.sql.execution.arrow.maxBytesPerBatch. No setting of the
    caller's session is touched, and a whole text is never split."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Forget remembered words, and return freed memory to the system where the C library can."""
    for found in _remembered:
        words = found()
        if words is not None:
            words.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task``, after which a Python worker is as small as before. Workers are used again by
    the stages that follow, which would otherwise add what each of them remembers."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def identity(text: str | Column = "text") -> tuple[Column, Column]:
    """r1, r2: 128 bits that tell apart rows which share a doc_id (equal for equal texts)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(0x5EED), text).alias("r2")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 1 << 18):
        super().__init__()
        self.seed, self.most = seed, most
        _remembered.append(weakref.ref(self))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * _A + mix(b + _A))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, by doubling: 1, 2, 4 ... and a last overlapping pair."""
    if len(words) < n:
        return words[:0]
    have, size = words, 1
    while size * 2 <= n:
        have, size = pair(have[:-size], have[size:]), size * 2
    if size < n:
        have = pair(have[: len(have) - (n - size)], have[n - size :])
    return have
