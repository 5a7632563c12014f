"""Token counts through a digest cache.

Each text's SHA-256 is joined, together with the tokenizer file's own digest, to stored
counts. Only digests without a count are encoded, once each, and then appended to the cache,
which lasts: the next run over the same texts encodes nothing. Rows are reduced to one text for
each (digest, doc_id) before they are shuffled, and of a digest only the smallest doc_id's is
encoded, so equal texts never meet in one task, however many there are.

Nulls and edge cases: a null text counts as empty, an empty text has 0 tokens, a null
doc_id is kept as it is, repeated rows each give a row, extra columns are ignored, an empty
table gives no rows. Line ends, case and code points are left alone: any other normalisation
could change a count. Two runs that append at once may store a count twice; it is read once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, shared_dir, table, written
from .tokenizer import encoder, texts

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def count(batches):
        for batch in portions(batches):
            n = [len(x) // 4 for x in encoder(path).packed(texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; an absent cache is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; new counts go to ``cache_path``."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text", F.coalesce("doc_id", F.lit(0)).alias("place"))
    digests = written(keyed.drop("text"), "digests")
    wanted = written(digests.groupBy("digest").agg(F.min("place").alias("place")), "wanted")
    misses = written(wanted.join(read_cache(spark, cache_path, version), "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        once = keyed.groupBy("digest", "place").agg(F.first("text").alias("text")).join(misses, ["digest", "place"])
        counted = once.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
        counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache_path)
    counts = written(read_cache(spark, cache_path, version).join(wanted, "digest", "left_semi"), "counts")
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder, where other runs find it."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/quillon-token-cache")
