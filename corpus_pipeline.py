"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity    documents that the classifier scores at 0.5 or more go
line_dedup  repeated multi-line chunks go, and documents of which nothing is left
near_dedup  one document of each class of near duplicates stays
mixing      each document is repeated as often as the source schedule takes it
packing     the pieces' places in sequences of 1024 tokens

All but the last return the columns of ``documents``. Nothing here is random: reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import WORD, table, written
from quillon.llm.line_dedup import line_dedup
from quillon.llm.mixing import mix
from quillon.llm.near_dedup import keep_one
from quillon.llm.packing import best_fit_packing
from quillon.llm.toxicity import fit_toxicity, reject_toxic

#: SQL can express neither the learned weights nor the hashes of the later stages.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup(docs).where((F.col("n_removed_lines") == 0) | F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    lengths = {"n_chars": F.when(F.col("n_removed_lines") > 0, F.char_length("text")).otherwise(F.col("kept.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **lengths}
    return kept.select(*(own.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    times = F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    taken = mix(docs).groupBy(F.struct("doc_id", "source", "key").alias("k")).agg(times.alias("times")).where("times > 0")
    rows = docs.select(F.struct("doc_id", "source", F.xxhash64("text").alias("key")).alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(taken, rows["k"].eqNullSafe(taken["k"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
