"""Backfills for rows of earlier layouts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import content_id
from ..functions.hashing import serialised, set_identity


def version0_hashes(t: Mapping[str, DataFrame]) -> DataFrame:
    """submission_id, hash: digest over the ids of its permutations, then of its links, then of
    its sets (a bag), each in ascending order. A submission has few of each."""
    rows = None
    for k, (name, column) in enumerate((("attribution_permutation", "permutation_id"), ("attribution_link", "link_id"), ("attribution_set", "set_id"))):
        part = t[name].select("submission_id", F.struct(F.lit(k).alias("k"), F.col(column).alias("id")).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    ids = rows.groupBy("submission_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    all_ = t["submission"].select(F.col("id").alias("submission_id")).join(ids, "submission_id", "left")
    text = F.coalesce(F.array_join(F.transform("x", lambda x: x["id"]), ""), F.lit(""))
    return all_.select("submission_id", serialised(F.sha2(text, 256), 0).alias("hash"))


def sets_from_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pairs``: submission_id, permutation_id, entity_id, one row per pair as once stored.
    Returns entity_set, entity_set_content and attribution_set rows."""
    members = pairs.groupBy("submission_id", "permutation_id").agg(F.array_sort(F.collect_set("entity_id")).alias("members"))
    sets = members.withColumn("hash", set_identity(F.col("members"))).withColumn("id", content_id("entity_set", "hash", "permutation_id"))
    attributed = sets.select(content_id("attribution_set", "submission_id", "id").alias("key"), "submission_id", F.col("id").alias("set_id")).withColumnRenamed("key", "id")
    content = sets.select(F.col("id").alias("set_id"), F.explode("members").alias("entity_id")).distinct()
    return sets.select("id", "hash", "permutation_id").distinct(), content, attributed
