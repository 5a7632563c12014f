"""Submission documents from the normalised tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import unquoted
from ..storage import cut


def reconstruct(t: Mapping[str, DataFrame]) -> DataFrame:
    """submission_id and body: a map of integration to its devices, each with its entities.
    Instances of a permutation come as often as its set was attributed. The few entities are
    written first, so that their size is known and sets aren't dealt by them; whole devices are
    dealt once, by submission."""
    entity = F.struct("assumed_state", "domain", F.col("category").alias("entity_category"), F.col("has_name").alias("has_entity_name"), "original_device_class", "unit_of_measurement")
    members = t["entity_set_content"].join(cut(t["entity"]).withColumnRenamed("id", "entity_id"), "entity_id").groupBy("set_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    sets = t["entity_set"].select(F.col("id").alias("set_id"), "permutation_id").join(members, "set_id", "left")
    permutations = t["permutation"].withColumnRenamed("id", "permutation_id").join(t["device"].withColumnRenamed("id", "device_id"), "device_id")
    instances = t["attribution_set"].select("submission_id", "set_id").join(sets, "set_id").join(permutations, "permutation_id")
    empty = F.array().cast(members.schema["entities"].dataType)
    device = F.struct(F.coalesce("entities", empty).alias("entities"), "entry_type", "has_configuration_url", unquoted("version_sw").alias("sw_version"), unquoted("version_hw").alias("hw_version"), "manufacturer", "model_id", "model")
    parts = instances.select("submission_id", "integration", device.alias("device")).repartition("submission_id").groupBy("submission_id", "integration").agg(F.array_sort(F.collect_list("device")).alias("devices"))
    return parts.groupBy("submission_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("integration", F.struct("devices"))))).alias("body"))
