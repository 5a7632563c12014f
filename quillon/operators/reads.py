"""The staging read queries as functions of the tables (a mapping of name to DataFrame)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import tri_state, unordered_between

Tables = Mapping[str, DataFrame]


def one(df: DataFrame):
    """The only row, or None; more than one is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def submissions_by_range(t: Tables, a: int, b: int, complete: bool | None = None) -> DataFrame:
    """Newest first; the id breaks ties."""
    return t["submission"].where(unordered_between("created_at", a, b) & tri_state("completed_at", complete)).orderBy(F.desc("created_at"), "id")


def attributions_by_range(t: Tables, a: int, b: int) -> DataFrame:
    return t["attribution_submission"].where(unordered_between("created_at", a, b)).orderBy(F.desc("created_at"), "id")


def devices_of(t: Tables, submission_id) -> DataFrame:
    own = t["attribution_device"].where(F.col("submission_id") == submission_id).select(F.col("device_id").alias("id"))
    return t["device"].join(own, "id").select("id", "integration", "manufacturer", "model", "model_id")


def permutations_of(t: Tables, submission_id) -> DataFrame:
    own = t["attribution_permutation"].where(F.col("submission_id") == submission_id).select(F.col("permutation_id").alias("id"))
    return t["permutation"].join(own, "id").select("id", "device_id", "entry_type", "has_configuration_url", "version_sw", "version_hw")


def links_of(t: Tables, submission_id) -> DataFrame:
    own = t["attribution_link"].where(F.col("submission_id") == submission_id).select(F.col("link_id").alias("id"))
    return t["link"].join(own, "id").select("id", "parent_id", "child_id")


def entities_of(t: Tables, submission_id, permutation_id) -> DataFrame:
    """Distinct: a permutation's set may be attributed to a submission several times."""
    sets = t["entity_set"].where(F.col("permutation_id") == permutation_id).select(F.col("id").alias("set_id"))
    there = t["attribution_set"].where(F.col("submission_id") == submission_id).select("set_id")
    ids = t["entity_set_content"].join(sets, "set_id").join(there, "set_id", "left_semi").select(F.col("entity_id").alias("id"))
    return t["entity"].join(ids, "id", "left_semi")


def compositions_of(t: Tables, permutation_id) -> DataFrame:
    """For each entity set of the permutation the number of submissions with it, and its
    entities. A set without members has no row."""
    sets = t["entity_set"].where(F.col("permutation_id") == permutation_id).select(F.col("id").alias("set_id"))
    counts = t["attribution_set"].join(sets, "set_id", "left_semi").groupBy("set_id").agg(F.countDistinct("submission_id").alias("count"))
    fields = ["id", "domain", "assumed_state", "has_name", "category", "original_device_class", "unit_of_measurement"]
    members = t["entity_set_content"].join(sets, "set_id", "left_semi").join(t["entity"].withColumnRenamed("id", "entity_id"), "entity_id")
    members = members.withColumnRenamed("entity_id", "id").groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("entities"))
    return counts.join(members, "set_id").select("set_id", "count", "entities")


def count_of(t: Tables, name: str) -> DataFrame:
    return counted(t[name])


def distinct_count_of(t: Tables, name: str, column: str) -> DataFrame:
    """Null counts as a value."""
    return counted(t[name].select(column).distinct())


def grouped_count(t: Tables, name: str, *columns: str) -> DataFrame:
    """Null forms a group; the largest first, then by the columns."""
    return t[name].groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *columns)


def by_key(t: Tables, name: str, column: str, value) -> DataFrame:
    return t[name].where(F.col(column) == value)


def labelled_gauge(t: Tables, name: str, *columns: str) -> DataFrame:
    """Grouped counts with a label for null."""
    return t[name].groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("<unknown>")).alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("count"))
