"""Faulty submissions by state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(name: str, rows: DataFrame) -> DataFrame:
    """A constant group: no row at all where there is nothing to count."""
    return rows.groupBy(F.lit(name).alias("state")).agg(F.count(F.lit(1)).alias("count"))


def derived_submission(t: Mapping[str, DataFrame], now: int, grace: int = 2 * 3600) -> DataFrame:
    """state, count: unfinished (old and not completed), empty (no device, completed or not),
    unreferenced (no attribution)."""
    s = t["submission"]
    unfinished = s.where(F.col("completed_at").isNull() & (F.col("created_at") < now - grace))
    empty = s.join(t["attribution_device"].select(F.col("submission_id").alias("id")), "id", "left_anti")
    unreferenced = s.join(t["attribution_submission"].select(F.col("submission_id").alias("id")), "id", "left_anti")
    return _state("unfinished", unfinished).unionByName(_state("empty", empty)).unionByName(_state("unreferenced", unreferenced))
