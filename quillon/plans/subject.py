"""Activity of subjects: how often each came within a window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def derived_subject(t: Mapping[str, DataFrame], now: int, window: int = 25 * 3600) -> DataFrame:
    """subject, streak. Of subjects seen after now - window, all submissions that follow another
    one by at most the window, as ``previous - current <= window``: that holds for every
    follower, so the streak is the number of submissions less one, and a subject with a single
    submission has no row."""
    seen = t["attribution_submission"].select("subject", "created_at")
    active = seen.where(F.col("created_at") >= now - window).select("subject")
    before = F.lag("created_at").over(W.partitionBy("subject").orderBy("created_at"))
    followed = seen.join(active, "subject", "left_semi").withColumn("previous", before)
    return followed.where(F.col("previous") - F.col("created_at") <= window).groupBy("subject").agg(F.count(F.lit(1)).alias("streak"))


def bounded_streak(t: Mapping[str, DataFrame], now: int, window: int = 25 * 3600, gap: int | None = None) -> DataFrame:
    """As ``derived_subject``, but followers count only within ``gap`` (the window) of the one before."""
    seen = t["attribution_submission"].select("subject", "created_at")
    active = seen.where(F.col("created_at") >= now - window).select("subject")
    before = F.lag("created_at").over(W.partitionBy("subject").orderBy("created_at"))
    followed = seen.join(active, "subject", "left_semi").withColumn("previous", before)
    return followed.where(F.col("created_at") - F.col("previous") <= (window if gap is None else gap)).groupBy("subject").agg(F.count(F.lit(1)).alias("streak"))
