"""Running means of how long queries take, and which run was slow."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_MEAN, FIRST_LIMIT = 0.010, 10.0


@dataclass
class Latencies:
    """Mean and number of runs by query name."""

    means: dict[str, tuple[float, int]] = field(default_factory=dict)
    slow: list[tuple[str, float]] = field(default_factory=list)

    def limit(self, name: str) -> float:
        """Twice the mean so far (of at least 10 ms); 10 s before there is one."""
        return 2 * max(LEAST_MEAN, self.means[name][0]) if name in self.means else FIRST_LIMIT

    def observe(self, name: str, seconds: float) -> bool:
        """Whether the run was slow, by what was known before it."""
        slow = seconds > self.limit(name)
        mean, count = self.means.get(name, (0.0, 0))
        self.means[name] = (mean + (seconds - mean) / (count + 1), count + 1)
        if slow:
            self.slow.append((name, seconds))
        return slow

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        started = time.perf_counter()
        yield
        self.observe(name, time.perf_counter() - started)


def running_means(runs: DataFrame) -> DataFrame:
    """``runs``: name, at, seconds. Adds the mean up to and with each run, and whether it was
    slow by the mean before it."""
    order = W.partitionBy("name").orderBy("at", "seconds")
    mean = F.avg("seconds").over(order.rowsBetween(W.unboundedPreceding, 0))
    before = F.avg("seconds").over(order.rowsBetween(W.unboundedPreceding, -1))
    limit = F.when(before.isNull(), FIRST_LIMIT).otherwise(2 * F.greatest(F.lit(LEAST_MEAN), before))
    return runs.withColumn("mean", mean).withColumn("slow", F.col("seconds") > limit)
