"""A queue of delivered documents in a folder, taken in later.

``put`` writes a batch of deliveries as JSON lines beside the queue and renames it into place,
so a batch is there whole or not at all. ``drain`` ingests the waiting batches, oldest first;
what was ingested leaves the queue, what fails goes to the archive with the reason beside it.
While the queue is suspended deliveries are still accepted and none is taken in.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .ingest import EXPECTED_DELIVERY, ingest

PENDING, BUFFER, ARCHIVE, SUSPENDED = "submission", "submission-buffer", "submission-archive", "_suspended"


@dataclass(frozen=True)
class Outcome:
    batch: str
    ok: bool
    metrics: dict[str, int]
    error: str | None = None


class Deferred:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, prefix: str) -> list[str]:
        path, fs = self._path(prefix)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def _move(self, batch: str, source: str, target: str) -> None:
        there, fs = self._path(target)
        fs.mkdirs(there)
        if not fs.rename(self._path(source, batch)[0], self._path(target, batch)[0]):
            raise FileNotFoundError(f"{source}/{batch}")

    def put(self, deliveries: DataFrame) -> str:
        """Queue deliveries (EXPECTED_DELIVERY; expected_at may be missing); the batch's name."""
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        deliveries.write.option("ignoreNullFields", "true").json(f"{self.root}/{BUFFER}/{batch}")
        self._move(batch, BUFFER, PENDING)
        return batch

    def read(self, batch: str, prefix: str = PENDING) -> DataFrame:
        """Deliveries of a batch; lines without id or body aren't any."""
        return self.spark.read.schema(EXPECTED_DELIVERY).json(f"{self.root}/{prefix}/{batch}").where("id is not null and body is not null")

    def pending(self) -> int:
        return len(self._list(PENDING))

    def archived(self) -> int:
        return len(self._list(ARCHIVE))

    def complete(self, batch: str) -> None:
        path, fs = self._path(PENDING, batch)
        fs.delete(path, True)

    def archive(self, batch: str) -> None:
        self._move(batch, PENDING, ARCHIVE)

    def retry(self, batch: str) -> None:
        """Queue an archived batch again."""
        self._move(batch, ARCHIVE, PENDING)

    def suspend(self) -> None:
        path, fs = self._path(SUSPENDED)
        fs.create(path, True).close()

    def resume(self) -> None:
        path, fs = self._path(SUSPENDED)
        fs.delete(path, False)

    def suspended(self) -> bool:
        path, fs = self._path(SUSPENDED)
        return fs.exists(path)

    def drain(self, catalog: Catalog, most: int | None = None, ttl: int | None = None) -> Iterator[Outcome]:
        """Ingest waiting batches, as the catalog's single writer, until none is left, ``most``
        were taken or the queue is suspended."""
        with catalog.lock() as owner:
            for batch in self._list(PENDING)[:most]:
                if self.suspended():
                    return
                catalog.beat(owner)
                try:
                    found = {r["kind"]: r["count"] for r in ingest(catalog, self.read(batch), ttl).collect()}
                except Exception as e:  # reported; the batch is kept for a later try
                    self.archive(batch)
                    yield Outcome(batch, False, {}, f"{type(e).__name__}: {str(e)[:500]}")
                    continue
                self.complete(batch)
                yield Outcome(batch, True, found)

    def gauges(self) -> DataFrame:
        """state, count of batches."""
        rows = [("deferred", self.pending()), ("archived", self.archived())]
        return self.spark.createDataFrame(rows, "state string, count long").select("state", F.col("count"))
