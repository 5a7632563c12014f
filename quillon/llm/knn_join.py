"""Exact top-k inner product search as a Voronoi join.

Vectors become integers, floor(256 * x). A bounded sample gives the pivots (about the square
root of the number of rows, at most half the sample). Every row goes to the cell of its nearest
pivot, and so does every query: the queries of a cell form a group. Cells are summed up by their
number of rows, radius and largest norm; groups by their radius, largest norm and lowest floor,
where a query's floor is its k-th best score within the sample, which its answers reach.

By Cauchy and Schwarz no row of a cell scores above p.p' + |p| r' + |p'| r + r r' with any query
of a group (pivots p, p', radii r, r'), nor above the product of the largest norms: where that
lies below the group's lowest floor, the cell is out for the whole group. For the cells that are
left each query has a bound of its own, q.p' + |q| r', and goes to those that reach its floor.

Of the two sides of the join the queries, a stated small part of the rows, are what is sent to
several cells. Cells of many rows are dealt by a hash into blocks of a bounded expected size,
their queries into batches of a bounded expected size, and the rows of a cell are replicated to
each of its batches; cells that no query reaches are left out. A block and a batch are solved
locally with one matrix product and give at most k rows for each query.

The sample and the summaries (one row per pivot) are all that the driver sees.

Edge cases: vectors null, empty, or with null or non-finite components, and rows with a null
vec_id take no part; rows of different lengths aren't compared; a query's own row is any row
with its vec_id; of queries that share a vec_id the smallest vector asks; repeated rows are
candidates each; components beyond 64-bit integers are held at their bounds, and scores that
a double cannot hold exactly are computed with Python's integers (held at 64 bits); fewer than k
candidates give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

CELLED = "vec_id long, v array<long>, dim int, cell int, dist double, norm double"
FLOORED = CELLED + ", floor double"
ASKED = "vec_id long, v array<long>, floor double, dim int, cell int"
HITS = "query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    x = F.transform(F.col(vector_column), lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    kept = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where((F.size(vector_column) > 0) & sound)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length in an Arrow list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and of b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def _cells(pivots: dict[int, np.ndarray]):
    def cells(batches):
        for batch in batches:
            n = batch.num_rows
            dim, cell, dist, norm = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
            for rows, m in _matrices(batch.column("v")) if n else []:
                x = m.astype(float)
                dim[rows], norm[rows] = m.shape[1], np.linalg.norm(x, axis=1)
                if (p := pivots.get(m.shape[1])) is not None:
                    near = (np.square(p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
                    cell[rows], dist[rows] = near, np.linalg.norm(x - p[near], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *map(pa.array, (dim, cell, dist, norm))], ["vec_id", "v", "dim", "cell", "dist", "norm"])

    return cells


def _floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds each query's k-th best score within the sample."""

    def floors(batches):
        for batch in batches:
            ids, out = batch.column("vec_id").to_numpy(), np.full(batch.num_rows, -np.inf)
            for rows, m in _matrices(batch.column("v")) if batch.num_rows else []:
                sample_ids, sample_rows = sample.get(m.shape[1], (np.zeros(0, np.int64), None))
                if len(sample_ids) < k:
                    continue
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    scores = products(m[at : at + 1024], sample_rows).astype(float)
                    scores[ids[part][:, None] == sample_ids[None, :]] = -np.inf
                    out[part] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "floor"])

    return floors


@dataclass(frozen=True)
class Cells:
    """The pivots of one dimension with their cells' rows, and the cells each query group may need."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    most: np.ndarray
    reach: np.ndarray


def group_reach(pivots: np.ndarray, cells: dict[int, tuple[int, float, float]], groups: dict[int, tuple[float, float, float]]) -> Cells:
    """cells: number of rows, radius, largest norm; groups: lowest floor, radius, largest norm."""
    n = len(pivots)
    count, radius, most = (np.asarray([cells.get(c, (0, 0.0, 0.0))[i] for c in range(n)], float) for i in range(3))
    floor, wide, long = (np.asarray([groups.get(c, (np.inf, 0.0, 0.0))[i] for c in range(n)], float) for i in range(3))
    norms = np.linalg.norm(pivots, axis=1)
    bound = pivots @ pivots.T + norms[:, None] * radius[None, :] + wide[:, None] * norms[None, :] + wide[:, None] * radius[None, :]
    bound = np.minimum(bound, long[:, None] * most[None, :])
    slack = 1e-9 * (norms + wide)[:, None] * (norms + radius)[None, :] + 1
    return Cells(pivots, count, radius, most, (bound + slack >= floor[:, None]) & (count > 0)[None, :])


def _send(cells: dict[int, Cells]):
    """Each query once for every cell that its group and its own bound leave."""

    def send(batches):
        for batch in batches:
            row, cell = [], []
            group, norms, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "norm", "floor"))
            for rows, m in _matrices(batch.column("v")) if batch.num_rows else []:
                if (own := cells.get(m.shape[1])) is None:
                    row.append(rows)
                    cell.append(np.full(len(rows), -1))
                    continue
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    norm = norms[part][:, None]
                    bound = np.minimum(m[at : at + 512].astype(float) @ own.pivots.T + norm * own.radius[None, :], norm * own.most[None, :])
                    need = own.reach[group[part]] & (bound + 1e-9 * norm * (own.most + own.radius)[None, :] + 1 >= floors[part][:, None])
                    i, c = np.nonzero(need)
                    row.append(part[i])
                    cell.append(c)
            for at, to in zip(row, cell):
                for start in range(0, len(at), 8192):
                    take = pa.array(at[start : start + 8192])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("vec_id", "v", "floor", "dim")), pa.array(to[start : start + 8192].astype(np.int32))], ["vec_id", "v", "floor", "dim", "cell"])

    return send


def _solve(k: int):
    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            x, ids = np.stack(rows["v"].to_list()), rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                scores = products(np.stack(part["v"].to_list()), x)
                for query, floor, s in zip(part["vec_id"].to_numpy(), part["floor"].to_numpy(), scores):
                    can = np.flatnonzero((ids != query) & (s >= floor))
                    if len(can) > k:
                        least = np.partition(s[can], len(can) - k)[len(can) - k]
                        can = can[s[can] >= least]
                    best = can[np.argsort(-s[can].astype(float) if np.abs(s).max() < 2**53 else np.asarray([-int(v) for v in s[can]], object), kind="stable")][:k]
                    found.append((np.full(len(best), query), ids[best], s[best]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return solve


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, sample: int = 1024, block_rows: int = 16_384, block_queries: int = 4096, plan: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id, v (integers); ``is_query`` is a
    condition on them. What the bounds left goes into ``plan``, if one is given."""
    pivots = pivots or min(sample // 2, math.isqrt(vectors.count()) + 1)
    seen: dict[int, dict[int, list[int]]] = {}
    for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect():
        seen.setdefault(len(row["v"]), {}).setdefault(row["vec_id"], row["v"])
    points = {d: (np.asarray(list(rows), np.int64), np.asarray(list(rows.values()), np.int64)) for d, rows in seen.items()}
    centres = {d: np.unique(m[: max(1, pivots)], axis=0).astype(float) for d, (_, m) in points.items()}
    celled = written(vectors.select("vec_id", "v").mapInArrow(_cells(centres), CELLED), "cells")
    of_rows = written(celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("most")), "summary")

    own = celled.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "cell", "dist", "norm")).alias("q")).select("vec_id", "q.*")
    queries = written(own.select("vec_id", "v", "dim", "cell", "dist", "norm").mapInArrow(_floors(points, k), FLOORED), "queries")
    of_groups = queries.groupBy("dim", "cell").agg(F.min("floor").alias("floor"), F.max("dist").alias("radius"), F.max("norm").alias("most"))
    # cells that have a pivot: at most as many as there are pivots, whatever the tables' size
    cells: dict[int, dict[int, tuple]] = {d: {} for d in centres}
    groups: dict[int, dict[int, tuple]] = {d: {} for d in centres}
    for into, rows in ((cells, of_rows.select("dim", "cell", "n", "radius", "most")), (groups, of_groups.select("dim", "cell", "floor", "radius", "most"))):
        for dim, cell, *values in rows.where("cell >= 0").collect():
            into[dim][cell] = tuple(values)
    reach = {d: group_reach(centres[d], cells[d], groups[d]) for d in centres}

    asked = written(queries.select("vec_id", "v", "dim", "cell", "norm", "floor").mapInArrow(_send(reach), ASKED), "asked")
    batches = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("batches"))
    grid = written(of_rows.select("dim", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")).join(batches, ["dim", "cell"]), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    place = ["dim", "cell", "block", "batch"]
    to_rows = celled.select("vec_id", "v", "dim", "cell").join(grid, ["dim", "cell"]).withColumn("block", dealt("blocks", "vec_id", F.monotonically_increasing_id())).withColumn("batch", every("batches")).select("vec_id", "v", *place)
    to_queries = asked.join(grid, ["dim", "cell"]).withColumn("batch", dealt("batches", "vec_id")).withColumn("block", every("blocks")).select("vec_id", "v", "floor", *place)
    if plan is not None:
        plan |= {"pairs": sum(int((c.count > 0).sum()) * len(groups[d]) for d, c in reach.items()), "pairs reached by groups": sum(int(c.reach[sorted(groups[d])].sum()) for d, c in reach.items())}
        plan |= {"queries": queries.count(), "queries sent": to_queries.count(), "rows sent": to_rows.count()}
    hits = to_queries.groupBy(*place).cogroup(to_rows.groupBy(*place)).applyInPandas(_solve(k), HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_top_k(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select * from r where rank <= 5
"""
