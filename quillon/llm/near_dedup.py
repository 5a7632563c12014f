"""Near-duplicate documents by BagMinHash over the multiset of five-word shingles.

A shingle that occurs c times has weight c. Weights are discretised at the integers, and the
axis of weights is covered by the dyadic intervals (0,1], (1,2], (2,4] ..., each with a Poisson
process of its width as rate: process of points (time, level within the interval, component).
A document sees the points whose level is at most its weight; a component's value is the time
of its first point. Two documents then agree in a component with the probability of their
weighted Jaccard similarity. Points come in the order of time, so a process stops at the
first point behind the largest component, and almost all stop after one or two points.

Documents with equal multisets form one node, with a number of its own. Nodes that share a band are candidates: first
each with its bucket's hub, the node that shares most buckets; then, where the verified links
leave a bucket with several classes, every pair between those classes. In buckets of more
than ``few`` nodes those outside the largest class meet all others in tiles of bounded size,
one matrix product each, of which one link per node and class is returned. Candidates are
verified on the whole texts, classes are the components of verified links.

Edge cases: null and empty texts have no shingle and are alone; under five words, the whole
word sequence is the one shingle; rows with a null doc_id are alone (class_id null); rows that
share doc_id and text (told apart by 128 bits of it) are one document; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, gram_hashes, identity, mix, pair, portions, table, tidy, written
from .components import components

KEY = ["doc_id", "r1", "r2"]
SIGNED = "doc_id long, r1 long, r2 long, key binary, n long, bands array<long>"
_words = WordHash(seed=7)
_STEP, _PART, _LEVEL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def bag(words: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(_words.of(words), min(size, len(words)))
    return np.unique(grams if len(words) >= size else mix(grams + np.uint64(len(words))), return_counts=True)


def signatures(hashes: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m first-point times; element i, of weight weights[i], is in document doc[i]."""
    sig = np.full(docs * m, np.inf)
    parts = [(hashes, doc, np.ones(len(doc)), weights)]
    low = 1
    while (more := weights > low).any():
        parts.append((mix(hashes[more] ^ np.uint64(low)), doc[more], np.full(int(more.sum()), float(low)), weights[more] - low))
        low *= 2
    seed, at, width, reach = (np.concatenate(x) for x in zip(*parts))
    time, step = np.zeros(len(seed)), 0
    with np.errstate(over="ignore"):
        while len(seed):
            step += 1
            random = mix(seed + np.uint64(step) * _STEP)
            time = time - np.log1p((random >> np.uint64(11)) * -(2.0**-53)) / width
            live = time < sig.reshape(docs, m).max(axis=1)[at]
            seed, at, width, reach, time, random = (x[live] for x in (seed, at, width, reach, time, random))
            seen = (mix(random ^ _LEVEL) >> np.uint64(11)) * 2.0**-53 * width < reach
            np.minimum.at(sig, (at * m + (mix(random ^ _PART) % np.uint64(m)).astype(np.int64))[seen], time[seen])
    return sig.reshape(docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for r in range(rows):
        out = pair(out, values[:, :, r])
    return out


def _sign(bands: int, rows: int):
    def sign(batches):
        for batch in portions(batches):
            bags = [bag(t.split()) for t in as_bytes(batch.column("text"))]
            filled = [i for i, (h, _) in enumerate(bags) if len(h)]
            keys = [hashlib.blake2b(h.tobytes() + c.tobytes(), digest_size=16).digest() if len(h) else None for h, c in bags]
            n = [int(c.sum()) for _, c in bags]
            found = np.zeros((0, bands), np.uint64)
            if filled:
                hashes, counts = (np.concatenate([bags[i][k] for i in filled]) for k in (0, 1))
                doc = np.repeat(np.arange(len(filled)), [len(bags[i][0]) for i in filled])
                found = band_hashes(signatures(hashes, counts, doc, len(filled), bands * rows), bands, rows)
            sizes = np.zeros(len(bags) + 1, np.int32)
            sizes[np.asarray(filled, int) + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.ascontiguousarray(found).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), lists], [*KEY, "key", "n", "bands"])

    return sign


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum() + b[1].sum()) - common)


def _verify(threshold: float):
    def verify(batches):
        last, bag_b = None, None
        for batch in portions(batches, "text_u"):
            us, vs = batch.column("u"), batch.column("v")
            good = []
            for ta, tb in zip(as_bytes(batch.column("text_u")), as_bytes(batch.column("text_v"))):
                if last is not tb and last != tb:
                    last, bag_b = tb, bag(tb.split())
                good.append(similarity(bag(ta.split()), bag_b) >= threshold - 1e-12)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(mask), vs.filter(mask)], ["u", "v"])

    return verify


def elements(words: list[bytes]) -> np.ndarray:
    """The multiset as a set: the c-th occurrence of a shingle is an element of its own."""
    h, c = bag(words)
    if len(h) == int(c.sum()):
        return h
    nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        return mix(np.repeat(h, c) + nth.astype(np.uint64) * _LEVEL)


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    in_a, in_b = np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(in_a, in_b)
    if not len(shared):
        return out
    at_a, at_b = np.searchsorted(shared, in_a), np.searchsorted(shared, in_b)
    ok_a, ok_b = shared[np.minimum(at_a, len(shared) - 1)] == in_a, shared[np.minimum(at_b, len(shared) - 1)] == in_b
    for low in range(0, len(shared), columns):
        here_a, here_b = ok_a & (at_a >= low) & (at_a < low + columns), ok_b & (at_b >= low) & (at_b < low + columns)
        x, y = np.zeros((len(a), min(columns, len(shared) - low)), np.float32), np.zeros((len(b), min(columns, len(shared) - low)), np.float32)
        x[row_a[here_a], at_a[here_a] - low] = 1
        y[row_b[here_b], at_b[here_b] - low] = 1
        out += x @ y.T
    return out


def _tile(threshold: float):
    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            a, b = ([elements((t or "").encode().split()) for t in side["text"]] for side in (left, right))
            na, nb = np.asarray([len(x) for x in a], float), np.asarray([len(x) for x in b], float)
            common = common_counts(a, b)
            alike = common >= threshold * (na[:, None] + nb[None, :] - common) - 1e-6
            root_a, node_a, root_b, node_b = (side[c].to_numpy(np.int64) for side in (left, right) for c in ("root", "node"))
            for i in np.flatnonzero(alike.any(axis=1)):
                seen = {root_a[i]}
                for j in np.flatnonzero(alike[i]):
                    if root_b[j] not in seen:
                        seen.add(root_b[j])
                        found.append((node_a[i], node_b[j]))
        return pd.DataFrame(np.asarray(found, np.int64).reshape(-1, 2), columns=["u", "v"])

    return tile


def _across_classes(crowds: DataFrame, text: DataFrame, threshold: float, tile: int = 256) -> DataFrame:
    """Links between the classes of each bucket in ``crowds`` (band, node, root)."""
    counts = crowds.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    grid = largest.select("band", F.col("most.root").alias("main"), F.ceil(F.col("all") / tile).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("most.n")) / tile).cast("int").alias("high"))
    rows = crowds.join(written(grid, "tiles"), "band").join(text, "node").select("band", "node", "root", "main", "wide", "high", "text", F.xxhash64("node", "band").alias("h"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda n: F.pmod("h", F.col(n)).cast("int")
    columns = ["band", "i", "j", "node", "root", "text"]
    left = rows.where("root != main").withColumn("i", cell("high")).withColumn("j", every("wide")).select(*columns)
    right = rows.withColumn("j", cell("wide")).withColumn("i", every("high")).select(*(F.col(c).alias(c) for c in columns))  # attributes of its own
    return left.groupBy("band", "i", "j").cogroup(right.groupBy("band", "i", "j")).applyInPandas(_tile(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 4, few: int = 32) -> DataFrame:
    """doc_id, r1, r2 (hashes of the text, tell apart rows that share a doc_id), class_id (smallest
    doc_id of the class) and kept (true for the one document of the class that stays)."""
    source = docs.select("doc_id", *identity(), "text")
    signed = written(source.mapInArrow(tidy(_sign(bands, rows)), SIGNED), "signatures")
    keyed = signed.where("key is not null and doc_id is not null")
    reps = keyed.groupBy("key").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # the numbers are fixed by this write: later steps read the files
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "key", "rep", "n", "bands"), "nodes")
    buckets = reps.select("node", "n", F.explode("bands").alias("band"))
    sizes = written(buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    crowded = written(buckets.join(sizes, "band"), "buckets")
    degrees = crowded.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = written(crowded.join(degrees, "node").groupBy("band").agg(F.min(F.struct(-F.col("degree"), "node", "n")).alias("hub")), "hubs")
    close = (F.least("n", "hub.n") >= threshold * F.greatest("n", "hub.n") - F.lit(1e-9)) & (F.col("node") != F.col("hub.node"))
    ends = crowded.join(hubs, "band").where(close).select(F.greatest("node", "hub.node").alias("u"), F.least("node", "hub.node").alias("v"))
    tried = written(ends.distinct(), "pairs")
    wanted = tried.select(F.col("u").alias("node")).unionByName(tried.select(F.col("v").alias("node"))).unionByName(crowded.where("size > 2").select("node")).distinct()
    asked = reps.join(wanted, "node").select("node", "rep.*")
    text = written(source.join(asked, KEY).dropDuplicates(KEY).select("node", "text"), "candidates")

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.join(text.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(text.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        return written(both.select("u", "v", "text_u", "text_v").mapInArrow(tidy(_verify(threshold)), "u long, v long"), "links")

    found = links(tried)
    roots = components(found)
    in_class = crowded.where("size > 2").join(roots, "node", "left").select("band", "size", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = written(in_class.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("band"), "mixed")
    open_buckets = written(in_class.join(mixed, "band"), "open")
    a, b = (open_buckets.where(F.col("size") <= few).alias(x) for x in "ab")
    near = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - F.lit(1e-9)
    across = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.node") > F.col("b.node")) & near)
    rest = across.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    more = links(written(rest, "pairs")).unionByName(_across_classes(open_buckets.where(F.col("size") > few), text, threshold))
    more = written(more, "more-links")
    roots = components(found.unionByName(more)) if not more.isEmpty() else roots
    rooted = written(reps.select("node", "key", "rep").join(roots, "node", "left").select("key", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("first")), "classes")
    classed = written(rooted.join(least, "root").select("key", "first"), "classed")
    joined = signed.select(*KEY, F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(classed, "key", "left")
    alone = F.col("first").isNull()
    return joined.select(*KEY, F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), (alone | (F.struct(*KEY) == F.col("first"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but those whose class another document stands for. Of rows that are
    one document (equal doc_id and text) the one whose other columns come first as JSON stays."""
    key, others = F.struct("doc_id", *identity()).alias("key"), [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    gone = written(near_duplicates(docs, **options).where("not kept").select(F.struct(*KEY).alias("key")).distinct(), "gone")
    once = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("once")
    order = (F.to_json(F.struct(*others)) if others else F.lit("")).alias("order")
    rows = docs.select(key, once, order, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    return rows.join(gone, "key", "left_anti").groupBy("key", "once").agg(F.min_by("all", "order").alias("all")).select("all.*")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
