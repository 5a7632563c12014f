"""Substring dedup by level-wise doubling of repeated word windows.

The levels are lengths that double up to the window: 13, 25 and 50 words for 50. On each
level every live window is stood for by its anchor, the run of that length inside it whose hash
is smallest. Equal windows have equal anchors at equal places, so a window whose anchor is seen
in one document alone is dropped there; the others live on and are looked at again at twice the
length, where they may get other anchors. The last level is the window itself, and nothing
survives that: its windows are repeated or not. An anchor whose surroundings (all words of the
live windows it stands for) are the same wherever it occurs needs no further level: all those
windows are repeated. When a level leaves no open anchor the doubling ends.

A window counts as repeated only where two independent 64-bit polynomial hashes of all its words
(or of its anchor's whole surroundings) agree, beside the anchor's own hash.

Groups are only ever reduced to the smallest doc_id by map-side aggregation. What is joined
back is one row per key, written first: Spark can then split a hot key's many rows, which it
can't below an aggregation.

Edge cases: null texts have no words; documents with fewer words than the window keep
everything; rows with a null doc_id keep everything and cause no removal; rows that share a
doc_id don't remove words from each other, and repeated ones cost as much as other rows; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, as_bytes, identity, mix, portions, table, written

KEY, ROW = ["doc_id", "r1", "r2"], "doc_id long, r1 long, r2 long"
#: A span of windows is one number, first * PACK + n.
PACK = 1 << 20
ANCHOR = {"a": pa.int64(), "g1": pa.int64(), "g2": pa.int64(), "first": pa.int32(), "n": pa.int32()}
FIELDS = "a:long,g1:long,g2:long,first:int,n:int"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SEGMENT = 1 << 16
_BASES = (0x9E3779B97F4A7C15 & ~7 | 5, 0xD1342543DE82EF95 & ~7 | 5)


class WordTable(dict):
    """word -> its place in two tables of independent 64-bit hashes, remembered up to a bound."""

    def __init__(self, seed: int, most: int = 1 << 18):
        super().__init__()
        self.seed, self.most, self.lanes = seed, most, np.empty((2, most), np.uint64)

    def __missing__(self, word: bytes) -> int:
        value, place = xxhash.xxh3_128_intdigest(word, self.seed), len(self)
        self.lanes[0, place], self.lanes[1, place] = value & MASK, value >> 64
        self[word] = place
        return place

    def of(self, lists: list[list[bytes]]) -> np.ndarray:
        """2 x words: both hashes of each word of the lists, one after the other."""
        out = []
        for words in lists:
            for start in range(0, len(words), self.most):
                part = words[start : start + self.most]
                if len(self) + len(part) > self.most:
                    self.clear()
                    out = [self.lanes[:, x] if x.ndim == 1 else x for x in out]
                out.append(np.fromiter(map(self.__getitem__, part), np.int32, len(part)))
        return np.concatenate([np.zeros((2, 0), np.uint64), *(self.lanes[:, x] if x.ndim == 1 else x for x in out)], axis=1)


_words = WordTable(seed=5)
_powers = [np.ones(1, np.uint64) for _ in range(4)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of both bases, and of their inverses modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((*_BASES, *(pow(b, -1, 1 << 64) for b in _BASES))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return [p[:n] for p in _powers]


class Polynomials:
    """Two polynomial hashes of any run of words, by prefix sums."""

    def __init__(self, lanes: np.ndarray):
        n = lanes.shape[1]
        *up, down1, down2 = powers(n + 1)
        self.down = (down1, down2)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n])]) for h, p in zip(lanes, up)]

    def of(self, lane: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[lane][stop] - self.sums[lane][start]) * self.down[lane][start]

    def grams(self, size: int) -> np.ndarray:
        """First hash of each run of ``size`` words."""
        s = self.sums[0]
        return mix((s[size:] - s[:-size]) * self.down[0][: len(s) - size]) if len(s) > size else s[:0]


def lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest (then leftmost) of each ``width`` neighbours."""
    out, low = np.zeros(max(0, len(grams) - width + 1), np.int64), np.uint64((SEGMENT << 1) - 1)
    for start in range(0, len(out), SEGMENT):
        have = grams[start : start + SEGMENT + width - 1] & ~low
        have, size, end = have | np.arange(len(have), dtype=np.uint64), 1, min(SEGMENT, len(out) - start)
        while size * 2 <= width:
            have, size = np.minimum(have[:-size], have[size:]), size * 2
        if size < width:
            have = np.minimum(have[: len(have) - (width - size)], have[width - size :])
        out[start : start + end] = (have[:end] & low).astype(np.int64) + start
    return out


def anchors_of(lists: list[list[bytes]], live: np.ndarray, size: int, window: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Anchors of ``size`` words of the live windows, given by their first words' places in all
    lists one after the other: the places of their first windows; hash, surroundings, number of windows."""
    hashes = Polynomials(_words.of(lists))
    grams = hashes.grams(size)
    place = lowest(grams, window - size + 1)[live]
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (live[1:] != live[:-1] + 1)]) if len(live) else live
    n = np.diff(np.r_[begin, len(live)])
    first, place = live[begin], place[begin]
    shape = mix(((place - first).astype(np.uint64) << np.uint64(32)) + n.astype(np.uint64))
    around = [mix(hashes.of(k, first, first + n + window - 1) ^ shape) for k in (0, 1)]
    return first, {"a": grams[place], "g1": around[0], "g2": around[1], "n": n}


def every_window(sizes: np.ndarray, window: int) -> np.ndarray:
    """The windows of lists of these sizes, by their first words' places in all lists one after the other."""
    counts = np.maximum(0, sizes - window + 1)
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)


def spans_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, number of windows) of a column of packed spans, neighbours joined."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row, packed = np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((packed, row))
    row, first, n = row[order], packed[order] // PACK, packed[order] % PACK
    if not len(row):
        return row, first, n
    begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1])])
    return row[begin], first[begin], np.add.reduceat(n, begin)


def _arrow(found: dict[str, np.ndarray], first: np.ndarray) -> list[pa.Array]:
    columns = found | {"first": first.astype(np.int32), "n": found["n"].astype(np.int32)}
    return [pa.array(columns[c].view(np.int64) if t == pa.int64() else columns[c], t) for c, t in ANCHOR.items()]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_level(size: int, window: int):
    """Every window of every text is live."""

    def find(batches):
        for batch in portions(batches):
            lists = [t.split() for t in as_bytes(batch.column("text"))]
            used = [[] if null else words for null, words in zip(batch.column("doc_id").is_null().to_pylist(), lists)]
            sizes = np.asarray([len(w) for w in used], np.int64)
            first, found = anchors_of(used, every_window(sizes, window), size, window)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, first, side="right")
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(lists)))].astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(_arrow(found, first - (ends - sizes)[doc]), list(ANCHOR)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array([len(w) for w in lists], pa.int64()), pa.array([digest(w) for w in lists], pa.string()), anchors], [*KEY, "n_words", "kept_sha256", "anchors"])

    return find


def _next_level(size: int, window: int):
    """The windows of the open spans are live. Spans whose words overlap form a region, and no
    other words are hashed."""

    def find(batches):
        for batch in portions(batches):
            row, start, n = spans_of(batch.column("open"))
            stop = start + n + window - 1
            new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])][: len(row)]
            begin, region = np.flatnonzero(new), np.cumsum(new) - 1
            left, right = start[begin], stop[np.r_[begin[1:], len(row)][: len(begin)] - 1]
            texts, words, lists = as_bytes(batch.column("text")), {}, []
            for i, a, b in zip(row[begin].tolist(), left.tolist(), right.tolist()):
                if i not in words:
                    words = {i: texts[i].split()}
                lists.append(words[i][a:b])
            ends = np.cumsum(right - left)
            moved = ends - right  # from a place in its text to its place in all lists
            live = np.repeat(start + moved[region] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            first, found = anchors_of(lists, live, size, window)
            of = np.searchsorted(ends, first, side="right")
            rows = pa.array(row[begin][of])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in KEY), *_arrow(found, first - moved[of])], [*KEY, *ANCHOR])

    return find


def _keep(window: int):
    def keep(batches):
        for batch in portions(batches):
            row, start, n = spans_of(batch.column("spans"))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            n_words, gone, shas = [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words, kept, done, covered = text.split(), [], 0, 0
                for a, b in zip(start[at[i] : at[i + 1]].tolist(), (start + n + window - 1)[at[i] : at[i + 1]].tolist()):
                    kept += words[done : max(a, done)]
                    covered += b - max(a, done) if b > done else 0
                    done = max(done, b)
                n_words.append(len(words))
                gone.append(covered)
                shas.append(digest(kept + words[done:]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return keep


def level_sizes(window: int, least: int = 13) -> list[int]:
    """Lengths of the levels: halves, rounded up, until one is at most ``least``; two levels at
    least, but none under 4 words."""
    sizes = [window]
    while (sizes[-1] > least or len(sizes) < 2) and -(-sizes[-1] // 2) >= 4:
        sizes.append(-(-sizes[-1] // 2))
    return sizes[::-1]


def substring_dedup(docs: DataFrame, window: int = 50, least: int = 13, trace: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words. Into ``trace``, if one is
    given, goes (length, anchors, anchors that are still open) of each level."""
    if not 2 <= window < PACK:
        raise ValueError(f"window must be at least 2 and below {PACK}")
    sizes = level_sizes(window, least)
    rows = docs.select("doc_id", *identity(), "text")
    all_rows = written(rows.mapInArrow(_first_level(sizes[0], window), f"{ROW}, n_words long, kept_sha256 string, anchors array<struct<{FIELDS}>>"), "anchors")
    anchors, marked, settled = all_rows.select(*KEY, F.inline("anchors")), None, []
    for size, following in zip(sizes, [*sizes[1:], None]):
        # on the last level the two hashes of all words are the key, and no window is open
        by = ["a"] if following else ["g1", "g2"]
        differ = (F.min("g1") != F.max("g1")) | (F.min("g2") != F.max("g2")) if following else F.lit(False)
        groups = anchors.groupBy(*by).agg(F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("most_doc"), differ.alias("open"))
        repeated = written(groups.where("least_doc < most_doc").select(*by, "least_doc", "open"), "repeated")
        span = F.col("first").cast("long") * PACK + F.col("n")
        alive = anchors.join(repeated, by).where("open or doc_id > least_doc").select(*KEY, "open", span.alias("span"))
        gathered = alive.groupBy(*KEY).agg(F.collect_set(F.when(F.col("open"), F.col("span"))).alias("open"), F.collect_set(F.when(~F.col("open"), F.col("span"))).alias("settled"))
        if trace is not None:
            trace.append((size, anchors.count(), alive.where("open").count()))
        if marked is None:
            spans = marked = written(rows.join(gathered, KEY), "marked")
            texts = marked
        else:
            spans = written(gathered, "spans")
            texts = marked.select(*KEY, "text").join(spans.where(F.size("open") > 0).select(*KEY, "open"), KEY)
        settled.append(spans.where(F.size("settled") > 0).select(*KEY, "settled"))
        if not following or repeated.where("open").isEmpty():
            break
        anchors = written(texts.where(F.size("open") > 0).select(*KEY, "text", "open").mapInArrow(_next_level(following, window), f"{ROW}, {FIELDS.replace(':', ' ')}"), "anchors")
    # a list of spans for each level that removes something of the document, and few levels
    removed = settled[0].withColumn("level", F.lit(0))
    for level, more in enumerate(settled[1:], 1):
        removed = removed.unionByName(more.withColumn("level", F.lit(level)))
    lists = F.array_sort(F.collect_set(F.struct("level", "settled")))
    removed = written(removed.groupBy(*KEY).agg(F.flatten(F.transform(lists, lambda x: x["settled"])).alias("spans")), "removed")
    changed = marked.select(*KEY, "text").join(removed, KEY).select("doc_id", "text", "spans").mapInArrow(_keep(window), OUT)
    same = all_rows.select(*KEY, "n_words", "kept_sha256").join(removed.select(*KEY), KEY, "left_anti")
    return changed.unionByName(same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) i from words where len(w) >= 50),
windows as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) h from starts),
firsts as (select h, min(doc_id) m from windows group by h),
covered as (select distinct doc_id, unnest(range(i, i + 50)) p from windows join firsts using (h) where doc_id > m),
gone as (select doc_id, list(p) ps from covered group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, j: not list_contains(ps, j)) end, ' ')) kept_sha256
from words left join gone using (doc_id)
"""
