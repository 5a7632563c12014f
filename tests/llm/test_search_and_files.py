import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.common import scratch
from quillon.llm.knn_join import products, quantised, voronoi_top_k
from quillon.llm.mixing import mix, points, source_targets
from quillon.llm.warc import MAGIC, read_archives, record_bytes, records_in, response_records, write_archives

from .conftest import edge_texts


def brute_top_k(rows, queries, k=5):
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, block_queries", [(16_384, 4096), (7, 3), (50, 1)])
def test_top_k_equals_brute_force(spark, block_rows, block_queries):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).round(3).tolist()
    rows = [(i, hot if i % 3 == 0 else (rng.normal(size=8) * (1 + i % 5)).round(3).tolist()) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * 8), (1150, [1.0, None] * 4), (1200, [float("inf")] * 8), (1250, [1.0, 2.0]), (1251, [3.0, 4.0]), (None, hot), (50, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("score", F.lit("x"))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    got = voronoi_top_k(quantised(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, pivots=16, sample=64, block_rows=block_rows, block_queries=block_queries).collect()
    assert sorted(map(tuple, got)) == brute_top_k(whole, queries)
    assert voronoi_top_k(quantised(df.limit(0), "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect() == []


def test_groups_reach_few_cells_where_clusters_are_apart(spark):
    """Query groups are kept from cells that cannot hold an answer, and answers stay exact."""
    rng = np.random.default_rng(6)
    centres = np.eye(12) * 40
    rows = [(i, (centres[i % 12] + rng.normal(size=12)).tolist()) for i in range(1200)]
    df = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    plan = {}
    got = voronoi_top_k(df, F.col("vec_id") % 50 == 0, pivots=64, sample=256, plan=plan).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute_top_k(whole, {i: v for i, v in whole if i % 50 == 0})
    assert plan["pairs reached by groups"] < 0.5 * plan["pairs"]
    assert plan["rows sent"] <= len(rows) and plan["queries sent"] <= plan["queries"] * 64 * 0.25


def test_products_are_exact_when_a_double_is_not():
    a, b = np.asarray([[2**40 + 1, 3]]), np.asarray([[2**20 + 1, 5], [1, 1]])
    assert products(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, 2**40 + 4]]


def member(i, payload, kind="response"):
    return record_bytes(kind, f"http://x/{i}", f"urn:page:{i}", None, payload, len(payload), hashlib.sha256(payload).hexdigest(), 6)


def test_reader_owns_each_record_once_for_any_split():
    payloads = [b"", b"x" * 3000, MAGIC * 50, *(bytes(np.random.default_rng(i).integers(0, 256, 700, dtype=np.uint8)) for i in range(20)), member(99, b"a nested archive")]
    data = b"".join(member(i, p) for i, p in enumerate(payloads))
    for split in (97, 1000, len(data)):
        got = [(h["warc-record-id"], p) for s in range(0, len(data), split) for _, h, p in records_in(io.BytesIO(data), s, min(len(data), s + split))]
        assert got == [(f"<urn:page:{i}>", p) for i, p in enumerate(payloads)]


def test_reader_skips_damage():
    parts = [member(i, bytes([65 + i]) * 500) for i in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"noise" + parts[0] + parts[1] + bytes(broken) + parts[3] + parts[4][:-9]
    assert [h["warc-record-id"] for _, h, _ in records_in(io.BytesIO(data), 0, len(data))] == [f"<urn:page:{i}>" for i in (0, 1, 3)]


def test_damage_is_counted_and_heads_are_standard(spark, tmp_path):
    parts = [member(i, b"p%d " % i * 900) for i in range(6)] + [member(6, b"", "revisit")]
    hurt = bytearray(parts[3])
    hurt[-6] ^= 0xFF
    data = b"".join([*parts[:3], bytes(hurt), *parts[4:6], parts[6], parts[0][:-9]])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, size long")
    for split in (200, 1 << 20):
        rows = read_archives(files, split, with_damaged=True).collect()
        assert sorted(r["offset"] for r in rows if r["record_type"] == "damaged") == [sum(map(len, parts[:3])), len(data) - len(parts[0]) + 9]
        assert sorted(r["record_id"] for r in rows if r["record_type"] != "damaged") == [f"urn:page:{i}" for i in (0, 1, 2, 4, 5, 6)]
        assert all(r["record_type"] != "damaged" for r in read_archives(files, split).collect())
    plain = zlib.decompress(parts[1], 31)
    assert b"Content-Type: application/http; msgtype=response" in plain and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in plain
    assert b"WARC-Profile: http" in zlib.decompress(parts[6], 31) and b"WARC-Profile" not in plain


def test_archive_round_trip(spark):
    long = "<p>é</p>" * 40
    rows = [(1, "u", long), (2, "u\r\nv", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "y" * 300_000), (9, "u", "z" * 100), (8, "u", "z" * 100), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("x")).repartition(3)
    for split in (300, 4 << 20):
        got = {r["record_id"]: r for r in read_archives(write_archives(response_records(df.drop("payload_digest")), scratch(spark, "warc")), split).collect()}
        assert len(got) == len(rows) and all(r["intact"] for r in got.values())
        for i, _, html in rows:
            r, payload = got[f"urn:page:{'' if i is None else i}"], (html or "").encode()
            first = {2: 1, 9: 8, None: 1}.get(i)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", f"urn:page:{first}") if first else ("response", None))
            assert r["payload"] == (b"" if first else payload)
    assert read_archives(write_archives(response_records(df.limit(0)), scratch(spark, "warc"))).collect() == []


def test_mix_meets_targets_and_bounds(spark, edge, nothing):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= set(over or free)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 12 + 0.002 * target[s] for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(7)).collect()))
    assert mix(nothing).collect() == []
    assert mix(edge).count() == len(edge_texts())


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Shares by weight, reshared until no source is above ``most`` times its words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        for s in over or free:
            target[s] = float(most * sizes[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= set(over or free)
    return {s: target[s] for s in order}


def brute_mix(rows, block, most=3):
    """taken of each row, slot by slot and word by word. ``rows``: (place in its source's
    shuffle, source, size)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes, most=most)
    total, upto, parts = sum(target.values()), 0.0, []
    for s, goal in target.items():
        upto += goal
        parts.append((s, (upto - goal) / total, 1.0 if upto >= total else upto / total))
    step, rank, taken_blocks = int(0.6180339887498949 * 2**53), {}, {}
    for slot in range(-int(-total // block)):
        x = (slot + 1) * step % 2**53 / 2**53
        s = next(s for s, low, high in parts if low <= x < high)
        r = rank[s] = rank.get(s, -1) + 1
        blocks = -(-sizes[s] // block)
        if r < blocks * most:
            key = s, r % blocks
            taken_blocks[key] = taken_blocks.get(key, 0) + 1
    words, out = {s: [] for s in sizes}, [0] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        words[rows[k][1]] += [k] * rows[k][2]
    for s, stream in words.items():
        run = 0
        for (of, b), n in taken_blocks.items():
            if of == s:
                part = stream[b * block : (b + 1) * block]
                run += n * len(part)
                for k in part:
                    out[k] += n
        goal = int(target[s] + 0.5)
        for at in range(min(run, goal), max(run, goal)):  # the run is drawn on or cut back to the target
            out[stream[at % len(stream)]] += 1 if run < goal else -1
    return out


@pytest.mark.parametrize("block_words", [1, 7, 60])
def test_mix_equals_brute_force(spark, block_words):
    """Ranks, blocks, pieces and settling, recomputed slot by slot."""
    rows = [(i, " ".join(["w"] * (i * 13 % 23)), None if i % 9 == 0 else f"s{i * i % 5}") for i in range(220)] + [(500, "w w w", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mix(df, block_words=block_words).collect()}
    place = {r["doc_id"]: (r["p"] >> 54 & 1023, r["p"]) for r in df.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(9)).alias("p")).collect()}
    want = brute_mix([(place[i], s, len(t.split())) for i, t, s in rows], block_words)
    assert got == {i: n for (i, *_), n in zip(rows, want)}


@pytest.mark.parametrize("block_words", [1, 40, 2500])
def test_mix_settles_every_source_at_any_block(spark, block_words):
    """Sources below one block, of 2-3 blocks and far above, and one with more words than its target."""
    words = {"a": 300_000, "b": 20, "c": 100, "d": 1000, "e": 2640, "f": 5200, None: 200_000}
    rows = [(i, " ".join(["w"] * 10), s) for s, n in words.items() for i in range(n // 10)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=block_words).collect()
    assert len(got) == len(rows)
    for s, n in words.items():
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"]) and all(0 <= r["taken"] <= 30 for r in mine)
        if s in ("b", "c", "d", "e", "f"):
            assert mine[0]["target"] == 3 * n and all(r["taken"] == 30 for r in mine)


def test_targets_reshare_until_none_is_above(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 1)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df, (1.0, 5.0, 5.0), 3).collect()}
    assert got == {"a": 958.0, "b": 30.0, "c": 30.0, "d": 3.0}


def test_golden_points_are_exact(spark):
    slots = [0, 1, 2, 1000, 2**26 - 1, 2**26, 2**31, 2**40 + 12345, 2**52 + 7, 2**53 - 2]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in slots], "id long").select(points(F.col("id"))).collect()]
    assert got == [(k + 1) * int(0.6180339887498949 * 2**53) % 2**53 / 2**53 for k in slots]


@pytest.mark.parametrize("kind", ["golden", "van_der_corput"])
def test_points_are_spread(spark, kind):
    x = sorted(r[0] for r in spark.range(2048).select(points(F.col("id"), kind)).collect())
    assert 0 <= x[0] and x[-1] < 1
    assert max(abs(v - k / 2048) for k, v in enumerate(x)) < 0.006
