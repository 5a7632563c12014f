import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import quillon.llm.token_counts as token_counts_module
from quillon.llm.common import scratch, shared_dir
from quillon.llm.packing import best_fit, best_fit_packing
from quillon.llm.token_counts import op2_token_counts, read_cache, token_counts, tokenizer_version
from quillon.llm.tokenizer import Encoder

from .conftest import edge_texts

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_whole_texts():
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()] + [t or "" for _, t in edge_texts()]
    assert Encoder(BPE).packed(texts) == [np.asarray(ids(t), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_to_their_library(name):
    encoder = Encoder(public_tokenizers.path(name))
    assert encoder.fast is None
    assert [len(x) > 0 for x in encoder.packed(["Some words", ""])] == [True, False]


def test_token_counts_edges_and_cache(spark, edge):
    cache = scratch(spark, "cache")
    for _ in range(2):  # the second time, all come from the cache
        got = sorted(map(tuple, token_counts(edge, BPE, cache).collect()), key=repr)
        want = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in edge_texts()), key=repr)
        assert got == want
    stored = read_cache(spark, cache, tokenizer_version(BPE))
    assert stored.count() == len({t or "" for _, t in edge_texts()})
    assert spark.read.parquet(cache).count() == stored.count()


def cached(spark, path):
    return sorted((r["digest"], r["n_tokens"]) for r in spark.read.parquet(path).collect())


def test_the_second_run_of_the_query_encodes_nothing(spark, monkeypatch):
    op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    path = f"{shared_dir(spark)}/quillon-token-cache"
    before = cached(spark, path)
    monkeypatch.setattr(token_counts_module, "_encode", lambda tokenizer: pytest.fail("encoded again"))
    assert op2_token_counts(spark, "/root/testdata/sf0.001").count() == 200
    assert cached(spark, path) == before and len({d for d, _ in before}) == len(before)


def test_each_digest_is_encoded_once(spark):
    cache = scratch(spark, "cache")
    rows = [(1, "a b c")] * 50 + [(None, "a b c")] * 50 + [(None, "d e")] * 50 + [(0, "d e"), (2, None), (2, "")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BPE, cache).collect()
    assert len(got) == len(rows)
    assert len(cached(spark, cache)) == 3


LONG_SPACES = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \t" * 500_000 + "b"]


def test_long_runs_of_white_space(spark):
    df = spark.createDataFrame(list(enumerate(LONG_SPACES)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, BPE, scratch(spark, "cache")).collect()}
    assert got == {i: len(ids(t)) for i, t in enumerate(LONG_SPACES)}
    pieces = best_fit_packing(df, BPE).collect()
    check_packing(pieces, list(enumerate(LONG_SPACES)), 1024)


def test_token_counts_of_nothing(spark, nothing):
    assert token_counts(nothing, BPE, scratch(spark, "cache")).collect() == []


def check_packing(pieces, texts, room):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    want = {}
    for i, t in texts:
        full = np.asarray(ids(t) + [2], "<u4")
        first = len(full) % room or min(room, len(full))
        edges = [0, *range(first, len(full) + 1, room)] if len(full) > room else [0, len(full)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.setdefault(i, []).append((k, a, b - a, zlib.crc32(full[a:b].tobytes())))
    assert {i: sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in ps) for i, ps in by_doc.items()} == {i: sorted(v) for i, v in want.items()}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences)


def test_packing_edges(edge, nothing):
    made = check_packing(best_fit_packing(edge, BPE).collect(), edge_texts(), 1024)
    total = sum(len(ids(t)) + 1 for _, t in edge_texts())
    assert made <= total / 1024 * 1.25 + 2
    assert best_fit_packing(nothing, BPE).collect() == []


def test_packing_fills_sequences():
    lengths = np.random.default_rng(1).integers(1, 1024, 6000)
    for by in ("norm", "dot"):
        sequence, offset = best_fit(lengths, (1024, 1024, 1024**2), (1.0, 0.05, 0.05), by)
        used = np.bincount(sequence, weights=lengths)
        assert used.max() <= 1024
        assert len(used) <= lengths.sum() / 1024 * 1.03 + 1


def test_packing_holds_every_capacity():
    lengths = np.random.default_rng(2).integers(1, 300, 2000)
    sequence, _ = best_fit(lengths, (1024, 3, 120_000.0), (1.0, 1.0, 1.0))
    assert np.bincount(sequence).max() <= 3
    assert np.bincount(sequence, weights=lengths.astype(float) ** 2).max() <= 120_000


def plain_best_fit(lengths, capacity, weights, by):
    """Piece by piece over all sequences so far; what each sequence holds in the end."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1.0, float(n) ** 2)
        best, score = None, None
        for b in bins:
            left = [c - u for c, u in zip(capacity, b)]
            if all(x >= y for x, y in zip(left, need)):
                if by == "norm":
                    s = -sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left, need, capacity))
                else:
                    s = sum(w * (y / c) * (x / c) for w, x, y, c in zip(weights, left, need, capacity))
                if score is None or s > score + 1e-15:
                    best, score = b, s
        if best is None:
            bins.append(best := [0.0, 0.0, 0.0])
        for k in range(3):
            best[k] += need[k]
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(1024, 1024, 1024.0**2), (1024, 5, 300_000.0), (900, 3, 900.0**2)])
def test_best_fit_equals_brute_force(by, capacity):
    """The same sequences by all three needs, where two of them bind and where they don't."""
    lengths, weights = np.random.default_rng(7).integers(1, 500, 400), (1.0, 0.31, 0.17)
    sequence, _ = best_fit(lengths, capacity, weights, by)
    held = [(float(lengths[sequence == s].sum()), float((sequence == s).sum()), float((lengths[sequence == s].astype(float) ** 2).sum())) for s in np.unique(sequence)]
    assert sorted(held) == plain_best_fit(lengths.tolist(), capacity, weights, by)
