import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.line_dedup import chunks_of, line_dedup, removable
from quillon.llm.near_dedup import bag, common_counts, elements, keep_one, near_duplicates, signatures, similarity
from quillon.llm.substring_dedup import WordTable, level_sizes, lowest, substring_dedup

from .conftest import edge_texts, prose


def brute_substrings(texts, size):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1) if i is not None else ():
            h = tuple(w[k : k + size])
            first[h] = min(first.get(h, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 8])
def test_substrings_equal_brute_force(edge, size):
    assert sorted(map(tuple, substring_dedup(edge, size).collect()), key=repr) == brute_substrings(edge_texts(), size)


def test_substrings_of_nothing(nothing):
    assert substring_dedup(nothing).collect() == []


def test_substring_windows_at_the_edges_of_a_passage(spark):
    passage = prose(9, 60)
    texts = [(i, f"{prose(100 + i, 20 + i)} {passage} {prose(200 + i, 30)}") for i in range(12)] + [(50, passage.replace("\n", " ")), (51, " ".join(passage.split()[:50])), (52, " ".join(passage.split()[:49]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(df).collect()), key=repr) == brute_substrings(texts, 50)


def test_levels_double_and_end_when_none_survives(spark):
    """Passages of 9, 20, 40 and 70 shared words: each lives on while the level's length allows it."""
    assert level_sizes(50) == [13, 25, 50] and level_sizes(50, 7) == [7, 13, 25, 50] and level_sizes(8) == [4, 8] and level_sizes(2) == [2]
    texts, open_at = [], {}
    for k, size in enumerate((9, 20, 40, 70)):
        passage = prose(300 + k, size).replace("\n", " ")
        pair = [(10 * k + i, f"{prose(400 + 10 * k + i, 60)} {passage} {prose(500 + 10 * k + i, 60)}") for i in range(2)]
        trace = []
        df = spark.createDataFrame(pair, "doc_id long, text string")
        assert sorted(map(tuple, substring_dedup(df, least=7, trace=trace).collect()), key=repr) == brute_substrings(pair, 50)
        open_at[size] = [s for s, _, alive in trace if alive]
        assert [s for s, *_ in trace] == [7, 13, 25, 50][: len(trace)] and trace[-1][2] == 0
        texts += pair
    assert open_at[9] in ([], [7]) and 25 not in open_at[20] and 50 not in open_at[70]
    assert max(open_at[9], default=0) <= max(open_at[20], default=0) <= max(open_at[40], default=0)
    trace = []
    assert sorted(map(tuple, substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"), least=7, trace=trace).collect()), key=repr) == brute_substrings(texts, 50)
    survivors = [alive for *_, alive in trace]
    assert survivors == sorted(survivors, reverse=True) and survivors[0] > survivors[-1] == 0


def test_repeated_rows_of_one_document_cost_like_others(spark):
    """5,000 rows of one doc_id: what is collected for a document doesn't grow with its rows."""
    text = prose(31, 540)
    rows = [(1, text)] * 4999 + [(2, text), (2, text + " and more words")]
    for run, removed in ((lambda d: substring_dedup(d).groupBy("doc_id").agg(F.sum("n_removed").alias("n")), {1: 0, 2: 1080}), (lambda d: line_dedup(d).groupBy("doc_id").agg(F.sum("n_removed_lines").alias("n")), {1: 0})):
        got = {r["doc_id"]: r["n"] for r in run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert {k: got[k] for k in removed} == removed and got[2] > 0


def test_word_tables_forget_without_changing_hashes():
    small, large = WordTable(5, most=8), WordTable(5)
    lists = [[b"%d" % (i * k % 13) for i in range(n)] for k, n in ((1, 5), (7, 30), (3, 0), (5, 9))]
    assert np.array_equal(small.of(lists), large.of(lists))


def test_anchor_is_the_leftmost_smallest():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    at = lowest(x, 37)
    pick = rng.integers(0, len(at), 2000)
    low = np.uint64((1 << 17) - 1)
    assert all(at[i] == i + np.argmin(x[i : i + 37] & ~low) for i in pick.tolist())


def plain_chunks(text, rolling=2, one_in=2, most=64):
    """The rule for chunk ends line by line: the hash of the last lines, by doubling pairs."""
    lines, out, held = text.split(b"\n"), [], []
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def pair(a, b):
        return mixed(a * golden + mixed(b + golden & mask) & mask)

    hashes = [xxhash.xxh3_64_intdigest(x, 1) for x in lines]
    for k, line in enumerate(lines):
        held.append(line)
        ends = k == len(lines) - 1 or (k >= rolling - 1 and mixed(pair(hashes[k - 1], hashes[k])) % one_in == 0)
        if k == len(lines) - 1 or len(lines) > 2 and ((ends and len(held) >= 2) or len(held) == most):
            out.append(b"\n".join(held))
            held = []
    return out


def test_chunks_equal_the_plain_rule():
    for text in [(t or "").encode() for _, t in edge_texts()] + [prose(k, 400, 3).encode() for k in range(5)] + [b"same\n" * 300, b"a\nb", b"\n\n\n"]:
        assert chunks_of(text, 2, 2, 64) == plain_chunks(text)


def brute_lines(texts):
    seen, out = {}, []
    for i, t in texts:
        for k, c in enumerate(plain_chunks((t or "").encode())):
            if i is not None and removable(c):
                seen[c] = min(seen.get(c, (i, k)), (i, k))
    for i, t in texts:
        kept, gone = [], 0
        for k, c in enumerate(plain_chunks((t or "").encode())):
            if i is not None and removable(c) and seen[c] < (i, k):
                gone += c.count(b"\n") + 1
            else:
                kept.append(c)
        out.append((i, None if t is None else b"\n".join(kept).decode(), 0 if t is None else t.count("\n") + 1, gone))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(edge, nothing):
    got = line_dedup(edge)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed_lines").collect()), key=repr) == brute_lines(edge_texts())
    assert sum(r[3] for r in brute_lines(edge_texts())) > 20
    assert got.select("kept.source", "kept.kept").distinct().count() > 1
    assert line_dedup(nothing).collect() == []


def test_line_chunks_resist_shifts():
    body = prose(11, 900).encode()
    a, b = set(chunks_of(body, 2, 2, 64)), set(chunks_of(b"an added line\nand another\n" + body, 2, 2, 64))
    assert len(a - b) <= 2
    assert b"\n".join(chunks_of(body, 2, 2, 64)) == body
    assert max(c.count(b"\n") for c in chunks_of(b"same\n" * 1000, 2, 2, 64)) < 64


def brute_classes(texts):
    bags = [bag((t or "").encode().split()) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] is not None and texts[b][0] is not None and len(bags[a][0]) and len(bags[b][0]) and similarity(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for a, (i, _) in enumerate(texts):
        groups.setdefault(find(a), []).append(i)
    return sorted(((i, min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g), key=repr)


def test_near_duplicates_equal_brute_force(edge, nothing):
    got = near_duplicates(edge)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got.collect()), key=repr) == brute_classes(edge_texts())
    assert near_duplicates(nothing).collect() == []
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 7, 9, 12}.issubset(ids) and not {2, 8, 10, 13} & set(ids)
    assert ids.count(None) == 2 and ids.count(18) == 1  # one of its two texts is a copy of 17's


def exact_links(texts, threshold=0.8, size=5):
    """All pairs of different texts of that weighted similarity, by counting shared shingles of
    words themselves: no hash, no bag and no band of the operator's."""
    bags, where, common = [], {}, Counter()
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        bags.append(Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
        for shingle, n in bags[-1].items():
            for other, m in where.get(shingle, ()):
                common[other, k] += min(n, m)
            where.setdefault(shingle, []).append((k, n))
    total = [sum(b.values()) for b in bags]
    return {p for p, c in common.items() if c >= threshold * (total[p[0]] + total[p[1]] - c) - 1e-9}


def test_no_exact_link_is_lost(spark):
    """Recall against every pair of a whole table, counted without the operator's parts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    pairs = exact_links([r["text"] for r in rows])
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [(rows[a]["doc_id"], rows[b]["doc_id"]) for a, b in pairs if found[rows[a]["doc_id"]] != found[rows[b]["doc_id"]]]
    assert len(pairs) > 100 and not lost
    root = list(range(len(rows)))
    for a, b in sorted(pairs):  # and no class holds more than the links do
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert found == {r["doc_id"]: rows[root[k]]["doc_id"] for k, r in enumerate(rows)}


@pytest.mark.parametrize("few", [1, 32])
def test_near_copies_of_near_copies_form_one_class(spark, few):
    """A chain whose ends aren't similar, and a group whose smallest member is at its border."""
    words = prose(21, 300).split()
    texts = []
    for i in range(30):
        w = list(words)
        for k in range(i):
            w[k * 9] = f"z{k}"
        texts.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["class_id"]) for r in near_duplicates(df, few=few).collect()), key=repr) == brute_classes(texts)


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = (np.arange(1, 60, dtype=np.uint64) * np.uint64(7919), rng.integers(1, 40, 59))
    b = (a[0][:50], np.maximum(1, a[1][:50] + rng.integers(-9, 9, 50)))
    doc = np.repeat([0, 1], [59, 50])
    sig = signatures(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), doc, 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - similarity(a, b)) < 0.02


def test_components(spark):
    edges = [(k, k + 1) for k in range(40) if k % 10 != 9] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: k - k % 10 for k in range(40)} | {k: 100 for k in range(100, 160)} | {k: k - k % 10 for k in range(40)}


def test_tiles_count_multisets():
    words = [w.split() for w in (b"a b c d e f g a b c d e f g", b"a b c d e f g h a b c d e", b"x y z x y z x y z", b"")]
    sets = [elements(w) for w in words]
    want = [[len(sets[i]) if i == j else round(similarity(bag(a), bag(b)) * (len(sets[i]) + len(sets[j])) / (1 + similarity(bag(a), bag(b)))) for j, b in enumerate(words)] for i, a in enumerate(words)]
    for columns in (2, 8192):
        assert common_counts(sets, sets, columns).tolist() == want
