import hashlib
import random
import zlib
from collections import Counter
from functools import partial

import corpus_pipeline
from pyspark.sql import functions as F
from quillon.llm.common import written
from quillon.llm.mixing import mix
from quillon.llm.toxicity import Rates, buckets_of

from .conftest import frame, prose
from .test_dedup import brute_lines, exact_links
from .test_models import plain_ftrl
from .test_search_and_files import brute_mix
from .test_tokens import check_packing


def corpus(spark):
    texts = [(i, prose(i, 150)) for i in range(40)]
    texts += [(100, prose(3, 150)), (101, prose(4, 150) + "\nwith one more line here"), (102, None), (103, ""), (None, prose(77, 50))]
    return texts, frame(spark, texts)


def test_stages_in_order(spark, tmp_path):
    texts, docs = corpus(spark)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, now, str(tmp_path)), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert out.count() == len(texts)
        if name == "line_dedup":
            assert 100 not in ids and set(range(40)) <= ids
            short = out.where("doc_id = 101").select("text", "n_chars").first()
            assert short["n_chars"] == len(short["text"]) < 100
        if name == "near_dedup":
            assert set(range(40)) <= ids
        if name == "mixing":
            assert ids <= set(range(40)) | {101, None}
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        now = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len(pieces) >= now.count() and all(p["offset"] + p["length"] <= 1024 for p in pieces)


def test_stages_of_nothing(spark, tmp_path):
    _, docs = corpus(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, str(tmp_path)), "test")
        assert now.count() == 0


def test_without_labels_no_document_is_rejected(spark, tmp_path):
    _, docs = corpus(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_rejected_documents_go(spark, tmp_path):
    rows = [(i, prose(i, 40) + (" hatefulword vileword" if i % 3 == 0 else "")) for i in range(400)]
    docs = frame(spark, rows)
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = [r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()]
    assert all(i % 3 for i in left) and len(left) == sum(1 for i in range(400) if i % 3)


def brute_toxicity(spark, texts, labels):
    """Rows that a plain FTRL, fed in the operator's order, scores below one half."""
    known = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5}
    order = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").collect()]
    by_id = {i: (t or "").encode() for i, t, _ in texts}
    features = lambda t: sorted({*buckets_of(t, 20).tolist()}) + [1 << 20]
    weights = plain_ftrl([(features(by_id[i]), known[i]) for i in order], Rates())
    return [r for r in texts if sum(weights.get(b, 0.0) for b in features((r[1] or "").encode())) < 0]


def brute_pipeline(spark, texts, labels):
    """What the pipeline packs: (doc_id, text) of each row before packing, by brute force stage by stage."""
    texts = brute_toxicity(spark, texts, labels)
    lines = {}
    for i, text, _, gone in brute_lines([(i, t) for i, t, _ in texts]):
        lines.setdefault(i, (text, gone))
    texts = [(i, lines[i][0], s) for i, _, s in texts if not lines[i][1] or (lines[i][0] or "").split()]
    root = list(range(len(texts)))
    for a, b in sorted(exact_links([t for _, t, _ in texts])):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    texts = [r for k, r in enumerate(texts) if root[k] == k]  # doc_ids ascend
    keys = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(9)).alias("p")).collect()
    place = {r["doc_id"]: (r["p"] >> 54 & 1023, r["p"]) for r in keys}
    sizes = [len((t or "").split()) for _, t, _ in texts]
    taken = brute_mix([(place[i], s, n) for (i, _, s), n in zip(texts, sizes)], 1)
    return [(i, t) for (i, t, _), n, k in zip(texts, sizes, taken) for _ in range(int(k / max(n, 1) + 0.5))]


def test_the_whole_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = []
    for i in range(330):
        words = prose(5000 + i % 300, 90, 6).split("\n")  # the last 30 copy the first
        if i % 6 == 1:
            words.insert(r.randrange(len(words)), "hatefulword vileword")
        if i % 11 == 2:
            words[3:3] = prose(9000, 40, 8).split("\n")  # a passage that many share
        if i % 29 == 3:
            words = [words[0].replace(" ", "  "), *words[1:]]
        texts.append((i, "\n".join(words) if i % 40 else ["", None][i // 40 % 2], f"s{i % 3}" if i % 7 else None))
    labels = [(i, 1, int(i % 6 == 1)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in texts], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute_pipeline(spark, texts, labels)
    assert 100 < len({i for i, _ in want}) < min(280, len(want))
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), want, 1024)


def test_reruns_agree(spark):
    def digest():
        rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "piece", "start", "length", "ids_crc32").collect()
        return hashlib.sha256(repr(sorted(map(tuple, rows), key=repr)).encode()).hexdigest()

    assert digest() == digest()


def test_mixing_keeps_small_sources_whole_at_large_blocks(spark, monkeypatch):
    """Beside a large source, those below one block and of 2-3 blocks keep every document three times."""
    monkeypatch.setattr(corpus_pipeline, "mix", partial(mix, block_words=2500))
    sizes = {"large": 4000, "tiny": 10, "two": 52, "under": 20}
    docs = spark.createDataFrame([(f"{s}-{i}", " ".join(["w"] * 100), s) for s, n in sizes.items() for i in range(n)], "doc_id string, text string, source string")
    got = Counter((r["source"], r["doc_id"]) for r in corpus_pipeline.mixing(spark, docs, "").collect())
    for s in ("tiny", "two", "under"):
        assert [got[s, f"{s}-{i}"] for i in range(sizes[s])] == [3] * sizes[s]
