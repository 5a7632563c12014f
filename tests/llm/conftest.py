import random

import pytest

#: Columns whose names the operators use inside; they must neither clash nor change results.
CLASHING = ["row", "key", "kept", "score", "gone", "size", "start", "n", "block", "taken", "range"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(seed: int, words: int, per_line: int = 9) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    shared = prose(1, 130)
    near = prose(2, 200)
    changed = near.split(" ")
    changed[50] = "changed"
    return [
        (1, shared), (2, shared), (2, shared), (3, "start of it\n" + shared + "\nend of it"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (None, shared), (None, None),
        (7, near), (8, " ".join(changed)), (9, "one"), (10, "one"), (11, "one two three"), (12, prose(3, 12_000)), (13, prose(3, 12_000) + " tail"), (14, "a a a a a a a a a a a a\n" * 30),
        (15, "café 日本語 \U0001f600 x y <|endoftext|> it's  two   spaces \n\n 'll"), (16, prose(4, 60)), (17, prose(5, 49)), (18, prose(5, 49)), (18, prose(6, 70)), (19, "x" * 50_000), (20, "same line\n" * 5 + "other"),
    ]


def frame(spark, texts, extra=True):
    rows = [(i, t, None if k % 5 == 4 else f"s{k % 4}", "en", None if t is None else len(t), *(["x"] * len(CLASHING))) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if extra else df.select("doc_id", "text", "source", "lang", "n_chars")


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_texts())


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
