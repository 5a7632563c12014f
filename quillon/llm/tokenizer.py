"""Exact token ids of whole texts.

A ``.json`` file is read by tokenizers, a ``.model`` file by sentencepiece. Where a ``.json``
file holds a byte-level BPE whose merges stand in the order of their ids, its own ranks are
given to tiktoken, which applies the same merges in the same order to the same pattern's
pieces several times faster; the tests compare whole texts. Texts that hold one of the
tokenizer's special strings always go to the library itself, which has its default for them,
and so do texts with runs of white space so long that the faster pattern refuses them.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by which merging equals the file's own merges, or None if it isn't of that kind."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if sorted(vocab.values()) != list(range(len(vocab))) or any(vocab.get(x) != 256 + i for i, x in enumerate(merged)):
        return None
    alphabet = byte_alphabet()
    try:
        return {bytes(alphabet[c] for c in token): rank for token, rank in vocab.items()}
    except KeyError:
        return None


class Encoder:
    """``packed(texts)``: for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.fast, self.special = None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: np.asarray(model.encode(text), "<u4").tobytes()
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if ranks := byte_level_ranks(spec):
            import tiktoken

            merges = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            self.fast = lambda text: merges.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.fast(text)
        except ValueError:  # its pattern gives up on runs of white space of several 100,000 characters
            return self.whole(text)

    def packed(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts(column) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast("binary").to_pylist()]
