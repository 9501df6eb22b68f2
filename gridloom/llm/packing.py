"""Packing documents into sequences of at most 2048 tokens by best-fit decreasing.

A document's ids end with END. Overlong documents are first cut into full windows; every piece, longest first, goes to
the open window with the least room that still fits it, which a segment tree over remaining capacities finds. Pieces are
dealt by a hash to shards of about SHARD pieces, so a task's memory is bounded and padding grows by at most a few windows
a shard; a shard's order depends on its rows alone, so reruns agree.

Defined results: a null or empty text is the single id END; rows with the same doc_id are packed apart; only doc_id and
text are read.
"""

from __future__ import annotations

import json
import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, map_text, only

WINDOW, END, SHARD = 2048, 1, 32768
_ENCODERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_byte_level(spec: dict) -> bool:
    """Whether the file is a byte-level BPE with the standard splitting rule and nothing else before or in its model."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    odd = spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges")
    odd = odd or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    return model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not odd


def encoder(path: str):
    """text -> ids, equal to tokenizers' encode(add_special_tokens=False).

    A plain byte-level BPE file, whose ids are in merge order, runs on a faster engine; other files, and texts that this
    engine refuses, go to the tokenizers library itself.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain_byte_level(spec):
        whole = Tokenizer.from_file(path)
        _ENCODERS[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
        return _ENCODERS[path]
    letters = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    # the splitting rule that the type ByteLevel stands for; the file names it, but doesn't spell it out
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # the engine's panics are not Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit | MemoryError):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

    _ENCODERS[path] = encode
    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each document, then what is left."""

    def run(keys, texts):
        encode = encoder(tokenizer)
        out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, text in zip(keys["doc_id"], texts, strict=True):
            ids = np.array([*encode(text.decode("utf-8", "replace")), end], "<u4")
            for at in range(0, len(ids), window):
                part = ids[at : at + window]
                for c, v in zip(out, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    out[c].append(v)
        return out

    return map_text(only(docs, "doc_id", "text"), ["doc_id", "text"], run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """Windows by remaining capacity; tightest(n) is the least capacity of at least n that some window has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, capacity: int, value: int) -> None:
        i = capacity + self.size
        while i and self.any[i] != value:
            self.any[i] = value
            i //= 2
            value = 1 if self.any[2 * i] or self.any[2 * i + 1] else 0

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._set(capacity, 1)

    def take(self, capacity: int) -> int:
        got = self.open[capacity].pop()
        if not self.open[capacity]:
            self._set(capacity, 0)
        return got

    def tightest(self, n: int) -> int:
        """-1 if there is none."""
        i = n + self.size
        if self.any[i]:
            return n
        while i > 1:  # up to the first right sibling with an open window, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; lengths must not increase."""
    tree, where, offset, n = CapacityTree(window), [], [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room < 0:
            room, got, n = window, n, n + 1
        else:
            got = tree.take(room)
        where.append(got)
        offset.append(window - room)
        if room > length:
            tree.add(room - length, got)
    return where, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, shard: int = SHARD) -> DataFrame:
    """pieces() with sequence_id and offset; sequences are padded to window tokens."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.table(pieces(docs, tokenizer or default_tokenizer(), window, end))
    shards = max(1, -(-cut.count() // shard))

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf.assign(sequence_id=np.array(where, np.int64) + (int(key[0]) << 32), offset=offset).drop(columns="shard")

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
