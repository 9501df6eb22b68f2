"""Removal of repeated word sequences by recompression.

Words get 64-bit names. Each round first names maximal runs of one symbol, then pairs a symbol of class 0 with a following
one of class 1 (classes are bits of the names). Names are hashes of what they stand for, so they are global without a
dictionary: a round is a projection of the whole corpus that needs no shuffle. Every symbol carries the words on which
its parse depends; wherever these words stand, the same symbol comes out, so equal windows have equal interior symbols.

A window's anchor is the longest such symbol inside it (ties by name). Neighbouring windows with one anchor form a range,
named by its anchor and by a hash of all its words; only these names are shuffled. An anchor that one document alone has
ends there. A range whose words occur in an earlier document is removed whole. Only ranges that are the first of their
words but share the anchor with other ranges are compared window by window. Windows without an inner symbol (long runs)
are their own anchors, so none is left out.

Defined results: a window counts as repeated if it also starts in a document with a smaller doc_id; null text has no
words; documents with the same words are compared once; rows with the same doc_id don't repeat each other; a null doc_id
is smaller than none and repeats nothing. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import Scratch, among, id_filter, join_hot, map_text, only

WINDOW, ROUNDS = 50, 4
_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _round(sym, st, en, cl, cr, doc, begin, end, k):
    """One run step and one pair step; cl and cr bound the words each symbol depends on (begin-1, end+1: the text's edge)."""
    n = len(sym)
    join = np.zeros(n, bool)
    join[1:] = (doc[1:] == doc[:-1]) & (sym[1:] == sym[:-1])
    head = np.flatnonzero(~join)
    tail = np.append(head[1:], n) - 1
    length = (tail - head + 1).astype(np.uint64)
    d = doc[head]
    left = np.zeros(len(head), bool)
    left[1:] = d[1:] == d[:-1]
    right = np.append(left[1:], False)
    ncl = np.where(left, cl[np.maximum(head - 1, 0)], begin[d] - 1)
    ncr = np.where(right, cr[np.minimum(tail + 1, n - 1)], end[d] + 1)
    sym = np.where(length > 1, tokens.mix(sym[head] * _C1 + length * _C2 + np.uint64(2 * k)), sym[head])
    st, en, cl, cr, doc = st[head], en[tail], ncl, ncr, d
    one = (tokens.mix(sym ^ tokens.mix(np.full(1, k + 1, np.uint64))) >> np.uint64(63)).astype(bool)
    pair = np.zeros(len(sym), bool)
    pair[:-1] = right[:-1] & ~one[:-1] & one[1:]
    second = np.append(False, pair[:-1])
    after = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
    before = np.maximum(np.arange(len(sym)) - 1, 0)
    made = tokens.mix(sym * _C2 + ((sym[after] << np.uint64(17)) | (sym[after] >> np.uint64(47))) * _C1 + np.uint64(2 * k + 1))
    nsym = np.where(pair, made, sym)
    nen = np.where(pair, en[after], en)
    # a lone symbol's fate depends on the neighbour it might have paired with
    ncr = np.where(pair, cr[after], np.where(one, cr, np.where(right, cr[after], end[doc] + 1)))
    ncl = np.where(one, np.where(left, cl[before], begin[doc] - 1), cl)
    keep = ~second
    return nsym[keep], st[keep], nen[keep], ncl[keep], ncr[keep], doc[keep]


def parse(words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """(symbol, start, end, context start, context end) after the rounds, in words of the whole batch."""
    end = np.cumsum(counts)
    begin = end - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    state = (words, at, at + 1, at, at + 1, doc)
    for k in range(rounds):
        if len(state[0]):
            state = _round(*state, begin, end, k)
    return state[:5]


def ranges(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """(text, first window, windows, anchor, hash of the range's words); windows are numbered inside their text."""
    sym, st, en, cl, cr = parse(words, counts, rounds)
    end = np.cumsum(counts)
    begin = end - counts
    live = np.maximum(counts - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), live)
    s = np.arange(live.sum()) - np.repeat(np.cumsum(live) - live, live) + begin[doc]
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    lo, hi = np.searchsorted(cl, s, "left"), np.searchsorted(cr, s + window, "right")
    rank = (np.uint64(255) - np.minimum(en - st, 255).astype(np.uint64) << np.uint64(56)) | (tokens.mix(sym) >> np.uint64(8))
    some = hi > lo
    anchor = np.full(len(s), -1)
    if some.any():
        size = (hi - lo)[some]
        level = np.floor(np.log2(size)).astype(np.int64)
        best = [np.arange(len(sym))]
        for k in range(level.max()):
            a, step = best[-1], 1 << k
            b = a[np.minimum(np.arange(len(a)) + step, len(a) - 1)]
            best.append(np.where(rank[b] < rank[a], b, a))
        stack = np.stack(best)
        a, b = stack[level, lo[some]], stack[level, hi[some] - (1 << level)]
        anchor[some] = np.where((rank[b] < rank[a]) | ((rank[b] == rank[a]) & (b < a)), b, a)
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (anchor[1:] < 0)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(s)))
    span = tokens.span_hashes(words, s[first], s[first] + many - 1 + window, seed=13)
    key = np.where(anchor[first] >= 0, sym[anchor[first]], span)
    return doc[first], s[first] - begin[doc[first]], many, key, span


def _digests(docs: DataFrame) -> DataFrame:
    def run(keys, texts):
        words, counts = tokens.word_hashes(texts)
        end = np.cumsum(counts)
        d = [tokens.span_hashes(words, end - counts, end, seed=k).view(np.int64) for k in (17, 19)]
        return {"doc_id": keys["doc_id"], "t": keys["t"], "n_words": counts, "d": d[0], "e": d[1]}

    return map_text(docs, ["doc_id", "t", "text"], run, "doc_id long, t long, n_words long, d long, e long")


def _ranges(docs: DataFrame, window: int) -> DataFrame:
    def run(keys, texts):
        words, counts = tokens.word_hashes(texts)
        row, s, n, key, span = ranges(words, counts, window)
        ids, t = np.array(keys["doc_id"], np.int64), np.array(keys["t"], np.int64)
        return {"doc_id": ids[row], "t": t[row], "s": s.astype(np.int32), "n": n.astype(np.int32), "key": key.view(np.int64), "span": span.view(np.int64)}

    return map_text(docs, ["doc_id", "t", "text"], run, "doc_id long, t long, s int, n int, key long, span long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """docs: (r: doc_id, t and at, an array of (s, n, key); text) -> a row for each window of the ranges."""

    def run(keys, texts):
        words, counts = tokens.word_hashes(texts)
        h1, h2 = tokens.window_hashes(words, window, seed=23), tokens.window_hashes(words, window, seed=29)
        begin = np.cumsum(counts) - counts
        out = {c: [] for c in ("doc_id", "t", "s", "key", "h1", "h2")}
        for r, b in zip(keys["r"], begin.tolist(), strict=True):
            for a in r["at"]:
                s = np.arange(a["s"], a["s"] + a["n"])
                for c, v in zip(out, (np.full(len(s), r["doc_id"]), np.full(len(s), r["t"]), s, np.full(len(s), a["key"]), h1[b + s].view(np.int64), (h2[b + s] >> np.uint64(33)).astype(np.int64)), strict=True):
                    out[c].append(v)
        return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()} | {"h2": np.concatenate(out["h2"]).astype(np.int32) if out["h2"] else np.zeros(0, np.int32), "s": np.concatenate(out["s"]).astype(np.int32) if out["s"] else np.zeros(0, np.int32)}

    return map_text(docs, ["r", "text"], run, "doc_id long, t long, s int, key long, h1 long, h2 int")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, t and text; t, a hash of the text, tells rows with one doc_id apart."""
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("t"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, spans): the word ranges [a, z) to remove, of documents that have any."""
    scratch = Scratch(docs.sparkSession)
    docs = _identified(docs).where("doc_id is not null")
    seen = scratch.table(_digests(docs).where(F.col("n_words") >= window))
    first = seen.groupBy("d", "e").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = scratch.table(seen.join(first, ["d", "e"]).where("doc_id > low").select("doc_id", "t", "n_words").distinct())
    scratch.drop(seen)
    maybe, surely = id_filter(copies, "doc_id")(docs, "doc_id")
    single = surely.union(among(maybe, copies, ["doc_id", "t"], present=False).select(*surely.columns))
    all_ranges = scratch.table(_ranges(single, window))
    shared = all_ranges.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high").select("key", "rows")
    met = scratch.table(join_hot(all_ranges, shared, ["key"], "rows", all_ranges.count()).drop("rows"))
    scratch.drop(all_ranges)
    firsts = scratch.table(met.groupBy("key", "span").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    open_ = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.lit(True).alias("open"))
    judged = scratch.table(join_hot(met, firsts.join(open_, "key", "left"), ["key", "span"], "rows", met.count()).drop("rows"))
    scratch.drop(met)
    whole = judged.where("first < doc_id").select("doc_id", "t", F.col("s").cast("int").alias("a"), (F.col("s") + F.col("n") + (window - 1)).cast("int").alias("z"))
    # at most one entry for each window of a document
    ask = scratch.table(judged.where("first = doc_id and open").groupBy("doc_id", "t").agg(F.collect_list(F.struct("s", "n", "key")).alias("at")))
    texts, _ = id_filter(ask, "doc_id")(docs, "doc_id")
    asked = texts.join(ask, ["doc_id", "t"]).select(F.struct("doc_id", "t", "at").alias("r"), "text")
    wins = scratch.table(_windows(asked, window))
    early = wins.groupBy("key", "h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high").drop("high")
    part = join_hot(wins, early, ["key", "h1", "h2"], "rows", wins.count()).where("doc_id > low").select("doc_id", "t", F.col("s").alias("a"), (F.col("s") + window).cast("int").alias("z"))
    copied = copies.select("doc_id", "t", F.lit(0).alias("a"), F.col("n_words").cast("int").alias("z"))
    return scratch.table(whole.union(part).union(copied).groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "z")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""
    spans = repeated_spans(docs, window)
    maybe, surely = id_filter(spans, "doc_id")(_identified(docs), "doc_id")
    plain = surely.select(F.struct("doc_id", F.lit(None).cast(dict(spans.dtypes)["spans"]).alias("spans")).alias("r"), "text")
    touched = maybe.join(spans, ["doc_id", "t"], "left").select(F.struct("doc_id", "spans").alias("r"), "text")

    def run(keys, texts):
        out = {"doc_id": [r["doc_id"] for r in keys["r"]], "n_words": [], "n_removed": [], "kept": []}
        for r, text in zip(keys["r"], texts, strict=True):
            words = text.split()
            n = len(words)
            if r["spans"]:
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, [x["a"] for x in r["spans"]], 1)
                np.add.at(mark, [x["z"] for x in r["spans"]], -1)
                words = [w for w, c in zip(words, np.cumsum(mark).tolist(), strict=False) if not c]
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        return out

    return map_text(plain.union(touched), ["r", "text"], run, "doc_id long, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats() with the SHA-256 of kept in its place."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
