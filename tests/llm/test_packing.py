import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing
from tests.llm import cases


def test_hard_rows(spark):
    df = cases.hard(spark)
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    out = packing.pack(df).toPandas()
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 1])
    for doc, texts in want.items():
        part = out[out.doc_id.isna()] if doc is None else out[out.doc_id == doc]
        assert part.length.sum() == sum(map(len, texts))
        crcs = sorted((at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for ids in texts for at in range(0, len(ids), 2048))
        assert sorted(zip(part.start, part.ids_crc32, part.doc_tokens, strict=True)) == crcs
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.pack(cases.empty(spark)).count() == 0


def test_best_fit_matches_plain_search():
    r = random.Random(5)
    for _ in range(30):
        window = r.choice([7, 64, 100])
        lengths = sorted((r.randint(1, window) for _ in range(200)), reverse=True)
        room, want = [], []
        for n in lengths:
            fits = [x for x in room if x >= n]
            if fits:
                k = min(fits)
                room.remove(k)
            else:
                k = window
            want.append(k)
            if k > n:
                room.append(k - n)
        where, offset = packing.best_fit_decreasing(lengths, window)
        assert [window - o for o in offset] == want
        fill = {}
        for w, o, n in zip(where, offset, lengths, strict=True):
            assert fill.get(w, 0) == o
            fill[w] = o + n


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    path = packing.default_tokenizer()
    test_ids_equal_the_tokenizers_library.tok = tok = getattr(test_ids_equal_the_tokenizers_library, "tok", None) or Tokenizer.from_file(path)
    text = text.encode("utf-8", "replace").decode()
    for t in (text, text + "<|endoftext|>" + text, text * 3 + "  \n" + text):
        assert packing.encoder(path)(t) == tok.encode(t, add_special_tokens=False).ids
