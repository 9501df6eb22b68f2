import random
import re

import numpy as np

from gridloom.llm import embed, substring, tokens
from tests.llm import cases


def plain_removal(rows, window):
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 5))) for _ in range(60)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 200)] + [["run"] * 120, ["x", "y"] * 70, text(7) * 20]
    rows = []
    for i in range(120):
        t = text(r.choice([0, 3, 60, 200]))
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            t += p if r.random() < 0.6 else p[a:b]
            t += text(r.choice([0, 1, 40]))
        if r.random() < 0.1 and rows:
            t = r.choice(rows)[1].split()
        rows.append((i, " ".join(t)))
    r.shuffle(rows)
    return rows


def removal(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()], key=str)


def test_removal_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert removal(cases.docs(spark, rows)) == plain_removal(rows, 50)


def test_removal_hard_rows(spark):
    df = cases.hard(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert removal(df) == plain_removal(rows, 50)
    assert substring.removal_digests(cases.empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors():
    """Whatever stands around it, a window's anchor is the same symbol at the same place."""
    r = random.Random(3)
    core = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(90)] + ["r"] * 8 + [r.choice("abcdefgh") for _ in range(60)]
    found = {}
    for _ in range(40):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 30))] for _ in range(2))
        words, counts = tokens.word_hashes([" ".join(a + core + b).encode()])
        _, s, n, key, _ = substring.ranges(words, counts)
        for i in range(len(s)):
            for w in range(s[i], s[i] + n[i]):
                if len(a) <= w <= len(a) + len(core) - 50:
                    assert found.setdefault(w - len(a), key[i]) == key[i]


def plain_links(rows, cosine):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, tuple(v)))
    good = sorted(set(good))
    unit = {g: np.array(g[1], float) / np.linalg.norm(np.array(g[1], float)) for g in good}
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if good[a][0] != good[b][0] and len(good[a][1]) == len(good[b][1]) and unit[good[a]] @ unit[good[b]] >= cosine:
                links[good[a][0]] += 1
                links[good[b][0]] += 1
                x, y = sorted((find(good[a][0]), find(good[b][0])))
                root[y] = x
    return sorted([(i, links[i], find(i)) for i, _ in rows], key=str)


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(60):
        base = r.normal(size=24)
        for _ in range([1, 2, 4, 700][0 if g % 3 else min(3, 1 + g // 9)] if g != 27 else 700):
            rows.append((len(rows), [float(np.float32(x)) for x in base + r.normal(size=24) * 0.1 * r.random()]))
    rows += [(len(rows) + k, rows[5][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted([(x.vec_id, x.n_links, x.component_id) for x in embed.link_vectors(df).collect()], key=str)
    want = plain_links(rows, 0.95)
    exact = sum(a == b for a, b in zip(got, want, strict=True))
    assert exact >= 0.99 * len(want), [(a, b) for a, b in zip(got, want, strict=True) if a != b][:5]
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_links_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as copies", "'x' as key")
    out = embed.link_vectors(df)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in out.collect()], key=str) == plain_links(rows, 0.95)
    assert embed.link_vectors(df.limit(0)).count() == 0


def test_chance_of_one_key():
    r = np.random.default_rng(1)
    a, b = r.standard_normal((64, 20000)), r.uniform(0, embed.WIDTH, 20000)
    x = np.zeros(64)
    y = np.zeros(64)
    y[0] = 0.5
    same = (np.floor((x @ a + b) / embed.WIDTH) == np.floor((y @ a + b) / embed.WIDTH)).mean()
    assert abs(same - embed.same_key_chance(0.5)) < 0.02
