import math
import re
from collections import defaultdict

from gridloom.llm import mixing
from tests.llm import cases


def plain_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out = set(names), {}
    while True:
        budget = 1.5 * sum(size.values()) - sum(out.values())
        share = {s: budget * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 2.0 * size[s] for s in over}
        left -= over


def check(df):
    out = mixing.mix(df).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(size)
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3, (s, taken[s], t)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df).collect()))
    return out


def test_targets_and_sizes(spark):
    rows = [(i, "w " * (i * 7 % 50), None, f"s{i % 3}" if i % 5 else None) for i in range(400)] + [(1000, "big " * 9000, None, "hot")]
    out = check(cases.docs(spark, rows))
    assert {r.doc_id: r.size for r in out} == {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}


def test_hard_rows(spark):
    df = cases.hard(spark)
    assert len(check(df)) == df.count()
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_apply_takes_what_the_mix_says(spark):
    rows = [(i, " x  y\tz\n" * (i % 9), None, f"s{i % 2}") for i in range(200)]
    df = cases.docs(spark, rows)
    want = {(r.doc_id, r.taken) for r in mixing.mix(df).collect() if r.taken}
    got = defaultdict(int)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert set(got.items()) == want


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 4)
    check(cases.docs(spark, [(i, "w " * (1 + i % 5), None, f"s{i % 4}") for i in range(3000)]))
