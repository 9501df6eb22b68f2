import random
import zlib

import numpy as np
import pytest

from gridloom.llm import langid, quality, toxicity
from tests.llm import cases

SYLLABLES = {"en": "the er on an re he in ed nd ha at", "fr": "le ou la eau que des é ment ion aux", "de": "der ch ei en sch ung ge be tz ä"}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    """Texts with known quality, toxicity and language, and the labels."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        lang = r.choice(list(SYLLABLES))
        t = prose(r, lang, r.choice([4, 30, 200]))
        bad, toxic = r.random() < 0.2, r.random() < 0.2
        if bad:
            t = r.choice([lambda t: " ".join(w + "%%%" for w in t.split()), lambda t: " | ".join(t.split()), lambda t: " ".join(w.upper() + "!!" for w in t.split())])(t)
        if toxic:
            w = t.split()
            w.insert(r.randrange(len(w) + 1), r.choice(["grumpfoo", "blargbar", "snorkelbaz"]) + r.choice(["", "x", "ish"]))
            t = " ".join(w)
        rows.append((i, t, lang, "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs = cases.docs(spark, rows)
    return docs.cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def rate(out, truth, column="predicted"):
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 100
    return sum(r[column] == truth[r.doc_id] for r in held) / len(held)


def test_quality(table):
    docs, labels = table
    out = quality.score_quality(docs, labels)
    assert rate(out, {r.doc_id: r.quality for r in labels.collect()}) > 0.95
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_quadratic_form_matches_the_definition():
    r = np.random.default_rng(0)
    x0, x1 = r.normal(0, 1, (400, 3)), r.normal(1, 2, (300, 3)) @ r.normal(0, 1, (3, 3))
    sums = {k: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for k, x in ((0, x0), (1, x1))}
    m = quality.fit_discriminant(sums, 3, 0.0, 0.0)
    z = (np.vstack((x0, x1)) - m.centre) / m.scale
    want = 0
    for sign, x in ((-1, x0), (1, x1)):
        s = (x - m.centre) / m.scale
        c = np.cov(s.T, bias=True) + 1e-3 * np.eye(3)
        d = z - s.mean(0)
        want = want + sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(x)))
    assert np.allclose(m.difference(np.vstack((x0, x1))), want)


def test_toxicity(table):
    docs, labels = table
    out = toxicity.score_toxicity(docs, labels)
    assert rate(out, {r.doc_id: r.toxic for r in labels.collect()}) > 0.95
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    clean = {r.doc_id for r in labels.collect() if not r.toxic}
    assert len(clean & left) >= 0.99 * len(clean)


def test_counterfactuals_lower_the_weight_of_groups(spark):
    """Toxic training texts mention one group far more often; neutral mentions must not score high."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = r.random() < 0.4
        w = prose(r, "en", 20).split()
        if r.random() < (0.9 if toxic else 0.05):
            w.insert(3, "muslim")
        elif r.random() < 0.5:
            w.insert(3, "christian")
        if toxic and r.random() < 0.7:
            w.insert(5, "grumpfoo")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = cases.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, y int").selectExpr("*", "cast(doc_id % 3 as int) as g")
    gap = {}
    for fairness in (0.0, 10.0):
        m = toxicity.train(docs, known, fairness=fairness)
        a, b, c = m.score([b"the muslim on an re", b"the christian on an re", b"the grumpfoo on an re"])
        gap[fairness] = a - b
        assert c > 0.7
    assert gap[0.0] > 0.2 and abs(gap[10.0]) < gap[0.0] / 4


def test_fit_against_a_plain_optimiser():
    """Newton's result has the least loss: plain gradient descent from zero gets there too."""
    r = np.random.default_rng(4)
    x = (r.random((80, 5)) < 0.4).astype(np.int8)
    y = (x[:, 0] + x[:, 1] + r.random(80) > 1.2).astype(float)
    change = (x[:20] - x[20:40]).astype(np.int8)
    w, b = toxicity.fit(x, y, change, 0.3, 2.0)
    v = np.zeros(6)
    design = np.column_stack((x, np.ones(80)))
    for _ in range(20000):
        grad = design.T @ (1 / (1 + np.exp(-design @ v)) - y) + np.append(0.3 * v[:5] + 2.0 * change.T.astype(float) @ (change @ v[:5]), 0)
        v -= 0.01 * grad
    assert np.allclose(np.append(w, b), v, atol=1e-3)


def test_swaps():
    assert toxicity.swaps(b"no terms here") == []
    assert toxicity.swaps(b"A woman and a Frau", (("woman", "man"), ("frau", "mann"))) == [b"a man and a mann"]
    assert toxicity.swaps(b"gay", (("gay", "straight", "queer"),)) == [b"straight", b"queer"]


def test_parts_by_hand():
    """Presence and density of words and of their first 4, 5 and 6 bytes; upper case and batches make no difference."""
    text, f = toxicity.parts([b"abcde ABCDE xy", b"", b"abcde"])
    assert np.array_equal(np.unique(text), [0, 2])
    one, three = set(f[text == 0].tolist()), set(f[text == 2].tolist())
    assert len(three) == 3 and three < one  # the word and two beginnings (a 5-byte word has no sixth)
    assert len(one) == 4 + 3  # xy, and the three again as dense
    alone = toxicity.parts([b"abcde ABCDE xy"])[1]
    assert set(alone.tolist()) == one


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.8), ("sf0.1", 0.92)])
def test_toxicity_of_held_out_documents(spark, sf, least):
    """Some toxic labels stand on texts without any mark, hence not 1 (18 toxic held-out documents at sf0.01)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    found = got[got.toxic == 1].predicted.mean(), got[got.toxic == 0].predicted.mean()
    assert found[0] >= least and found[1] <= 0.02, found


def test_toxicity_of_repeated_rows(spark):
    """One text of a doc_id is learned, so the sample stays bounded; every row gets its score."""
    docs = cases.docs(spark, [(i % 4, f"word{i % 4} " + "bad " * (i % 2)) for i in range(400)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    rows, _ = toxicity._sample(docs, labels.selectExpr("doc_id", "toxic as y", "0 as g"), 10, 10)
    assert rows.count() == 4
    assert toxicity.score_toxicity(docs, labels).count() == 400


def test_language(table):
    docs, _ = table
    out = langid.identify(docs)
    assert rate(out, {r.doc_id: r.lang for r in docs.collect()}, "lang_pred") > 0.95


def test_presence_kernel_by_hand():
    x = langid.spectra([b"abc", b"abd", b"", b"ABC"])
    k = langid.kernel(x, x)
    # n-grams with the closing space: a b c _ ab bc c_ abc bc_ against a b d _ ab bd d_ abd bd_
    assert np.array_equal(x[0], x[3]) and np.isclose(k[0, 1], 4 / 9, atol=0.01)


def test_hard_rows(spark, table):
    _, labels = table
    df = cases.hard(spark)
    n = df.count()
    for out in (quality.score_quality(df, labels), toxicity.score_toxicity(df, labels), langid.identify(df)):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == by[2] == by[3] == "und" and by[6] == "de"
    none = labels.limit(0)
    empty = cases.empty(spark)
    for docs, lab in ((df, none), (empty, labels), (empty, none), (df, labels.selectExpr("doc_id", "1 as quality", "0 as toxic"))):
        assert quality.score_quality(docs, lab).count() == docs.count()
        assert toxicity.score_toxicity(docs, lab).count() == docs.count()
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
