"""Toxicity scores by a logistic classifier that counterfactuals regularise.

A text's features are its words and the first 4, 5 and 6 bytes of its words, once by presence anywhere in the whole text
and once by density (at least 1 word in SPARSE, and two), so that one chance word in a long text differs from a habit.
Besides the logistic loss and a ridge, the fit pays for every change of the linear score when the identity terms of a
labelled text are swapped for others of their group, so neutral mentions of a group don't raise scores.

The fit reads a sample of at most about POSITIVES toxic and NEGATIVES other labelled training documents (by a hash of
doc_id; one text for each doc_id) and keeps the FEATURES hashed features with the largest likelihood ratio, and those of
identity terms; these bounds are parameters. Scores are calibrated on scores of documents that the scoring model did not
learn from (FOLDS models, each without a part of the sample). Scoring reads everything.

Defined results: null or wordless texts have no features and get the base score; rows with the same doc_id each get
their score; a null doc_id is never learned from and not held out; with labels of one class or none, scores are that
class (or 0.5). Only doc_id, text and the label are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import distinct_labels, fold, list_array, map_text, only
from gridloom.plans.scratch import release

POSITIVES, NEGATIVES, FEATURES, SPACE, SPARSE, FOLDS = 4000, 8000, 512, 1 << 20, 120, 3
RIDGE, FAIRNESS = 0.1, 10.0
#: Groups of identity terms (English, German, French, Spanish); each group's terms can stand for each other.
IDENTITY = tuple(
    tuple(g.split())
    for g in (
        "women men girls boys", "woman man girl boy", "mother father", "she he", "gay straight lesbian bisexual queer", "transgender cisgender",
        "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "black white asian latino arab",
        "immigrant citizen refugee", "immigrants citizens refugees", "american mexican chinese indian african european", "disabled deaf blind", "old young elderly",
        "frauen männer mädchen jungen", "frau mann", "muslime christen juden hindus", "muslimisch christlich jüdisch", "ausländer inländer flüchtlinge", "türken deutsche polen",
        "femmes hommes filles garçons", "femme homme fille garçon", "musulmans chrétiens juifs", "musulman chrétien juif", "noirs blancs arabes", "immigrés citoyens réfugiés",
        "mujeres hombres niñas niños", "mujer hombre niña niño", "musulmanes cristianos judíos", "negros blancos latinos", "inmigrantes ciudadanos refugiados",
    )
)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True
_WORD = re.compile(r"[^\W\d_]+")


def parts(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats, in order. wanted: a mark for each of the 2 * SPACE features; others are left out."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    letter = _WORD_BYTE[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(data) and letter[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    begins = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in lowered[:-1]], out=begins[1:])
    doc = np.searchsorted(begins, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    of, keys = tokens.byte_hashes(data), []
    keep = None if wanted is None else wanted[:SPACE] | wanted[SPACE:]
    for k in (0, 4, 5, 6):
        at = np.flatnonzero(end - start >= k) if k else np.arange(len(start))
        h = (tokens.mix(of(start[at], start[at] + k if k else end[at]) + np.uint64(k)) & np.uint64(SPACE - 1)).astype(np.int64)
        if keep is not None:
            good = keep[h]
            at, h = at[good], h[good]
        keys.append(doc[at] * SPACE + h)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    text, f = key // SPACE, key % SPACE
    dense = (n >= 2) & (n * SPARSE >= words[text])
    text, f = np.concatenate((text, text[dense])), np.concatenate((f, f[dense] + SPACE))
    if wanted is not None:
        good = wanted[f]
        text, f = text[good], f[good]
    order = np.lexsort((f, text))
    return text[order], f[order]


def swaps(text: bytes, groups=IDENTITY) -> list[bytes]:
    """The text with each identity term replaced by the next of its group, and by the one before; none without such terms."""
    lowered = text.decode("utf-8", "replace").lower()
    out = []
    for step in (1, -1):
        after = {t: g[(i + step) % len(g)] for g in groups for i, t in enumerate(g)}
        made, n = _WORD.subn(lambda m: after.get(m[0], m[0]), lowered)  # noqa: B023
        if n and made != lowered and made.encode() not in out:
            out.append(made.encode())
    return out


@dataclass
class Model:
    """Weights of features for the whole sample (the first row) and without each of its folds; slope and shift calibrate."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[bytes], which: np.ndarray | None = None) -> np.ndarray:
        place = self.__dict__.get("_place")
        if place is None:
            place = np.full(2 * SPACE, -1, np.int32)
            place[self.ids] = np.arange(len(self.ids))
            self.__dict__["_place"] = place
        row = np.zeros(len(texts), np.int64) if which is None else which
        text, f = parts(texts, place >= 0)
        return self.bias[row] + np.bincount(text, self.weights[row[text], place[f]], len(texts))

    def score(self, texts: list[bytes], which: np.ndarray | None = None) -> np.ndarray:
        """which: for each text 0, or 1 + the fold whose model did not learn from it."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts, which) + self.shift, -40, 40)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_place"}


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, ridge: float = RIDGE, fairness: float = FAIRNESS, rows=None, changes=None, use=None) -> tuple[np.ndarray, float]:
    """Newton steps on logistic loss + ridge/2 |w|^2 + fairness/2 |change w|^2; a row of change is x less its swapped form.

    rows, changes and use: the rows of x and of change, and the columns, that count (all by default); they are read in blocks.
    """
    rows = np.arange(len(x)) if rows is None else rows
    changes = np.arange(len(change)) if changes is None else changes
    use = np.arange(x.shape[1]) if use is None else use
    n, k = len(rows), len(use)
    penalty = np.zeros((k + 1, k + 1))
    penalty[:k, :k] = ridge * np.eye(k)
    for at in range(0, len(changes), 1024):
        c = change[np.ix_(changes[at : at + 1024], use)].astype(np.float32)
        penalty[:k, :k] += fairness * (c.T @ c)
    beta = np.zeros(k + 1)
    for _ in range(30):
        grad, hess = penalty @ beta, penalty + 1e-6 * np.eye(k + 1)
        for at in range(0, n, 1024):  # blocks of rows: the matrix stays in bytes
            block = np.ones((min(1024, n - at), k + 1), np.float32)
            block[:, :k] = x[np.ix_(rows[at : at + 1024], use)]
            p = 1 / (1 + np.exp(-np.clip(block @ beta.astype(np.float32), -40, 40)))
            grad += block.T @ (p - y[rows[at : at + 1024]]).astype(np.float32)
            hess += (block * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ block
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return beta[:-1], float(beta[-1])


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through (z, y), both classes weighing the same and labels smoothed (Platt 1999)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t, w = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    centre, scale = z.mean(), max(1e-6, z.std())
    design, beta = np.column_stack(((z - centre) / scale, np.ones(len(z)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        hess = (design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (w * (p - t)) + 1e-3 * beta)
        beta = beta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] <= 0:
        return 1.0, 0.0
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def _sample(docs: DataFrame, known: DataFrame, positives: int, negatives: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, g, text) of labelled documents: ids are sampled first (a bounded number), then broadcast to the scan; one text a doc_id."""
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    grain = 1 << 30
    part = lambda n, most: grain if n <= most else int(grain * most / n)
    limit = F.when(F.col("y") == 1, part(counts.get(1, 0), positives)).otherwise(part(counts.get(0, 0), negatives))
    ids = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(grain)) < limit)
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.first("g").alias("g"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows, counts


def train(docs: DataFrame, known: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, most: int = FEATURES, groups=IDENTITY, ridge: float = RIDGE, fairness: float = FAIRNESS) -> Model:
    """known: (doc_id, y, g) of the rows to learn from; g, 0 to FOLDS - 1, deals them to folds."""
    rows, counts = _sample(only(docs, "doc_id", "text"), known, positives, negatives)
    plain = Model(bias=np.zeros(1 + FOLDS), weights=np.zeros((1 + FOLDS, 0)))
    if set(counts) != {0, 1}:
        plain.shift = {(1,): 40.0, (0,): -40.0}.get(tuple(counts), 0.0)
        return plain

    def present(keys, texts):
        group = np.array([2 * g + y for g, y in zip(keys["g"], keys["y"], strict=True)], np.int64)
        text, f = parts(texts)
        code, n = np.unique(f * (2 * FOLDS) + group[text], return_counts=True)
        return {"f": code // (2 * FOLDS), "c": (code % (2 * FOLDS)).astype(np.int32), "n": n}

    each = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    sums = map_text(rows, ["y", "g", "text"], present, "f long, c int, n long").groupBy("f").agg(*each)
    seen = {(r.g, r.y): r.n for r in rows.groupBy("g", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes := {y for _, y in seen}) < 2:
        plain.shift = 0.0 if not classes else 40.0 if 1 in classes else -40.0
        return plain

    def ratio(without: int | None) -> Column:
        """The likelihood ratio of presence against absence in both classes, over all folds but one."""
        folds = [g for g in range(FOLDS) if g != without]
        t = [float(sum(seen.get((g, y), 0) for g in folds)) for y in (0, 1)]
        n = [sum((F.col(f"c{2 * g + y}") for g in folds), F.lit(0)) for y in (0, 1)]
        every, total = n[0] + n[1], t[0] + t[1]
        out = F.lit(0.0)
        for y in (0, 1):
            out = out + n[y] * F.log(F.greatest(n[y], F.lit(0.5)) * total / F.greatest(every, F.lit(1)) / max(t[y], 1.0))
            out = out + (t[y] - n[y]) * F.log(F.greatest(t[y] - n[y], F.lit(0.5)) * total / F.greatest(total - every, F.lit(0.5)) / max(t[y], 1.0))
        return F.when(every >= 3, F.round(out, 6)).otherwise(0.0)

    scored = sums.select("f", *[ratio(w).alias(f"r{i}") for i, w in enumerate((None, *range(FOLDS)))]).cache()
    best = [np.array([r.f for r in scored.where(f"r{i} > 0").orderBy(F.col(f"r{i}").desc(), "f").limit(most).collect()], np.int64) for i in range(1 + FOLDS)]
    scored.unpersist()
    marks = parts([" ".join(t for g in groups for t in g).encode()])[1] if groups else np.zeros(0, np.int64)
    marks = np.unique(marks % SPACE)
    ids = np.unique(np.concatenate((*best, marks)))
    wanted = np.zeros(2 * SPACE, bool)
    wanted[ids] = True

    place = np.full(2 * SPACE, -1, np.int32)
    place[ids] = np.arange(len(ids))

    def vectors(keys, texts):
        """f: a text's features; c, d: for every swapped form (numbered by c) the features that it gains (d) or loses (-1 - d)."""
        text, f = parts(texts, wanted)
        turned = [(i, s) for i, t in enumerate(texts) for s in swaps(t, groups)]
        owner = np.array([i for i, _ in turned], np.int64)
        text2, f2 = parts([s for _, s in turned], wanted) if turned else (np.zeros(0, np.int64),) * 2
        f, f2 = place[f], place[f2]
        # sets of (form, feature) before and after, as numbers
        size, n = np.bincount(text, minlength=len(texts)), len(ids)
        begin = np.cumsum(size) - size
        old = np.concatenate([k * n + f[begin[i] : begin[i] + size[i]] for k, i in enumerate(owner.tolist())] or [np.zeros(0, np.int64)]).astype(np.int64)
        new = text2 * n + f2
        gain, lose = np.setdiff1d(new, old, assume_unique=True), np.setdiff1d(old, new, assume_unique=True)
        form = np.concatenate((gain // n, lose // n)) if n else np.zeros(0, np.int64)
        sign = np.concatenate((gain % n, -1 - lose % n)) if n else np.zeros(0, np.int64)
        doc = owner[form]
        order = np.argsort(doc, kind="stable")
        changes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        return {
            "y": keys["y"], "g": keys["g"], "h": keys["h"], "f": list_array(f, size, pa.int32()),
            "c": list_array(form[order].astype(np.int32), changes, pa.int32()), "d": list_array(sign[order].astype(np.int32), changes, pa.int32()),
        }

    # as Arrow and in a fixed order; the driver holds flat arrays of at most the sample's documents
    keyed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(12)))
    got = map_text(keyed, ["y", "g", "h", "text"], vectors, "y int, g int, h long, f array<int>, c array<int>, d array<int>").toArrow().sort_by("h").combine_chunks()
    flat = {c: (got[c].chunk(0) if got[c].num_chunks else pa.array([], got[c].type)) for c in got.column_names}
    y, g = flat["y"].to_numpy().astype(float), flat["g"].to_numpy()
    sizes = lambda c: flat[c].value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(y), len(ids)), np.int8)
    x[np.repeat(np.arange(len(y)), sizes("f")), flat["f"].flatten().to_numpy()] = 1
    doc, form, d = np.repeat(np.arange(len(y)), sizes("c")), flat["c"].flatten().to_numpy(), flat["d"].flatten().to_numpy()
    _, row = np.unique(doc.astype(np.int64) << 32 | form, return_inverse=True)
    owner = np.zeros(row.max(initial=-1) + 1, np.int64)
    owner[row] = doc
    change = np.zeros((len(owner), len(ids)), np.int8)  # the text less its swapped form
    change[row, np.where(d < 0, -1 - d, d)] = np.where(d < 0, 1, -1)
    del got, flat, doc, form, d, row
    model = Model(ids, np.zeros((1 + FOLDS, len(ids))), np.zeros(1 + FOLDS))
    z = np.zeros(len(y))
    for i in range(1 + FOLDS):
        rest, left = np.flatnonzero(g != i - 1), np.flatnonzero(g == i - 1)
        if len(rest) and 0 < y[rest].sum() < len(rest):
            use = np.flatnonzero(np.isin(ids, np.concatenate((best[i], marks))))
            w, b = fit(x, y, change, ridge, fairness, rest, np.flatnonzero(g[owner] != i - 1), use)
            model.weights[i, use], model.bias[i] = w, b
            for at in range(0, len(left) if i else 0, 1024):
                part = left[at : at + 1024]
                z[part] = x[part].astype(np.float32) @ model.weights[i].astype(np.float32) + b
    if len(set(g.tolist())) > 1:
        model.slope, model.shift = calibrate(z, y)
    return model


def score(docs: DataFrame, model: Model, columns: list[str], which: Column | None = None) -> DataFrame:
    """The named columns (of simple types) and score. which: see Model.score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the parameters
    kinds = dict(docs.dtypes)

    def run(keys, texts):
        return {c: [k[c] for k in keys["_k"]] for c in columns} | {"score": held.value.score(texts, np.array(keys["_w"], np.int64))}

    rows = docs.select(F.struct(*columns).alias("_k"), (F.lit(0) if which is None else which).alias("_w"), "text")
    return map_text(rows, ["_k", "_w", "text"], run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows with crc32(doc_id) mod folds = held are not learned from."""
    docs = only(docs, "doc_id", "text")
    known = distinct_labels(labels, "toxic").where("y in (0, 1)").where(fold(F.col("doc_id"), folds) != held)
    model = train(docs, known.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")))
    out = score(docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, whose score stays below threshold.

    A labelled document is scored by the model that did not learn from its fold, so a label never decides on its own text.
    """
    group = F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(0)).cast("int")
    known = distinct_labels(labels, "toxic").where("y in (0, 1)").withColumn("g", group)
    model = train(only(docs, "doc_id", "text"), known)
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts, which):
        import pandas as pd

        found = []
        for at in range(0, len(texts), 256):
            found.append(held.value.score([b"" if t is None else t.encode() for t in texts.iloc[at : at + 256]], which.iloc[at : at + 256].to_numpy(np.int64)))
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.where(rate(F.col("text"), group + 1) < threshold)
