"""Language identification by a string kernel.

A text's spectrum is the set of its 1- to 3-byte n-grams (letters lower-cased, other ASCII as one space), hashed to
BUCKETS. The blended-spectrum presence kernel of two texts is the size of their spectra's intersection over the geometric
mean of their sizes. Nyström landmarks turn it into vectors, on which one-versus-rest ridge regression is solved; a batch
of texts is scored by three matrix products. Texts are read whole.

The fit reads a sample of at most about PER_LANGUAGE labelled training texts a language and SAMPLE in all (by a hash of
doc_id and text; equal rows count once), and LANDMARKS of them; these are parameters. A language is never left out.

Defined results: null text or text without a letter gives `und` and score 0; a null doc_id is scored but never learned
from and not held out; without training rows every text is `und`. Inputs of a prediction: the text alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fold, map_text, only

BUCKETS, LANDMARKS, PER_LANGUAGE, SAMPLE, RIDGE = 8192, 256, 1500, 30000, 1e-3
_MAYBE = re.compile(r"[^\W\d_]")
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)


def has_letter(text: str) -> bool:
    """Whether a character is of category L; the quick test alone would take fractions and superscripts too."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def spectra(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """A boolean row of n-gram buckets for each text."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    data = _CLEAN[np.frombuffer(b"".join(t + b" " for t in lowered), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    out = np.zeros(len(texts) * buckets, bool)
    code = data.copy()
    for n in (1, 2, 3):
        m = len(data) - n + 1
        if n > 1:
            code = (code[:m] << np.uint32(8)) | data[n - 1 :]
        inside = owner[:m] == owner[n - 1 :]
        if n > 1:
            inside &= ~((data[:m] == 32) & (data[1 : m + 1] == 32))
        h = ((code[:m] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(7)) & np.uint32(buckets - 1)
        out[owner[:m][inside] * buckets + h[inside]] = True
    return out.reshape(len(texts), buckets)


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    x, z = x.astype(np.float32), z.astype(np.float32)
    return (x @ z.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] / np.sqrt(np.maximum(z.sum(1), 1))[None, :]


class KernelClassifier:
    def __init__(self, x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(y))
        label = np.array([self.names.index(v) for v in y])
        # landmarks evenly from every language, in the given (hashed) order
        turn = np.zeros(len(y), int)
        for k in range(len(self.names)):
            turn[label == k] = np.arange((label == k).sum())
        picked = np.lexsort((label, turn))[: max(landmarks, len(self.names))]
        self.z = x[picked]
        values, vectors = np.linalg.eigh(kernel(self.z, self.z).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.map = vectors[:, good] / np.sqrt(values[good])
        phi = np.column_stack((kernel(x, self.z) @ self.map, np.ones(len(y))))
        # every language weighs the same
        weight = 1 / np.bincount(label)[label] * len(y) / len(self.names)
        target = (label[:, None] == np.arange(len(self.names))[None, :]).astype(float)
        gram = (phi * weight[:, None]).T @ phi + ridge * len(y) * np.eye(phi.shape[1]) / 100
        self.w = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)

    def values(self, x: np.ndarray) -> np.ndarray:
        return (kernel(x, self.z) @ self.map) @ self.w[:-1] + self.w[-1]


def _sample(docs: DataFrame, folds: int, held: int, per_language: int, sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).where(fold(F.col("doc_id"), folds) != held)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, BUCKETS), bool), []
    grain, per_language = 1 << 30, max(1, min(per_language, sample // len(counts)))
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(grain))
    share = {k: grain if n <= per_language else max(1, int(grain * per_language / n)) for k, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    picked = rows.where(u < limit).dropDuplicates(["doc_id", "lang", "text"]).select(F.struct("doc_id", "lang").alias("k"), "text")

    def run(keys, texts):
        return {"doc_id": [k["doc_id"] for k in keys["k"]], "lang": [k["lang"] for k in keys["k"]], "bits": [b.tobytes() for b in np.packbits(spectra(texts), axis=1)]}

    got = map_text(picked, ["k", "text"], run, "doc_id long, lang string, bits binary").toArrow()
    order = sorted(range(len(got)), key=lambda i: (_scatter(got["doc_id"][i].as_py()), got["lang"][i].as_py(), got["bits"][i].as_py()))
    bits = np.array([np.frombuffer(got["bits"][i].as_py(), np.uint8) for i in order]).reshape(len(order), -1)
    return np.unpackbits(bits, axis=1).astype(bool), [got["lang"][i].as_py() for i in order]


def _scatter(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 20


def identify(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows with crc32(doc_id) mod folds = held are not learned from."""
    docs = only(docs, "doc_id", "text", "lang")
    x, y = _sample(docs, folds, held, per_language)
    model = KernelClassifier(x, y, landmarks) if y else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the parameters

    def run(keys, texts):
        m = shared.value
        ids, flags = [k["doc_id"] for k in keys["k"]], [k["held_out"] for k in keys["k"]]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        spoken = [i for i, t in enumerate(texts) if t and has_letter(t.decode("utf-8", "replace"))]
        if m is not None and spoken:
            v = m.values(spectra([texts[i] for i in spoken]))
            best = v.argmax(1)
            for i, b, s in zip(spoken, best, np.clip(v[np.arange(len(best)), best], 0, 1), strict=True):
                names[i], scores[i] = m.names[b], s
        return {"doc_id": ids, "held_out": flags, "lang_pred": names, "score": pa.array(scores)}

    key = F.struct("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")).alias("k")
    return map_text(docs.select(key, "text"), ["k", "text"], run, "doc_id long, held_out boolean, lang_pred string, score double")
