"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words' shapes (letters by case, digits, punctuation), its words, and marks
of repetition; a term vector holds root frequencies, weighted by rarity.  The latent space is the
leading right singular vectors of a labelled sample's term matrix.  The sample's vectors and labels are
broadcast (their number is fixed); each batch of documents is multiplied with them in blocks, and the
``NEIGHBOURS`` most similar vote with their similarity as weight.

The sample has at most ``per_class`` labelled documents of each class (a documented bound); terms are
extracted where documents lie, only term counts come to the driver.

Edge cases: null, empty and wordless texts have no neighbours and score 0; null labels don't count,
repeated ones once, and ids with both labels not at all; without labels every score is 0; null ids and repeated rows are scored like
others; further columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed_labels, id_remainder

SHAPES, WORDS, MARKS = 1024, 1024, 32
TERMS = SHAPES + WORDS + MARKS
DIMENSIONS, NEIGHBOURS, WORD_WEIGHT, POWER = 48, 15, 0.3, 4.0


def _class(c: int) -> int:
    if 97 <= c <= 122 or c >= 128:
        return 97
    if 65 <= c <= 90:
        return 65
    return 48 if 48 <= c <= 57 else c


_CLASSES = bytes(map(_class, range(256)))
_RUN = re.compile(rb"(.)\1+", re.S)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and root frequencies of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    shapes = Counter(_RUN.sub(rb"\1", raw.translate(_CLASSES)).split())
    total: dict[int, float] = {}
    for s, c in shapes.items():
        t = zlib.crc32(s) % SHAPES
        total[t] = total.get(t, 0.0) + c
    different = Counter(words)
    for w, c in different.items():
        t = SHAPES + zlib.crc32(w) % WORDS
        total[t] = total.get(t, 0.0) + c * WORD_WEIGHT**2
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = len(raw) - sum(raw.translate(_CLASSES).count(x) for x in (b" ", b"\n"))
    marks = {
        0: again,
        1: max(0, n - len(different)) / 4,
        2: (len(lines) - len(set(lines))) * n / max(1, len(lines)),
        3: n * min(1.0, max(different.values()) / n),
        4 + min(9, int(np.log2(n + 1))): n / 8,
        16 + min(9, letters // n): n / 8,
    }
    for m, c in marks.items():
        if c > 0:
            total[SHAPES + WORDS + m] = float(c)
    return np.fromiter(total, np.int32, len(total)), np.sqrt(np.fromiter(total.values(), np.float32, len(total)) / n)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.basis.shape[1]), dtype=np.float32)
        for i, (t, v) in enumerate(rows):
            if len(t):
                out[i] = (v * self.rarity[t]) @ self.basis[t]
        return _unit(out)

    def vote(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(x), 256):
            near = x[a : a + 256] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            out[a : a + 256] = np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), 0.0)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 4) -> Model:
    """A latent space from term vectors, by subspace iteration, and the labelled vectors in it."""
    if not rows:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, (t, v) in enumerate(rows):
        x[i, t] = v
    rarity = np.log((1.0 + len(rows)) / (1.0 + (x > 0).sum(axis=0))).astype(np.float32) + 1.0
    x *= rarity
    d = min(DIMENSIONS, len(rows))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, d)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    basis = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T
    return Model(rarity, basis.astype(np.float32), _unit(x @ basis).astype(np.float32), np.array(labels, dtype=np.float64))


def fit(documents: DataFrame, labels: DataFrame, *, label_col: str = "quality", fold: int = 4, held_out: int = 2, per_class: int = 2000) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    usable = agreed_labels(labels, label_col).where(id_remainder("doc_id", fold) != held_out)
    sample = [(r.doc_id, r.y) for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    chosen = F.broadcast(documents.sparkSession.createDataFrame(sample, "doc_id long, y int"))

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [term_counts(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "t": [r[0].tolist() for r in rows], "v": [r[1].tolist() for r in rows]})

    found = documents.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(terms, "doc_id long, y int, t array<int>, v array<float>")
    rows = sorted(((r.doc_id, r.y, r.t, r.v) for r in found.toLocalIterator()), key=lambda r: (r[0], r[2], r[3]))
    return train([(np.array(r[2], np.int32), np.array(r[3], np.float32)) for r in rows], [r[1] for r in rows])


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            out = []
            for a in range(0, len(texts), 512):
                out.append(model.vote(model.project([term_counts(t) for t in texts.iloc[a : a + 512]])))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return documents.select(F.col(id_col), F.pandas_udf(scored, "double")(F.col(text_col)).alias("score"))
