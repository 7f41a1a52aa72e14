"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A text's features are its word n-grams, those of the words' shapes (runs of capitals, small letters, digits
and signs; a repeated word has a shape of its own), and whether a three-word run occurred before in the text,
all hashed into ``2 ** BITS`` places. A value is the share of n-grams of its kind, so a text of any length
weighs the same. Scores are sparse dot products of these values with the weights.

The weights are fitted on a bounded sample: at most ``rows`` labelled documents, taken by the hash of their
id. It is dealt to ``SHARDS`` tasks; each makes FTRL-proximal passes over its documents, and the weights are
averaged (4 bytes a place and shard).

Defined results: a null or empty text has no features and gets the score of the intercept; without labels
every score is 0.5; a null label is not used; of several labels of a document each counts as one example.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLANKS, add_columns, hashed_words, mix, shingles, text_bytes

BITS = 20
SHARDS = 4
_KIND = bytes(
    9 if c == 32 or 9 <= c <= 13 else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_SAME = np.uint64(0xA5A5A5A5A5A5A5A5)


def shape(raw: bytes | None) -> bytes:
    """Text with each run of one kind of character as one character."""
    if not raw:
        return b""
    b = np.frombuffer(raw.translate(_KIND), dtype=np.uint8)
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = b[1:] != b[:-1]
    return b[keep].tobytes()


def _repeated(runs: np.ndarray) -> np.ndarray:
    """For each run whether it occurred before."""
    order = np.argsort(runs, kind="stable")
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:]] = runs[order[1:]] == runs[order[:-1]]
    return again


def features(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values per text; a place may come up more than once."""
    out = []
    marks = hashed_words([shape(t) for t in texts], bytes(range(9)) + b" " + bytes(range(10, 256)))
    for (_, words, bounds), (_, kinds, ends) in zip(_regroup(hashed_words(texts, BLANKS)), _regroup(marks)):
        w, k = words, kinds.copy()
        if not len(w):
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
            continue
        if len(k) == len(w):
            k[1:][w[1:] == w[:-1]] = _SAME
        again = _repeated(shingles(w, 3)).astype(np.uint64)
        ids, values = [], []
        for kind, grams in enumerate((w, shingles(w, 2), k, shingles(k, 2), again)):
            ids.append((mix(grams + np.uint64(kind + 1)) >> np.uint64(64 - BITS)).astype(np.int64))
            values.append(np.full(len(grams), 1.0 / len(grams)))
        out.append((np.concatenate(ids), np.concatenate(values)))
    return out


def each_features(texts: list[bytes | None], at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(texts), at_once):
        yield from features(texts[i : i + at_once])


def _regroup(slices):
    """One text at a time from ``hashed_words``."""
    for first, hashes, bounds in slices:
        for i in range(len(bounds) - 1):
            yield first + i, hashes[bounds[i] : bounds[i + 1]], bounds


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; place ``2 ** BITS`` is the intercept."""

    def __init__(self, alpha: float = 0.5, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (sigmoid(float(w @ value)) - label) * value
        squared = gradient * gradient
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[at] += squared


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int) -> np.ndarray:
    """Weights after FTRL passes over sparse examples in an order that depends on the pass only."""
    model = Ftrl()
    joined = []
    for ids, values in examples:
        at, where = np.unique(ids, return_inverse=True)
        joined.append((np.append(at, 1 << BITS), np.append(np.bincount(where, values, len(at)), 1.0)))
    for k in range(passes):
        for i in np.random.default_rng(k).permutation(len(joined)):
            model.learn(*joined[i], float(labels[i]))
    return model.weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 16_000, passes: int = 6) -> np.ndarray:
    """Weights from a bounded sample of the labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    sample = known.withColumn("h", F.xxhash64("id")).orderBy("h", "label").limit(rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # the sample has at most ``rows`` rows of 20 bytes
    dealt = texts.join(F.broadcast(sample), "id").withColumn("shard", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(SHARDS)))

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("label", "ascending")])
        w = train(list(each_features(text_bytes(group, "text"))), group.column("label").to_numpy(), passes)
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "n": pa.array([group.num_rows], pa.int64())})

    total, n = np.zeros((1 << BITS) + 1, dtype=np.float64), 0
    for r in dealt.groupBy("shard").applyInArrow(shard, "weights binary, n long").toLocalIterator():
        total += np.frombuffer(r["weights"], dtype=np.float32).astype(np.float64) * r["n"]
        n += r["n"]
    return (total / max(n, 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` plus ``score``, from 0 to 1; a column of this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def dot(batch: pa.RecordBatch) -> dict:
        w = shared.value
        texts = text_bytes(batch, text)
        return {"score": [float(sigmoid(float(w[at] @ value) + w[1 << BITS])) for at, value in each_features(texts)]}

    return add_columns(docs, dot, "score double")
