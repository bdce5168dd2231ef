"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

Features are the distinct n-grams (SIZES characters) of the lower-cased text with runs of white space taken as one, hashed into
2**BITS slots. Each slot's value is its log-count ratio r: the log of the share of toxic against other training documents that hold
it. A logistic regression on these scaled features is fitted on a bounded sample, and its weights are multiplied into r, so a
text's score is the sum of one number for each distinct slot. Slots with hardly any weight are dropped after training. Scoring
streams Arrow batches, each document on its own, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, between_words, table
from .quality import labelled_sample, remainder

SIZES = (3, 4, 5, 6)
BITS = 20
#: Labelled rows of each class that are drawn for training, by a hash of doc_id, and the bytes that their texts may have together.
SAMPLE = 2500
SAMPLE_BYTES = 8 << 20
#: Training documents that must hold a slot.
LEAST_DOCS = 5
#: Least log-count ratio, either way, of a slot that is learned.
LEAST_RATIO = 0.7
THRESHOLD = 0.7

_U = np.uint64


def characters(text: bytes | None, piece: int = PIECE) -> Iterator[str]:
    """What n-grams are taken from, by pieces: lower case, one space for each run of white space, one before and one after."""
    held = ""
    for part in between_words(text or b"", piece):
        if seq := part.decode("utf-8", "replace").lower().split():
            if held:
                yield held
            held = f" {' '.join(seq)}"
    yield f"{held or ' '} "


def grams(text: bytes | None, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The slot of every n-gram of the text's characters, by pieces; n-grams repeat. An n-gram is in the piece that it ends in."""
    before = ""
    for part in characters(text, piece):
        for at in range(0, len(part), piece):
            line = before + part[at : at + piece]
            h = data = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(_U)
            out = []
            for n in range(2, max(SIZES) + 1):
                if len(data) < n:
                    break
                h = h[:-1] * _U(0x100000001B3) + data[n - 1 :]
                if n in SIZES:
                    new = h[max(0, len(before) - n + 1) :]
                    out.append(((new + _U(n)) * _U(0x9E3779B97F4A7C15) >> _U(64 - BITS)).astype(np.int32))
            if out:
                yield np.concatenate(out)
            before = line[1 - max(SIZES) :]


def slots(text: bytes | None, among: np.ndarray | None = None, piece: int = PIECE) -> np.ndarray:
    """The distinct slots of the text's n-grams, in order; with `among` only those where it is not zero."""
    found = [np.unique(g if among is None else g[among[g] != 0]) for g in grams(text, piece)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *found]))


@dataclass
class Model:
    weight: np.ndarray  # (slots,) float32
    shift: float

    def score(self, text: bytes | None) -> float:
        found = slots(text, self.weight)
        return float(1 / (1 + np.exp(-np.clip(self.weight[found].sum(dtype=np.float64) + self.shift, -60, 60))))


def train(texts: list[bytes | None], labels: np.ndarray, l2: float = 1e-6, steps: int = 300, least_docs: int = LEAST_DOCS) -> Model:
    """Fit by gradient descent with momentum on the log loss; classes weigh the same. One class alone gives its label's share."""
    y = np.asarray(labels, dtype=np.float64)
    weight = np.zeros(1 << BITS, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(weight, 0.0 if len(y) == 0 else 4 * (2 * y[0] - 1))
    docs, toxic = np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for t, label in zip(texts, y):
        found = slots(t)
        docs[found] += 1
        toxic[found] += int(label)
    r = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((docs - toxic + 0.5) / (len(y) - y.sum() + 1))
    r[(docs < least_docs) | (np.abs(r) < LEAST_RATIO)] = 0
    held = [slots(t, r) for t in texts]  # only the learned slots of each text, so that memory goes with these
    every, doc = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    names, every = np.unique(every, return_inverse=True)
    r = r[names]
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b, vw, vb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    scale = np.sqrt(np.bincount(doc, weights=r[every] ** 2, minlength=len(y)).mean()) or 1.0
    x = r / scale  # value of a slot in every document that holds it
    for _ in range(steps):
        z = np.bincount(doc, weights=(w * x)[every], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weigh
        vw = 0.9 * vw - 4.0 * (np.bincount(every, weights=g[doc], minlength=len(names)) * x + l2 * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    final = w * x
    final[np.abs(final) < 1e-3 * np.abs(final).max(initial=0)] = 0
    weight[names] = final
    return Model(weight, b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """The classifier for labels.toxic, from labelled rows that are not held out."""
    return train(*labelled_sample(docs, labels, "toxic", remainder("doc_id", 3) != 1, per_class, SAMPLE_BYTES))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every document row: the probability of label 1, and whether it reaches the threshold.

    A null text scores as the empty one; a null or repeated doc_id is a row like any other; an empty table gives no rows; other
    columns are ignored. The score of a text does not depend on the other rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, 4 MB

    def scan(batches):
        own = shared.value
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
