"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk (a learned vector
for each byte value, WIDTH bytes at a time, every second position), the largest response of each filter in the chunk passes a
rectifier, and the chunks' values are combined (mean, largest and smallest over the chunks) into one probability. The network is
trained by back-propagation on whole texts of a bounded sample of labelled rows; through the max-pooling only one window a chunk and
filter gets a gradient. Scoring streams Arrow batches, each document on its own, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

CHUNK = 512
#: Bytes that neighbouring chunks share.
OVERLAP = 64
WIDTH = 8
DEPTH = 8
FILTERS = 32
#: Labelled rows of each class that are drawn for training, by a hash of doc_id, and the bytes that their texts may have together.
SAMPLE = 2000
SAMPLE_BYTES = 8 << 20
EPOCHS = 8
#: Share of the training texts of which a random short piece is shown as well: short texts are rare.
PIECES = 0.25
THRESHOLD = 0.3


def chunks_of(text: bytes | None) -> np.ndarray:
    """(n, CHUNK) bytes of the chunks that cover the text, the last filled up with zeros."""
    data = np.frombuffer(text or b"", dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(data) - CHUNK) // step))
    padded = np.zeros((n - 1) * step + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Network:
    embed: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS,)
    shift: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.standard_normal((256, DEPTH)).astype(np.float32)
        embed[0] = 0
        return cls(embed, (rng.standard_normal((WIDTH * DEPTH, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), np.zeros(1, np.float32))

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(n, positions, FILTERS) of the filters at every second byte of each chunk."""
        seen = self.embed[chunks].reshape(len(chunks), CHUNK * DEPTH)
        shape = len(chunks), (CHUNK - WIDTH) // 2 + 1, WIDTH * DEPTH
        windows = np.lib.stride_tricks.as_strided(seen, shape, (seen.strides[0], 2 * DEPTH * seen.itemsize, seen.itemsize), writeable=False)
        return windows @ self.filters

    def pooled(self, chunks: np.ndarray, piece: int = 16) -> np.ndarray:
        return np.concatenate([self.responses(chunks[i : i + piece]).max(axis=1) for i in range(0, len(chunks), piece)])

    def combine(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(pooled + self.bias, 0)
        return h, np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)])

    def score(self, texts: list[bytes | None], piece: int = 64) -> np.ndarray:
        """Probability of label 1 for each text."""
        chunks = [chunks_of(t) for t in texts]
        pooled = self.pooled(np.concatenate(chunks)) if chunks else np.zeros((0, FILTERS))
        out, at = np.empty(len(texts)), 0
        for k, c in enumerate(chunks):
            z = self.combine(pooled[at : at + len(c)])[1] @ self.out + self.shift[0]
            out[k] = 1 / (1 + np.exp(-float(np.clip(z, -60, 60))))
            at += len(c)
        return out


PARTS = ("embed", "filters", "bias", "out", "shift")


def add_gradient(net: Network, text: bytes | None, label: float, weight: float, grads: dict[str, np.ndarray], piece: int = 16) -> float:
    """Adds the gradient of weight * (log loss of the text) by each part of the network to grads; returns the text's probability.

    Chunks pass `piece` at a time, so that a long text takes no more room than its pooled values.
    """
    chunks = chunks_of(text)
    at, pooled = [], []
    for i in range(0, len(chunks), piece):
        z = net.responses(chunks[i : i + piece])
        at.append(z.argmax(axis=1))  # (n, FILTERS)
        pooled.append(np.take_along_axis(z, at[-1][:, None], axis=1)[:, 0])
    at, pooled = np.concatenate(at), np.concatenate(pooled)
    h, features = net.combine(pooled)
    p = 1 / (1 + np.exp(-float(np.clip(features @ net.out + net.shift[0], -60, 60))))
    g = net.out.dtype.type((p - label) * weight)
    grads["out"] += g * features
    grads["shift"] += g
    mean, high, low = (net.out[k * FILTERS : (k + 1) * FILTERS] * g for k in range(3))
    dh = np.repeat(mean[None] / len(h), len(h), axis=0)
    cols = np.arange(FILTERS)
    dh[h.argmax(axis=0), cols] += high
    dh[h.argmin(axis=0), cols] += low
    dz = dh * (h > 0)
    grads["bias"] += dz.sum(axis=0)
    bytes_at = chunks[np.arange(len(chunks))[:, None, None], 2 * at[:, :, None] + np.arange(WIDTH)]  # (n, FILTERS, WIDTH)
    gz = dz[:, :, None]
    grads["filters"] += (gz * net.embed[bytes_at].reshape(*dz.shape, WIDTH * DEPTH)).sum(axis=0).T
    back = (gz * net.filters.T[None]).reshape(-1, DEPTH)
    for k in range(DEPTH):
        grads["embed"][:, k] += np.bincount(bytes_at.ravel(), weights=back[:, k], minlength=256)
    return p


def train(texts: list[bytes | None], labels: np.ndarray, seed: int = 3, epochs: int = EPOCHS, batch: int = 16) -> Network:
    """Fit a network by Adam on the log loss; classes weigh the same. Without both classes the network gives the label's share."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.shift[0] = 0 if len(y) == 0 else 4 * (2 * y[0] - 1)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    first = {k: np.zeros_like(getattr(net, k)) for k in PARTS}
    second = {k: np.zeros_like(getattr(net, k)) for k in PARTS}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            shown = [(texts[d], d) for d in docs]
            for d in docs:
                if texts[d] and rng.random() < PIECES:
                    n = int(rng.integers(16, 400))
                    a = int(rng.integers(max(1, len(texts[d]) - n + 1)))
                    shown.append((texts[d][a : a + n], d))
            grads = {k: np.zeros_like(getattr(net, k)) for k in PARTS}
            for text, d in shown:
                add_gradient(net, text, y[d], weight[d] / len(shown), grads)
            grads["embed"][0] = 0
            step += 1
            rate = 0.01 * (1 - step / (steps + 1))
            for k in PARTS:
                x, g = getattr(net, k), grads[k] + (1e-4 * getattr(net, k) if k in ("filters", "out") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                x -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the doc_id written as text, modulo by; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: Column, per_class: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """(texts, labels) of a sample of the labelled documents for which rows holds; whole texts.

    Of each class at most per_class documents are drawn, by a hash of doc_id; of these, in that order, each is taken whose text still
    fits into most_bytes. So at most twice that many bytes come to the driver. A doc_id that repeats gives one row: its largest
    label, its smallest text.
    """
    known = labels.where(rows & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]).withColumnRenamed("doc_id", "id2"))  # 2 * per_class rows at most
    got = docs.where("text is not null").select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id2")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = checkpointed(got.select("doc_id", "y", F.col("text").cast("binary").alias("text")))
    room, taken = {0: most_bytes, 1: most_bytes}, []
    for r in got.select("doc_id", "y", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            taken.append(r["doc_id"])
    sample = got.where(F.col("doc_id").isin(taken)).toArrow().sort_by("doc_id")
    return sample["text"].to_pylist(), sample["y"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Network:
    """The network for labels.quality, from labelled rows that are not held out."""
    return train(*labelled_sample(docs, labels, "quality", remainder("doc_id", 5) != 0, per_class, SAMPLE_BYTES))


def score_documents(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every document row: the probability of label 1, and whether it reaches the threshold.

    A null text scores as the empty one; a null or repeated doc_id is a row like any other; an empty table gives no rows; other
    columns are ignored. The score of a text does not depend on the other rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def scan(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score([t.as_py()])[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' rows whose text reaches the threshold; columns as in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def scan(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([bool(model.score([t.as_py()])[0] >= threshold) for t in texts], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
