"""Embedding near-dedup: random-hyperplane signatures in several tables, exact cosines, distributed connected components.

Equal vectors of a label are one member of the search. Each table cuts the members of a label by the signs of their products with
its random hyperplanes. Members that share a bucket in some table are first compared by a sketch, the signs for 128 more hyperplanes:
pairs whose sketches are farther apart than pairs at the threshold are by any real chance do not count. What is left connects members
to clusters, of which a task sends on spanning forests only. All links of a member lie within its cluster, and the cluster's
pairs are compared exactly, in double precision, in blocks: a vector is sent to each part of its cluster that holds its block. A cluster
of very many members is compared by its buckets instead, where a pair counts in the first table that brings it together. Tasks send on only each member's number of
links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, checkpointed, connected_components, few_pairs, joined_back, many_pairs, spanning, spans_of, table
from .near_dedup import in_blocks

THRESHOLD = 0.98
#: Chance that a pair exactly at the threshold meets in no table, or is told apart by its sketches; pairs above it are missed more rarely.
MISS = 1e-6
#: Members of a bucket that the number of hyperplanes aims at, were the vectors of the largest label spread evenly.
BUCKET = 128
#: Hyperplanes of a sketch.
SKETCH = 128
#: Members of a bucket whose sketches, and of a cluster whose vectors, are compared in one piece.
MEET = 4096
BLOCK = 256
#: Members of a cluster up to which it is compared as a whole.
CLUSTER = 8192
SEED = 11
_WORDS = [f"sketch{k}" for k in range(SKETCH // 64)]


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(hyperplanes a table, tables, most differing bits of sketches) for n vectors of a label."""
    bits = min(31, max(4, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4))
    apart = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(miss / 2) / math.log(1 - (1 - apart) ** bits))
    tail, most = 1.0, -1
    while tail > miss / 2:
        most += 1
        tail -= math.comb(SKETCH, most) * apart**most * (1 - apart) ** (SKETCH - most)
    return bits, tables, most


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector over a power of two that brings its largest component near 1: no product or norm of any finite vector over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def signs(vectors: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(n, count) signs of the products with so many random hyperplanes."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], count))
    return vectors @ planes > 0


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """int32 bucket of each vector in each table."""
    found = signs(vectors, tables * bits, SEED).reshape(len(vectors), tables, bits)
    return (found * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def sketches(vectors: np.ndarray) -> np.ndarray:
    """(n, SKETCH // 64) words."""
    return np.packbits(signs(vectors, SKETCH, SEED + 1), axis=1, bitorder="little").view("<i8")


def links_in(group: np.ndarray, rows: pd.DataFrame, threshold: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row to rows that it meets first in this table, spanning forest of row numbers) within groups of sorted rows."""
    side, copies, tab = rows["side"].to_numpy(), rows["copies"].to_numpy(), rows["tab"].to_numpy()
    size = rows["embedding"].map(len).to_numpy()  # equal within a group
    sigs = np.stack(rows["sigs"].to_numpy())
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.append(first, len(group)))
    end = np.repeat(first + length, length)
    links, forest = np.zeros(len(rows), dtype=np.int64), [np.zeros((0, 2), dtype=np.int64)]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        for t in np.unique(tab[a]) if len(a) else ():
            here = tab[a] == t
            x, y = a[here], b[here]
            new = ~(sigs[x, : max(t, 0)] == sigs[y, : max(t, 0)]).any(axis=1)  # none is earlier than a whole cluster
            x, y = x[new], y[new]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            if len(x):
                forest.append(spanning(np.stack([x, y], axis=1)))

    for d in np.unique(size):
        mine = np.flatnonzero(size == d)
        x = np.zeros((len(rows), d)) if len(mine) < len(rows) else np.empty((len(rows), d))
        x[mine] = scaled(np.stack(rows["embedding"].to_numpy()[mine]).astype(np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
        at, k = mine[np.repeat(length <= 64, length)[mine]], 1
        while len(at := at[at + k < end[at]]):
            i = at[(side[at] == 0) | (side[at] != side[at + k])]
            near = np.einsum("nd,nd->n", x[i], x[i + k]) / (norm[i] * norm[i + k]) >= threshold
            take(i[near], i[near] + k)
            k += 1
        for g in np.flatnonzero((length > 64) & (size[first] == d)):
            whole = np.arange(first[g], first[g] + length[g])
            one, two = (whole, whole) if side[whole[0]] == 0 else (whole[side[whole] == 1], whole[side[whole] == 2])
            for i in range(0, len(one), step):
                part = one[i : i + step]
                a, b = np.nonzero((x[part] @ x[two].T) / (norm[part][:, None] * norm[two][None, :]) >= threshold)
                a, b = part[a], two[b]
                take(*((a[a < b], b[a < b]) if one is two else (a, b)))
    return links, spanning(np.concatenate(forest))


def clusters(signed: DataFrame, most: int, block: int = MEET) -> DataFrame:
    """Edges (a, b) that connect the members of signed (member, label, dims, sigs, sketch words) as their pairs do that share a bucket and
    whose sketches differ in at most `most` bits."""
    keyed = signed.select("member", "label", "dims", *_WORDS, F.posexplode("sigs").alias("tab", "sig"))
    keyed = keyed.select("member", *_WORDS, F.xxhash64("label", "dims", "tab", "sig").alias("key"))
    dealt = in_blocks(keyed, ["key"], "member", block).select("key", "part", "side", "member", *_WORDS).repartition("key", "part").sortWithinPartitions("key", "part", "side", "member")

    def flush(pdf: pd.DataFrame, group: np.ndarray):
        member, side = pdf["member"].to_numpy(), pdf["side"].to_numpy()
        words = [pdf[k].to_numpy().view(np.uint64) for k in _WORDS]

        def near(x, y) -> np.ndarray:
            return sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in words) <= most

        first, count = spans_of(group)
        found = [np.zeros((0, 2), dtype=np.int64)]
        for i, j in few_pairs(first, count, side):
            close = near(i, j)
            if close.any():
                found.append(np.stack([i[close], j[close]], axis=1))
        for part, whole, meet in many_pairs(first, count, side):
            i, j = np.nonzero(meet & near((part, None), (None, whole)))
            if len(i):
                found.append(spanning(np.stack([i + part.start, j + whole.start], axis=1)))
        yield pd.DataFrame(member[spanning(np.concatenate(found))], columns=["a", "b"])

    return dealt.mapInPandas(lambda batches: by_group(batches, flush), "a long, b long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, cluster: int = CLUSTER, meet: int = MEET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id long, embedding array, label).

    Rows link if their labels are equal and not null and their cosine is at least threshold. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing, neither do vectors of different lengths. n_links counts the other
    rows linked directly (a repeated row is another row); component_id is the smallest vec_id reachable, kept whether it is the
    row's own. Vectors are scaled by powers of two first, so very large and very small ones link as their directions do. A small cluster
    compares all of its pairs, one of more than `cluster` members those that share a bucket: of pairs exactly at the threshold `miss`
    may be lost there, as everywhere where pairs must first meet. A null vec_id is never the smallest unless its component has no other, and is not kept. An empty table gives no
    rows; other columns are ignored.
    """
    narrow = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(narrow).alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # Equal vectors of a label go by a hash of 128 bits, so that rows find their member again without their vectors.
    same = [F.xxhash64("label", "embedding").alias("one"), F.xxhash64(F.lit(SEED), "embedding", "label").alias("two")]
    rows = rows.where("usable").select("vec_id", "label", "embedding", *same)
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables, most = plan(largest, threshold, miss)
    classes = rows.groupBy("one", "two").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))

    def sign(batches):
        for pdf in batches:
            size = pdf["embedding"].map(len).to_numpy()
            sigs, sketch = np.zeros((len(pdf), tables), dtype=np.int32), np.zeros((len(pdf), len(_WORDS)), dtype=np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = scaled(np.stack(pdf["embedding"].iloc[at].to_numpy()).astype(np.float64))
                sigs[at], sketch[at] = signatures(x, bits, tables), sketches(x)
            yield pdf.assign(dims=size, sigs=list(sigs), **dict(zip(_WORDS, sketch.T)))

    signed = classes.mapInPandas(sign, f"one long, two long, copies long, least long, label string, embedding {narrow}, dims int, sigs array<int>, {', '.join(f'{k} long' for k in _WORDS)}")
    signed = checkpointed(signed.withColumn("member", F.monotonically_increasing_id()))  # the numbers stay, as the rows are written
    nodes = checkpointed(connected_components(clusters(signed, most, meet)))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "root2")
    inside = checkpointed(joined_back(nodes, sizes, [("root", "root2")]).select("node", "root", (F.col("n") <= cluster).alias("whole")))
    # A cluster is one place of comparison, or, where it is large, its buckets are; the vectors come in once these are dealt out.
    places = inside.where("whole").select(F.col("node").alias("member"), F.lit(-1).alias("tab"), F.col("root").alias("key"))
    buckets = signed.join(inside.where("not whole").select("node"), F.col("member") == F.col("node")).select("member", "label", "dims", F.posexplode("sigs").alias("tab", "sig"))
    places = checkpointed(places.unionByName(buckets.select("member", "tab", F.xxhash64("label", "dims", "tab", "sig").alias("key"))))
    payload = signed.select(F.col("member").alias("member2"), "copies", "embedding", "sigs", F.col("label").alias("kind"), "dims")
    dealt = joined_back(in_blocks(places, ["tab", "key"], "member", block), payload, [("member", "member2")]).drop("member2")
    order = ["key", "part", "tab", "kind", "dims"]  # the last three tell apart what a clash of hashes puts together

    def compare(pdf: pd.DataFrame, group: np.ndarray):
        new = np.zeros(len(pdf) - 1, dtype=bool)
        for k in order:
            column = pdf[k].to_numpy()
            new |= column[1:] != column[:-1]
        links, edges = links_in(np.cumsum(np.concatenate([[0], new])), pdf, threshold)
        ids, some = pdf["member"].to_numpy(), np.flatnonzero(links)
        edge = np.repeat(np.array([0, 1], dtype=np.int32), [len(some), len(edges)])
        yield pd.DataFrame({"edge": edge, "a": np.concatenate([ids[some], ids[edges[:, 0]]]), "b": np.concatenate([links[some], ids[edges[:, 1]]])})

    dealt = dealt.repartition("key", "part").sortWithinPartitions(*order, "side", "member")
    found = checkpointed(dealt.mapInPandas(lambda batches: by_group(batches, compare, 10_000), "edge int, a long, b long"))
    counts = found.where("edge = 0").groupBy(F.col("a").alias("member2")).agg(F.sum("b").alias("others"))
    linked = connected_components(found.where("edge = 1").select("a", "b"))
    named = signed.select("member", "one", "two", "copies", "least").join(linked, F.col("member") == F.col("node"), "left").withColumn("root", F.coalesce("root", "member"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root2")
    named = joined_back(named, least, [("root", "root2")]).join(counts, F.col("member") == F.col("member2"), "left")
    named = named.select(F.col("one").alias("one2"), F.col("two").alias("two2"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = joined_back(rows.select("vec_id", "one", "two"), named, [("one", "one2"), ("two", "two2")])
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")).unionByName(alone)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings, within labels."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
