"""Pieces shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes that end a word (ASCII white space), as a lookup table over byte values.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Deletes nothing, maps A-Z to a-z and keeps every other byte.
LOWER = bytes(range(256)).lower()

#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


#: Members of a bucket up to which buckets are compared many at a time.
FEW = 32


def between_words(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of some `size` bytes, each but the last ended by white space; a longer word is not cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size - 1)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: the session's spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; a cluster is an error, as its machines share no local folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of results that nothing reads any more, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joined_back(rows: DataFrame, totals: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """rows joined with an aggregate of them by its keys, (name in rows, name in totals).

    A hash of the keys is one more join key. Without it the join would take over the aggregate's partitioning, and the engine
    could not split the rows of a hot key: it can only where both sides are shuffled for the join.
    """
    match = F.xxhash64(*[a for a, _ in on]) == F.xxhash64(*[b for _, b in on])
    for a, b in on:
        match = match & (F.col(a) == F.col(b))
    return rows.join(totals, match, how)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (doc_id). Those with a null doc_id stay, and stay where they are."""
    gone = gone.select(F.col("doc_id").alias("__id")).distinct()
    return joined_back(docs.where("doc_id is not null"), gone, [("doc_id", "__id")], "left_anti").unionByName(docs.where("doc_id is null"))


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds, for each name in totals, the sum of its column over all rows before a row in that order (0 for the first).

    Rows are dealt out by ranges of the order, so no task has more than a range of them; only one row a range is put in one place.
    The order must tell rows apart.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__sum_{k}") for k, c in totals.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__range").alias("__range2"), *[F.coalesce(F.sum(f"__sum_{k}").over(earlier), F.lit(0)).alias(f"__sum_{k}") for k in totals])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in totals.items()])
    joined = own.join(sums, F.col("__range") == F.col("__range2"))
    return joined.select(*rows.columns, *[(F.col(k) + F.col(f"__sum_{k}")).alias(k) for k in totals])


def repeated(groups: DataFrame, count: str, most: int = 4096) -> DataFrame:
    """Each row as often as `count` (a long, 1 at least) says, with nth, from 0 up; large counts are spread over tasks."""
    last = lambda first: F.least(first + most, F.col(count)) - 1
    zero = F.lit(0).cast("long")
    few = groups.where(F.col(count) <= most).withColumn("nth", F.explode(F.sequence(zero, F.col(count) - 1)))
    many = groups.where(F.col(count) > most).withColumn("__first", F.explode(F.sequence(zero, F.col(count) - 1, F.lit(most).cast("long"))))
    many = many.repartition(*groups.columns, "__first").withColumn("nth", F.explode(F.sequence(F.col("__first"), last(F.col("__first"))))).drop("__first")
    return few.unionByName(many)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Edges (child, smallest node of its tree) that connect the same nodes as pairs do."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(pairs.shape)
    root = np.arange(len(nodes))
    while len(flat):
        ends = root[flat]
        flat = flat[ends[:, 0] != ends[:, 1]]
        ends = root[flat]
        if len(ends):
            np.minimum.at(root, ends.max(axis=1), ends.min(axis=1))
        while (root != (up := root[root])).any():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[root[own]]], axis=1)


def forest_of(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Replace the edges (a, b) of each partition by at most one edge a node; at most `most` edges are held at once."""

    def shrink(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf[["a", "b"]].to_numpy(dtype=np.int64))
            n += len(pdf)
            if n >= most:
                held = [spanning(np.concatenate(held))]
                n = len(held[0])
                if n >= most // 2:  # hardly any edge was redundant: pass them on
                    yield pd.DataFrame(held[0], columns=["a", "b"])
                    held, n = [], 0
        if n:
            yield pd.DataFrame(spanning(np.concatenate(held)), columns=["a", "b"])

    return edges.select("a", "b").where("a <> b").mapInPandas(shrink, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a long, b long); root is the smallest node it reaches.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) on checkpointed edge tables. Neighbourhoods are only
    ever reduced by a minimum, so a node with a great many neighbours is pre-aggregated before the shuffle and the join that
    brings the minimum back can be split. Self edges, repeated edges and rows with a null are ignored; no edges give no rows.
    """
    e = forest_of(edges.where("a is not null and b is not null"))
    e = checkpointed(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # Large star: every neighbour above a node moves to the node's smallest neighbour (or to the node itself).
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
        e = joined_back(both.where("v > u"), low, [("u", "u2")]).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"), "m")
        moved = joined_back(e, low, [("a", "a2")]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.where("a <> b").union(low.select(F.col("a2").alias("a"), F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def few_pairs(first: np.ndarray, count: np.ndarray, side: np.ndarray):
    """Yields (i, j), rows that meet in groups of at most FEW rows, i before j; no row twice among the i or the j of one step."""
    end = np.repeat(first + count, count)
    at, d = np.flatnonzero(np.repeat(count <= FEW, count)), 1
    while len(at := at[at + d < end[at]]):
        i = at[(side[at] == 0) | (side[at] != side[at + d])]
        yield i, i + d
        d += 1


def many_pairs(first: np.ndarray, count: np.ndarray, side: np.ndarray, step: int = 256):
    """Yields (rows, columns, meet) for groups of more rows: slices, and which of their pairs meet; every row meets all its others."""
    for g in np.flatnonzero(count > FEW):
        stop = first[g] + count[g]
        whole = slice(first[g], stop)
        for a in range(first[g], stop, step):
            part = slice(a, min(a + step, stop))
            meet = (side[part, None] == 0) | (side[part, None] != side[None, whole])
            meet[np.arange(part.stop - a), np.arange(a, part.stop) - first[g]] = False
            yield part, whole, meet


def spans_of(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each group of sorted rows."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return first, np.diff(np.append(first, len(group)))


def by_group(batches, flush, most: int = 100_000):
    """Feeds flush (rows, group numbers) with some `most` rows at a time; rows of one (key, part) stay together."""

    def numbered(pdf: pd.DataFrame):
        key, part = pdf["key"].to_numpy(), pdf["part"].to_numpy()
        yield from flush(pdf, np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])))

    held: list[pd.DataFrame] = []
    count = 0
    for pdf in batches:
        held.append(pdf)
        count += len(pdf)
        if count < most:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1])  # may go on in the next batch
        held, count = [pdf[last]], int(last.sum())
        if count < len(pdf):
            yield from numbered(pdf[~last].reset_index(drop=True))
    if count:
        yield from numbered(pd.concat(held, ignore_index=True))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]
