"""Sharding of a corpus: minimax contiguous partition over ordered atomic groups.

Groups are equal texts, in the order of their texts' hashes. The smallest capacity for which contiguous runs of groups fill at most
n shards is found by binary search with a greedy check, and the list is cut there. The list that is searched holds cells, ranges of
hashes, of which only those are cut finer that a cut can fall into: between the capacity that cells allow and the least one that any
list could, the greedy cuts stay within a few cells. So the driver holds a bounded list, the cuts fall between single groups, and the
capacity is the smallest of all groups' however large the corpus is. Texts are read once and never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, repeated, table

#: Bits of a text's hash that order the groups.
HASH_BITS = 62
#: Leading bits that name a cell at first, and bits by which a cell is cut finer.
CELL_BITS, FINER_BITS = 14, 7
#: Rows that are numbered together within a shard.
SLOT_ROWS = 2048


def smallest_capacity(sizes: np.ndarray, n_shards: int) -> int:
    """Smallest capacity with which the ordered sizes fit into n_shards contiguous runs."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    total = int(ends[-1])
    low, high = max(-(-total // n_shards), int(sizes.max(initial=0))), total
    while low < high:
        mid = (low + high) // 2
        if greedy_ends(ends, mid, n_shards)[-1] == len(sizes):
            high = mid
        else:
            low = mid + 1
    return low


def greedy_ends(ends: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """How many atoms the first 1, 2, ... runs hold, each filled as far as the capacity goes; ends are the atoms' running sizes from 0."""
    at, found = 0, []
    for _ in range(n_shards):
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        found.append(at)
    return found


def where_cuts_can_be(sizes: np.ndarray, single: np.ndarray, n_shards: int) -> np.ndarray:
    """Numbers of the atoms of several groups that a greedy cut can fall into, for any capacity that can be the smallest.

    If there are none, the smallest capacity of the atoms is that of the groups: the greedy check comes out the same for both.
    """
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    high = smallest_capacity(sizes, n_shards)
    low = max(-(-int(ends[-1]) // n_shards), int(sizes[single].max(initial=0)))
    if low >= high:
        return np.zeros(0, dtype=int)
    large = np.flatnonzero(~single & (sizes > low))
    if len(large):  # they stop the greedy check short, and there are few
        return large
    # Finer atoms let a cut go farther than those of the atoms at the least capacity, but not beyond full shards of the largest.
    near = np.array(greedy_ends(ends, low, n_shards))
    far = np.searchsorted(ends, np.minimum(float(high) * np.arange(1, n_shards + 1), float(ends[-1])), side="left")
    inside = np.zeros(len(sizes) + 1, dtype=int)
    np.add.at(inside, near, 1)
    np.add.at(inside, np.maximum(far, near), -1)
    return np.flatnonzero((np.cumsum(inside)[:-1] > 0) & ~single)


def cut_points(sizes: np.ndarray, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, first atom of shards 1, 2, ...): the smallest capacity, and cuts that keep to it.

    Of the cuts that the capacity allows, each is the one nearest to an even share of what is left, so that the slack of the
    greedy packing does not gather in the last shard.
    """
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    capacity = smallest_capacity(sizes, n_shards)
    earliest = [len(sizes)]  # of the cut before the last shard, and so on: packing from the end
    for _ in range(n_shards - 1):
        earliest.append(int(np.searchsorted(ends, ends[earliest[-1]] - capacity, side="left")))
    earliest.reverse()
    cuts, at = [], 0
    for k in range(n_shards - 1):
        latest = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        ideal = ends[at] + (ends[-1] - ends[at]) / (n_shards - k)
        best = int(np.searchsorted(ends, ideal))
        if best and ideal - ends[best - 1] < ends[min(best, len(sizes))] - ideal:
            best -= 1
        at = min(max(best, at, earliest[k]), latest)
        cuts.append(at)
    return capacity, cuts


def _cells(rows: DataFrame, rest: int) -> pa.Table:
    """(rest, cell, bytes, n, single) of the cells that share all but `rest` bits of the hash."""
    cell = F.shiftright("hash", rest)
    return rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("hash") == F.max("hash")).alias("single")).select(F.lit(rest).cast("long").alias("rest"), "cell", "bytes", "n", "single").toArrow()


def _sorted(cells: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The cells in order, and their first hashes."""
    first = cells["cell"].to_numpy() << cells["rest"].to_numpy()
    order = np.argsort(first)
    return cells.take(order), first[order]


def atoms_of(rows: DataFrame, n_shards: int, most: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
    """(first hashes, sizes, number of rows): cells of rows (hash, size), fine enough that the smallest capacity is that of the groups.

    At most `most` cells are cut finer at a time, so that a bounded number comes to the driver.
    """
    cells, first = _sorted(_cells(rows, HASH_BITS - CELL_BITS))
    while len(at := where_cuts_can_be(cells["bytes"].to_numpy(), cells["single"].to_numpy(zero_copy_only=False), n_shards)[:most]):
        finer = [cells.filter(pa.array(~np.isin(np.arange(len(cells)), at)))]
        rest, cell = cells["rest"].to_numpy()[at], cells["cell"].to_numpy()[at]
        for r in np.unique(rest).tolist():
            some = rows.where(F.shiftright("hash", r).isin(cell[rest == r].tolist()))
            finer.append(_cells(some, max(0, r - FINER_BITS)))
        cells, first = _sorted(pa.concat_tables(finer))
    return first, cells["bytes"].to_numpy(), int(np.sum(cells["n"].to_numpy()))


def reached(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds a value reaches: binary search in one literal array, so that the plan stays small for any number."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= value, at + step).otherwise(at))


def shard(docs: DataFrame, n_shards: int) -> DataFrame:
    """Assign every row to a shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size is the text's UTF-8 bytes plus 16. Rows with equal texts share a shard. Slots count from 0 within a shard without a
    gap; they follow hash buckets of the rows, then doc_id, so reruns agree. A null text counts as the empty one; a null or
    repeated doc_id is a row like any other (equal rows are interchangeable); an empty table gives no rows; other columns are
    ignored. Where a group is larger than a fair share the capacity is that group's size, and shards can stay empty if there are
    fewer groups than shards.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS).alias("hash"))
    rows = checkpointed(rows)
    first, sizes, n = atoms_of(rows, n_shards)
    _, cuts = cut_points(sizes, n_shards)
    shard_of = reached(F.col("hash"), [int(first[k]) if k < len(first) else 1 << HASH_BITS for k in cuts])
    parts = max(1, -(-n // (n_shards * SLOT_ROWS)))
    place = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(parts)).cast("int")
    # Equal rows go as one until they have their slots.
    own = ["shard", "part", "doc_id", "text_crc32", "size", "hash"]
    rows = rows.select("doc_id", "size", "text_crc32", "hash", shard_of.alias("shard"), place.alias("part")).groupBy(*own).agg(F.count("*").alias("rows"))
    rows = checkpointed(rows)
    counts = rows.groupBy("shard", "part").agg(F.sum("rows").alias("n"))
    before = counts.select(F.col("shard").alias("shard2"), F.col("part").alias("part2"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    at = F.sum("rows").over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "hash")) - F.col("rows")
    placed = rows.withColumn("at", at).join(before, (F.col("shard") == F.col("shard2")) & (F.col("part") == F.col("part2")))
    placed = repeated(placed.select("doc_id", "size", "text_crc32", "shard", "rows", (F.col("before") + F.col("at")).alias("from")), "rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("from") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), 40)
