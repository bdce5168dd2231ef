"""SimHash near-dedup with pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of 16 segments. If two fingerprints differ in at most r bits, then from some segment
on, every chain of l consecutive segments (round the ring) holds at most l * r / 16 of the differences (the pigeonring
principle, Qin and Xiao 2018). For r = 3 the first five segments of that chain must be equal, which is the key that brings
candidates together: 16 keys of 20 bits a fingerprint. A candidate pair must then keep to the budget of each longer chain (one
difference within ten segments, two within fifteen) before its whole Hamming distance is looked at.

Where there are so many fingerprints that 20 bits no longer part them, the budget of ten segments lends more: of the five segments
after the equal ones at most one bit differs, so of two (or four) pieces of these all but one are equal as well. A key then has 30 (or
35) bits, and there are two (or four) times as many keys.

Equal fingerprints are one member of the search. Pairs never leave the task that finds them: each key's members are compared in
blocks and only a spanning forest of the links goes on. A key with more members than a block is dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, PIECE, between_words, checkpointed, connected_components, joined_back, spanning, table, without

SHINGLE = 3
RADIUS = 3
SEGMENTS = 16
#: Members of a key that are compared in one piece.
BLOCK = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE, piece: int = PIECE) -> int:
    """SimHash of the text's word shingles, repeats included: a bit is 1 if it is set in over half of their XXH64 (seed 42).

    A long text is gone through by pieces; the last words of one begin the next.
    """
    h = xxhash.xxh64_intdigest
    votes, n, seq = np.zeros(64, dtype=np.int64), 0, []
    for part in between_words(text or b"", piece):
        seq += part.translate(LOWER).split()
        if len(seq) < shingle:
            continue
        line = b" ".join(seq)
        ends = np.cumsum(np.fromiter(map(len, seq), dtype=np.int64, count=len(seq)) + 1)
        starts = [0, *ends[: len(seq) - shingle].tolist()]
        ends = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, ends)], dtype="<u8")
        for at in range(0, len(hashes), 1 << 16):
            votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        seq = seq[len(seq) - shingle + 1 :]
    if not n:
        return h(b" ".join(seq), 42) if seq else 0
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every document row."""

    def scan(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def chain_masks(radius: int, segments: int = SEGMENTS) -> tuple[int, list[tuple[np.uint64, int]]]:
    """(leading bits that must be equal, [(mask of leading bits, most differences)]) for a chain that starts at the top bit."""
    width = 64 // segments
    exact = next(k for k in range(1, segments + 1) if (k + 1) * radius // segments >= 1)
    rest = []
    for k in range(exact + 1, segments + 1):
        if k == segments or (k + 1) * radius // segments > k * radius // segments:
            rest.append((np.uint64(((1 << (k * width)) - 1) << (64 - k * width)), k * radius // segments))
    return exact * width, rest


def _rotated(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    """fp with bit (63 - by) moved to the top."""
    by = by.astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) % np.uint64(64))))


def links_within(key: np.ndarray, side: np.ndarray, fp: np.ndarray, rest: list[tuple[np.uint64, int]], step: int = 512) -> np.ndarray:
    """Links (fp, fp) between rows of equal key, as a forest; rows are sorted by key and fp is turned so that the chain is on top.

    side 0 takes part in all pairs of its key; sides 1 and 2 are two blocks of a large key: only pairs across them count.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], dtype=int)
    count = np.diff(np.concatenate([first, [len(key)]]))
    found = []

    def check(a: np.ndarray, b: np.ndarray) -> None:
        x = fp[a] ^ fp[b]
        good = x != 0
        for mask, most in rest:
            good &= np.bitwise_count(x & mask) <= most
        found.append(np.stack([a[good], b[good]], axis=1))

    few = count <= 64
    group_end = np.repeat(first + count, count)
    small = np.repeat(few, count)
    at = np.flatnonzero(small)
    d = 1
    while len(at := at[at + d < group_end[at]]):
        pair = at[(side[at] == 0) | (side[at] != side[at + d])]
        check(pair, pair + d)
        d += 1
    for g in np.flatnonzero(~few):
        rows = np.arange(first[g], first[g] + count[g])
        one, two = (rows, rows) if side[rows[0]] == 0 else (rows[side[rows] == 1], rows[side[rows] == 2])
        for i in range(0, len(one), step):
            part = one[i : i + step]
            other = two if one is not two else two[i:]
            x = fp[part][:, None] ^ fp[other][None, :]
            good = x != 0
            for mask, most in rest:
                good &= np.bitwise_count(x & mask) <= most
            a, b = np.nonzero(good)
            if len(a):
                found.append(spanning(np.stack([part[a], other[b]], axis=1)))
    return spanning(np.concatenate(found)) if found else np.zeros((0, 2), dtype=int)


#: Large keys up to so many are made known to all tasks (a few MB).
KNOWN = 50_000


def in_blocks(members: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Deal out each key's members: adds part (long) and side (0, 1 or 2), with a key's pairs all within one part.

    A key with at most `most` members is one part, side 0. A larger one is cut into hash blocks; a block's members go to the
    part of that block alone (side 0) and to a part with each other block (sides 1 and 2), so that every pair meets once and no
    task holds more than about two blocks. How keys are cut decides on no pair, so their sizes are estimated, with a wide margin,
    from a hash share of the members: a large key is one with half of `most` by estimate.
    """
    share = max(1, min(16, most // 256))
    some = members.where(F.pmod(F.xxhash64(F.lit(5), member), F.lit(share)) == 0) if share > 1 else members
    large = some.groupBy(*keys).agg((F.count("*") * share).alias("n")).where(F.col("n") > (most / 2 if share > 1 else most))
    large = checkpointed(large.select(*[F.col(k).alias(f"{k}_2") for k in keys], F.ceil(F.col("n") / most).alias("blocks")))
    n = large.count()
    if n == 0:
        return members.withColumn("part", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    if n <= KNOWN:
        dealt = members.join(F.broadcast(large), [members[k] == large[f"{k}_2"] for k in keys], "left")
    else:
        dealt = joined_back(members, large, [(k, f"{k}_2") for k in keys], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), member), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("part", part).withColumn("side", side.cast("int")).drop("own", "other", "blocks", *[f"{k}_2" for k in keys])


def pieces_for(n: int) -> int:
    """Pieces of the segments after the equal ones, so that n fingerprints spread over buckets of some sixteen at most."""
    return 1 if n <= 1 << 24 else 2 if n <= 1 << 34 else 4


def key_masks(radius: int, pieces: int) -> list[int]:
    """The bits of a turned fingerprint that make its keys: the leading ones, and all but one of the pieces of those after them."""
    exact, rest = chain_masks(radius)
    lead = ((1 << exact) - 1) << (64 - exact)
    reach = int(rest[0][0]).bit_count() - exact
    if pieces == 1 or rest[0][1] != 1 or reach % pieces:  # only where at most one bit differs in what comes next
        return [lead]
    size = reach // pieces
    part = [((1 << size) - 1) << (64 - exact - size * (k + 1)) for k in range(pieces)]
    return [lead | sum(part) - part[k] for k in range(pieces)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, pieces: int = 1) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fp (long) as their links of at most radius bits do."""
    _, rest = chain_masks(radius)
    width = 64 // SEGMENTS
    turns = [F.shiftleft("fp", width * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - width * k)) if k else F.col("fp") for k in range(SEGMENTS)]
    masks = key_masks(radius, pieces)
    # The last bits of a key say where the chain begins and which piece is left out: the masks leave them free.
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = fps.select(F.posexplode(F.array(*turns)).alias("seg", "turned"))
    keys = keys.select("seg", "turned", F.posexplode(F.array(*[F.col("turned").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("piece", "bits"))
    keys = keys.select(F.col("bits").bitwiseOR(F.col("seg").cast("long") * len(masks) + F.col("piece")).alias("key"), "turned")
    dealt = in_blocks(keys, ["key"], "turned", block).repartition("key", "part").sortWithinPartitions("key", "part", "side", "turned")

    def compare(batches):
        held: list[pd.DataFrame] = []
        n = 0

        def flush(pdf: pd.DataFrame):
            key = pdf["key"].to_numpy()
            part = pdf["part"].to_numpy()
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            fp = pdf["turned"].to_numpy().view(np.uint64)
            edges = links_within(group, pdf["side"].to_numpy(), fp, rest)
            seg = (key & 0xFF) // len(masks) * width
            back = _rotated(fp, (64 - seg) % 64).view(np.int64)
            return pd.DataFrame({"a": back[edges[:, 0]], "b": back[edges[:, 1]]})

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < 200_000:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1])  # may go on in the next batch
            held, n = [pdf[last]], int(last.sum())
            if n < len(pdf):
                yield flush(pdf[~last].reset_index(drop=True))
        if n:
            yield flush(pd.concat(held, ignore_index=True))

    return dealt.select("key", "part", "side", "turned").mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document row.

    fingerprint is 16 lowercase hex digits; component_id the smallest doc_id reached by links of at most radius differing bits.
    A text of fewer words than a shingle has the hash of its whole word sequence, a null, empty or blank one the fingerprint
    zero, which links like any other. A null doc_id is never the smallest unless its component has no other; repeated doc_ids
    are rows like any other; an empty table gives no rows; other columns are ignored.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(links(classes.select("fp"), radius, pieces=pieces_for(classes.count())))
    named = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root2")
    named = joined_back(named, least, [("root", "root2")]).select(F.col("fp").alias("fp2"), "component_id")
    return rows.join(named, F.col("fp") == F.col("fp2")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents' rows with the smallest doc_id of each group of near duplicates; columns as in docs.

    Of a doc_id that repeats, all rows stay or go together; rows with a null doc_id stay.
    """
    return without(docs, near_duplicates(docs, shingle, radius).where("doc_id <> component_id").select("doc_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
