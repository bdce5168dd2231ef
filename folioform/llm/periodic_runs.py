"""Periodic runs: maximal stretches of words that repeat with a period, and texts without the repeats.

A run of period p and length 2p or more holds two neighbouring points of the grid 0, p, 2p, ... For every period up to half of a text
all grid points are therefore compared with the point one period on; how far the two positions agree to the right and to the left
(longest common extensions) gives the run. All pairs of all texts of a batch go together: pairs whose own or next words differ fall
away by comparison, the others' extensions are found by one binary search over prefix hashes for all at once. Runs are then verified
word by word. The same stretch is found for multiples of its period too; its smallest period stays.

Texts of a batch lie in one array of word numbers, parted by numbers of their own, so that no extension leaves a text. Pairs are made
in bounded steps: a text of n words has some n ln n of them, and never more than STEP are held. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Words of a run at least, besides twice its period.
LEAST = 12
#: Pairs compared at a time; bytes of text that share an array of words; bytes that are split into words at a time.
STEP, TOGETHER, PIECE = 1 << 18, 1 << 20, 1 << 22

#: Prefix hashes are polynomials at BASE modulo a prime whose products fit 64 bits. Collisions only cost time, as runs are verified.
MODULUS, BASE = (1 << 31) - 1, 1_103_515_245

_SPACE = b" \t\n\r\x0b\x0c"

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Numbers(dict):
    """Numbers of words, given in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, which are split a piece at a time."""
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):  # to the end of a word
                near = [k for k in (text.find(c, end) for c in (_SPACE[i : i + 1] for i in range(len(_SPACE)))) if k >= 0]
                end = min(near, default=len(text))
            words = text[at:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def prefix_hashes(x: np.ndarray, modulus: int = MODULUS) -> tuple[np.ndarray, np.ndarray]:
    """(h, power): the hash of x[i:j] is h[j] - h[i] over power[i]."""
    power = np.ones(len(x) + 1, dtype=np.uint64)
    n = 1
    while n < len(power):  # powers of the base by doubling
        more = min(n, len(power) - n)
        power[n : n + more] = power[:more] * np.uint64(pow(BASE, n, modulus)) % np.uint64(modulus)
        n += more
    h = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x.astype(np.int64).view(np.uint64) % np.uint64(modulus) * power[:-1] % np.uint64(modulus), out=h[1:])
    return h % np.uint64(modulus), power


def extensions(h: np.ndarray, power: np.ndarray, i: np.ndarray, p: np.ndarray, most: np.ndarray, right: bool, modulus: int) -> np.ndarray:
    """How many words from i (right) or before i (left) agree with those p further on, at most `most`, by a binary search for all."""
    m = np.uint64(modulus)
    shift, low, high = power[p], np.zeros(len(i), dtype=np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        a, b = (i, i + middle) if right else (i - middle, i)
        same = (h[b] + m - h[a]) % m * shift % m == (h[b + p] + m - h[a + p]) % m
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _exact(x: np.ndarray, i: int, p: int, first: int, end: int) -> tuple[int, int]:
    """The stretch around i in which words p apart agree, word by word."""
    apart = np.flatnonzero(x[i : end - p] != x[i + p : end])
    before = np.flatnonzero(x[first:i] != x[first + p : i + p])
    return (first + int(before[-1]) + 1 if len(before) else first), (i + int(apart[0]) + p if len(apart) else end)


def _settle(x: np.ndarray, found: list[np.ndarray], known: dict[tuple[int, int], int], first: np.ndarray, end: np.ndarray, least: int) -> None:
    """Verifies stretches (point, period, from, to) and enters each with its smallest period into `known`."""
    i, p, s, e = found
    order = np.lexsort((p, e, s))
    i, p, s, e = i[order], p[order], s[order], e[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])]))
    for g, stop in zip(new, np.append(new[1:], len(s))):
        at = (int(s[g]), int(e[g]))
        q = known.get(at)
        if q is None and np.array_equal(x[at[0] : at[1] - p[g]], x[at[0] + p[g] : at[1]]):
            q = known[at] = int(p[g])
        # A period of at most half of the stretch is a multiple of the smallest one; any other came from a collision.
        for k in range(g, stop) if q is None else g + np.flatnonzero(p[g:stop] % q):
            doc = np.searchsorted(first, i[k], side="right") - 1
            a, b = _exact(x, int(i[k]), int(p[k]), int(first[doc]), int(end[doc]))
            if b - a >= max(least, 2 * p[k]):
                known[a, b] = min(int(p[k]), known.get((a, b), int(p[k])))


def runs_of(texts: list[np.ndarray], least: int = LEAST, modulus: int = MODULUS) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, given as word numbers from 0 up, by start and then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    parts = [np.array([-1], dtype=np.int32)]
    for k, t in enumerate(texts):
        parts += [t, np.array([-2 - k], dtype=np.int32)]
    x = np.concatenate(parts)
    first = np.concatenate([[1], 1 + np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64)
    end = first + sizes
    known: dict[tuple[int, int], int] = {}
    h = power = None
    # One row for each period of each text, with as many pairs as its grid has.
    periods = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), periods)
    p_of = np.arange(len(text), dtype=np.int64) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = np.concatenate([[0], np.cumsum((sizes[text] - 1) // p_of)])
    for low in range(0, int(pairs[-1]), STEP):
        high = min(low + STEP, int(pairs[-1]))
        a, b = np.searchsorted(pairs, [low, high - 1], side="right") - 1
        counts = np.minimum(pairs[a + 1 : b + 2], high) - np.maximum(pairs[a : b + 1], low)
        p = np.repeat(p_of[a : b + 1], counts)
        i = (np.arange(low, high) - np.repeat(pairs[a : b + 1], counts)) * p + np.repeat(first[text[a : b + 1]], counts)
        at = np.flatnonzero(x[i] == x[i + p])
        i, p = i[at], p[at]
        at = (x[i + 1] == x[i + p + 1]) | (x[i - 1] == x[i + p - 1])  # more than one word of a run agrees with the word one period on
        i, p = i[at], p[at]
        if not len(i):
            continue
        if h is None:
            h, power = prefix_hashes(x, modulus)
        doc = np.searchsorted(first, i, side="right") - 1
        right = extensions(h, power, i, p, end[doc] - i - p, True, modulus)
        left = extensions(h, power, i, p, i - first[doc], False, modulus)
        at = right + left >= np.maximum(p, least - p)
        if at.any():
            i, p, right, left = i[at], p[at], right[at], left[at]
            _settle(x, [i, p, i - left, i + right + p], known, first, end, least)
    out: list[list] = [[] for _ in texts]
    if known:
        for (s, e), q in known.items():
            doc = int(np.searchsorted(first, s, side="right")) - 1
            out[doc].append((s - int(first[doc]), e - s, q))
    return [np.array(sorted(r, key=lambda z: (z[0], z[2])), dtype=np.int64).reshape(-1, 3) for r in out]


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(ids: np.ndarray, names: list[bytes], step: int = 1 << 16) -> bytes:
    return b" ".join(b" ".join([names[k] for k in ids[at : at + step]]) for at in range(0, len(ids), step))


def _collapse(texts: list[bytes], least: int) -> list[tuple[int, np.ndarray, bytes]]:
    numbers = Numbers()
    ids = [numbers.of(t) for t in texts]
    names = list(numbers)
    out = []
    for own, runs in zip(ids, runs_of(ids, least)):
        kept = own[~repeats(len(own), runs)] if len(runs) else own
        out.append((len(own), runs, _joined(kept, names)))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: its runs by start and period, and its words without the repeats.

    A run has `least` words (4 at least) and two periods at least. A word goes if a run holds it behind that run's first period; the
    others are joined by one space. A null text is like an empty one: no words, no runs, an empty text. A null or repeated doc_id is a
    row like any other; an empty table gives no rows; other columns are ignored. Rows do not depend on each other.
    """

    def scan(batches):
        for batch in batches:
            rows = [t.as_py() or b"" for t in batch.column(1)]
            done, at = [], 0
            while at < len(rows):
                end, size = at + 1, len(rows[at])
                while end < len(rows) and size + len(rows[end]) <= TOGETHER:
                    size += len(rows[end])
                    end += 1
                done += _collapse(rows[at:end], least)
                at = end
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for _, r, _ in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            kept = pa.array([k for _, _, k in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in done], pa.int64()), pa.array(runs, kind), kept], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the most words; of equal ones that which starts first, then the one with the smallest period. Null without any."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the CRC-32 of doc_id, end in words that repeat; the others keep their texts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    n = F.size("__words").cast("long")
    p = 1 + F.floor((n - F.col("__a")) / (3 + g % 8))
    word = lambda i: F.get("__words", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    rows = docs.select("doc_id", "text", g.alias("__g"), F.when(chosen, words).alias("__words"))
    rows = rows.withColumn("__a", F.col("__g") % n).withColumn("__p", p)
    return rows.select("doc_id", F.when(F.col("__words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth have planted ones; digests of all runs and of the collapsed texts."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    top = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
