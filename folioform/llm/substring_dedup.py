"""Substring dedup by level-wise doubling of repeated word windows.

What is looked for are windows of WINDOW words that also start earlier in the corpus. A window is first judged by windows of
BASE words inside it: the one with the smallest hash stands for it, so equal windows are stood for by equal ones, and only about
one position in eight is looked up. A short window that occurs once in the corpus cannot lie in a repeated long one; positions
whose short window repeats are extended to twice the length and judged again among themselves, and so on, until the windows of
the full length that are left are compared by 96-bit hashes and the first place of each is known. All others go.

Texts that equal that of a smaller doc_id need no search: every window of theirs starts earlier. Every lookup is an aggregation
with map-side sums, followed by a join that can be split; the texts are dealt out by doc_id once and read again at each level.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, joined_back, table

WINDOW = 20
BASE = 5
#: Bytes of text that are hashed in one piece.
PIECE = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=_U) | _U(1)
_FACTOR = [_U(0xD1342543DE82EF95), _U(0xAF251AF3B0F025B5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _slide(a: np.ndarray, k: int, op) -> np.ndarray:
    """op over each k neighbours."""
    size = 1
    while size * 2 <= k:
        a = op(a[:-size], a[size:]) if len(a) > size else a[:0]
        size *= 2
    rest = k - size
    return a if not rest else op(a[:-rest], a[rest:]) if len(a) > rest else a[:0]


class Piece:
    """The words of some documents, hashed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        inside = ~IS_SPACE[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[-1]]
        start[firsts] = inside[firsts]
        starts = np.flatnonzero(start)
        self.doc = np.searchsorted(offsets, starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        if len(starts):
            at = np.arange(starts[0], len(data))
            at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
            powers = np.full(int(at.max()) + 1, _STEP, dtype=_U)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            value = _BYTE[data[starts[0] :]] * powers[at]
            value[~inside[starts[0] :]] = 0
            self.word = np.add.reduceat(value, starts - starts[0])
        else:
            self.word = np.zeros(0, dtype=_U)

    def grams(self, length: int, which: int = 0) -> np.ndarray:
        """Hash of the words i to i + length - 1, documents run together."""
        power = _mixed(self.word ^ _U(which * 0x5851F42D4C957F2D))  # hashes of `size` words
        factor, size, out, have = _FACTOR[which], 1, None, 0
        while size <= length:
            if length & size:
                out = power if out is None else self._joined(power, out, size, have, factor)
                have += size
            if size * 2 <= length:
                power = self._joined(power, power, size, size, factor)
            size *= 2
        return _mixed(out)

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, na: int, nb: int, factor) -> np.ndarray:
        """Hashes of na + nb words from those of na words and of the nb after them."""
        n = max(0, len(b) - na)
        scale = _U(pow(int(factor), nb, 1 << 64))
        return a[:n] * scale + b[na : na + n]

    def windows(self, window: int) -> np.ndarray:
        """Which positions start a window within a document."""
        n = max(0, len(self.word) - window + 1)
        return self.doc[:n] == self.doc[window - 1 : window - 1 + n]

    def stands(self, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each short window, smallest of these in each window)."""
        h = self.grams(length) >> _U(16)  # 48 bits: where these clash a window is only judged at the next level too
        return h, _slide(h, window - length + 1, np.minimum)

    def chosen(self, length: int, window: int, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, hash, times, 2 at most) of the distinct short windows that stand for candidate windows."""
        h, least = self.stands(length, window)
        k = window - length + 1
        held = np.concatenate([np.zeros(k - 1, dtype=_U), np.where(candidate, least, _U(0)), np.zeros(k - 1, dtype=_U)])
        take = np.flatnonzero((_slide(held, k, np.maximum) == h) & (h > 0))
        doc, f = self.doc[take], h[take]
        order = np.lexsort((f, doc))
        doc, f = doc[order], f[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])])) if len(f) else np.zeros(0, dtype=int)
        times = np.minimum(np.diff(np.append(new, len(f))), 2)
        return doc[new], f[new], times

    def among(self, length: int, window: int, doc: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Which windows are stood for by one of their document's short windows (doc, f)."""
        ok = self.windows(window)
        least = self.stands(length, window)[1]
        at = np.flatnonzero(ok)
        mine = _mixed(least[at] + self.doc[at].astype(_U) * _STEP)
        ok[at] = np.isin(mine, _mixed(f + doc.astype(_U) * _STEP))
        return ok


def _pieces(batch: pa.RecordBatch, size: int = PIECE):
    """(first row, end row, Piece) over the texts of a batch; column 1 holds them."""
    texts = batch.column(1).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def _flat(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(row from a, value) of the entries of a list column's rows a to b."""
    part = column.slice(a, b - a)
    size = np.asarray(part.value_lengths().fill_null(0))
    return np.repeat(np.arange(b - a), size), part.flatten().to_numpy(zero_copy_only=False)


def _level(length: int, before: int | None, window: int):
    """Short windows of this length that stand for windows whose short window of the length before repeats."""

    def scan(batches):
        for batch in batches:
            for a, b, piece in _pieces(batch):
                if before is None:
                    candidate = piece.windows(window)
                else:
                    doc, f = _flat(batch.column(2), a, b)
                    if not len(f):
                        continue
                    candidate = piece.among(before, window, doc, f.view(_U))
                if candidate.any():
                    doc, f, times = piece.chosen(length, window, candidate)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array(f.view(np.int64)), pa.array(times.astype(np.int32))], names=["doc_id", "f", "times"])

    return scan


def _last(length: int, window: int):
    """Windows of the full length that may repeat."""

    def scan(batches):
        for batch in batches:
            for a, b, piece in _pieces(batch):
                doc, f = _flat(batch.column(2), a, b)
                if not len(f):
                    continue
                at = np.flatnonzero(piece.among(length, window, doc, f.view(_U)))
                doc = piece.doc[at]
                h = [pa.array((piece.grams(window, k)[at] >> _U(32 * k)).view(np.int64)) for k in (0, 1)]  # 96 bits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array((at - piece.first[doc]).astype(np.int32)), *h], names=["doc_id", "pos", "h1", "h2"])

    return scan


def _finish(length: int, window: int, with_text: bool):
    def scan(batches):
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            copies = batch.column(4).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, piece in _pieces(batch):
                doc, f = _flat(batch.column(2), a, b)
                gone = np.zeros(len(piece.word), dtype=bool)
                if len(f):
                    again = piece.among(length, window, doc, f.view(_U))
                    row, pos = _flat(batch.column(3), a, b)
                    again[piece.first[row] + pos] = False
                    again = np.flatnonzero(again)
                    change = np.zeros(len(gone) + 1, dtype=np.int32)
                    np.add.at(change, again, 1)
                    np.add.at(change, again + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                for k in range(a, b):
                    text, n = batch.column(1)[k].as_py(), int(piece.n_words[k - a])
                    drop = gone[piece.first[k - a] : piece.first[k - a] + n]
                    if copies[k] and n >= window:
                        removed, kept = n, b""
                    else:
                        removed, own = int(drop.sum()), (text or b"").split()
                        kept = b" ".join(compress(own, (~drop).tolist()) if removed else own)
                    out["n_words"].append(n)
                    out["n_removed"].append(removed)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept if with_text and text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string())], names=["doc_id", *out])

    return scan


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, f, times) whose f occurs more than once."""
    twice = rows.groupBy("f").agg(F.sum("times").alias("n")).where("n >= 2").select(F.col("f").alias("f2"))
    return joined_back(rows.select("doc_id", "f"), twice, [("f", "f2")]).select("doc_id", "f")


def _lists(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("id2")).agg(F.collect_list(value).alias("list"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, base: int = BASE, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every document row.

    Words covered by a window of `window` words that also starts earlier (smaller doc_id, or same document and earlier start) go;
    windows are judged on the input. window must be base times a power of two. A null or empty text has no words. A row with a
    null doc_id, and rows of a doc_id that repeats with different texts, are left whole and are earlier for none; equal rows are
    one document and get equal results. An empty table gives no rows; other columns are ignored. kept (with_text) are the words
    left, joined by one space; null for a null text.
    """
    lengths = [base]
    while lengths[-1] * 2 <= window:
        lengths.append(lengths[-1] * 2)
    if lengths.pop() != window or not lengths:
        raise ValueError("window must be base times a power of two, and more than base")
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    unnamed, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")  # the first meet no list: they stay where they are
    texts = docs.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")).distinct()
    least = texts.groupBy(F.col("sha").alias("sha2")).agg(F.min("doc_id").alias("least"))
    copies = joined_back(texts, least, [("sha", "sha2")]).where("doc_id > least").select("doc_id")
    unclear = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    found = docs.mapInArrow(_level(lengths[0], None, window), "doc_id long, f long, times int")
    found = _repeated(found).join(copies.union(unclear), "doc_id", "left_anti")
    for before, length in zip(lengths, lengths[1:]):
        at = docs.join(_lists(found, "f"), F.col("doc_id") == F.col("id2"), "left").select("doc_id", "text", "list")
        found = _repeated(at.mapInArrow(_level(length, before, window), "doc_id long, f long, times int"))
    lists = _lists(found, "f")
    at = docs.join(lists, F.col("doc_id") == F.col("id2"), "left").select("doc_id", "text", "list")
    full = at.mapInArrow(_last(lengths[-1], window), "doc_id long, pos int, h1 long, h2 long")
    firsts = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first")).select("first.doc_id", "first.pos")
    firsts = _lists(firsts, "pos").select(F.col("id2").alias("id3"), F.col("list").alias("firsts"))
    whole = copies.join(unclear, "doc_id", "left_anti").select(F.col("doc_id").alias("id4"), F.lit(True).alias("copy")).distinct()
    at = docs.join(lists, F.col("doc_id") == F.col("id2"), "left").join(firsts, F.col("doc_id") == F.col("id3"), "left").join(whole, F.col("doc_id") == F.col("id4"), "left")
    at = at.select("doc_id", "text", "list", "firsts", "copy")
    at = at.unionByName(unnamed.select("*", *[F.lit(None).cast(at.schema[k].dataType).alias(k) for k in ("list", "firsts", "copy")]))
    out = at.mapInArrow(_finish(lengths[-1], window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 20 words that also start earlier."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """doc_id: (n_words, n_removed, digest) straight from the definition, for tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        own = (text or "").encode().split()
        gone = set()
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[doc_id] = (len(own), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in gone)).hexdigest())
    return out


OP5_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, range(20) t(k)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
