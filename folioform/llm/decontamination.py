"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the word sequences of the test items, one edge a word. Documents are streamed through it word by
word: the state and the length of the longest suffix of the text read so far that occurs in some item. Where the length reaches
the window, the last `window` words are a window of an item; items shorter than the window are found whole, by links from a
state to the nearest shorter item that ends there.

Only words that can take part are fed to it: an exact pre-filter drops the words of a document that do not lie in a run of
adjacent word pairs known from the items, long enough for the shortest window; before such a run the state is the root anyway.

An automaton holds a bounded number of words; test items beyond that are matched by further automata, one pass over the documents
each. Passes only differ in what they find: rows are told apart by a number of their own, never by what they hold.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import LOWER, checkpointed, table

#: Words: runs of digits, letters and characters beyond ASCII; every other byte parts them.
_FOLD = bytes(LOWER[b] if chr(b).isalnum() and b < 128 or b >= 128 else 0x20 for b in range(256))
_IS_WORD = np.array([c != 0x20 for c in _FOLD])

#: Words of a matched stretch that count as a leak.
WINDOW = 10
#: Words of test items that one automaton holds; more items are matched in further automata, one pass each.
MOST_WORDS = 250_000

_LEAK = StructType(
    [StructField("n_words", LongType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("items", ArrayType(StringType())), StructField("longest", LongType()), StructField("kept", StringType())]
)
_ARROW_LEAK = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("kept", pa.string())])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class _Growing:
    """States of an automaton while items are read; edges are dictionaries here and flat arrays in the finished Automaton."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of q that are at most one longer than p's."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # read before, in this or another item
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new


def _rows_of(pairs: set[tuple[int, int]], n: int) -> tuple[array, array]:
    """(first, value): the values of row k are value[first[k] : first[k + 1]], in order."""
    rows = np.array(sorted(pairs), dtype=np.int32).reshape(-1, 2)
    first = np.searchsorted(rows[:, 0], np.arange(n + 1)).astype(np.int32)
    return array("i", first.tobytes()), array("i", np.ascontiguousarray(rows[:, 1]).tobytes())


class Automaton:
    """Generalised suffix automaton of test items in flat arrays, with what is needed to name the items of a window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: list[object] = []
        self.vocabulary: dict[bytes, int] = {}
        self.least = window
        grown, pairs, ends, short = _Growing(), set(), [], set()
        for name, seq in items:
            if not seq:
                continue
            k = len(self.ids)
            self.ids.append(name)
            self.least = min(self.least, len(seq))
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in seq]
            pairs.update(zip(coded, coded[1:]))
            last = 0
            for i, c in enumerate(coded, 1):
                last = grown.extend(last, c)
                if i >= window:
                    ends.append((last, k))
            if len(coded) < window:
                short.add((last, k))
        self.link, self.length = grown.link, grown.length
        n = len(self.link)
        self.edge = array("i", np.cumsum([0, *map(len, grown.next)]).astype(np.int32).tobytes())  # edges of state s: edge[s] to edge[s + 1]
        self.symbol, self.target = array("i"), array("i")
        for edges in grown.next:
            for c in sorted(edges):
                self.symbol.append(c)
                self.target.append(edges[c])
        del grown
        self.item_first, self.item = _rows_of({(self.top(state), k) for state, k in ends}, n)
        self.short_first, self.short = _rows_of(short, n)
        shorter = {state for state, _ in short}
        self.jump = array("i", bytes(4 * n))  # nearest state by links, itself included, whose longest string is a shorter item
        for state in np.argsort(np.frombuffer(self.length, dtype=np.int32), kind="stable").tolist()[1:]:
            self.jump[state] = state if state in shorter else self.jump[self.link[state]]
        self.bits = max(16, int(len(pairs) * 16).bit_length())
        self.pairs = np.zeros(1 << self.bits, dtype=bool)
        if pairs:
            a, b = np.array(sorted(pairs), dtype=np.uint64).T
            self.pairs[self._slot(a, b)] = True

    def top(self, state: int) -> int:
        """The state that holds the last `window` words of the state's strings, which are that long at least."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def _runs(self, coded: np.ndarray):
        """Stretches [start, end) of words outside of which no window can lie."""
        if self.least == 1:
            good, more = coded > 0, 0
        else:
            good, more = np.zeros(len(coded) - 1, dtype=bool), 1
            known = np.flatnonzero((coded[1:] > 0) & (coded[:-1] > 0))
            good[known] = self.pairs[self._slot(coded[known], coded[known + 1])]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2] + more
        long = ends - starts >= self.least
        return zip(starts[long].tolist(), ends[long].tolist())

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(merged spans [start, end) of words inside windows, the items with windows, longest match that ends a window)."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        if len(text) < self.least:
            return spans, found, longest
        get = self.vocabulary.get
        coded = np.fromiter((get(w, 0) for w in text), dtype=np.uint64, count=len(text))
        window, link, length, jump = self.window, self.link, self.length, self.jump
        edge, symbol, target = self.edge, self.symbol, self.target
        seen: set[int] = set()

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))

        for first, end in self._runs(coded):
            state = n = 0
            for i, c in enumerate(coded[first:end].tolist(), first + 1):
                while True:
                    e = bisect_left(symbol, c, edge[state], edge[state + 1])
                    if e < edge[state + 1] and symbol[e] == c:
                        state, n = target[e], n + 1
                        break
                    if not state:
                        n = 0
                        break
                    state = link[state]
                    n = length[state]
                if n >= window:
                    longest = max(longest, n)
                    hit(i - window, i)
                    s = self.top(state)
                    if s not in seen:
                        seen.add(s)
                        found.update(self.item[self.item_first[s] : self.item_first[s + 1]])
                s = jump[state]
                if s and length[s] > n:  # the state's longest string is longer than what was read
                    s = jump[link[s]]
                if s:
                    longest = max(longest, length[s])
                    hit(i - length[s], i)
                while s:
                    found.update(self.short[self.short_first[s] : self.short_first[s + 1]])
                    s = jump[link[s]]
        return spans, found, longest


def automata(items: DataFrame, window: int, most_words: int = MOST_WORDS):
    """Automata of the test items (item_id, text), each of at most most_words words (one item more at the end); one at least."""
    held, n, none = [], 0, True
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        seq = words(bytes(row["text"]) if row["text"] is not None else None)
        held.append((row["item_id"], seq))
        n += len(seq)
        if n >= most_words:
            yield Automaton(held, window)
            held, n, none = [], 0, False
    if n or none:
        yield Automaton(held, window)


def _scan(docs: DataFrame, carry: list[str], machine: Automaton, with_text: bool, only_hits: bool = False) -> DataFrame:
    """The columns to carry of each document row, and __leak: n_words, starts and ends of the hit spans in words, items, longest,
    and the text without them."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the words of one automaton

    def scan(batches):
        own = shared.value
        for batch in batches:
            out, keep = [], []
            for at, text in enumerate(batch.column("__bytes")):
                text = text.as_py()
                seq = words(text)
                spans, found, longest = own.matches(seq)
                if spans or not only_hits:
                    items = sorted({str(own.ids[k]) for k in found})
                    kept = without(text, spans).decode() if with_text and text is not None else None
                    out.append({"n_words": len(seq), "starts": [a for a, _ in spans], "ends": [b for _, b in spans], "items": items, "longest": longest, "kept": kept})
                    keep.append(at)
            some = batch.select(carry) if len(keep) == batch.num_rows else batch.select(carry).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, _ARROW_LEAK)], names=[*carry, "__leak"])

    schema = StructType([*docs.select(*carry).schema.fields, StructField("__leak", _LEAK)])
    return docs.select(*carry, F.col("text").cast("binary").alias("__bytes")).mapInArrow(scan, schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes of the words of the spans; what parted them from the words before stays."""
    if not spans:
        return text
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[np.frombuffer(text, dtype=np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def _leaks(docs: DataFrame, carry: list[str], items: DataFrame, window: int, most_words: int, with_text: bool) -> DataFrame:
    """The columns to carry of every document row and its __leak from all automata."""
    machines = automata(items, window, most_words)
    first, second = next(machines), next(machines, None)
    if second is None:
        return _scan(docs, carry, first, with_text)
    # Rows are numbered and written down once, so that the passes speak of the same ones; a pass leaves the rows that it hit.
    rows = checkpointed(docs.select(*carry, F.col("text").cast("binary").alias("__text"), F.monotonically_increasing_id().alias("__row")))
    texts = rows.select("__row", F.col("__text").alias("text"))
    hits = None
    for machine in (m for part in ([first, second], machines) for m in part):
        some = checkpointed(_scan(texts, ["__row"], machine, False, only_hits=True))
        hits = some if hits is None else hits.unionByName(some)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("__leak.starts", "__leak.ends"))))
    found = hits.groupBy(F.col("__row").alias("__hit")).agg(spans.alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__leak.items")))).alias("__items"), F.max("__leak.longest").alias("__longest"))

    def finish(batches):
        for batch in batches:
            out = []
            for text, spans, items, longest in zip(*(batch.column(k) for k in ("__text", "__spans", "__items", "__longest"))):
                text, merged = text.as_py(), []
                for s in spans.as_py() or []:
                    if merged and s["starts"] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s["ends"]))
                    else:
                        merged.append((s["starts"], s["ends"]))
                kept = without(text, merged).decode() if with_text and text is not None else None
                out.append({"n_words": len(words(text)), "starts": [a for a, _ in merged], "ends": [b for _, b in merged], "items": items.as_py() or [], "longest": longest.as_py() or 0, "kept": kept})
            yield pa.RecordBatch.from_arrays([*batch.select(carry).columns, pa.array(out, _ARROW_LEAK)], names=[*carry, "__leak"])

    schema = StructType([*docs.select(*carry).schema.fields, StructField("__leak", _LEAK)])
    joined = rows.join(found, F.col("__row") == F.col("__hit"), "left").select(*carry, "__text", "__spans", "__items", "__longest")
    return joined.mapInArrow(finish, schema)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, starts, ends, items, longest, kept) for every document row.

    starts and ends are the word offsets of the merged spans covered by windows, items the sorted item_ids (as strings) with
    windows in the document, longest the longest match in words that ends a window (0: none), kept (with_text) the text without the spans. A null
    or empty text has no words; an item without words matches nothing; an item shorter than the window is one window; repeated
    items and items with a null id count each by its id (null: "None"); no items leave every document alone; each row is judged
    by its own text, whatever its doc_id; other columns are ignored. Results do not depend on most_words, which only says how many
    passes the test items take.
    """
    return _leaks(docs, ["doc_id"], items, window, most_words, with_text).select("doc_id", "__leak.*")


def covered(starts: Column | str = "starts", ends: Column | str = "ends") -> Column:
    """Words inside the spans."""
    lengths = F.zip_with(starts, ends, lambda a, b: (b - a).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda x, y: x + y)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents' rows without what they share with test items; columns as in docs.

    A row of whose words more than the share max_coverage lie in windows goes; from others the covered spans are cut. Rows without
    a hit pass unchanged, nulls and empty texts included. Each row is judged by its own text, whatever its doc_id.
    """
    found = _leaks(docs, docs.columns, items, window, most_words, with_text=max_coverage > 0)
    hit = F.size("__leak.starts") > 0
    kept = found.where(~hit | (covered("__leak.starts", "__leak.ends") <= max_coverage * F.col("__leak.n_words")))
    if max_coverage > 0:
        kept = kept.withColumn("text", F.when(hit, F.col("__leak.kept")).otherwise(F.col("text")))
    return kept.select(docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents share with the benchmark."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = covered()
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int) -> tuple[int, int, str]:
    """(n_words, n_hit, items' digest) straight from the definition, for tests."""
    seq = words(text.encode()) if text else []
    hit, found = set(), set()
    for name, item in items:
        own = words(item.encode()) if item else []
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for i in range(len(seq) - n + 1):
                if seq[i : i + n] == own[a : a + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(seq), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
