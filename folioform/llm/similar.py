"""Near duplicates by similarity of shingle sets: found by wide SimHash fingerprints, decided by the sets.

The votes of a SimHash, BITS of them over the distinct word shingles, are a projection of the shingle set that keeps angles; their
signs are the fingerprint. The share of bits in which two fingerprints differ is the angle between the sets over pi, so a least
Jaccard similarity s gives a radius: sets of equal size with that similarity have the cosine 2s / (1 + s). Fingerprints only propose:
pairs within three standard deviations beyond the radius go on, and the exact Jaccard similarity of the two shingle sets decides.

Candidates share the key of some table. A key is made of symbols: the votes are turned by random signs and a Hadamard transform, and
of each group of turned votes the place and sign of the largest is a symbol (cross-polytope hashing, Andoni and others 2015). That
needs several times fewer tables than equal bits do. By the pigeonring principle, two fingerprints within the radius have a word from
which on every chain of l consecutive words (round the ring) holds at most l / WORDS of the radius: pairs without such a chain are
dropped before their whole distance is counted.

Of small sets the votes say little, so pairs with a set of at most FEW shingles are found besides by an exact join: the shingles of a set
are put in order, the rarest first, and two sets that are similar enough share one of their first few (prefix filtering).

Of a large group of copies not all pairs are decided. First every document proposes two partners, the smallest and the nearest that
it met. Then, where documents that met are not connected by these, their pairs are decided where they meet, nearest first, until they
are. So no refused pair stands for another, a group that is connected costs few decisions a document, and pairs never leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_group, checkpointed, connected_components, few_pairs, joined_back, many_pairs, spanning, spans_of, without
from .near_dedup import in_blocks

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint.
WORDS = 8
BITS = 64 * WORDS
#: Chance that a pair exactly at the least similarity meets in no table; closer pairs are missed far more rarely.
MISS = 0.005
#: Members of a bucket that are compared in one piece.
BLOCK = 4096
#: The same where their shingle sets are at hand.
SETS = 512
#: Shingles of a set up to which its pairs are found by an exact join of sets; larger sets' votes tell them apart well enough.
FEW = 16
#: Documents up to which their ids are made known to all tasks (32 MB); more are met by a shuffle.
KNOWN = 4_000_000
SEED = 23

#: Chance that a symbol of a group of so many votes agrees at the similarity 0.8, the least measured over sets of 5 to 2,000 shingles.
SAME = {16: 0.505, 32: 0.455, 64: 0.415, 128: 0.38, 256: 0.345}

_KEYS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, dtype=np.uint64)


def radius_of(similarity: float, bits: int = BITS) -> int:
    return math.floor(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def farthest(similarity: float, bits: int = BITS) -> int:
    """Three standard deviations beyond the radius: pairs that similar are seldom farther apart."""
    radius = radius_of(similarity, bits)
    return radius + math.ceil(3 * math.sqrt(radius * (1 - radius / bits)))


def plan(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int, int]:
    """(votes a symbol, symbols a key, tables) for n documents: keys as long as spread unlike documents over buckets of some four."""
    need = max(10, math.ceil(math.log2(max(n, 1) / 4)))
    symbols = -(-need // 9)
    group = 1 << max(4, -(-need // symbols) - 1)
    # The chance falls with the squared distance of the sets (on the unit sphere) over its complement; SAME has it at 0.8.
    power = _spread(similarity) / _spread(SIMILARITY)
    return group, symbols, math.ceil(math.log(miss) / math.log(1 - SAME[group] ** (power * symbols)))


def _spread(similarity: float) -> float:
    cosine = 2 * similarity / (1 + similarity)
    return (1 - cosine) / (1 + cosine)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle."""
    seq = text.translate(LOWER).split() if text else []
    if not seq:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(seq)
    h = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, seq), dtype=np.int64, count=len(seq)) + 1)
    k = min(shingle, len(seq))
    spans = zip([0, *ends[:-k].tolist()], (ends[k - 1 :] - 1).tolist())
    return np.sort(np.fromiter({h(line[a:b]) for a, b in spans}, dtype=np.uint64))


def votes(own: np.ndarray) -> np.ndarray:
    """(BITS,) how many more of a set's hashes have a bit than not."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(own), 255):  # so many ones fit into a byte
        x = own[at : at + 255, None] ^ _KEYS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * total - len(own)


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """WORDS words, little-endian: a bit is 1 if it is set in over half of the hashes."""
    return np.packbits(votes(shingles(text, shingle)) > 0, bitorder="little").tobytes()


def _turned(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of each row."""
    half = 1
    while half < x.shape[1]:
        y = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(x.shape)
        half *= 2
    return x


def keys_of(rows: np.ndarray, group: int, symbols: int, tables: int) -> np.ndarray:
    """(n, tables) keys of rows of votes."""
    rows = rows.astype(np.float32)
    count, each = tables * symbols, BITS // group
    found = np.empty((len(rows), -(-count // each) * each), dtype=np.int64)
    for k in range(found.shape[1] // each):
        signs = np.random.default_rng([SEED, k]).choice(np.array([-1, 1], dtype=np.float32), BITS)
        x = _turned(rows * signs).reshape(len(rows), each, group)
        at = np.abs(x).argmax(axis=2)
        found[:, k * each : (k + 1) * each] = 2 * at + (np.take_along_axis(x, at[:, :, None], axis=2)[:, :, 0] > 0)
    parts = found[:, :count].reshape(len(rows), tables, symbols)
    return (parts << (np.arange(symbols) * group.bit_length())).sum(axis=2)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of words (n, WORDS) differ in at most radius bits: by chains of words round the ring, then in full."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    ring = np.cumsum(np.concatenate([np.zeros((len(d), 1), dtype=np.int64), d, d[:, :-1]], axis=1), axis=1)
    chain = np.zeros(len(d), dtype=bool)
    for start in range(WORDS):
        ok = np.ones(len(d), dtype=bool)
        for k in range(1, WORDS + 1):
            ok &= (ring[:, start + k] - ring[:, start]) * WORDS <= radius * k
        chain |= ok
    out = chain.copy()
    out[chain] = d[chain].sum(axis=1) <= radius
    return out


def _in_buckets(members: DataFrame, block: int) -> DataFrame:
    """Members (key, node, ...) dealt out and sorted by buckets (key, part)."""
    return in_blocks(members, ["key"], "node", block).repartition("key", "part").sortWithinPartitions("key", "part", "side", "node")


def _members(classes: DataFrame, *columns: str) -> DataFrame:
    """(key, node, columns, word): a row for each table of each class; key names the table too, and word is the one of the fingerprint
    that the table looks at first."""
    each = classes.select("node", *columns, "words", F.posexplode("keys").alias("table", "symbols"))
    key = F.shiftleft(F.col("table").cast("long"), 48).bitwiseOR(F.col("symbols").cast("long"))
    return each.select(key.alias("key"), "node", *columns, F.element_at("words", F.pmod("table", F.lit(WORDS)) + 1).alias("word"))


def partners(classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, least, nearest): the smallest and the nearest document that each of classes (node, words, keys) met, itself excluded.

    Documents meet in a bucket if one word of their fingerprints, which depends on the table, does not rule the similarity out; a
    document that met none has no row.
    """
    far = farthest(similarity, 64)

    def flush(pdf: pd.DataFrame, group: np.ndarray):
        node, side, word = pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["word"].to_numpy().view(np.uint64)
        first, count = spans_of(group)
        least, nearest, apart = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), -1), np.full(len(node), far + 1)
        for i, j in few_pairs(first, count, side):
            d = np.bitwise_count(word[i] ^ word[j])
            close = d <= far
            for x, y in ((i[close], j[close]), (j[close], i[close])):
                least[x] = np.minimum(least[x], node[y])
                better = d[close] < apart[x]
                nearest[x[better]], apart[x[better]] = node[y[better]], d[close][better]
        for part, whole, meet in many_pairs(first, count, side):
            d = np.where(meet, np.bitwise_count(word[part, None] ^ word[None, whole]), far + 1)
            least[part] = np.where(d <= far, node[None, whole], least[part, None]).min(axis=1)
            at = d.argmin(axis=1)
            nearest[part], apart[part] = node[whole][at], d[np.arange(len(d)), at]
        met = apart <= far
        yield pd.DataFrame({"node": node[met], "least": least[met], "apart": apart[met], "nearest": nearest[met]})

    met = _in_buckets(_members(classes), block).select("key", "part", "side", "node", "word").mapInPandas(lambda batches: by_group(batches, flush), "node long, least long, apart long, nearest long")
    return met.groupBy("node").agg(F.min("least").alias("least"), F.min_by("nearest", F.struct("apart", "nearest")).alias("nearest"))


def _jaccard(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes are that similar; two empty ones are."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return both >= least * (len(x) + len(y) - both)


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, own): the shingle sets of the documents (doc_id, text) named in ids (id); only their texts are hashed."""
    ids = checkpointed(ids)
    few = ids.count() <= KNOWN  # then texts stay where they are read
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def hashed(batches):
        for batch in batches:
            own = [shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    return texts.mapInArrow(hashed, "node long, own binary")


def still_alike(classes: DataFrame, roots: DataFrame, docs: DataFrame, similarity: float, shingle: int, block: int = SETS) -> DataFrame:
    """Edges (a, b) of roots that connect what partners left apart: classes (node, words, keys) that meet and have different roots
    (node, root).

    Their pairs are decided where they meet, nearest fingerprints first, and never leave the task: a pair that others have connected
    meanwhile is passed over, and only the edges that connect go on.
    """
    radius, far = farthest(similarity), farthest(similarity, 64)
    rooted = classes.join(roots.select(F.col("node").alias("node2"), "root"), F.col("node") == F.col("node2"))
    members = _in_buckets(_members(rooted, "root"), BLOCK).select("key", "part", "side", "node", "root", "word")

    def apart(pdf: pd.DataFrame, group: np.ndarray):
        side, root, word = pdf["side"].to_numpy(), pdf["root"].to_numpy(), pdf["word"].to_numpy().view(np.uint64)
        some = np.zeros(len(pdf), dtype=bool)
        first, count = spans_of(group)
        for i, j in few_pairs(first, count, side):
            other = (root[i] != root[j]) & (np.bitwise_count(word[i] ^ word[j]) <= far)
            some[i[other]] = some[j[other]] = True
        for part, whole, meet in many_pairs(first, count, side):
            some[part] |= (meet & (root[part, None] != root[None, whole]) & (np.bitwise_count(word[part, None] ^ word[None, whole]) <= far)).any(axis=1)
        yield pdf[["key", "node", "root"]][some]

    # Fingerprints and sets come in for those that meet another root; a member of several parts of a bucket is one again.
    members = checkpointed(members.mapInPandas(lambda batches: by_group(batches, apart), "key long, node long, root long").distinct())
    own = _sets(docs, members.select(F.col("node").alias("id")).distinct(), shingle).join(classes.select(F.col("node").alias("node2"), "words"), F.col("node") == F.col("node2")).select("node2", "words", "own")
    dealt = joined_back(in_blocks(members, ["key"], "node", block), own, [("node", "node2")])
    dealt = dealt.select("key", "part", "side", "node", "root", "words", "own").repartition("key", "part").sortWithinPartitions("key", "part", "side", "node")

    def flush(pdf: pd.DataFrame, group: np.ndarray):
        side, words = pdf["side"].to_numpy(), np.stack(pdf["words"].to_numpy()).view(np.uint64)
        names, label = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["own"]]
        edges = []

        def decide(i: np.ndarray, j: np.ndarray) -> None:
            near = within(words[i], words[j], radius)
            i, j = i[near], j[near]
            order = np.argsort(np.bitwise_count(words[i] ^ words[j]).sum(axis=1), kind="stable")
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                for x, y in zip(*(k[part[label[i[part]] != label[j[part]]]] for k in (i, j))):
                    if label[x] != label[y] and _jaccard(sets[x], sets[y], similarity):
                        edges.append((label[x], label[y]))
                        label[label == label[x]] = label[y]

        first, count = spans_of(group)
        for i, j in few_pairs(first, count, side):
            other = label[i] != label[j]
            decide(i[other], j[other])
        for part, whole, meet in many_pairs(first, count, side):
            i, j = np.nonzero(np.triu(meet, part.start - whole.start) & (label[part, None] != label[None, whole]))
            decide(i + part.start, j + whole.start)
        if edges:
            yield pd.DataFrame(names[np.array(edges)], columns=["a", "b"])

    return dealt.mapInPandas(lambda batches: by_group(batches, flush, 5_000), "a long, b long").distinct()


def _small_edges(classes: DataFrame, similarity: float, block: int = SETS) -> DataFrame:
    """Edges (a, b) that connect, as all pairs of that Jaccard similarity do, the classes (node, size, own) of which one has at most FEW shingles."""
    largest = math.floor(FEW / similarity)  # that a similar set has
    each = classes.where(F.col("size").between(1, largest)).select("node", "size", F.explode("own").alias("key"))
    often = each.groupBy(F.col("key").alias("key2")).agg(F.count("*").alias("often")).where("often > 1")
    # The rarest first: those that no other set holds take up places of a prefix, but need not meet anybody.
    placed = joined_back(each, often, [("key", "key2")], "left").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "key"))).alias("keys"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1
    own = F.transform("keys", lambda k: k["key"])
    first = placed.select("node", own.alias("own"), F.explode(F.slice("keys", F.lit(1), prefix.cast("int"))).alias("k")).where("k.often > 1")
    members = first.select("node", F.col("k.key").alias("key"), "own")
    dealt = in_blocks(members, ["key"], "node", block).select("key", "part", "side", "node", "own").repartition("key", "part").sortWithinPartitions("key", "part", "side", "node")

    def flush(pdf: pd.DataFrame, group: np.ndarray):
        node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
        sizes = pdf["own"].map(len).to_numpy()
        sets = np.zeros((len(pdf), largest), dtype=np.int64)
        sets[np.arange(largest) < sizes[:, None]] = np.concatenate(pdf["own"].to_numpy())
        held = np.arange(largest) < sizes[:, None]
        edges = []
        for at, n in zip(*spans_of(group)):
            label = np.arange(n)  # members of one label are connected; a member is compared with those of other labels only
            for k in range(n - 1):
                other = at + 1 + k + np.flatnonzero((label[k + 1 :] != label[k]) & ((side[at + k] == 0) | (side[at + k + 1 : at + n] != side[at + k])))
                both = (np.isin(sets[other], sets[at + k, : sizes[at + k]]) & held[other]).sum(axis=1)
                close = other[both >= similarity * (sizes[other] + sizes[at + k] - both) - 1e-9]
                if len(close):
                    edges += [(node[at + k], node[j]) for j in close]
                    label[np.isin(label, label[close - at])] = label[k]
        if edges:
            yield pd.DataFrame(spanning(np.array(edges, dtype=np.int64)), columns=["a", "b"])

    return dealt.mapInPandas(lambda batches: by_group(batches, flush, 20_000), "a long, b long")


def _words_in(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def alike(edges: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The edges (a, b) of doc_ids that fingerprints and sizes do not rule out and whose shingle sets have that Jaccard similarity.

    classes (node, words, size) has the fingerprint and size of each; only the texts of what is left are read again and hashed.
    """
    radius = farthest(similarity)
    one, two = (classes.select(F.col("node").alias(k), F.col("words").alias(f"words_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")

    def judge(batches):
        for batch in batches:
            keep = pa.array(within(_words_in(batch.column(2)), _words_in(batch.column(3)), radius))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    near = edges.join(one, "a").join(two, "b").where(small >= F.lit(similarity) * large).select("a", "b", "words_a", "words_b")
    near = checkpointed(near.mapInArrow(judge, "a long, b long"))
    own = _sets(docs, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), shingle)

    def decide(batches):
        for batch in batches:
            keep = pa.array([_jaccard(*(np.frombuffer(v.as_py(), dtype=np.uint64) for v in pair), similarity) for pair in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one, two = (own.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    return checkpointed(near.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b").mapInArrow(decide, "a long, b long").distinct())


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for every document row with a doc_id.

    Rows link if the Jaccard similarity of their shingle sets is as high; component_id is the smallest doc_id reachable. A text of
    fewer words than a shingle is one shingle; texts without words are alike; rows of one doc_id are one document, whatever their
    texts; rows with a null doc_id are left out; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    group, symbols, tables = plan(docs.count(), similarity)
    wide = symbols * group.bit_length() > 31

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingles(t.as_py(), shingle) for t in part.column(1)]
                same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
                rows = np.stack([votes(x) for x in own])
                words = np.packbits(rows > 0, axis=1, bitorder="little").view("<i8")
                keys = keys_of(rows, group, symbols, tables)
                few = [x.view(np.int64) if len(x) * similarity <= FEW else x[:0].view(np.int64) for x in own]
                lists = [pa.array(list(x), pa.list_(t)) for x, t in ((words, pa.int64()), (keys, pa.int64() if wide else pa.int32()), (few, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), same, pa.array([len(x) for x in own], pa.int32()), *lists], names=["doc_id", "same", "size", "words", "keys", "own"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id long, same binary, size int, words array<long>, keys array<{'long' if wide else 'int'}>, own array<long>")
    rows = checkpointed(rows)
    # A class has one shingle set, so that deciding on its first document decides on all.
    classes = checkpointed(rows.groupBy("same").agg(F.min(F.struct("doc_id", "size", "words", "keys", "own")).alias("x")).select("same", F.col("x.doc_id").alias("node"), "x.size", "x.words", "x.keys", "x.own"))
    met = checkpointed(partners(classes, similarity, block))
    edges = met.select(F.col("node").alias("x"), F.explode(F.array("least", "nearest")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
    named = rows.select("doc_id", "same").join(classes.select(F.col("same").alias("same2"), F.col("node").alias("first")), F.col("same") == F.col("same2")).select("doc_id", "first")
    named = checkpointed(named)
    least = named.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select(F.col("doc_id").alias("doc2"), "a")  # several texts
    several = named.join(least, F.col("doc_id") == F.col("doc2")).select("a", F.col("first").alias("b"))
    small = _small_edges(classes, similarity, min(block, SETS))
    roots = connected_components(alike(edges, classes, docs, similarity, shingle).union(several).union(small))
    # Those that met, but are not connected by their partners.
    known = met.select(F.col("node").alias("met")).join(roots, F.col("met") == F.col("node"), "left").select(F.col("met").alias("node"), F.coalesce("root", "met").alias("root"))
    rest = checkpointed(still_alike(classes, known, docs, similarity, shingle, min(block, SETS)))
    if not rest.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    return named.join(roots, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("root", "first").alias("component_id"))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The documents' rows with the smallest doc_id of each group; columns as in docs. Rows with a null doc_id stay."""
    return without(docs, similar_documents(docs, similarity, shingle).where("doc_id <> component_id").select("doc_id"))
