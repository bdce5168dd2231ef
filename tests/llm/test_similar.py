import random

import numpy as np
import pytest

from folioform.llm import similar

from .test_small_operators import ODD, prose


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_chains_lose_no_pair_within_the_radius():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, (3000, similar.WORDS), dtype=np.uint64)
    flips = (rng.random((3000, similar.WORDS, 64)) < rng.random((3000, 1, 1)) * 0.3).astype(np.uint8)
    b = a ^ np.packbits(flips, axis=2, bitorder="little").view("<u8")[:, :, 0]
    d = np.bitwise_count(a ^ b).astype(int).sum(axis=1)
    assert (similar.within(a, b, 77) == (d <= 77)).all()
    assert 500 < (d <= 77).sum() < 2500


def test_keys_agree_as_often_as_planned():
    rng = np.random.default_rng(5)
    group, symbols, tables = similar.plan(200_000)
    met = []
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        a, b = (similar.keys_of(similar.votes(x)[None], group, symbols, tables)[0] for x in (base[:90], base[10:]))  # 80 of 100
        met.append((a == b).sum())
    assert np.mean(met) >= 0.9 * tables * similar.SAME[group] ** symbols and np.mean(np.array(met) == 0) <= 0.015
    assert len(a) == tables and a.max() < (2 * group) ** symbols
    assert [similar.plan(10**k)[2] for k in (2, 5, 9)] == sorted(similar.plan(10**k)[2] for k in (2, 5, 9))


def test_turning_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((3, 64)).astype(np.float32)
    assert np.allclose((similar._turned(x) ** 2).sum(axis=1), 64 * (x**2).sum(axis=1), rtol=1e-4)
    assert np.allclose(similar._turned(similar._turned(x)), 64 * x, atol=1e-3)


def test_votes_count_bits():
    for n in (0, 1, 254, 255, 256, 700):
        own = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        mixed = [similar.votes(own[k : k + 1]) for k in range(n)]
        assert (similar.votes(own) == (np.sum(mixed, axis=0) if n else 0)).all()


@pytest.mark.parametrize("block", [4096, 6])
def test_similar_documents(spark, make, block):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        w = [f"v{rng.randrange(2000)}" for _ in range(rng.randint(80, 300))]
        rows.append((1000 + i * 20, " ".join(w)))
        for k in range(1, rng.randint(1, 12)):
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 30)):
                v[rng.randrange(len(v))] = "changed"
            rows.append((1000 + i * 20 + k, ("\n" if k % 2 else " ").join(v)))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows), block=block).collect()}
    text = dict(rows)
    met = missed = 0
    for i in text:
        for j in text:
            if i < j:
                s = jaccard(text[i], text[j])
                if s >= 0.8:
                    met += 1
                    missed += got[i] != got[j]
                if i // 20 != j // 20:
                    assert got[i] != got[j]
    assert met > 100 and missed <= met * 0.01
    assert all(v == min(k for k in got if got[k] == v) for v in got.values())
    kept = similar.drop_similar(make(*rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_pairs_are_decided_by_their_shingle_sets(spark, make):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"u{i}x{k}" for k in range(304)]
        v = list(w)
        for k in range(1, rng.choice([6, 7, 8, 9])):
            v[k * 31] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows)).collect()}
    text = dict(rows)
    alike = {i: jaccard(text[2 * i], text[2 * i + 1]) >= 0.8 for i in range(60)}
    linked = {i: got[2 * i] == got[2 * i + 1] for i in range(60)}
    assert 10 < sum(alike.values()) < 50
    assert not any(linked[i] and not alike[i] for i in range(60))
    assert sum(alike[i] and not linked[i] for i in range(60)) <= 1


def test_recall_at_the_threshold(spark, make):
    """Pairs at a similarity of 0.8 to 0.82, texts of all lengths."""
    rng = random.Random(10)
    rows, pairs = [], []
    for i in range(400):
        n = rng.choice([12, 20, 40, 80, 160, 400])
        w = [f"r{i}x{k}" for k in range(n)]
        shingles = n - 4
        more = int(shingles / 0.8 - shingles)  # words put to the end: the least that leave a similarity of 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"more{i}x{k}" for k in range(more)]))]
        pairs.append(i)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows)).collect()}
    text = dict(rows)
    near = [i for i in pairs if jaccard(text[2 * i], text[2 * i + 1]) >= 0.8]
    assert len(near) == len(pairs)
    assert sum(got[2 * i] == got[2 * i + 1] for i in near) >= 0.985 * len(near)
    assert all(got[2 * i] == 2 * i for i in pairs)


def test_one_doc_id_with_several_texts(spark, make):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(5, a), (9, a), (9, b), (12, b), (13, c), (None, c)]
    got = sorted((r["doc_id"], r["component_id"]) for r in similar.similar_documents(make(*rows)).collect())
    assert got == [(5, 5), (9, 5), (9, 5), (12, 5), (13, 13)]
    assert sorted(r["doc_id"] or 0 for r in similar.drop_similar(make(*rows)).collect()) == [0, 5, 13]


def test_refused_edges_stand_for_no_other_pair(spark, make):
    rng = random.Random(9)
    shared = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(80):  # a family at a similarity of some 0.7, within which pairs at some 0.85 hide
        own = shared[:210] + [f"own{i}x{k}" for k in range(45)] if i % 2 == 0 else list(base)
        if i % 2 == 0:
            base = own
        else:
            for _ in range(4):
                own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows)).collect()}
    text = dict(rows)
    true = [(i, j) for i in text for j in text if i < j and jaccard(text[i], text[j]) >= 0.8]
    least = {i: i for i in text}
    for _ in text:
        for i, j in true:
            least[i] = least[j] = min(least[i], least[j])
    assert len(true) > 20 and sum(got[i] != got[j] for i, j in true) <= 1
    assert sum(got[i] != least[i] for i in text) <= 2


def test_odd_rows(spark, make):
    got = similar.similar_documents(make(*ODD)).collect()
    assert len(got) == len(ODD) - 1
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 9)} == {5}
    assert {r["doc_id"] for r in similar.drop_similar(make(*ODD)).collect()} == {None, 1, 4, 5, 7, 8}
    assert similar.drop_similar(make(*ODD)).columns == make(*ODD).columns
    assert similar.similar_documents(make((1, "x")).limit(0)).count() == 0
    assert len(similar.wide_fingerprint(prose(3).encode())) == 8 * similar.WORDS


@pytest.mark.parametrize("shingles", [1, 2, 5, 6, 9, 16])
def test_recall_of_short_texts(spark, make, shingles):
    """Sets of so many shingles against as large ones as have a similarity of 0.8 still, and one too large."""
    rows = []
    for i in range(150):
        w = [f"s{i}x{k}" for k in range(shingles + 4)]
        more = int(shingles / 0.8 + 1e-9) - shingles
        rows += [(4 * i, " ".join(w)), (4 * i + 1, " ".join(w[: len(w)] + [f"m{i}x{k}" for k in range(more)])), (4 * i + 2, " ".join([f"o{i}x{k}" for k in range(more + 1)] + w))]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows)).collect()}
    text = dict(rows)
    for i in range(150):
        for j in (1, 2):
            assert (got[4 * i + j] == 4 * i) == (jaccard(text[4 * i], text[4 * i + j]) >= 0.8 or (j == 2 and jaccard(text[4 * i + 1], text[4 * i + 2]) >= 0.8))


@pytest.mark.parametrize("block", [4096, 64])
def test_small_sets_against_all_pairs(spark, make, block):
    """Families of short texts that share most words, some of them very common."""
    rng, rows = random.Random(12), []
    common = [f"c{k}" for k in range(22)]
    for i in range(300):
        n = rng.randint(1, 20)
        w = common[rng.randrange(3) :][:n] if rng.random() < 0.7 else [f"f{i % 9}x{k}" for k in range(n)]
        rows.append((i, " ".join(w + ([f"tail{i}"] if rng.random() < 0.5 else []))))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(make(*rows), block=block).collect()}
    least = {i: i for i, _ in rows}
    pairs = [(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= 0.8]
    for _ in range(30):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert len(pairs) > 300 and got == least


def test_rows_without_an_id_stay_where_they_are(spark, make):
    from folioform.llm import substring_dedup
    from pyspark.sql import functions as F

    docs = make(*[(None, f"t{i} " * 30) for i in range(400)], (1, "a b c d e f"), (2, "a b c d e f")).repartition(8)
    for out in (similar.drop_similar(docs), substring_dedup.dedup_substrings(docs)):
        where = out.where("doc_id is null").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in where) == 400 and len(where) >= 4 and max(r["count"] for r in where) < 150
