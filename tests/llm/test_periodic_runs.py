"""Periodic runs against plain loops over all periods and starts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from folioform.llm import periodic_runs as R


def brute(words, least=R.LEAST):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    n, k = rng.randrange(0, 90), rng.randrange(1, 4)
    w = [rng.randrange(k) for _ in range(n)]
    if n > 20 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("modulus", [R.MODULUS, 7, 2])
@pytest.mark.parametrize("step", [R.STEP, 17])
def test_runs_against_loops(monkeypatch, modulus, step):
    """Small moduli make prefix hashes collide; small steps part the pairs of one period."""
    monkeypatch.setattr(R, "STEP", step)
    rng = random.Random(modulus + step)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randrange(0, 7))]
        for least in (R.LEAST, 4):
            got = R.runs_of([np.array(t, dtype=np.int32) for t in texts], least, modulus)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, least) for t in texts]


def test_one_word_repeated_and_pieces(monkeypatch):
    assert R.runs_of([np.zeros(30_000, dtype=np.int32)])[0].tolist() == [[0, 30_000, 1]]
    text = b" a  bb\tccc\x0b\x0c" * 40 + b"\xc2\xa0d"
    whole = R.Numbers().of(text)
    monkeypatch.setattr(R, "PIECE", 3)
    assert (R.Numbers().of(text) == whole).all() and len(whole) == 121


def test_operator_on_odd_rows(spark, make):
    long = " ".join(f"w{i}" for i in range(50_000)) + " end end" * 3000
    docs = [(1, "a b c " * 7 + "x"), (2, None), (3, ""), (4, " \n"), (None, "z " * 12), (1, "a b c " * 7 + "x"), (5, long), (6, "é è é " * 9)]
    got = R.periodic_runs(make(*docs)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, text in docs:
        words = (text or "").encode().split()
        if i != 5:
            assert [tuple(x) for x in by[i]["runs"]] == brute(words) and by[i]["n_words"] == len(words)
            assert by[i]["collapsed"] == collapse([w.decode() for w in words], brute(words))
    assert [tuple(x) for x in by[5]["runs"]] == [(50_000, 6000, 1)] and by[5]["collapsed"].endswith("w49999 end")
    assert R.periodic_runs(make(*docs).limit(0)).count() == 0


def test_query_against_loops(spark, data):
    got = {r["doc_id"]: tuple(r)[1:] for r in R.op11_periodic_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        digests = tuple(hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapse(w, runs)))
        assert got[i] == (len(runs), *four, *digests), i
