"""The subpackage's queries on the small tables, against their SQL where there is some; the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

from folioform.llm.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    source = {"op1_embedding_dedup": "embeddings", "op2_url_filter": "pages", "op12_html_extraction": "pages", "op13_conversation_repair": "(SELECT DISTINCT conv_id FROM conversations)"}
    assert len(rows) == duck.execute(f"SELECT count(*) FROM {source.get(name, 'documents')}").fetchone()[0]
    if name in SQL:
        res = duck.execute(SQL[name])
        columns = [c[0] for c in res.description]
        assert sorted(tuple(r[c] for c in columns) for r in df.select(*columns).fillna("").collect()) == sorted(tuple("" if v is None else v for v in r) for r in res.fetchall())


def test_decontamination_on_the_tables(spark, data, duck):
    from folioform.llm import decontamination as D

    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"]) for r in QUERIES["op8_decontamination"](spark, data).collect()}
    grams = {}
    for k, t in items:
        w = D.words(t.encode())
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(k)
    import hashlib

    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        w, hit, found = D.words(text.encode()), set(), set()
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in grams:
                hit |= set(range(i, i + 10))
                found |= grams[tuple(w[i : i + 10])]
        assert got[doc] == (len(w), len(hit), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, data)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before, name
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            from folioform.llm.common import checkpointed

            docs = checkpointed(docs)
        if k < 3:
            assert len(after) == len(set(after)) <= seen[-1] and len(after) > seen[-1] // 2
        seen.append(len(after))
    assert seen[-1] == seen[-2]
    assert P.run(spark, data).count() == seen[-1]
    from folioform.llm.common import checkpoint_folder

    left = [p.name for p in Path(checkpoint_folder(spark).removeprefix("file:")).glob("pipeline-*/*")]
    assert left and all(x.startswith("3-") for x in left)


CLASHES = ("size", "score", "root", "node", "key", "own", "words", "starts", "rows", "tag", "shard", "slot", "hash", "part", "n", "label", "text2")


def _folder(spark, path, docs):
    """Tables for the pipeline with these documents and columns whose names its stages use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.select("*", *[F.lit("clash").alias(k) for k in CLASHES]).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 1), (7, None, None), (7, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven"), (None, None), (2, ""), (2, "!!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _good(i, n=60):
    import random

    rng = random.Random(i)
    return " ".join(f"word{rng.randrange(3000)}" for _ in range(n))


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs = [(i, _good(i) if i % 4 else "#### $$$$ !!!! " * 20, "en", "ab"[i % 2], 1) for i in range(300)]
    odd = [(None, _good(1000), "en", "a", 1), (None, _good(1000), "en", "a", 1), (None, None, None, None, None), (1001, None, "en", "a", None), (1002, "", "en", None, 0), (1003, " \n", "en", "b", 3)]
    odd += [(1004, _good(1004), "en", "a", 1), (1004, _good(1004), "en", "a", 1), (1004, _good(1005), "en", "b", 1), (1006, _good(1004), "en", "a", 1)]
    odd += [(1007, "prefix One two, THREE four five six seven eight nine ten. " + _good(1007), "en", "a", 1), (1008, _good(1008, 30_000), "en", None, 1), (1009, "é" * 3000, "xx", "a", 1)]
    d = _folder(spark, tmp_path / "odd", docs + odd)
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = now.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = now.select("doc_id", "text").collect()
        now = stage(spark, now, d)
        if k < 4:
            assert now.columns == columns, name
            now.write.parquet(f"{d}/{name}")
            now = spark.read.parquet(f"{d}/{name}")
        kept[name] = now
        if k < 3:
            assert {tuple(r) for r in now.select("doc_id", "text").collect()} <= {tuple(r) for r in before}
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in kept.items()}
    assert not {i for i in ids["quality"] if i is not None and i < 300 and i % 4 == 0} and len([i for i in ids["quality"] if i and i < 300]) > 200
    assert ids["near_duplicates"].count(None) == ids["quality"].count(None) and 1006 not in ids["near_duplicates"]
    assert ids["near_duplicates"].count(1004) == ids["quality"].count(1004)
    assert (1007 in ids["near_duplicates"]) and 1007 not in ids["decontamination"] and len(ids["near_duplicates"]) - len(ids["decontamination"]) == 1
    slots = {}
    for r in kept["sharding"].collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == len(ids["mixing"])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    assert P.run(spark, _folder(spark, tmp_path / "empty", [])).count() == 0
