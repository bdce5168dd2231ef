"""Medians of large groups, boxes that meet, nearest boxes: against plain loops, and by how many rows are compared."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from folioform.operators import boxes, layout, ranks


def test_median_of_one_group_of_all_rows(spark):
    """100,000 distinct values of one key: narrowed in rounds, no window, exact; rows of the key come back from several tasks."""
    rows = spark.range(100_000, numPartitions=8).select(F.lit(1).alias("key"), ((F.col("id") * 7919) % 300_007 / 8.0).alias("font_size"))
    want = statistics.median((k * 7919) % 300_007 / 8.0 for k in range(100_000))
    got = ranks.medians(rows, ["key"], "font_size", middle=50).collect()
    assert [(r["n"], r["median"]) for r in got] == [(100_000, want)]
    out = layout.harmonize(rows, [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "harmonized" in plan
    assert out.where(F.col("font_size") > F.round(F.lit(want * 0.85), 2)).where("harmonized = font_size").count() == 0


@pytest.mark.parametrize("middle", [3, 64, 4096])
def test_medians_against_plain_ones(spark, middle):
    rng, rows = random.Random(middle), []
    for g in [None, *range(12)]:
        n = rng.choice([0, 1, 2, 3, 10, 501, 1000])
        spread = rng.choice([3, 40, 10**6])
        rows += [(g, rng.randrange(spread) * 10.0 ** rng.choice([-200, 0, 200])) for _ in range(n)] + [(g, None)] * rng.randrange(3)
    df = spark.createDataFrame(rows, "key int, v double")
    got = {r["key"]: (r["n"], r["least"], r["median"]) for r in ranks.medians(df, ["key"], "v", middle).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got == {g: (len(v), min(v), statistics.median(v)) for g, v in values.items()}
    assert ranks.medians(df.limit(0), ["key"], "v").count() == 0


def some_boxes(rng, n, side):
    out = []
    for k in range(n):
        w, h = (rng.choice([2, 10, 40, 400]), rng.choice([2, 8, 200])) if rng.random() < 0.2 else (12, 6)
        x, y = rng.randrange(-20, side), rng.randrange(-20, side)
        out.append((k % 3, 0, k, float(x), float(y), float(x + w), float(y + h), rng.choice([4.0, 10.0])))
    return out


BOXES = "doc_id long, page_index int, block_id int, x0 double, y0 double, x1 double, y1 double, font_size double"


def test_meeting_against_all_pairs(spark):
    rng = random.Random(2)
    a, b = some_boxes(rng, 150, 300), some_boxes(rng, 150, 300)
    met = boxes.meeting(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), layout.PAGE).select("block_id", "o_block_id").collect()
    want = [(p[2], q[2]) for p in a for q in b if p[0] == q[0] and p[3] <= q[5] and q[3] <= p[5] and p[4] <= q[6] and q[4] <= p[6]]
    assert sorted(map(tuple, met)) == sorted(want) and len(want) > 50


@pytest.mark.parametrize(("n", "side"), [(40, 300), (300, 300), (300, 4000)])
def test_room_against_all_pairs(spark, n, side):
    rng = random.Random(n + side)
    own = some_boxes(rng, n, side)
    df = spark.createDataFrame(own, BOXES)
    below = {r["block_id"]: r["vertical_limit"] for r in layout.room_below(df, df).collect()}
    beside = {r["block_id"]: (r["left_limit"], r["right_limit"]) for r in layout.room_beside(df, df).collect()}
    same = lambda p, q: all(abs(p[k] - q[k]) <= 0.5 for k in range(3, 7))
    cut = lambda p, q, a, b: max(0.0, min(p[b], q[b]) - max(p[a], q[a]))
    for p in own:
        others = [q for q in own if q[0] == p[0] and not same(p, q)]
        under = [q[4] - 1 for q in others if q[4] > p[4] + max(4.0, p[7] * 0.6) and cut(p, q, 3, 5) > 0.3 * min(p[5] - p[3], q[5] - q[3])]
        row = [q for q in others if cut(p, q, 4, 6) > 0.5]
        left = max([q[5] + 2 for q in row if q[5] <= p[3]], default=2.0)
        right = min([q[3] - 2 for q in row if q[5] > p[3] and q[3] >= p[5]], default=600.0)
        assert below[p[2]] == max(p[4] + 10, min(840.0, min(under, default=842.0)))
        assert beside[p[2]] == (max(2.0, left), min(598.0, right))


def test_many_boxes_on_one_page(spark):
    """20,000 boxes on one page: compared are those of the same cells, not 400 million pairs."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("block_id"), (F.col("id") % 100 * 12.0).alias("x0"), (F.floor(F.col("id") / 100) * 8.0).alias("y0"))
    df = df.withColumn("x1", F.col("x0") + 10.0).withColumn("y1", F.col("y0") + 6.0).withColumn("font_size", F.lit(6.0))
    below = layout.room_below(df, df, 5000.0)
    assert below.count() == 20_000
    got = {r["block_id"]: r["vertical_limit"] for r in below.where("block_id % 997 = 0").collect()}
    assert all(v == (max(k // 100 * 8.0 + 10, (k // 100 + 1) * 8.0 - 1) if k < 19_900 else 4998.0) for k, v in got.items())
    assert boxes.meeting(df, df, layout.PAGE).count() == 20_000
    assert layout.room_beside(df, df, 2000.0).where("left_limit = 2.0").count() == 200


@pytest.mark.parametrize("room", [layout.room_beside, layout.room_below])
def test_crowded_pages_and_others_as_one(spark, monkeypatch, room):
    """Pages with few obstacles in one join, the others by cells: the same limits wherever the border between them lies."""
    rng = random.Random(8)
    rows = [(None if doc == 4 else doc, *r[1:]) for doc, n in enumerate((3, 40, 90, 1, 25)) for r in some_boxes(rng, n, 200)]
    b = spark.createDataFrame(rows, BOXES)
    obstacles = b.where("doc_id is null or doc_id <> 3")
    got = {}
    for small in (0, 30, 1000):
        monkeypatch.setattr(boxes, "SMALL", small)
        got[small] = sorted(map(repr, room(b, obstacles).collect()))
    assert got[0] == got[30] == got[1000] and len(got[0]) == len(rows)


def test_pages_of_few_boxes_meet_in_one_join(spark):
    b = spark.createDataFrame(some_boxes(random.Random(9), 60, 200), BOXES)
    plan = layout.room_beside(b, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
