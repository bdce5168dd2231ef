"""Folds by neighbourhood against folds over all that was kept."""

import random
import time

from pyspark.sql import functions as F

from folioform.operators import layout as Y


def plain_apart(boxes):
    kept = []
    for b in boxes:
        if not any(all(abs(b[k] - o[k]) <= 0.5 for k in b) for o in kept):
            kept.append(b)
    return [boxes.index(b) for b in kept]


def plain_rows(boxes, least):
    heads, rows = [], []
    for b in boxes:
        def fits(h, b=b):
            shared = min(h["y1"], b["y1"]) - max(h["y0"], b["y0"])
            return shared > 0 and shared / min(h["y1"] - h["y0"], b["y1"] - b["y0"]) >= least
        at = next((k for k, h in enumerate(heads) if fits(h)), len(heads))
        rows.append(at)
        if at == len(heads):
            heads.append(b)
    return rows


def some(rng, n, side):
    out = []
    for _ in range(n):
        x, y = rng.randrange(-4 * side, 4 * side) / 4, rng.randrange(-4 * side, 4 * side) / 4
        out.append({"x0": x, "y0": y, "x1": x + rng.choice([0, 3, 3.25]), "y1": y + rng.choice([0, 0.5, 4, 12, 90])})
    return out


def test_folds_against_plain_ones():
    rng = random.Random(4)
    for n, side in ((0, 5), (200, 4), (200, 60), (400, 15)):
        boxes = [dict(b) for b in some(rng, n, side)]
        assert [boxes[k] for k in Y._apart(boxes)] == [boxes[k] for k in plain_apart(boxes)]
        for least in (0.6, 0.2):
            assert Y._rows_of(boxes, least) == plain_rows(boxes, least)


def test_time_grows_with_the_boxes(spark):
    """10,000 and 40,000 boxes apart on one page: some four times the time, not sixteen."""
    took = []
    for n in (10_000, 40_000):
        boxes = [{"x0": k % 100 * 5.0, "y0": k // 100 * 15.0, "x1": k % 100 * 5.0 + 4, "y1": k // 100 * 15.0 + 11} for k in range(n)]
        began = time.perf_counter()
        assert len(Y._apart(boxes)) == n and max(Y._rows_of(boxes, 0.6)) == n // 100 - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
    page = spark.createDataFrame([(boxes[:10_000],), (None,), ([],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = page.select(F.size(Y.apart_boxes(F.col("b"))).alias("n"), F.array_max(Y.cluster_rows(F.col("b"))).alias("row")).collect()
    assert (got[0]["n"], got[0]["row"], got[2]["n"], got[2]["row"]) == (10_000, 99, 0, None)
