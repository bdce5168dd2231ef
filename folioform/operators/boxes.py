"""Boxes of a page that meet, and the nearest box on a side, by cells of the page.

A page (any keys) is cut into cells as large as its boxes are on average, a few times over; a box lies in all cells it touches, and boxes
are compared within a cell only. So rows compared grow with the boxes that are near each other, not with the square of a page's boxes.
Sizes of cells are worked out from sums of whole numbers, which come out the same whatever the order in which rows are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.runs import checkpointed
from .ranks import group_join

#: A cell is so many average boxes wide and high; a strip so many wide, a band so many high.
CELL, STRIP, BAND = 2, 2, 8
#: How many times higher the bands of the next round are, for boxes without another one in the last round's.
GROWTH = 16

#: Obstacles of a page that each of its blocks is compared with, at most; the boxes of pages with more are compared by cells.
SMALL = 128

_EDGES = ("x0", "y0", "x1", "y1")


def _average(rows: DataFrame, keys: list[str], sizes: dict[str, Column]) -> DataFrame:
    """(keys, names of sizes): averages, 1 at least, that do not depend on the order of rows."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(*[F.greatest(F.sum(F.ceil(F.greatest(c, F.lit(0.0)))) / n, F.lit(1.0)).alias(k) for k, c in sizes.items()])


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(F.greatest(low, high) / size))


def meeting(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of a box of a and a box of b of the same page that overlap or touch, once: a's columns, and b's with o_ before their names.

    Boxes have x0, y0, x1, y1, none of them null. A pair is reported by the cell in which its common part begins.
    """
    sized = a.select(*keys, *_EDGES).unionByName(b.select(*keys, *_EDGES))
    sizes = _average(sized, keys, {"__w": (F.col("x1") - F.col("x0")) * CELL, "__h": (F.col("y1") - F.col("y0")) * CELL})

    def dealt(rows: DataFrame) -> DataFrame:
        held = group_join(rows, sizes, keys)
        held = held.withColumn("__i", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("__w"))))
        return held.withColumn("__j", F.explode(_cells(F.col("y0"), F.col("y1"), F.col("__h"))))

    one, two = dealt(a), dealt(b)
    two = two.select(*[F.col(c).alias(f"o_{c}") for c in two.columns])
    match = (F.col("__i") == F.col("o___i")) & (F.col("__j") == F.col("o___j"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    for k, j, size in (("x", "__i", "__w"), ("y", "__j", "__h")):
        match = match & (F.col(f"{k}0") <= F.col(f"o_{k}1")) & (F.col(f"o_{k}0") <= F.col(f"{k}1")) & (F.col(j) == F.floor(F.greatest(f"{k}0", f"o_{k}0") / F.col(size)))
    met = one.join(two, match)
    return met.select(*a.columns, *[f"o_{c}" for c in b.columns])


def nearest(blocks: DataFrame, obstacles: DataFrame, keys: list[str], ids: list[str], meets: Column) -> DataFrame:
    """(keys, ids, near) of every block: the least `at` of the page's obstacles from the block's `since` on whose side meets the block's.

    blocks have since, side0, side1; obstacles at, side0, side1, and in `meets` and the joined rows all of their columns have o_ before
    their names. near is null where there is none. Pages are cut into strips along the sides and into bands along `at`. A block looks
    through the rest of its band and the next one; where nothing is found, through bands that are GROWTH times as high, until these are
    as high as the page. ids tell a page's blocks apart.
    """
    sized = blocks.select(*keys, "side0", "side1", F.lit(None).cast("double").alias("at")).unionByName(obstacles.select(*keys, "side0", "side1", "at"))
    width = F.sum(F.ceil(F.greatest((F.col("side1") - F.col("side0")) * STRIP, F.lit(0.0)))) / F.count("*")
    # Bands as high as hold some boxes of every strip, were they spread evenly. A page without an obstacle has no row.
    height = (F.max("at") - F.min("at")) * BAND / F.sqrt(F.count("at"))
    sizes = sized.groupBy(*keys).agg(F.greatest(width, F.lit(1.0)).alias("__w"), F.greatest(height, F.lit(1.0)).alias("__h"), (F.max("at") - F.min("at")).alias("__reach")).where("__reach is not null")
    sizes = checkpointed(sizes)  # one row a page, read by both sides
    most = sizes.agg(F.max(F.col("__reach") / F.col("__h"))).first()[0] or 0.0
    rounds = 1 + math.ceil(math.log(max(most, 1.0), GROWTH))
    held = group_join(blocks, sizes.select(*keys, "__w", "__h"), keys, "left").withColumn("near", F.lit(None).cast("double"))
    others = group_join(obstacles, sizes.select(*keys, "__w", "__h"), keys).withColumn("__strip", F.explode(_cells(F.col("side0"), F.col("side1"), F.col("__w"))))
    others = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns])
    for k in range(rounds):
        height, last = F.col("__h") * float(GROWTH**k), k == rounds - 1
        # The last round takes what is left as one band: no box lies beyond.
        band = F.lit(0).cast("long") if last else F.floor(F.col("since") / height)
        own = F.when(F.col("near").isNull() & F.col("__w").isNotNull(), _cells(F.col("side0"), F.col("side1"), F.col("__w")))
        asked = held.withColumn("__strip", F.explode_outer(own))
        asked = asked.withColumn("__band", F.when(F.col("__strip").isNotNull(), band) if last else F.explode_outer(F.when(F.col("__strip").isNotNull(), F.array(band, band + 1))))
        o_band = F.lit(0).cast("long") if last else F.floor(F.col("o_at") / (F.col("o___h") * float(GROWTH**k)))
        there = others.withColumn("o___band", o_band)
        match = (F.col("__strip") == F.col("o___strip")) & (F.col("__band") == F.col("o___band"))
        for c in keys:
            match = match & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        match = match & (F.col("o_at") >= F.col("since")) & meets
        found = asked.join(there, match, "left")
        carried = [c for c in held.columns if c not in (*keys, *ids, "near")]
        held = found.groupBy(*keys, *ids).agg(*[F.first(c).alias(c) for c in carried], F.coalesce(F.min("o_at"), F.first("near")).alias("near"))
    return held.select(*keys, *ids, "near")


def by_crowd(blocks: DataFrame, obstacles: DataFrame, keys: list[str], few: Callable[[DataFrame, DataFrame], DataFrame], many: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """few(blocks, obstacles) of the pages with SMALL obstacles at most and many(blocks, obstacles) of the others, as one."""
    crowded = checkpointed(obstacles.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SMALL))
    if crowded.isEmpty():
        return few(blocks, obstacles)
    part = lambda rows, there: group_join(rows, crowded, keys, "left").where(F.col("__n").isNotNull() if there else F.col("__n").isNull()).drop("__n")
    return few(part(blocks, False), part(obstacles, False)).unionByName(many(part(blocks, True), part(obstacles, True)))


def compared(blocks: DataFrame, obstacles: DataFrame, keys: list[str], ids: list[str], meets: Column, least: dict[str, Column]) -> DataFrame:
    """(keys, ids, names of least) of every block: the least of each column over the page's obstacles that meet it, whose columns have o_
    before their names. For pages with few obstacles."""
    others = obstacles.select(*[F.col(c).alias(f"o_{c}") for c in obstacles.columns])
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    found = blocks.join(others, meets, "left")
    return found.groupBy(*keys, *ids).agg(*[F.min(c).alias(name) for name, c in least.items()])
