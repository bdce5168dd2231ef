"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words. A document's expected number of copies is its source's target over its source's size; the
whole part is taken for certain and the fraction is a copy probability. Within hash buckets of a source, documents are paired in
turn and probability mass (weighted by their sizes, so that the expected words stay the same) is moved at random from one to the
other until one of the two is integral. A bucket ends with at most one fractional document; these residuals are combined in the
same way by a tree of further rounds, a fixed fan-in at a time, until a source has one, which is rounded by its own probability.
So a source's taken words differ from its target by less than one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, joined_back, repeated, running_totals, table

#: Rows that one task rounds at a time, and residuals that one task combines.
FAN_IN = 2048
#: A source's words are taken this often at most.
MOST_COPIES = 3
SEED = 20240229


def pivotal(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Round p (0 to 1) to integers in order, keeping sum(p * size) until one entry is left; (rounded p, its index or -1).

    coin[i] in [0, 1) decides the step that brings in entry i. Each entry's expectation is kept.
    """
    p, size, coin = p.tolist(), size.tolist(), coin.tolist()
    held = -1
    for i, x in enumerate(p):
        if not 0.0 < x < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], x
        up = min((1.0 - a) * size[held], b * size[i])  # words that can move to the held entry
        down = min(a * size[held], (1.0 - b) * size[i])  # or from it
        if coin[i] * (up + down) < down:
            if (1.0 - a) * size[held] <= b * size[i]:
                p[held], p[i] = 1.0, b - up / size[i]
                held, other = i, held
            else:
                p[held], p[i], other = a + up / size[held], 0.0, i
        elif a * size[held] <= (1.0 - b) * size[i]:
            p[held], p[i] = 0.0, b + down / size[i]
            held, other = i, held
        else:
            p[held], p[i], other = a - down / size[held], 1.0, i
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held] = float(round(p[held]))
            held = -1
    return np.array(p), held


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size).

    By code point of their names, null last, sources weigh 1, 2, 3, 1, ...; together the targets are the sum of all sizes, and
    none is above MOST_COPIES times its source's size: what is cut off goes to the others by weight, round after round. That comes
    to a level of words for each unit of weight, above which sources are cut: in the order of size by weight, the first source that
    the level of those after the ones before it leaves whole.
    """
    order = F.col("source").asc_nulls_last()
    s = running_totals(sizes.select("source", "n", "source_size"), [order], {"rank": F.lit(1).cast("long")})
    cap = F.col("source_size") * F.lit(MOST_COPIES)
    s = checkpointed(s.select("source", "n", "source_size", (F.col("rank") % 3 + 1).alias("weight"), cap.alias("cap")))
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - F.col("cut")) / (F.lit(weights) - F.col("passed"))
    ratio = F.col("cap") / F.col("weight")
    s = running_totals(s.withColumn("ratio", ratio), [F.col("ratio"), order], {"cut": F.col("cap"), "passed": F.col("weight")})
    s = checkpointed(s.withColumn("level", F.when(F.col("passed") < weights, level)))
    found = s.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "passed"))).first()[0] or 0.0
    return s.select("source", "n", "source_size", F.least(F.col("weight") * F.lit(float(found)), F.col("cap").cast("double")).alias("target"))


def _round(last: bool):
    """One step of the reduction: rounds a bucket's rows; at the last step the one left over too, by its own probability."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["coin", "doc_id", "size", "tag"], kind="stable").reset_index(drop=True)
        u = (pdf["coin"].to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
        p, held = pivotal(pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(float), u)
        if held >= 0 and last:
            p[held] = float((u[held] * 2654435761.0) % 1.0 < p[held])
            held = -1
        return pdf.assign(p=p, left=np.arange(len(pdf)) == held)

    return combine


def _size(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _tag(text: str = "text"):
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _taken(docs: DataFrame, seed: int) -> DataFrame:
    """(no_id, doc_id, source, size, tag, rows, source_size, target, copies, more): each of the equal rows is taken `copies` times, and
    `more` of them once more. doc_id is 0 where it is null.

    Equal rows go as one: n rows with the fraction p are n * p of them for certain and one with what is left, as pairing equal rows
    would leave it.
    """
    rows = docs.select("doc_id", "source", _size().alias("size"), _tag().alias("tag")).groupBy("doc_id", "source", "size", "tag").agg(F.count("*").alias("rows"))
    rows = checkpointed(rows)
    sources = checkpointed(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))))
    most = sources.agg(F.max("n")).first()[0] or 0
    s = sources.select(F.col("source").alias("source2"), "source_size", "target", F.ceil(F.col("n") / FAN_IN).alias("buckets"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.when(F.col("size") > 0, (share - F.floor(share)) * F.col("rows")).otherwise(0.0)
    coin = F.xxhash64(F.lit(seed), "doc_id", "size", "tag")
    # The number of sources says nothing about the size of one: a hot one is split where it meets its own totals.
    left = joined_back(rows.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()), s.withColumn("named2", F.coalesce("source2", F.lit(""))).withColumn("no_source2", F.col("source2").isNull()), [("named", "named2"), ("no_source", "no_source2")]).select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "source", "size", "tag", "rows", "source_size", "target",
        F.floor(share).alias("copies"), F.floor(part).alias("more"), (part - F.floor(part)).alias("p"), coin.alias("coin"), F.pmod(F.shiftright(coin, 20), F.col("buckets")).alias("bucket"),
    )
    schema = left.schema.simpleString()[len("struct<") : -1] + ",left:boolean"
    buckets, done = max(1, -(-most // FAN_IN)), []
    while True:
        last = buckets == 1
        out = checkpointed(left.groupBy("source", "bucket").applyInPandas(_round(last), schema))
        done.append(out.where("not left").drop("left"))
        if last:
            break
        left = out.where("left").drop("left").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets = -(-buckets // FAN_IN)
    every = done[0]
    for x in done[1:]:
        every = every.union(x)
    return every.select("no_id", "doc_id", "source", "size", "tag", "rows", "source_size", "target", "copies", (F.col("more") + F.col("p").cast("long")).alias("more"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    Reruns agree: coins are hashes of the seed and the row, and rounding goes in the order of these within buckets that depend
    on them alone. A null or blank text has size 0 and is taken 0 times its words; a null source is a source of its own, the
    last; a null or repeated doc_id is a row like any other (equal rows are interchangeable); an empty table gives no rows;
    other columns are ignored.
    """
    rows = repeated(_taken(docs, seed), "rows")
    copies = F.col("copies") + (F.col("nth") < F.col("more")).cast("long")
    return rows.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents' rows as often as mix takes them (0 to MOST_COPIES times); columns as in docs.

    Rows are told apart by doc_id, source and text. Where these are equal some of the rows are taken once more than others, so that a
    source keeps its target.
    """
    taken = _taken(docs, seed).select(F.struct("no_id", "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "tag").alias("__of"), F.col("rows").alias("__rows"), F.col("copies").alias("__copies"), F.col("more").alias("__more"))
    taken = checkpointed(taken)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), _tag().alias("tag"))
    each = docs.withColumn("__key", own).join(taken.where("__copies > 0 or __more > 0"), F.col("__key") == F.col("__of"))
    again = lambda rows, n: rows.where(n > 0).withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    out = again(each.where("__rows = 1"), F.col("__copies") + F.col("__more")).select(docs.columns)
    if taken.where("__rows > 1").isEmpty():
        return out
    # Equal rows are numbered where they lie; a place's first number follows from the counts of those before it.
    equal = checkpointed(each.where("__rows > 1").drop("__of").withColumn("__place", F.spark_partition_id()))
    counts = equal.groupBy(F.col("__key").alias("__of"), F.col("__place").alias("__at")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__of").orderBy("__at")) - F.col("__n")).drop("__n")
    nth = F.row_number().over(Window.partitionBy("__key", "__place").orderBy("__place")) - 1 + F.col("__before")
    numbered = joined_back(equal, counts, [("__key", "__of"), ("__place", "__at")]).withColumn("__nth", nth)
    return out.union(again(numbered, F.col("__copies") + (F.col("__nth") < F.col("__more")).cast("long")).select(docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
