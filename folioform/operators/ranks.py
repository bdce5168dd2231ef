"""Order statistics of groups of any size: no group is sorted or held anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.runs import checkpointed

#: Distinct values of a group from which its middle ones are picked at last, and ranges that a group's values are counted in till then.
MIDDLE, RANGES = 4096, 64


def group_join(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of totals, an aggregate of them by keys; nulls are equal.

    A hash of the keys is one more join key: the rows of a hot key are dealt out anew for the join, so that the engine can split them.
    """
    held = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    match = F.xxhash64(*keys) == F.xxhash64(*[f"__{k}" for k in keys])
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(held, match, how).drop(*[f"__{k}" for k in keys])


def _found(sums: Column, below: Column, rank: Column, field: str) -> Column:
    """struct<at, before> of the first of sums (ordered struct<field, n>) that reaches a rank, counted from 0, and what lies before it."""
    start = F.struct(below.alias("sum"), F.lit(None).cast("struct<at: double, before: bigint>").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["sum"] + x["n"]
        hit = F.when(acc["hit"].isNull() & (now > rank), F.struct(x[field].cast("double").alias("at"), acc["sum"].alias("before"))).otherwise(acc["hit"])
        return F.struct(now.alias("sum"), hit.alias("hit"))

    return F.aggregate(sums, start, step, lambda acc: acc["hit"])


def medians(rows: DataFrame, keys: list[str], value: str, middle: int = MIDDLE) -> DataFrame:
    """(keys, n, least, median) of each group's values as doubles, exactly; nulls count for nothing, a group of nulls has no row.

    Equal values go as one with a count. As long as a group has more than `middle` distinct ones, its values are counted in RANGES ranges
    cut at approximate quantiles, and only those of the ranges that hold its middle ranks stay: each round leaves about a thirty-second.
    Cuts decide on what is counted together, never on the result.
    """
    held = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    widest = lambda groups: groups.agg(F.max("__distinct")).first()[0] or 0
    total, most = None, widest(held.groupBy(*keys).agg(F.count("*").alias("__distinct")))
    if most > middle:
        held = checkpointed(held)
        total = held.groupBy(*keys).agg(F.sum("__c").alias("n"), F.min("__v").alias("least"))
        total = checkpointed(total.withColumn("__below", F.lit(0).cast("long")))
    while most > middle:
        cuts = held.groupBy(*keys).agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
        ranged = group_join(held, cuts, keys).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
        sums = ranged.groupBy(*keys, "__r").agg(F.sum("__c").alias("n"))
        sums = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "n"))).alias("__sums"))  # RANGES at most
        both = group_join(total, sums, keys)
        low, high = (_found(F.col("__sums"), F.col("__below"), rank, "__r") for rank in (first, last))
        near = both.withColumn("__low", low).withColumn("__high", high).select(*keys, "n", "least", F.col("__low.at").alias("__from"), F.col("__high.at").alias("__to"), F.col("__low.before").alias("__below"))
        held = checkpointed(group_join(ranged, near.select(*keys, "__from", "__to"), keys).where(F.col("__r").between(F.col("__from"), F.col("__to"))).select(*keys, "__v", "__c"))
        left = held.groupBy(*keys).agg(F.count("*").alias("__distinct"))
        total, most = checkpointed(near.drop("__from", "__to")), widest(left)
    values = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__v", F.col("__c").alias("n")))).alias("__values"))  # `middle` at most
    low, high = (_found(F.col("__values"), F.col("__below"), rank, "__v")["at"] for rank in (first, last))
    if total is None:
        all_ = F.aggregate("__values", F.lit(0).cast("long"), lambda n, x: n + x["n"])
        whole = values.select("*", all_.alias("n"), F.get("__values", F.lit(0))["__v"].alias("least"), F.lit(0).cast("long").alias("__below"))
    else:
        whole = group_join(total, values, keys)
    return whole.select(*keys, "n", "least", ((low + high) / 2).alias("median"))
