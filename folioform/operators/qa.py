"""Counters, quality flags and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def segment_stats(done: DataFrame, key: str) -> DataFrame:
    """(key, total, translated, rejected, calls) from rows (key, state, calls)."""
    return done.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "translated").alias("translated"), F.count_if(F.col("state") == "rejected").alias("rejected"), F.sum("calls").cast("long").alias("calls"))


def html_stats(nodes: DataFrame, key: str) -> DataFrame:
    """(key, nodes_translated, nodes_skipped, nodes_retried, nodes_rejected, api_calls) from one row a text node.

    Rows are (key, applied, retried, rejected booleans, calls); every node that no translation was put into counts as skipped.
    """
    applied = F.count_if("applied")
    return nodes.groupBy(key).agg(
        applied.alias("nodes_translated"), (F.count("*") - applied).alias("nodes_skipped"), F.count_if("retried").alias("nodes_retried"), F.count_if("rejected").alias("nodes_rejected"), F.sum("calls").cast("long").alias("api_calls")
    )


def direct_stats(blocks: DataFrame, key: str) -> DataFrame:
    """One row a document from blocks (key, status 'fit', 'unplaced' or 'skipped', retried, rejected, calls, residual booleans and ints).

    blocks_truncated and blocks_dropped are always 0.
    """
    total, fit = F.count("*"), F.count_if(F.col("status") == "fit")
    return blocks.groupBy(key).agg(
        total.alias("blocks_total"), fit.alias("blocks_translated"), (total - fit).alias("blocks_skipped"), F.count_if("retried").alias("blocks_retried"), F.count_if("rejected").alias("blocks_rejected"),
        F.sum("calls").cast("long").alias("api_calls"), F.count_if(F.col("status") == "unplaced").alias("blocks_unplaced"), F.count_if("residual").alias("blocks_residual_source"),
        F.lit(0).cast("long").alias("blocks_truncated"), F.lit(0).cast("long").alias("blocks_dropped"),
    )


def quality_flags(stats: Column) -> Column:
    """array<string> of the labels of defects that a JSON stats sidecar counts; empty for a missing or malformed one."""
    counted = [F.try_variant_get(F.try_parse_json(stats), f"$.{k}", "int") for k in fixed.DEFECTS]
    return F.array_compact(F.array(*[F.when(c > 0, F.lit(v)) for c, v in zip(counted, fixed.DEFECTS.values())]))


def sidecar(stats: DataFrame, kind: str) -> Column:
    """The JSON of a stats row, with its kind."""
    return F.to_json(F.struct(*[F.col(c) for c in stats.columns], F.lit(kind).alias("stats_kind")))


def run_summary(jobs: DataFrame) -> DataFrame:
    """One row of counts over jobs (status, flags)."""
    has = lambda c: F.count_if(c)
    status = F.col("status")
    return jobs.agg(
        F.count("*").alias("jobs"), has(status == "translated").alias("translated"), has(status == "copied_source_language").alias("copied"), has(F.startswith(status, F.lit("skipped"))).alias("skipped"),
        has(status == "failed").alias("failed"), has(F.size("flags") > 0).alias("flagged"),
    )


def script_chars(c: Column, first: int, last: int) -> Column:
    return T.times(c, rf"[\x{{{first:x}}}-\x{{{last:x}}}]")


def token_hits(c: Column, wanted: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"), F.lit(0))
    return F.size(F.filter(found, lambda t: t.isin(*wanted)))


def bounding_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("members"))


def image_stats(regions: DataFrame, key: str) -> DataFrame:
    """(key, image_regions_processed, image_blocks_translated, image_blocks_rejected, api_calls) from one row a recognised block.

    Rows are (key, region, placed, rejected, calls); blocks that did not fit count as neither.
    """
    return regions.groupBy(key).agg(
        F.countDistinct("region").alias("image_regions_processed"), F.count_if("placed").alias("image_blocks_translated"), F.count_if("rejected").alias("image_blocks_rejected"), F.sum("calls").cast("long").alias("api_calls")
    )
