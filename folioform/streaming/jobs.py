"""Streaming forms: work off new jobs once, keep a manifest, stay with the fallback after a failure."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def new_jobs(jobs: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each job (output_name) once; repeats within the watermark are dropped."""
    return jobs.withWatermark(time, late).dropDuplicatesWithinWatermark(["output_name"])


def keep_manifest(jobs: DataFrame, path: str, checkpoint: str):
    """A query that appends each batch of jobs to the manifest, one folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return jobs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


class Sticky(StatefulProcessor):
    """Keeps the failed keys, and nothing of others; a key that no call touches for `idle` milliseconds is forgotten (0: never)."""

    def __init__(self, key: str, order: str, idle: int):
        self.key, self.order, self.idle = key, order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.down = handle.getValueState("down", "down boolean", self.idle or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.down.exists():
            self.down.update((True,))  # touched: its time begins again
            for pdf in rows:
                yield self.routed(pdf, pd.Series("down", pdf.index))
            return
        held = list(rows)  # numbers and flags of one key and one batch: where the first failure lies decides on all of them
        first = min((f[self.order].min() for pdf in held if len(f := pdf[pdf["failed"]])), default=None)
        if first is not None:
            self.down.update((True,))
        for pdf in held:
            routes = pd.Series("first", pdf.index).mask(pdf["failed"] | pdf["unsupported"], "fallback")
            yield self.routed(pdf, routes if first is None else routes.mask(pdf[self.order] > first, "down"))

    def routed(self, pdf: pd.DataFrame, routes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({self.key: pdf[self.key], self.order: pdf[self.order], "route": routes})

    def close(self) -> None:
        pass


def sticky_route(calls: DataFrame, key: str = "user_id", order: str = "event_id", idle: timedelta | None = None) -> DataFrame:
    """(key, order, route) of a stream of calls (key, order, failed boolean, unsupported boolean).

    As operators.translate.route, with the flag kept in the key's state; within a batch calls go in order. A null flag is false, a
    null order comes before any failure. State is kept of keys with a failure alone; with `idle` it goes when a key's last call is
    that long ago, and the key's next call asks the first provider again. Needs a state store with values of several states, as
    spark.sql.streaming.stateStore.providerClass names it (RocksDB's).
    """
    kinds = dict(calls.dtypes)
    flags = [F.coalesce(F.col(k), F.lit(False)).alias(k) for k in ("failed", "unsupported")]
    sticky = Sticky(key, order, int(idle / timedelta(milliseconds=1)) if idle else 0)
    return calls.select(key, order, *flags).groupBy(key).transformWithStateInPandas(sticky, f"{key} {kinds[key]}, {order} {kinds[order]}, route string", "Append", "ProcessingTime" if idle else "None")
