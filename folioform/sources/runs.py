"""Output folders that several runs write to, each run's rows counting all at once or not at all.

A run writes its tables under an id of its own, <folder>/<table>/run=<id>, and is published last, by one file that is renamed into
<folder>/_published. Readers take the rows of published runs only, so what a run that died has left is never seen, and the next run does
that work again. Ids sort by time; where runs wrote the same output, the last published one counts.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Runs:
    """Tables of a folder, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def new(self) -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def place(self, table: str, run: str) -> str:
        return f"{self.folder}/{table}/run={run}"

    def put(self, rows: DataFrame, table: str, run: str) -> DataFrame:
        """Writes rows as the run's share of a table and gives them back as they lie there; written again they replace themselves."""
        rows.write.mode("overwrite").parquet(self.place(table, run))
        return self.spark.read.schema(rows.schema).parquet(self.place(table, run))

    def _names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.store.listStatus(at)) if self.store.exists(at) else []

    def published(self) -> list[str]:
        """Ids of the runs that count, in order of time."""
        return [n for n in self._names(f"{self.folder}/_published") if not n.startswith((".", "_"))]

    def publish(self, run: str) -> None:
        """From now on the run's rows count. The file is complete before it is renamed, and renaming is one step of the store."""
        held = self.path(f"{self.folder}/_published/_{run}")
        self.store.create(held, True).close()
        if not self.store.rename(held, self.path(f"{self.folder}/_published/{run}")):
            raise OSError(f"the run {run} cannot be published in {self.folder}")

    def read(self, table: str) -> DataFrame | None:
        """Rows of a table from published runs, with their run; None where there are none."""
        runs = set(self.published())
        places = [f"{self.folder}/{table}/{n}" for n in self._names(f"{self.folder}/{table}") if n.removeprefix("run=") in runs]
        if not places:
            return None
        # Tables may have gained columns from run to run.
        return self.spark.read.option("basePath", f"{self.folder}/{table}").option("mergeSchema", "true").parquet(*places).withColumn("run", F.col("run").cast("string"))

    def last(self, table: str, key: str) -> DataFrame | None:
        """The rows of each key from the last published run that wrote it."""
        rows = self.read(table)
        if rows is None:
            return None
        newest = rows.groupBy(F.col(key).alias("__key")).agg(F.max("run").alias("__run"))
        return rows.join(newest, F.col(key).eqNullSafe(F.col("__key")) & (F.col("run") == F.col("__run"))).drop("__key", "__run")

    def sweep(self) -> list[str]:
        """Removes what unpublished runs have left in all tables, and returns their ids. No other run may be at work."""
        runs, gone = set(self.published()), set()
        for table in self._names(self.folder):
            for name in self._names(f"{self.folder}/{table}") if not table.startswith("_p") else []:
                run = name.removeprefix("run=")
                if name.startswith("run=") and run not in runs:
                    self.store.delete(self.path(f"{self.folder}/{table}/{name}"), True)
                    gone.add(run)
        return sorted(gone)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the session's spark.checkpoint.dir; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/folders"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the session's checkpoint folder, or to one below shared_folder() where none is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
