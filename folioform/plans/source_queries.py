"""Queries over written files: documents through their data source, outputs of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, office
from ..sources.runs import Runs, shared_folder
from .registry import query, table


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """(path, part, para, run, text): conversations as the runs of Word files, one a turn, longer turns in two."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    halves = F.when(F.length("text") > 40, F.array(F.substring("text", 1, 20), F.substring("text", 21, 1 << 30))).otherwise(F.array("text"))
    return c.select(F.format_string("c%d.docx", "conv_id").alias("path"), F.lit(files.BODY).alias("part"), F.col("turn").cast("int").alias("para"), F.posexplode(halves).alias("run", "text"))


@query("""
WITH r AS (SELECT conv_id, turn, unnest(CASE WHEN length(text) > 40 THEN [0, 1] ELSE [0] END) AS run, text FROM conversations),
t AS (SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS para, run, CASE WHEN length(text) <= 40 THEN text WHEN run = 0 THEN substr(text, 1, 20) ELSE substr(text, 21) END AS text FROM r)
SELECT conv_id::BIGINT AS conv_id, para::INTEGER AS para, run::INTEGER AS run, sha256(text) AS text FROM t WHERE regexp_matches(text, '[^\\s]')
""")
def office_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as Word files, which appear together, and read again as runs, many files to a task."""
    office.register(spark)
    folder = shared_folder(spark)
    made = files.new_documents(_conversations(spark, d)).select(F.col("path").alias("name"), "content")
    made.write.format("folioform-files").mode("append").save(folder)
    runs = spark.read.format("folioform-office").load(folder)
    return runs.select(F.regexp_extract("path", r"c(-?\d+)\.docx$", 1).cast("long").alias("conv_id"), "para", "run", F.sha2("text", 256).alias("text"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END::INTEGER AS run_no, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END::DOUBLE AS price FROM orders
""")
def published_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as outputs of three runs: the second is never published, the third replaces every third output."""
    runs = Runs(spark, shared_folder(spark))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    shares = [o, o.withColumn("price", F.lit(0.0)), o.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") * 2)]
    for k, rows in enumerate(shares):
        own = runs.new()
        runs.put(rows.withColumn("run_no", F.lit(k + 1)), "out", own)
        if k != 1:
            runs.publish(own)
    return runs.last("out", "o_orderkey").select("o_orderkey", "run_no", "price")
