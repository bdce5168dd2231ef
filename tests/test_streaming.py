"""Routes of streamed calls against the batch form, and what becomes of their state."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from folioform.operators import translate as R
from folioform.streaming.jobs import sticky_route

pytest.importorskip("google.protobuf")  # Spark's own state client needs it
SCHEMA = "user_id long, event_id long, failed boolean, unsupported boolean"


@pytest.fixture
def routed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(batches, idle=None, pause=0.0):
        """Routes by event of batches of calls, and the rows of state after each batch; the stream starts again for each."""
        (tmp_path / "in").mkdir()
        kept = []
        for k, rows in enumerate(batches):
            if k:
                time.sleep(pause)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            out = sticky_route(stream, idle=idle).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            q = out.trigger(once=True).start()
            ended = q.awaitTermination(40)
            q.stop()
            assert ended
            kept.append(next(p.stateOperators[0].numRowsTotal for p in reversed(q.recentProgress) if p.numInputRows))
        return {r["event_id"]: r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}, kept

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streamed_routes_are_those_of_a_batch(spark, routed):
    rows = [(u, 100 * b + e, (u * 7 + e * 3 + b) % 11 == 0, (u + e) % 5 == 0) for b in range(3) for u in range(12) for e in range(8)]
    got, kept = routed([[r for r in rows if r[1] // 100 == b][::-1] for b in range(3)])
    want = R.route(spark.createDataFrame(rows, SCHEMA).withColumn("event", F.col("event_id")), "user_id", "event_id", F.col("failed"), F.col("unsupported"))
    per_user = {}
    for u, e, failed, unsupported in sorted(rows):
        route = "down" if per_user.get(u) is not None and e > per_user[u] else "fallback" if failed or unsupported else "first"
        per_user[u] = per_user[u] if per_user.get(u) is not None else e if failed else None
        per_user.setdefault(("got", e), []).append(route)
    told = {}
    for r in want.collect():
        told.setdefault(r["event_id"], []).append(r["route"])
    assert {e: sorted(x) for e, x in told.items()} == {e[1]: sorted(x) for e, x in per_user.items() if isinstance(e, tuple)}
    assert set(got) == set(told) and all(got[e] in told[e] for e in got)
    assert kept == [len({u for u, e, failed, _ in rows if failed and e < 100 * (b + 1)}) for b in range(3)]


def test_state_of_idle_keys_goes(routed):
    calls = [[(1, 1, True, False), (2, 2, False, False)], [(3, 3, False, False)], [(1, 4, False, False), (1, 5, True, False)]]
    got, kept = routed(calls, idle=timedelta(seconds=1), pause=2.0)
    assert got == {1: "fallback", 2: "first", 3: "first", 4: "first", 5: "fallback"}
    assert kept == [1, 0, 1]


def test_calls_keep_a_key_down(routed):
    calls = [[(1, 1, True, False)], [(1, 2, False, False)], [(1, 3, False, True)]]
    got, _ = routed(calls, idle=timedelta(minutes=5))
    assert got == {1: "fallback", 2: "down", 3: "down"}


def test_missing_flags_and_orders(routed):
    got, _ = routed([[(1, None, None, None), (1, 2, True, None), (None, 3, False, False), (1, 4, None, None)]])
    assert got == {None: "first", 2: "fallback", 3: "first", 4: "down"}
