"""Thread rows joined by (thread, chunk): equal results, a hot thread in many tasks."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import scan
from threadlens.operators.schema import THREAD
from threadlens.operators.scan import attach


@pytest.mark.parametrize("chunk_rows", [1, 3, 1 << 14])
def test_same_as_a_join_on_the_thread(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(scan, "CHUNK_ROWS", chunk_rows)
    rows = spark.createDataFrame([("c", t, i) for t, n in enumerate([1, 2, 3, 10]) for i in range(n)] + [("d", 0, 0)], "corpus string, thread_id long, row_idx long")
    one = rows.where("corpus = 'c'").groupBy(*THREAD).agg(F.max("row_idx").alias("last_row")).withColumn("v", F.col("thread_id") * 7)
    got = {(r.corpus, r.thread_id, r.row_idx): r.v for r in attach(rows, one, THREAD).collect()}
    assert got == {(r.corpus, r.thread_id, r.row_idx): None if r.corpus == "d" else r.thread_id * 7 for r in rows.collect()}


def test_a_hot_thread_is_spread_without_runtime_replanning(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_ROWS", 100)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select(F.lit("c").alias("corpus"), F.lit(5).cast("long").alias("thread_id"), F.col("id").alias("row_idx"))
        one = spark.createDataFrame([("c", 5, 19_999, "text")], "corpus string, thread_id long, last_row long, v string")
        sizes = [r[1] for r in attach(rows, one, THREAD).groupBy(F.spark_partition_id()).count().collect()]
        got = attach(rows, one, THREAD)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_chunk" in plan and "BroadcastNestedLoopJoin" not in plan
        parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert sum(r["count"] for r in parts) == 20_000 == sum(sizes)
        assert len(parts) > 10 and max(r["count"] for r in parts) < 5_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
