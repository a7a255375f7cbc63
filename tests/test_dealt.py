"""What a task of the orders' queries gets."""

from pyspark.sql import functions as F

from lanewise.operators.overview import overview
from lanewise.operators.scan import TASK_ROWS, dealt
from lanewise.sources import adapters
from lanewise.sources.adapters import orders_trace


def test_tasks_follow_the_rows(spark):
    df = spark.range(5_000).withColumn("k", F.col("id") % 1_000)
    assert dealt(df, "k", 100).rdd.getNumPartitions() == 50
    assert dealt(df, "k").rdd.getNumPartitions() == df.rdd.getNumPartitions() and 5_000 < TASK_ROWS


def test_lines_keep_their_tasks_through_windows(spark, sf, monkeypatch):
    want = sorted(map(str, orders_trace(spark, sf).stages.collect()))
    monkeypatch.setattr(adapters, "dealt", lambda df, key: dealt(df, key, 500))
    stages = orders_trace(spark, sf).stages
    assert "REPARTITION_BY_NUM" in stages._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, stages.collect())) == want


def test_stages_are_not_dealt_by_name(spark, sf):
    plan = overview(orders_trace(spark, sf), 64, 64)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(trace" in line and "name" in line.split("hashpartitioning(")[1].split(")")[0]]


def test_cells_are_aggregated_by_hashing(spark, sf):
    plan = overview(orders_trace(spark, sf), 64, 64)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
