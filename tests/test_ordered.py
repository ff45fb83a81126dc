"""Ordered carry over range partitions against a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slickwatch.operators import ordered


def reports(spark, n, hot):
    """Keys and order with ties, null keys, and payloads that are mostly null."""
    key = F.when(F.rand(3) < hot, F.lit("hot")).otherwise(F.when(F.col("id") % 17 == 3, None).otherwise((F.col("id") % 23).cast("string")))
    return spark.range(0, n, 1, 7).select(
        "id", key.alias("k"), (F.col("id") % 3).alias("j"), (F.col("id") * 7919 % 1009).alias("t"),
        F.when(F.hash("id") % 11 == 0, F.struct(F.col("id").alias("at"), F.timestamp_seconds(F.col("id")).alias("ts"))).alias("p"),
    )


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(("n", "hot", "keys"), [(5000, 0.7, ["k"]), (5000, 1.0, ["k"]), (3000, 0.0, ["k", "j"]), (40, 0.5, ["k"])])
def test_carry_against_a_window(spark, n, hot, keys, inclusive):
    df = reports(spark, n, hot)
    got = ordered.carry_forward(df, keys, ["t", "id"], F.col("p"), out="q", inclusive=inclusive)
    assert got.columns == [*df.columns, "q"]
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("q", F.last("p", ignorenulls=True).over(w))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_empty(spark):
    df = reports(spark, 10, 0.5).limit(0)
    assert ordered.carry_forward(df, ["k"], ["t"], F.col("p")).count() == 0


def test_hot_key_is_many_tasks(spark):
    """One exchange, by range; a key with all rows lies over all tasks and no payload is lost between them."""
    df = spark.range(0, 100_000, 1, 6).select(F.lit("hot").alias("k"), "id", F.when(F.col("id") == 0, F.struct("id")).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.carry_forward(df, ["k"], ["id"], F.col("p"))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 50_000
    assert got.filter("prev.id = 0").count() == 99_999
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # the one exchange lies before the checkpoint
