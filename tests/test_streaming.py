"""The streamed position operators against the batch ones."""

from pyspark.sql import functions as F

from slickwatch.operators import positions as pos
from slickwatch.streaming import live

SCHEMA = "ordinal bigint, mmsi string, ts timestamp, lat double, lon double, sog double, cog double"


def test_first_reports_match_batch(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id").alias("ordinal"),
        (F.col("id") % 5).cast("string").alias("mmsi"),
        F.timestamp_seconds(F.lit(1596585600) + F.floor(F.col("id") / 2) * 60).alias("ts"),
        (F.lit(-20.0) + F.floor(F.col("id") / 2) % 3 * 0.1).alias("lat"),
        F.lit(57.0).alias("lon"),
        F.lit(5.0).alias("sog"),
        F.lit(10.0).alias("cog"),
    )
    doubled = df.unionByName(df.filter("ordinal % 4 = 0").withColumn("ordinal", F.col("ordinal") + 1000))
    doubled.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = (
        live.first_reports(stream).writeStream.format("memory").queryName("firsts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    flagged = pos.flag_positions(doubled)
    want = flagged.filter("quality NOT LIKE '%DUPLICATE%'").count()
    assert spark.table("firsts").count() == want < doubled.count()
