"""Session settings shared by every job, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings an already running session may still change. They never lower what
# the cluster configured: partition counts and memory stay the cluster's choice.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a given session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "slickwatch", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SLICKWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``; only when a session names
    none (a test on one machine) is a temporary one made. A checkpoint there
    outlives the executors that wrote it, which ``localCheckpoint`` would not.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
            "spark.checkpoint.dir"
        )
        context.setCheckpointDir(named or _own_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all tasks of a shuffle.

    For much work a row on a table so small when packed that one task reads it; the
    number is named, so that adaptive execution does not put the rows together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, which only a local master can share."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files all executors must see.

    Below the shared folder named by ``spark.checkpoint.dir`` where there is
    one, else a temporary folder on this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _own_folder(spark, name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    For wide intermediate tables read several times: like a checkpoint it cuts
    the lineage and outlives executors, and readers get columns on demand.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
