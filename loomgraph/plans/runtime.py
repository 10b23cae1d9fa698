"""Session set-up, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix=f"loomgraph-{os.getpid()}-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and continue from the files (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def within_bytes(df: DataFrame, limit: int) -> bool:
    """True if the optimizer's size estimate of ``df`` is a proven bound below ``limit`` bytes.

    For file scans the estimate comes from file sizes; for unknown plans Spark
    assumes a huge size, so the answer errs towards not broadcasting.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint only when the size estimate stays under ``limit``; otherwise a shuffle join is planned."""
    return F.broadcast(df) if within_bytes(df, limit) else df
