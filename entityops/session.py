"""Session helpers: a local session for tests and benchmarks, and lineage cutting on shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session; on a cluster use the session the cluster hands out."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("entityops")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="entityops-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there afterwards.

    Used where one narrow intermediate feeds several branches of a plan, so that the wide scan (or
    an Arrow UDF) behind it runs once and survives the loss of executors.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
