"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A setting of our own, since a running session refuses a new ``spark.checkpoint.dir``.
LOCAL_FOLDER = "entityops.local.folder"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="entityops-shared-")
        spark.conf.set(LOCAL_FOLDER, root)
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends here and survives lost executors."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
