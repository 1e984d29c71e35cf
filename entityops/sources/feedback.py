"""Feedback logs: stable row ids, append sink and tolerant reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK_SCHEMA = (
    "feedbackId string, createdAt string, reviewId string, rating string, comment string, countryCode string, trustScore int, "
    "trustBand string, mode string, trigger string, connectorIds array<string>, _corrupt string"
)


def feedback_rows(entries: DataFrame, key: list[str], created_at: Column) -> DataFrame:
    """Entries with an id and a UTC stamp.

    The id is made from the entry's own key, so a retried task writes the same id again instead of a
    new one.
    """
    digest = F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in key]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return entries.select(
        F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts]).alias("feedbackId"),
        F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("createdAt"), "*",
    )


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def stream_feedback(rows: DataFrame, path: str, checkpoint: str):
    """The same sink for a stream; exactly once through the sink's own log."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback rows with a declared schema; blank and malformed lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", FEEDBACK_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("f")).where("f._corrupt IS NULL").select("f.*").drop("_corrupt")
