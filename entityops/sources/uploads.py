"""Verdicts on uploaded files by size and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops import constants as C


def mime_of(content: Column) -> Column:
    """Type by signature, null when none matches."""
    head = F.hex(F.substring(content, 1, 8))
    out = F
    for signature, mime in C.SIGNATURES:
        out = out.when(head.startswith(signature), F.lit(mime))
    return out.otherwise(F.lit(None).cast("string"))


def upload_verdict(content: Column, size: Column, max_bytes: int = C.MAX_UPLOAD_BYTES, allowed: list[str] | None = None) -> Column:
    """struct<status, mime>: 400 empty, 413 too large, 415 unknown or not allowed, else 200; in this order."""
    mime = mime_of(content)
    legal = mime.isin(*([m for _, m in C.SIGNATURES] if allowed is None else allowed))
    status = (
        F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > max_bytes, 413).when(~F.coalesce(legal, F.lit(False)), 415).otherwise(200)
    )
    return F.struct(status.alias("status"), F.when(status == 200, mime).alias("mime"))


def upload_scan(
    spark: SparkSession, path: str, max_bytes: int = C.MAX_UPLOAD_BYTES, allowed: list[str] | None = None, manifest: DataFrame | None = None
) -> DataFrame:
    """Verdict for every file below ``path``.

    Spark's file sources leave out files of zero bytes; with a ``manifest`` (path) of what was uploaded
    they are reported too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The source pushes a filter on length down and lists sizes without reading; only small files are read.
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    verdict = upload_verdict(F.col("content"), F.col("length"), max_bytes, allowed)
    found = small.unionByName(large).select("path", "length", verdict.alias("v")).select("path", "length", "v.status", "v.mime")
    if manifest is None:
        return found
    return manifest.select("path").join(found, "path", "left").select(
        "path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("status", F.lit(400)).alias("status"), "mime"
    )
