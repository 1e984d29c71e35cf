"""From raw documents to token ids: rules, duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops.llm import byte_bpe, decontaminate, jaccard_join, privacy, quality_rules
from entityops.llm.queries import DEMO_KEY, byte_vocabulary
from entityops.llm.storage import remove, shared_folder, table


def _with_text(docs: DataFrame, names: list[str], text) -> DataFrame:
    """The columns ``names`` with a new text and, where it is among them, its length in code points."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source repeat."""
    judged = quality_rules.apply_rules(docs).where("kept")
    return _with_text(judged, docs.columns, F.col("clean_text"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 per cent of the shingles of five words alike."""
    return jaccard_join.one_of_each(docs, jaccard_join.Join(width=5, percent=80))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return _with_text(privacy.replace_entities(docs, DEMO_KEY), docs.columns, F.col("text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and of the bytes that they decode to."""
    encoded = byte_bpe.encode(docs, byte_vocabulary(), decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("PII surrogates", privacy_stage),
    ("byte-level BPE", token_stage),
]

#: Surrogates and merges are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage-{number}", folder)
        if number:
            remove(spark, f"{folder}/stage-{number - 1}")  # read for the last time
    return docs
