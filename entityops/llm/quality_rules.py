"""Quality rules: word statistics of every text and lines that many documents of one host repeat.

Only DataFrame functions. No step moves a text: statistics stay with the row, and what is shuffled are
line hashes with their counts. Rows with equal id, host and text are one document; they get equal results.
A null text or host counts as an empty one; a text without a word fails the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_WHITE_CLASS = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Limits:
    """Limits of the rules.

    A line is frequent if more than ``line_documents`` documents of its host hold it, whatever the size of the host
    (and, where it is asked for, more than ``line_percent`` per cent of them). The document with the smallest id keeps it, so that no line
    leaves the host for good. A document is depleted if fewer than ``min_words`` words or less than
    ``min_left_percent`` per cent of them remain after a removal.
    """

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    line_documents: int = 10
    line_percent: int = 0
    min_left_percent: int = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE_CLASS), lambda w: w != "")


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, _WHITE_CLASS, " ")))


def word_statistics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A window is a run of ``window`` words. Equal windows are found by sorting their 64-bit hashes together
    with their places; texts whose window hashes are all different skip that. Each intermediate is used
    more than once by the next step, so that Catalyst keeps it as a column instead of repeating it.
    """
    names = docs.columns
    value = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns(
        {
            "_words": _words(value),
            "_lines": F.filter(F.split(value, "\n"), lambda line: F.length(_without(line, WHITE)) > 0),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(_without(value, WHITE)).cast("long"),
            "n_symbols": (F.length(value) - F.length(_without(value, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(
                F.size("_words") >= window,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    sorted_, size = F.col("_sorted"), F.size("_sorted")
    twice = F.filter(
        "_sorted",
        lambda x, k: ((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get(sorted_, k + 1)["h"] == x["h"])),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(-window).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + window).alias("end"), (acc["n"] + F.least(F.lit(window), i + window - acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    # A generator of one row: no filter on the statistics moves below it, where it would repeat the steps.
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    return step.select(*names, F.inline(F.array(found)))


def _row_key(doc_id: Column, host: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(host.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(_id, _host, _row, at, _h, _w): every line with a word, as hashes: id, host, row, place, host and line, words."""
    source = F.coalesce(F.col(host).cast("string"), F.lit(""))
    lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(_normal_line(x).alias("line"), F.size(_words(x)).alias("w"))
    )
    return (
        docs.select(F.col(doc_id).alias("_id"), source.alias("_source"), _row_key(F.col(doc_id), F.col(host), F.col(text)).alias("_row"), F.posexplode(lines).alias("at", "x"))
        .where("x.line <> ''")
        .select("_id", F.xxhash64("_source").alias("_host"), "_row", "at", F.xxhash64("_source", "x.line").alias("_h"), F.col("x.w").alias("_w"))
    )


def frequent_lines(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(_h, _owner): hashes of host and line above the limits, and the smallest id that holds each.

    Documents are counted by id: copies of a row count once, equal texts under two ids count twice.
    Counts are partial aggregates, so a line that a third of all documents hold loads no single task.
    """
    held = _lines(docs, doc_id, text, host).groupBy("_h", "_host", "_id").agg(F.lit(1).alias("one"))
    counts = held.groupBy("_h", "_host").agg(F.count("*").alias("n"), F.min("_id").alias("_owner")).where(F.col("n") > limits.line_documents)
    if not limits.line_percent:
        return counts.select("_h", "_owner")
    ids = docs.select(F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("_host"), F.col(doc_id).alias("_id"))
    hosts = ids.groupBy("_host", "_id").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count("*").alias("total"))
    return counts.join(hosts, "_host").where(F.col("n") * 100 > F.col("total") * limits.line_percent).select("_h", "_owner")


def _removed(docs: DataFrame, limits: Limits, doc_id: str, text: str, host: str) -> DataFrame:
    """(_row, gone, gone_lines): words that a document loses, and the hashes of the lines that go."""
    lines = _lines(docs, doc_id, text, host).drop("_host")
    hit = lines.join(frequent_lines(docs, limits, doc_id, text, host), "_h").where(~F.col("_id").eqNullSafe(F.col("_owner")))
    once = hit.groupBy("_row", "at", "_h").agg(F.max("_w").alias("w"))
    return once.groupBy("_row").agg(F.sum("w").alias("gone"), F.collect_set("_h").alias("gone_lines"))


def apply_rules(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``kept``, ``n_line_words`` and ``clean_text``.

    ``n_line_words`` are the words in removed lines; ``clean_text`` is the text without these lines.
    """
    names = [c for c in docs.columns if c not in RESULT_COLUMNS]
    keep = F.struct(*[F.col(c) for c in names])
    packed = docs.select(keep.alias("_all"), F.col(doc_id).alias("_id"), F.col(host).alias("_source"), F.col(text).alias("_text"))
    measured = word_statistics(packed, "_text", limits.window).withColumn("_row", _row_key(F.col("_id"), F.col("_source"), F.col("_text")))
    joined = measured.join(_removed(docs, limits, doc_id, text, host), "_row", "left")
    gone = F.coalesce("gone", F.lit(0))
    left = F.col("n_words") - gone
    base_failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.repeat_percent)
    depleted = (gone > 0) & ((left < limits.min_words) | (left * 100 < F.col("n_words") * limits.min_left_percent))
    source = F.coalesce(F.col("_source").cast("string"), F.lit(""))
    clean = F.when(
        gone > 0,
        F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("gone_lines", F.xxhash64(source, _normal_line(x)))), "\n"),
    ).otherwise(F.col("_text"))
    return joined.select(
        "_all.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"),
        gone.alias("n_line_words"),
        clean.alias("clean_text"),
    )


RESULT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words", "clean_text")
