"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets.

Only DataFrame functions. Documents get a keyed random key, are sorted by (source, key) in ranges, and their
token counts are summed up along that order: within each range by a window, before it by the totals of the
ranges. A source that holds a third of all rows is cut into many ranges like any other stretch of the order.
Each source's budget is cut exactly: every document is taken as often as whole epochs fit, and the first
documents of the order once more until the rest of the budget is used; the last of them in part.

What is sorted are ids, sources, sizes and keys; texts are read once. Nothing is collected but one row.
Repeated rows (equal id, source and size) are counted first and dealt one after the other at the end. A null
text has no words; a null source is a source of its own, the last one; null ids are dealt by their sizes.
An empty table, and sources without a word, get targets of 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entityops.llm.storage import shared_folder, table

# Fixed value: the white space between words.
_WHITE = " \t\n\x0b\x0c\r"
_WIDE = "decimal(38,0)"  # products of sizes and weights


@dataclass(frozen=True)
class Mix:
    """``weights`` go round over the sources in code point order; together they get ``share_percent`` of all sizes.

    No source gets more than ``epochs`` times its size. ``seed`` fixes the order of the documents.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    epochs: int = 2
    seed: str = "mix"


def n_words(text: Column) -> Column:
    """Number of words: pieces between white space that are not empty."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _WHITE, " " * len(_WHITE)), " "), "")).cast("long")


def running(df: DataFrame, order: list[str], sums: dict[str, str], folder: str, name: str) -> DataFrame:
    """``df`` with, for each ``sums`` item (new column -> column), its sum over all rows before in ``order``.

    Rows are sorted into ranges, which are written; sums run inside the ranges, and the totals of earlier
    ranges are added. There are as many totals as ranges. Rows that tie in ``order`` get sums in any order.
    """
    placed = table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name, folder)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_WIDE)
    totals = placed.groupBy("_range").agg(*[F.sum(F.col(c).cast(_WIDE)).alias(f"_all_{k}") for k, c in sums.items()])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(before), zero).alias(f"_start_{k}") for k in sums])
    within = placed.select("*", *[F.coalesce(F.sum(F.col(c).cast(_WIDE)).over(inside), zero).alias(f"_in_{k}") for k, c in sums.items()])
    joined = within.join(starts, "_range")
    return joined.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_start_{k}")).cast(_WIDE).alias(k) for k in sums])


def source_targets(sizes: DataFrame, mix: Mix, folder: str) -> DataFrame:
    """(_none, _source, source_size, target, budget, offset) of every source.

    sizes: _none, _source, size, n. Shares above ``epochs`` times a source's size are cut there, and what is left
    is shared by weight among the others. In the order of size over weight the cut sources come first, so that
    sums along that order tell who is cut and what one unit of weight gets in the end. ``offset`` is the size of
    all sources before. All sums are whole numbers; only the target is rounded, once.
    """
    sources = sizes.groupBy("_none", "_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running(sources, ["_none", "_source"], {"_rank": "_one", "offset": "source_size"}, folder, "sources")
    weight = F.get(F.array(*[F.lit(w) for w in mix.weights]), (F.col("_rank") % len(mix.weights)).cast("int")).cast(_WIDE)
    ranked = ranked.withColumn("weight", weight).withColumn("_level", (F.col("source_size").cast(_WIDE) * math.lcm(*mix.weights) / F.col("weight")).cast(_WIDE))
    levelled = running(ranked, ["_level", "_none", "_source"], {"_size_before": "source_size", "_weight_before": "weight"}, folder, "levels")
    levelled = table(levelled, "levelled", folder)
    all_ = levelled.agg(F.sum(F.col("source_size").cast(_WIDE)).alias("size"), F.sum("weight").alias("weight")).first()
    whole = F.lit(mix.share_percent * int(all_["size"] or 0)).cast(_WIDE)
    left = whole - F.col("_size_before") * (100 * mix.epochs)
    weight_left = F.lit(int(all_["weight"] or 0)).cast(_WIDE) - F.col("_weight_before")
    cut = F.col("source_size").cast(_WIDE) * (100 * mix.epochs) * weight_left <= left * F.col("weight")
    levelled = levelled.withColumn("_cut", cut)
    open_ = ~F.col("_cut")
    rest = levelled.agg(
        F.sum(F.when(~open_, F.col("source_size").cast(_WIDE))).alias("size"), F.sum(F.when(open_, F.col("weight"))).alias("weight")
    ).first()
    shared = F.lit(mix.share_percent * int(all_["size"] or 0) - 100 * mix.epochs * int(rest["size"] or 0)).cast(_WIDE) * F.col("weight")
    unit = 100 * int(rest["weight"] or 1)
    levelled = levelled.withColumn("_shared", shared).withColumn("_unit", F.lit(unit).cast(_WIDE))
    most = (F.col("source_size") * mix.epochs).cast("long")
    return levelled.select(
        "_none",
        "_source",
        "source_size",
        F.when(open_, F.col("_shared").cast("double") / F.lit(float(unit))).otherwise(most.cast("double")).alias("target"),
        F.when(open_, F.expr("_shared div _unit")).otherwise(most).alias("budget"),
        "offset",
    )


def mix_plan(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words the mix takes of each row, repeats counted."""
    folder = shared_folder(docs.sparkSession)
    origin = F.col(source).cast("string")
    rows = docs.select(F.col(doc_id).alias("_id"), origin.isNull().alias("_none"), F.coalesce(origin, F.lit("")).alias("_source"), n_words(F.col(text)).alias("size"))
    sizes = table(rows.groupBy("_id", "_none", "_source", "size").agg(F.count("*").alias("n")), "sizes", folder)
    targets = table(source_targets(sizes, mix, folder), "targets", folder)
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    keyed = sizes.withColumn("_key", key).withColumn("_words", F.col("size") * F.col("n"))
    placed = running(keyed, ["_none", "_source", "_key", "_id", "size"], {"_before": "_words"}, folder, "order")
    joined = placed.join(targets, ["_none", "_source"])
    # copies one after the other, in runs of 1024
    copies = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1024))).alias("_run"))
    copies = copies.select("*", F.explode(F.sequence(F.col("_run") * 1024, F.least(F.col("n"), F.col("_run") * 1024 + 1024) - 1)).alias("_copy"))
    copies = copies.withColumn("_from", (F.col("_before") - F.col("offset") + F.col("_copy") * F.col("size")).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    copies = copies.withColumn("_epochs", epochs.cast("long"))
    rest = F.col("budget") - F.col("_epochs") * F.col("source_size") - F.col("_from")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return copies.select(
        F.col("_id").alias(doc_id), F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken")
    )


def mixed_texts(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: ``docs`` with ``epoch``, one row for each time a document is taken, and its text cut to the words taken.

    Needs ids that tell the rows apart: rows without an id are left out, rows that share one are taken alike.
    """
    names = [c for c in docs.columns if c != "epoch"]
    wanted = plan.where(F.col("taken") > 0).groupBy(F.col(doc_id).alias("_id"), F.col("size").alias("_size")).agg(F.max("taken").alias("_taken"))
    packed = docs.select(F.struct(*names).alias("_all"), F.col(doc_id).alias("_id"), n_words(F.col(text)).alias("_size"), F.col(text).alias("_text"))
    times = packed.join(wanted, ["_id", "_size"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_taken") / F.col("_size")) - 1)).alias("_epoch"))
    left = F.least(F.col("_size"), F.col("_taken") - F.col("_epoch") * F.col("_size"))
    words = F.filter(F.split(F.translate("_text", _WHITE, " " * len(_WHITE)), " "), lambda w: w != "")
    cut = F.when(left == F.col("_size"), F.col("_text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return times.select(*[cut.alias(c) if c == text else F.col("_all")[c].alias(c) for c in names], F.col("_epoch").alias("epoch"))
