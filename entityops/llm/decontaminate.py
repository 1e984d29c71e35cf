"""Benchmark decontamination by spaced seeds.

A seed is a mask over ``span`` successive words of which some places are ignored, so that a window still
matches after a word at an ignored place was replaced. Windows of all test texts and of all training texts
are hashed under each mask; hashes are joined, and every hit is verified: along the diagonal on which test
and training words line up, the best run of words (match +1, substitution -2) is sought, over the whole of
both texts' common part. A run of ``min_words`` words, or a whole shorter test text, of which at least
``min_identity`` per cent match, is a leak.

Words are runs of bytes other than ASCII white space, compared without case of ASCII letters and without
leading and trailing ASCII punctuation. Null and empty texts, and test texts under eight words, have
no windows and match nothing; neither do items without an id. Documents that repeat are treated row by row,
and results carry ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.llm import words as W

# Fixed masks: 1 is compared, 0 is ignored. Each compares eight words; no two share their pattern of gaps.
MASKS = ("11111111", "1110110111", "1101011010111", "11001010010010111")


@dataclass(frozen=True)
class Match:
    masks: tuple[str, ...] = MASKS
    min_words: int = 13
    min_identity: int = 75
    sketch_bits: int = 25


def _seeds(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, places of windows, their hashes); a window lies within one text."""
    for number, mask in enumerate(masks):
        span = len(mask)
        if len(hashes) < span:
            continue
        at = np.arange(len(hashes) - span + 1)
        at = at[at + span <= first[doc[at] + 1]]
        value = np.full(len(at), 0x51ED27 + number, dtype=np.uint64)
        for offset, used in enumerate(mask):
            if used == "1":
                value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[at + offset]
        yield number, at, W.mix(value)


def _tokens(texts: list[bytes]) -> W.Words:
    return W.split_words([t.lower() for t in texts], strip_punctuation=True)


def test_seeds(benchmark: DataFrame, match: Match, item_id: str, text: str) -> DataFrame:
    """(seed, item, item_at) of every window of the test texts."""

    def run(batches):
        for batch in batches:
            texts = W.text_bytes(batch.column(1))
            for begin, part in W.chunks(texts):
                found = _tokens(part)
                for _, at, value in _seeds(found.hash, found.doc, found.first, match.masks):
                    ids = batch.column(0).take(pa.array(found.doc[at] + begin))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), ids, pa.array((at - found.first[found.doc[at]]).astype(np.int32))], names=["seed", "item", "item_at"]
                    )

    kind = benchmark.schema[item_id].dataType.simpleString()
    return benchmark.select(F.col(item_id), F.col(text)).mapInArrow(run, f"seed long, item {kind}, item_at int")


def _cells(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - bits)
    return (seed >> top).astype(np.int64), ((seed << np.uint64(bits)) >> top).astype(np.int64)


def _sketch(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits in which each test seed sets two: its size does not grow with the tests."""
    cell = F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.shiftrightunsigned(F.shiftleft("seed", bits), 64 - bits)))
    parts = seeds.select(cell.alias("cell")).select(
        F.shiftright("cell", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(cell % 32 as int))").alias("b")
    )
    rows = parts.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return table


def _train_hits(docs: DataFrame, sketch, match: Match, doc_id: str, text: str) -> DataFrame:
    """(doc, row, seeds, places, ids): rows with a window whose hash is in the sketch, and their word hashes."""
    bits, masks = match.sketch_bits, match.masks

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = W.text_bytes(batch.column(1))
            for begin, part in W.chunks(texts):
                found = _tokens(part)
                at_all, seed_all = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, at, value in _seeds(found.hash, found.doc, found.first, masks):
                    hit = np.ones(len(at), dtype=bool)
                    for cell in _cells(value, bits):
                        hit &= (sketch.value[cell >> 5] >> (cell & 31).astype(np.uint32)) & np.uint32(1) == 1
                    at_all.append(at[hit])
                    seed_all.append(value[hit])
                at, seed = np.concatenate(at_all), np.concatenate(seed_all)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                which, low = np.unique(found.doc[at], return_index=True)
                if len(which):
                    bounds = pa.array(np.append(low, len(at)).astype(np.int32))
                    ids = [found.hash[found.first[d] : found.first[d + 1]].tobytes() for d in which]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(which + begin)),
                            pa.array((task << 40) + number + which),
                            pa.ListArray.from_arrays(bounds, pa.array(seed.view(np.int64))),
                            pa.ListArray.from_arrays(bounds, pa.array((at - found.first[found.doc[at]]).astype(np.int32))),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc", "row", "seeds", "places", "ids"],
                    )
                number += len(part)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc {kind}, row long, seeds array<long>, places array<int>, ids binary")


def _best_run(same: np.ndarray) -> tuple[int, int]:
    """The run [begin, end) with the highest sum of +1 for a match and -2 for a substitution; the first of equals."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.argmin(total[: end + 1]))
    return begin, end


def leaks(
    docs: DataFrame, benchmark: DataFrame, match: Match = Match(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", folder: str | None = None
) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, n_words, n_same): verified overlaps, the longest for each pair.

    Places count words from 0. Windows of training texts pass a fixed-size bitmap of the test hashes before
    they are shuffled; the join itself compares full hashes. Only texts with a hit are shuffled.
    """
    from entityops.llm.storage import shared_folder, table

    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    seeds = test_seeds(benchmark, match, item_id, item_text)
    sketch = spark.sparkContext.broadcast(_sketch(seeds, match.sketch_bits))
    hits = table(_train_hits(docs, sketch, match, doc_id, text), "hits", folder)
    pairs = (
        hits.select("doc", "row", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
        .select("row", F.col("x.seeds").alias("seed"), F.col("x.places").alias("at"))
        .join(seeds, "seed")
        .select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("words")).mapInArrow(_item_ids, f"item {kind}, words binary")
    candidates = pairs.join(hits.select("doc", "row", "ids"), "row").join(items, "item")
    schema = "doc_at int, at_item int, n_words int, n_same int"
    min_words, identity = match.min_words, match.min_identity

    @F.pandas_udf(schema)
    def verify(ids, words, shift):
        import pandas as pd

        out = np.zeros((len(ids), 4), dtype=np.int32)
        for i, (a, b, s) in enumerate(zip(ids, words, shift, strict=True)):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            low, high = max(0, -s), min(len(b), len(a) - s)
            begin, end = _best_run(a[low + s : high + s] == b[low:high])
            same = int((a[low + begin + s : low + end + s] == b[low + begin : low + end]).sum())
            if end - begin >= min(min_words, len(b)) and 100 * same >= identity * (end - begin):
                out[i] = (low + begin + s, low + begin, end - begin, same)
        return pd.DataFrame(out, columns=["doc_at", "at_item", "n_words", "n_same"])

    checked = candidates.select("doc", "row", "item", verify("ids", "words", "shift").alias("v")).where("v.n_words > 0")
    best = checked.groupBy("doc", "item").agg(
        F.min_by("v", F.struct(-F.col("v.n_same"), F.col("v.n_words"), F.col("v.doc_at"), F.col("v.at_item"))).alias("v")
    )
    return best.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("v.doc_at").alias("doc_at"),
        F.col("v.at_item").alias("item_at"),
        F.col("v.n_words").alias("n_words"),
        F.col("v.n_same").alias("n_same"),
    )


def _item_ids(batches):
    for batch in batches:
        found = _tokens(W.text_bytes(batch.column(1)))
        rows = [found.hash[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["item", "words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, match: Match = Match(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    found = leaks(docs, benchmark, match, doc_id, text).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, F.col(doc_id) == F.col("_leak"), "left_anti")
