"""Token ids on disk: one compressed frame for each document, with a shared dictionary and an offset index.

A store is a folder with two Parquet tables. ``dictionary`` holds the zstandard dictionary, trained on
serialized id arrays, its SHA-256, and the width of an id. ``blocks`` holds runs of documents in ascending
doc_id order: the frames of a block one after the other, and for each of them doc_id, number of ids and
offset; and the number of ids before the block in its shard, the dictionary's hash, and the smallest and
largest doc_id, by which a reader of few documents skips the other blocks. A frame is one document's ids,
the end id included, as little-endian integers of that width, compressed for itself with the dictionary.

Null texts count as empty and hold the end id only. Documents without an id come first; rows with equal ids
stay all, ordered by their frames.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entityops.llm.words import slices


@dataclass(frozen=True)
class Format:
    """``sample`` documents with at most ``sample_ids`` successive ids each train the dictionary of ``dictionary_bytes``."""

    tokenizer: str
    end_id: int = 1
    sample: int = 2000
    sample_ids: int = 2048
    dictionary_bytes: int = 64 << 10
    level: int = 3
    block_bytes: int = 1 << 20


#: Words with their ids that one Python process remembers; beyond it forgets all and begins anew.
_MOST_WORDS = 900_000
_TAIL = string.punctuation.replace("'", "")
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str):
    """(tokenizer, width of an id, remembered words, whether an id ends a word) of this process."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        ends = np.zeros(found.get_vocab_size(), dtype=bool)
        ends[[i for word, i in found.get_vocab().items() if word.endswith("</w>")]] = True
        _TOKENIZERS[path] = (found, 2 if found.get_vocab_size() <= 1 << 16 else 4, {}, ends)
    return _TOKENIZERS[path]


def _remember(known: dict[str, bytes], words: list[str], data: bytes, bounds: np.ndarray) -> None:
    places = bounds.tolist()
    known.update(zip(words, (data[a:b] for a, b in zip(places, places[1:])), strict=True))


def _serialized(texts: list[str], path: str, end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as bytes.

    The tokenizer drops white space and never merges across it, so texts are cut at blanks and line feeds and
    each different piece is encoded once while it is remembered. It also ignores case: ASCII letters are
    lowered first.
    """
    tokenizer, width, known, ends = _tokenizer(path)
    pieces = [t.encode().lower().decode().replace("\n", " ").split(" ") for t in texts]
    values = [list(map(known.get, p)) for p in pieces]
    new = {w for p, found in zip(pieces, values, strict=True) if None in found for w, v in zip(p, found, strict=True) if v is None}
    if len(known) + len(new) > _MOST_WORDS:
        known.clear()  # the ids of known words are in ``values``; single words may be needed again
    # Behind a letter or digit, punctuation without an apostrophe is always a token of its own.
    tails = {w: w[len(c) :] for w in new if not w[-1:].isalnum() and (c := w.rstrip(_TAIL)) and len(c) < len(w) and c[-1].isalnum()}
    plain = {w[: -len(t)] for w, t in tails.items()}.union(tails.values(), new.difference(tails)) - known.keys()
    letters = [w for w in plain if w.isalpha()]
    parts = [letters[low : low + 2000] for low in range(0, len(letters), 2000)]
    others = list(plain.difference(letters))
    for part, found in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
        ids = np.array(found.ids, dtype=f"<u{width}")
        bounds = np.concatenate(([0], np.flatnonzero(ends[ids]) + 1)) * width
        if len(bounds) == len(part) + 1:
            _remember(known, part, ids.tobytes(), bounds)
        else:  # a word of letters that its normal form splits
            others += part
    for low in range(0, len(others), 2000):
        part = others[low : low + 2000]
        found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        bounds = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part) + 1)) * width
        _remember(known, part, np.array(found.ids, dtype=f"<u{width}").tobytes(), bounds)
    known.update((w, known[w[: -len(t)]] + known[t]) for w, t in tails.items())
    end = np.array([end_id], dtype=f"<u{width}").tobytes()
    out = []
    for words, found in zip(pieces, values, strict=True):
        if None in found:
            found = [known[w] if v is None else v for w, v in zip(words, found, strict=True)]
        found.append(end)
        out.append(b"".join(found))
    return out


def train_dictionary(docs: DataFrame, form: Format, doc_id: str, text: str) -> bytes:
    """A dictionary from a bounded sample: the documents whose ids hash lowest, a piece of each chosen by its id."""
    chosen = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(form.sample)
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("_chosen")).select(F.xxhash64(doc_id).alias("h"), F.col(text))
    path, end_id, most = form.tokenizer, form.end_id, form.sample_ids

    def run(batches):
        for batch in slices(batches, 1):
            width = _tokenizer(path)[1]
            data = _serialized([t or "" for t in batch.column(1).to_pylist()], path, end_id)
            size = most * width
            pieces = [d[(h % max(1, len(d) // size)) * size :][:size] for d, h in zip(data, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.binary())], names=["h", "piece"])

    samples = [r["piece"] for r in sorted(rows.mapInArrow(run, "h long, piece binary").collect())]
    try:
        return zstandard.train_dictionary(form.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(samples)[-form.dictionary_bytes :]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write(docs: DataFrame, path: str, form: Format, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Write the store of ``docs`` to ``path``.

    Ranges of doc_id with about equal numbers of rows become shards; texts are encoded and compressed where
    they are read, and only frames are shuffled.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = train_dictionary(docs, form, doc_id, text)
    mark = hashlib.sha256(data).hexdigest()
    shared = spark.sparkContext.broadcast(data)
    cuts = docs.stat.approxQuantile(doc_id, [i / shards for i in range(1, shards)], 0.25 / shards) if shards > 1 else []
    bounds = np.array(sorted(cuts), dtype=np.float64)
    width = _tokenizer(form.tokenizer)[1]
    spark.createDataFrame([(mark, bytearray(data), width)], "hash string, data binary, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def frames(batches):
        words = _dictionary(shared.value)
        if words:
            words.precompute_compress(level=form.level)
        press = zstandard.ZstdCompressor(level=form.level, dict_data=words)
        for batch in slices(batches, 1):
            ids = _serialized([t or "" for t in batch.column(1).to_pylist()], form.tokenizer, form.end_id)
            place = np.nan_to_num(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(bounds, place).astype(np.int32)),
                    batch.column(0),
                    pa.array([len(x) // width for x in ids], pa.int32()),
                    pa.array([press.compress(x) for x in ids], pa.binary()),
                ],
                names=["shard", "doc", "n", "frame"],
            )

    def blocks(batches):
        shard, before, number, held = None, 0, 0, 0
        docs_, counts, sizes, parts = [], [], [], []

        def close():
            offsets = np.cumsum(sizes) - np.array(sizes)
            known = [d for d in docs_ if d is not None]
            row = [shard, number, mark, before, min(known, default=None), max(known, default=None), docs_, counts, offsets.tolist(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

        kinds = {
            "shard": pa.int32(),
            "block": pa.int32(),
            "dictionary": pa.string(),
            "ids_before": pa.int64(),
            "low": pa.int64(),
            "high": pa.int64(),
            "docs": pa.list_(pa.int64()),
            "counts": pa.list_(pa.int32()),
            "offsets": pa.list_(pa.int64()),
            "frames": pa.binary(),
        }
        for batch in batches:
            for s, d, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and (s != shard or held + len(frame) > form.block_bytes):
                    yield close()
                    before, number, held = before + sum(counts), number + 1, 0
                    docs_, counts, sizes, parts = [], [], [], []
                if s != shard:
                    shard, before, number = s, 0, 0
                held += len(frame)
                docs_.append(d)
                counts.append(n)
                sizes.append(len(frame))
                parts.append(frame)
        if parts:
            yield close()

    schema = "shard int, block int, dictionary string, ids_before long, low long, high long, docs array<long>, counts array<int>, offsets array<long>, frames binary"
    found = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(frames, "shard int, doc long, n int, frame binary")
    dealt = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc", "frame")
    dealt.mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def _decoded(rows: DataFrame, data: bytes, width: int, only: frozenset | None, with_ids: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, counts, offsets, frames = (batch.column(i)[row].as_py() for i in range(5))
                ends = [*offsets[1:], len(frames)]
                firsts = (start + np.cumsum(counts) - np.array(counts)).tolist()
                some = [i for i, d in enumerate(docs) if only is None or d in only]
                ids = [np.frombuffer(open_.decompress(frames[offsets[i] : ends[i]]), dtype=f"<u{width}").astype("<u4").tobytes() for i in some]
                columns = {
                    "doc_id": pa.array([docs[i] for i in some], pa.int64()),
                    "start": pa.array([firsts[i] for i in some], pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.select("start", "docs", "counts", "offsets", "frames").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, or of the few in ``doc_ids``.

    ``start`` counts the ids of all documents before. The ids before a shard come from the totals of the
    shards, a table with one row for each shard. Blocks that can't hold a wanted document are not read.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(head["data"]).hexdigest() != head["hash"]:
        raise ValueError("the dictionary does not have the hash that its store names")
    rows = spark.read.parquet(f"{path}/blocks")
    totals = rows.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    placed = rows.where(F.col("dictionary") == head["hash"])
    only = None
    if doc_ids is not None:
        only = frozenset(doc_ids)
        test = F.lit(False)
        for d in only:
            test = test | ((F.col("low") <= d) & (F.col("high") >= d))
        placed = placed.where(test)
    placed = placed.join(F.broadcast(before), "shard").withColumn("start", F.col("base") + F.col("ids_before"))
    return _decoded(placed, bytes(head["data"]), head["width"], only, with_ids)
