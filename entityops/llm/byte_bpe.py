"""Byte-level BPE over a corpus: each distinct pre-token is encoded once.

Texts are cut into pre-tokens by the pattern and numbered inside blocks (runs of rows of one input partition,
bounded in bytes): a block has a dictionary of its distinct pre-tokens and, for each text, the positions as
numbers into that dictionary. Dictionary rows are shuffled and sorted by word, so that each distinct word of
the corpus is encoded once and its ids join all its rows in that place. Blocks then meet their ids in a
join by block, and texts are put together by position. Decoding joins ids with the table of token bytes, whose size
is that of the vocabulary and checked.

Null texts count as empty. Repeated rows get equal results. A common word has one row in each block, not one
for each occurrence, so no key is hot. Rows of texts are never split, so the order of tokens is that of the text.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops.llm.words import give_back, slices


@dataclass(frozen=True)
class Vocabulary:
    """A rank file (one base64 token and its rank a line) and the pattern of pre-tokens."""

    path: str
    pattern: str
    most_tokens: int = 1 << 20


#: Text of a block, and rows of the dictionary that one task holds at a time.
_BLOCK_BYTES = 16 << 20
_PACK_ROWS = 1 << 19

_RANKS: dict[str, dict[bytes, int]] = {}
_ENCODERS: dict[Vocabulary, object] = {}


def ranks(vocabulary: Vocabulary) -> dict[bytes, int]:
    """Token bytes and ranks, read once per process."""
    if vocabulary.path not in _RANKS:
        with open(vocabulary.path, "rb") as lines:
            found = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if len(found) > vocabulary.most_tokens:
            raise ValueError("the vocabulary is larger than the bound of tables that every task holds")
        _RANKS[vocabulary.path] = found
    return _RANKS[vocabulary.path]


def _encoder(vocabulary: Vocabulary):
    if vocabulary not in _ENCODERS:
        import tiktoken

        _ENCODERS[vocabulary] = tiktoken.Encoding("corpus", pat_str=vocabulary.pattern, mergeable_ranks=ranks(vocabulary), special_tokens={})
    return _ENCODERS[vocabulary]


def _blocks(batches):
    """(number of the block, batch); the same scan gives the same numbers, whichever task reads it."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, batch in enumerate(slices(batches, 1, _BLOCK_BYTES)):
        yield (task << 32) + number, batch


def _packed(numbers: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """The number of low bytes that the largest number needs, then these bytes as planes, compressed."""
    planes = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return press.compress(bytes([planes]) + np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes())


def _unpacked(data: bytes, open_: zstandard.ZstdDecompressor) -> np.ndarray:
    plain = np.frombuffer(open_.decompress(data), dtype=np.uint8)
    out = np.zeros(((len(plain) - 1) // int(plain[0]), 4), dtype=np.uint8)
    out[:, : plain[0]] = plain[1:].reshape(int(plain[0]), -1).T
    return out.view("<u4").ravel()


def dictionary_rows(docs: DataFrame, text: str, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """(block, place, word): the distinct pre-tokens of each block in the order of their first mention.

    Reads the columns that ``_position_rows`` reads: Spark closes batches by rows and by the bytes of all
    columns, and both scans have to cut the same blocks.
    """

    def run(batches):
        find = regex.compile(pattern).findall
        for block, batch in _blocks(batches):
            seen: dict[str, None] = {}
            for value in batch.column(1):
                seen |= dict.fromkeys(find(value.as_py() or ""))
            words = list(seen)
            for low in range(0, len(words), 50_000):
                part = words[low : low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block)), pa.array(np.arange(low, low + len(part), dtype=np.int32)), pa.array(part, pa.string())],
                    names=["block", "place", "word"],
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, "block long, place int, word string")


class _Numbers(dict):
    """Numbers of words in the order of their first mention."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _position_rows(docs: DataFrame, doc_id: str, text: str, pattern: str) -> DataFrame:
    """(block, doc, places): each row's positions as compressed numbers into the dictionary of its block."""

    def run(batches):
        find, press = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=3)
        for block, batch in _blocks(batches):
            number = _Numbers().__getitem__
            data = []
            for value in batch.column(1):
                words = find(value.as_py() or "")
                data.append(_packed(np.fromiter(map(number, words), dtype=np.uint32, count=len(words)), press))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), block)), batch.column(0), pa.array(data, pa.binary())], names=["block", "doc", "places"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"block long, doc {kind}, places binary")


def encode_words(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(block, places, sizes, ids): the dictionary rows' ids, packed by block.

    Rows are dealt out and sorted by word, so that a word is encoded where its run of rows begins and its ids
    go to all rows of the run. Packs hold at most ``_PACK_ROWS`` rows, whatever the partition holds.
    """

    def run(batches):
        encode, press = _encoder(vocabulary).encode_ordinary, zstandard.ZstdCompressor(level=3)
        last, ids = None, None
        blocks, places, found = [], [], []

        def packs():
            block, place = np.concatenate(blocks), np.concatenate(places)
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter((i for part in found for i in part), dtype=np.uint32, count=int(size.sum()))
            start = np.cumsum(size) - size
            order = np.lexsort((place, block))
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                n = size[part]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                data = [_packed(x, press) for x in (place[part], n, flat[np.repeat(start[part], n) + inside])]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[part[0]])]), *[pa.array([x], pa.binary()) for x in data]], names=["block", "places", "sizes", "ids"])

        for batch in batches:
            blocks.append(batch.column(0).to_numpy())
            places.append(batch.column(1).to_numpy())
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                found.append(ids)
            if len(found) >= _PACK_ROWS:
                yield from packs()
                blocks, places, found = [], [], []
        if found:
            yield from packs()

    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, places binary, sizes binary, ids binary")


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every row's text as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are also decoded again where they were put together, as ``decode`` does it.
    """
    filled = encode_words(dictionary_rows(docs, text, vocabulary.pattern, doc_id), vocabulary)
    positions = _position_rows(docs, doc_id, text, vocabulary.pattern)
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = docs.sparkSession.sparkContext.broadcast(_byte_table(vocabulary)) if decoded else None

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        place, size, flat = (np.concatenate([np.zeros(0, "<u4"), *(_unpacked(x.as_py(), open_) for x in left.column(c))]) for c in ("places", "sizes", "ids"))
        start, count = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[place], count[place] = np.cumsum(size) - size, size
        out, counts = [], []
        for packed in right.column("places"):
            at = _unpacked(packed.as_py(), open_)
            n = count[at]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(flat[np.repeat(start[at], n) + inside].tobytes())
            counts.append(len(inside))
        columns = {"doc_id": right.column("doc"), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(out, pa.binary())}
        if tokens is not None:
            columns["decoded"] = pa.array([_bytes_of(data, *tokens.value) for data in out], pa.binary())
        del out, place, size, flat, start, count
        give_back()
        return pa.table(columns)

    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    return filled.groupBy("block").cogroup(positions.groupBy("block")).applyInArrow(assemble, schema)


def token_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(id, bytes) of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in sorted(ranks(vocabulary).items(), key=lambda x: x[1])], "id int, bytes binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids: a lookup join against the token-byte table.

    The table is sent to every task; its size is bounded by ``most_tokens``. An id it lacks is an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast(_byte_table(vocabulary))
    names = [c for c in encoded.columns if c != "decoded"]
    place = names.index(ids)

    def run(batches):
        for batch in slices(batches, place):
            out = [_bytes_of(data.as_py() or b"", *table.value) for data in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, encoded.select(*names).schema.add("decoded", "binary"))


def _bytes_of(ids: bytes, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> bytes:
    """The bytes of ids, looked up in the table of token bytes."""
    at = np.frombuffer(ids, dtype="<u4")
    if len(at) and (at.max() >= len(size) or (size[at] < 0).any()):
        raise ValueError("an id is not in the token-byte table")
    n = size[at]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(first[at], n) + inside].tobytes()


def _byte_table(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = ranks(vocabulary)
    size = np.full(max(found.values()) + 1, -1, dtype=np.int64)
    for token, i in found.items():
        size[i] = len(token)
    length = np.maximum(size, 0)
    flat = b"".join(token for token, _ in sorted(found.items(), key=lambda x: x[1]))
    return np.cumsum(length) - length, size, np.frombuffer(flat, dtype=np.uint8)

