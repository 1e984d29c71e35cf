"""Word spans and word hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Words are runs of bytes other than these: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[list(WHITE)] = True

IS_PUNCTUATION = np.zeros(256, dtype=bool)
IS_PUNCTUATION[list(string.punctuation.encode())] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of a run of texts: ``doc`` is the text a word belongs to, ``first[i]`` the first word of text i."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    return np.cumprod(out, dtype=np.uint64)


def split_words(texts: list[bytes], strip_punctuation: bool = False) -> Words:
    """All words of ``texts`` with their 64-bit hashes; stripped words lose ASCII punctuation at both ends."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.cumsum(lengths) - lengths
    inside = ~IS_WHITE[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    if strip_punctuation:
        solid = np.flatnonzero(inside & ~IS_PUNCTUATION[buffer])
        low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = high > low
        start, end = solid[low[some]], solid[high[some] - 1] + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    if not len(start):
        return Words(buffer, start, end, doc, first, np.zeros(0, np.uint64))
    size = end - start
    at = np.cumsum(size) - size
    position = np.arange(int(size.sum())) - np.repeat(at, size)
    letters = buffer[position + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(size.max()))[position]
    return Words(buffer, start, end, doc, first, mix(np.add.reduceat(letters, at)))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about two megabytes with the index of their first text; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > _CHUNK_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def slices(batches, column: int, most_bytes: int = 8 << 20) -> Iterator:
    """Batches cut into runs of rows with about ``most_bytes`` of text, so that a task's memory stays bounded."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python processes between tasks, and they share an executor's memory with it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
