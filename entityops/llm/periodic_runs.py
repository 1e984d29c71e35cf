"""Periodic runs: stretches of words that repeat with one period, found word by word.

A run is a stretch of at least ``max(min_words, min_repeats * q)`` words whose smallest period is ``q`` and
that no neighbouring word extends. Words are read in order. Each lag at which words match keeps the length
of its current match; a word's earlier occurrences say which lags go on and which may open, and a lag whose
match ends with sufficient length emits its run at once. Two things keep the lags sparse:

* A run of period q matches for at least ``(min_repeats - 1) * q`` words, so a lag between 2^k and 2^(k+1)
  need only be opened at words whose number 2^k divides, and its match is followed back from there. That
  leaves at most 2^k earlier occurrences to look at, n log n in a text of n words, however often they occur.
* No lag is opened that is a multiple of a shorter one whose match covers a whole lag of words: it would
  find the same run again.

Only words that end a context of ``min_words - 1`` words seen before in their text can open a lag; contexts
are compared by hash, and what they let through by the words themselves.

A null or empty text and one without a run have no runs; a null text collapses to an empty one. Rows are
independent of each other: repeated rows, null ids and extra columns pass, columns named like a result are
replaced. Texts are read whole, in slices of a few megabytes; only a single text must fit in memory.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from entityops.llm.words import mix, slices, text_bytes

RESULT_COLUMNS = ("n_words", "runs", "collapsed")
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


@dataclass(frozen=True)
class Shape:
    """A run has at least ``min_words`` words and ``min_repeats`` (2 at least) times its period."""

    min_words: int = 6
    min_repeats: int = 4

    @property
    def context(self) -> int:
        """Words in a row that match in every run, so that each lag's match holds a whole context at an opening word."""
        least = min(max(self.min_words - q, (self.min_repeats - 1) * q) for q in range(1, self.min_words + 1))
        # the match without its first context - 1 words must still hold a multiple of 2^k <= q
        spare = min(max(self.min_words - q, (self.min_repeats - 1) * q) - (1 << (q.bit_length() - 1)) for q in range(1, 2 * self.min_words + 2))
        return max(1, min(least, spare + 1))


def runs_of(words: list, shape: Shape = Shape(), opens: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period.

    ``opens``: numbers, ascending, of the words that end a context seen before; all words may open without it.
    """
    n, found = len(words), {}
    active: dict[int, int] = {}  # lag -> the first word of its current match
    places: dict = {}
    ids = [places.setdefault(w, len(places)) for w in words]
    seen: list[list[int]] = [[] for _ in places]
    may_open = bytearray(b"\x01") * n if opens is None else bytearray(n)
    if opens is not None:
        for i in opens.tolist():
            may_open[i] = 1

    def end(lag: int, stop: int) -> None:
        start = active.pop(lag) - lag
        if stop - start >= max(shape.min_words, shape.min_repeats * lag):
            found[start, stop] = min(lag, found.get((start, stop), lag))

    for i, word in enumerate(ids):
        if active:
            for lag in [p for p in active if ids[i - p] != word]:
                end(lag, i)
        if may_open[i]:
            earlier = seen[word]
            step = 1
            while earlier and step * shape.min_repeats <= n and i % step == 0:
                # earlier occurrences with a lag of step to 2 * step - 1, nearest first
                for at in range(bisect_left(earlier, i - step + 1) - 1, bisect_left(earlier, i - 2 * step + 1) - 1, -1):
                    lag = i - earlier[at]
                    # where runs repeat thrice or more, an opening word further on holds more of a match that is still short
                    back = step - 1 if shape.min_repeats > 2 else 0
                    if lag in active or i - back < lag or ids[i - back] != ids[i - back - lag]:
                        continue
                    if any(lag % p == 0 and i - first + 1 >= lag - p for p, first in active.items()):
                        continue
                    if ids[i - back : i] != ids[i - back - lag : i - lag]:
                        continue
                    first = i
                    while first > lag and ids[first - 1] == ids[first - 1 - lag]:
                        first -= 1
                    active[lag] = first
                step *= 2
        seen[word].append(i)
    for lag in list(active):
        end(lag, n)
    return sorted((start, stop - start, lag) for (start, stop), lag in found.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def _openings(texts: list[list[bytes]], context: int) -> list[np.ndarray]:
    """For each text the words that end a context of words which occurred before in that text, by hash."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    code = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=total).view(np.uint64)
    code = mix(code)
    joined = code.copy()
    for k in range(1, context):
        joined[k:] = joined[k:] * np.uint64(0x9E3779B97F4A7C15) + code[: total - k] if k < total else joined[k:]
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(np.arange(total) - first[doc] >= context - 1)
    keys = mix(joined[whole] ^ mix(doc[whole].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    hits = whole[again]
    cuts = np.searchsorted(hits, np.concatenate((first, [total])))
    return [hits[cuts[k] : cuts[k + 1]] - first[k] for k in range(len(texts))]


def find_runs(docs: DataFrame, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start and period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that a run repeats. One narrow pass.
    """
    names = [c for c in docs.columns if c not in RESULT_COLUMNS or c == text]
    place = names.index(text)
    outputs = [*[c for c in names if c not in RESULT_COLUMNS], *RESULT_COLUMNS]

    def run(batches):
        for batch in slices(batches, place):
            texts = [t.split() for t in text_bytes(batch.column(place))]  # bytes split at the six white characters
            runs, collapsed = [], []
            for words, opens in zip(texts, _openings(texts, shape.context)):
                found = runs_of(words, shape, opens) if len(opens) else []
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(kept_words(words, found)))
            columns = [batch.column(names.index(c)) for c in outputs if c not in RESULT_COLUMNS]
            results = [pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, pa.list_(_ARROW_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *results], names=outputs)

    rows = docs.select(*names)
    schema = T.StructType([f for f in rows.schema.fields if f.name not in RESULT_COLUMNS])
    return rows.mapInArrow(run, schema.add("n_words", "long").add("runs", T.ArrayType(_RUN)).add("collapsed", "string"))
