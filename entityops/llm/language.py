"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. The vector of an n-gram
binds the vectors of its letters: each is permuted (rotated by one place for every letter that follows) and
all are multiplied. A text is the bundle, the sum, of the vectors of its n-grams; a language is the bundle of
its texts, taken to length one and centred on the mean of all languages. A text's language is the prototype
with the largest cosine to it; equal cosines go to the language first in order.

N-grams run over the letters of any script in lower case with one blank for anything else between them and
at both ends. Texts without a letter, and null ones, are ``und`` with score 0. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops.llm.words import slices


@dataclass(frozen=True)
class Space:
    """``remembered`` bounds the vectors of n-grams that one Python process holds."""

    dimensions: int = 1024
    gram: int = 3
    seed: int = 20260101
    remembered: int = 1 << 15
    sharpness: float = 12.0


UNKNOWN = "und"
_BLANK = 0x20
_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, _BLANK, dtype=np.int32)
        for point in range(0x33480):
            letter = chr(point)
            if letter.isalpha():
                table[point] = ord(letter.lower()[0])
        _LETTERS = table
    return _LETTERS


def grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text, as numbers of 21 bits a letter, and how often each occurs."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    points = np.concatenate(([_BLANK], points, [_BLANK]))
    blank = points == _BLANK
    points = points[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    if len(points) < n or (points == _BLANK).all():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(points) - n + 1
    codes = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        codes = (codes << np.uint64(21)) | points[k : k + size]
    return np.unique(codes, return_counts=True)


class Memory:
    """Vectors of letters and of n-grams; both depend on the space and the letters only."""

    def __init__(self, space: Space):
        self.space = space
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.slots, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.vectors = np.zeros((space.remembered, space.dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.space.seed, point])).integers(0, 2, self.space.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, one a row."""
        out = np.ones((len(codes), self.space.dimensions), dtype=np.int8)
        for k in range(self.space.gram):
            points = ((codes >> np.uint64(21 * (self.space.gram - 1 - k))) & np.uint64((1 << 21) - 1)).astype(np.int64)
            kinds, which = np.unique(points, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(p)), self.space.gram - 1 - k) for p in kinds])
            out *= table[which]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of sorted different ``codes``, each as often as it occurs. Sums are whole numbers and exact."""
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        known = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        kind = np.float32 if counts.sum() < 1 << 23 else np.float64
        total = np.zeros(self.space.dimensions, kind)
        some = self.slots[place[known]] if known.any() else place[:0]
        for low in range(0, len(some), 4096):
            total += counts[known][low : low + 4096].astype(kind) @ self.vectors[some[low : low + 4096]].astype(kind)
        fresh, often = codes[~known], counts[~known]
        for low in range(0, len(fresh), 4096):
            part = fresh[low : low + 4096]
            vectors = self.bound(part)
            total += often[low : low + 4096].astype(kind) @ vectors.astype(kind)
            room = min(len(part), self.space.remembered - self.used)
            if room > 0:
                self.vectors[self.used : self.used + room] = vectors[:room]
                codes_, slots = np.concatenate((self.codes, part[:room])), np.concatenate((self.slots, np.arange(self.used, self.used + room)))
                order = np.argsort(codes_, kind="stable")
                self.codes, self.slots, self.used = codes_[order], slots[order], self.used + room
        return total


_MEMORIES: dict[Space, Memory] = {}


def _memory(space: Space) -> Memory:
    if space not in _MEMORIES:
        _MEMORIES[space] = Memory(space)
    return _MEMORIES[space]


def fit(docs: DataFrame, space: Space = Space(), text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each language over all ``docs`` with a language.

    Tasks send one bundle for each of their languages; sums over tasks are partial aggregates by language and
    dimension. What reaches the driver has languages x dimensions numbers.
    """

    def run(batches):
        memory = _memory(space)
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            found: dict[str, list] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = grams(value, space.gram)
                if len(codes):
                    found.setdefault(name, []).append((codes, counts))
            for name, parts in found.items():
                codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(which, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                sums[name] = sums.get(name, 0) + memory.bundle(codes, counts).astype(np.int64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text)).mapInArrow(run, "lang string, bundle array<long>")
    rows = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for row in rows:
        out.setdefault(row["lang"], np.zeros(space.dimensions))[row["pos"]] = row["n"]
    unit = {k: v / (np.linalg.norm(v) or 1.0) for k, v in out.items()}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else np.zeros(space.dimensions)
    return {k: (v - mean) / (np.linalg.norm(v - mean) or 1.0) for k, v in sorted(unit.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], space: Space = Space(), text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the best language among the sharpened cosines."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    languages = list(prototypes)
    table = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[k] for k in languages]).astype(np.float32) if languages else None)
    place = names.index(text)

    def run(batches):
        memory = _memory(space)
        for batch in slices(batches, place):
            pred, score = [], []
            for value in batch.column(place).to_pylist():
                codes, counts = grams(value, space.gram)
                if not len(codes) or not languages:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                vector = memory.bundle(codes, counts).astype(np.float32)
                cosine = (table.value @ vector) / (np.linalg.norm(vector) or 1.0)
                best = int(np.argmax(cosine))
                weight = np.exp(space.sharpness * (cosine - cosine[best]).astype(np.float64))
                pred.append(languages[best])
                score.append(float(1.0 / weight.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    rows = docs.select(*names)
    return rows.mapInArrow(run, _schema(rows).add("lang_pred", "string").add("score", "double"))


def _schema(rows: DataFrame):
    return type(rows.schema)(list(rows.schema.fields))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of an id, as text, leaves ``part`` divided by ``parts``."""
    return F.crc32(doc_id.cast("string")) % parts == part
