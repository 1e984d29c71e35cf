"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``passage_words`` words, to its end. Every passage is described by numbers
(shares of kinds of letters and symbols, lengths and repetition of words, hashed words) and encoded by a layer.
A gated attention unit, tanh times sigmoid, gives each passage a weight; the weighted mean of the encoded
passages is scored. Only documents have labels: encoder, attention and scorer are trained together on them.

Training takes a bounded sample of labelled documents (``sample``, those whose ids hash lowest) and of each at
most ``bag`` evenly spaced passages; scoring takes every passage of every text. Null and empty texts and texts
without a word have one passage of zeros and get the score that the model has for it. Conflicting labels of
one document count by their mean. Repeated rows get equal results. Without labels, or with one kind of them, the
score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.llm import words as W


@dataclass(frozen=True)
class Settings:
    passage_words: int = 64
    buckets: int = 32
    hidden: int = 32
    gate: int = 16
    sample: int = 4000
    bag: int = 32
    epochs: int = 40
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


# Kinds of bytes that are counted for a passage; every other byte of a word counts as a letter beyond ASCII.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#*$%&", b"|", b"<>", b"\"'()[]{}", b"-_/\\=+~^`@:;"]
_KIND = np.full(256, len(KINDS), dtype=np.int64)
for _number, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _number
DENSE = len(KINDS) + 1 + 7


def passages(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and the end)."""
    found = W.split_words(texts)
    n_words = np.diff(found.first)
    count = np.maximum(1, -(-n_words // s.passage_words))
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    out = np.zeros((total, DENSE + s.buckets), dtype=np.float32)
    if not len(found.doc):
        return out, first
    inside = np.arange(len(found.doc)) - found.first[found.doc]
    owner = first[found.doc] + inside // s.passage_words
    head = np.flatnonzero(np.diff(owner, prepend=-1))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    last = np.append(found.doc[head[1:]] != found.doc[head[:-1]], True)
    end = np.where(last, offsets[found.doc[head] + 1] - 1, np.append(found.start[head[1:]], 0))
    span = end - found.start[head]
    filled = owner[head]
    which = np.repeat(np.arange(len(head)), span)
    place = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + np.repeat(found.start[head], span)
    kinds = np.bincount(which * (len(KINDS) + 1) + _KIND[found.buffer[place]], minlength=len(head) * (len(KINDS) + 1)).reshape(len(head), -1)
    out[filled, : len(KINDS) + 1] = kinds / np.maximum(span, 1)[:, None]
    size = (found.end - found.start).astype(np.float64)
    n = np.diff(np.append(head, len(owner)))
    mean = np.add.reduceat(size, head) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(size * size, head) / n - mean * mean, 0))
    order = np.lexsort((found.hash, owner))
    new = (np.diff(owner[order], prepend=-1) != 0) | (np.diff(found.hash[order].view(np.int64), prepend=0) != 0)
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    of_run = owner[order][new]
    starts = np.flatnonzero(np.diff(of_run, prepend=-1))
    same = np.append(False, (found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1]))
    dense = (
        np.log1p(n) / 5,
        mean / 10,
        spread / 10,
        np.diff(np.append(starts, len(of_run))) / n,
        np.maximum.reduceat(runs, starts) / n,
        np.add.reduceat(same.astype(np.float64), head) / n,
        np.log1p(inside[head]) / 10,
    )
    for k, values in enumerate(dense):
        out[filled, len(KINDS) + 1 + k] = values
    bucket = (found.hash >> np.uint64(40)).astype(np.int64) % s.buckets
    sign = np.where(found.hash & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(owner * s.buckets + bucket, weights=sign, minlength=total * s.buckets).reshape(total, s.buckets)
    words = np.bincount(owner, minlength=total)
    out[:, DENSE:] = hashed / np.sqrt(np.maximum(words, 1))[:, None]
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def start(features: int, s: Settings) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(s.seed)

    def weights(a: int, b: int) -> np.ndarray:
        return (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    return {
        "enc": weights(features, s.hidden),
        "enc_b": np.zeros(s.hidden, np.float32),
        "tan": weights(s.hidden, s.gate),
        "tan_b": np.zeros(s.gate, np.float32),
        "sig": weights(s.hidden, s.gate),
        "sig_b": np.zeros(s.gate, np.float32),
        "att": weights(s.gate, 1)[:, 0],
        "out": weights(s.hidden, 1)[:, 0],
        "out_b": np.zeros(1, np.float32),
    }


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Bags lie one after the other in ``x``; ``first`` has where each begins, and the end."""
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ m["enc"] + m["enc_b"])
    t, g = np.tanh(h @ m["tan"] + m["tan_b"]), _sigmoid(h @ m["sig"] + m["sig_b"])
    e = (t * g) @ m["att"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["out"] + m["out_b"])}


def gradient(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy."""
    f = forward(m, x, first)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    dz = d[:, None] * m["out"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt = de[:, None] * m["att"] * g * (1 - t * t)
    dg = de[:, None] * m["att"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m["tan"].T + dg @ m["sig"].T) * (1 - h * h)
    return {
        "enc": x.T @ dh,
        "enc_b": dh.sum(0),
        "tan": h.T @ dt,
        "tan_b": dt.sum(0),
        "sig": h.T @ dg,
        "sig_b": dg.sum(0),
        "att": (t * g).T @ de,
        "out": f["z"].T @ d,
        "out_b": d.sum(keepdims=True),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Adam over the sample in an order that the seed fixes."""
    every = np.concatenate(bags)
    shift, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - shift) / scale for b in bags]
    m = start(every.shape[1], s)
    low, high = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    draw, step = np.random.default_rng(s.seed), 0
    for epoch in range(s.epochs):
        order = draw.permutation(len(bags))
        rate = s.rate * (1 - epoch / s.epochs)
        for at in range(0, len(order), s.batch):
            part = order[at : at + s.batch]
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in part])))
            step += 1
            for k, v in gradient(m, np.concatenate([bags[i] for i in part]), first, labels[part]).items():
                v = v + s.decay * m[k]
                low[k] = 0.9 * low[k] + 0.1 * v
                high[k] = 0.999 * high[k] + 0.001 * v * v
                m[k] = (m[k] - rate * (low[k] / (1 - 0.9**step)) / (np.sqrt(high[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {**m, "shift": shift, "scale": scale}


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray] | float:
    """The model, or a constant score where there is nothing to tell apart."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).cast("double").alias("y"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(s.sample)
    rows = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("_id")).select("_id", "y", F.col(text))

    def run(batches):
        for batch in W.slices(batches, 2):
            x, first = passages(W.text_bytes(batch.column(2)), s)
            data = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                pick = np.unique(np.linspace(a, b - 1, min(s.bag, b - a)).astype(np.int64))
                data.append(x[pick].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["id", "y", "x"])

    kind = labels.schema[doc_id].dataType.simpleString()
    found = sorted(rows.mapInArrow(run, f"id {kind}, y double, x binary").dropDuplicates(["id"]).collect())
    y = np.array([r["y"] for r in found], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return train([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, DENSE + s.buckets) for r in found], y, s)


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is, from 0 to 1."""
    names = [c for c in docs.columns if c != "score"]
    place = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in W.slices(batches, place):
            if isinstance(m, float):
                out = np.full(batch.num_rows, m)
            else:
                texts, parts = W.text_bytes(batch.column(place)), []
                for _, part in W.chunks(texts):
                    x, first = passages(part, s)
                    parts.append(forward(m, (x - m["shift"]) / m["scale"], first)["p"].astype(np.float64))
                out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "score"])

    rows = docs.select(*names)
    return rows.mapInArrow(run, type(rows.schema)(list(rows.schema.fields)).add("score", "double"))
