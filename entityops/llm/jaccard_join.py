"""N-gram Jaccard join as a size-aware heavy-light join.

A document's set holds its distinct runs of ``width`` words (the whole sequence if it has fewer words).
Sets link if their Jaccard similarity is at least ``percent`` per cent. Sets are ordered by one global
order, rare shingles first: two linked sets share at least k of the first ``n - ceil(t n) + k`` shingles.

* Small sets post every subset of ``subset`` shingles of that prefix (k = ``subset``).
* Large sets, and small ones that can link with them, post each shingle of the prefix (k = 1), which forms
  the inverted lists to scan.
* The boundary is the size at which both kinds of postings together cost least; it is computed from the
  sizes of all sets and from the lengths of the lists that frequent shingles have.

Equal sets are one entity. In a list of up to ``short`` entities all are compared; in a longer one all are
compared with the smallest first. A longer list is settled once its members are in one component, since another link between them
changes nothing; lists that are not go on with more pivots (see ``_quota``), each of which leaves the list when it was
compared with every member of another component. So every list ends with each of its pairs compared or
connected, without all pairs within a group of copies. Pairs that size and bitmap allow are checked on their
whole sets.

Null and empty texts and texts without words have an empty set and link with nothing, not even each other.
Repeated rows get equal results. Sets are identified, and shingles compared, by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entityops.llm import words as W
from entityops.llm.graph import merged
from entityops.llm.storage import remove, shared_folder, table


@dataclass(frozen=True)
class Join:
    """``frequent`` bounds the table of frequent shingles (an ordering aid, no result depends on it).

    Lists whose rarest shingle is known to be in ``hot`` documents are joined in a way that splits them over tasks.
    Pivots of a list grow by ``growth`` a round: more of it means fewer rounds, and more pairs that a later link makes needless.
    """

    width: int = 4
    percent: int = 85
    subset: int = 3
    frequent: int = 1 << 19
    frequent_in_batch: int = 2
    sketch_bits: int = 25
    pivots: tuple[int, int, int] = (1, 4, 1024)
    growth: int = 16
    short: int = 4
    broadcast_rows: int = 1 << 17
    scattered_percent: int = 80
    hot: int = 1 << 14


#: Bits of a set's parity bitmap.
_PARITY = 1024

_FACTORS = W.powers(64) | np.uint64(1)


def _shingles(found: W.Words, i: int, width: int) -> np.ndarray:
    """The sorted set of text i."""
    hashes = found.hash[found.first[i] : found.first[i + 1]]
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        return W.mix(np.sum(hashes * _FACTORS[width : width + len(hashes)], keepdims=True) + np.uint64(len(hashes)))
    n = len(hashes) - width + 1
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value += hashes[k : k + n] * _FACTORS[k]
    value = np.sort(W.mix(value))
    return value[np.concatenate(([True], value[1:] != value[:-1]))]


def _sets(batch, column: int, width: int):
    """(row, set) of every row of a batch."""
    for begin, part in W.chunks(W.text_bytes(batch.column(column))):
        found = W.split_words([t.lower() for t in part])
        for i in range(len(part)):
            yield begin + i, _shingles(found, i, width)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _statistics(docs: DataFrame, text: str, join: Join) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Sizes of all sets, and the most frequent shingles with their counts.

    Runs of about 8 MB of text send shingles that at least ``frequent_in_batch`` of their texts hold; sums over these runs are
    lower bounds of the document frequency. Sizes are sent rounded to two significant digits.
    """

    def run(batches):
        for batch in W.slices(batches, 0):
            sizes: dict[int, int] = {}
            parts = [np.zeros(0, np.uint64)]
            for _, s in _sets(batch, 0, join.width):
                n = len(s)
                scale = 10 ** max(0, len(str(n)) - 2)
                sizes[n // scale * scale] = sizes.get(n // scale * scale, 0) + 1
                parts.append(s)
            shingle, count = np.unique(np.concatenate(parts), return_counts=True)
            often = count >= join.frequent_in_batch
            keys = np.concatenate((np.fromiter(sizes, np.int64, len(sizes)), shingle[often].view(np.int64)))
            counts = np.concatenate((np.fromiter(sizes.values(), np.int64, len(sizes)), count[often]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)) < len(sizes)), pa.array(keys), pa.array(counts)], names=["is_size", "key", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "is_size boolean, key long, n long").groupBy("is_size", "key").agg(F.sum("n").alias("n"))
    rows = table(rows, "statistics")
    sizes = {r["key"]: r["n"] for r in rows.where("is_size").toLocalIterator()}
    top = rows.where("not is_size").orderBy(F.desc("n"), "key").limit(join.frequent).toArrow()
    shingle, count = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shingle)
    return sizes, shingle[order], count[order]


def boundary(sizes: dict[int, int], frequent: np.ndarray, join: Join) -> int:
    """The largest size of a small set. A posting in an inverted list costs as much as the mean list is long, four at most:
    the order keeps the longest lists out of the prefixes."""
    total = sum(n * c for n, c in sizes.items()) or 1
    squares = float((frequent.astype(np.float64) ** 2).sum())
    scan = 1 + min(squares / total, 3.0)

    def cost(limit: int) -> float:
        out = 0.0
        for n, c in sizes.items():
            spare = n - _needed(n, join.percent)
            if join.width <= n <= limit:
                out += c * math.comb(spare + join.subset, join.subset)
            if 100 * n > join.percent * limit:
                out += c * (spare + 1) * scan
        return out

    return min([0, *(n for n in sizes if n <= 400)], key=lambda b: (cost(b), b))


def _postings(s: np.ndarray, limit: int, frequent: np.ndarray, count: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, largest sizes, hot): the postings of a set, for each the size of the largest set that can link here, and
    whether its list is known to be long.

    If a posting is the first that two sets share, they share nothing before its place, which bounds their
    intersection; a pair that is too large for this bound links nowhere or in another list.
    """
    n = len(s)
    if n <= join.subset and _needed(n + 1, join.percent) > n:
        return s[:0], np.zeros(0, np.int64), np.zeros(0, bool)  # such a small set links with its equals only
    place = np.searchsorted(frequent, s)
    place[place == len(frequent)] = 0
    known = frequent[place] == s if len(frequent) else np.zeros(n, dtype=bool)
    documents = np.where(known, count[place], 0) if len(frequent) else np.zeros(n, np.int64)
    if known.any():
        order = np.argsort(documents, kind="stable")
        s, documents = s[order], documents[order]
    spare = n - _needed(n, join.percent)
    out, places = [], []
    if n <= limit:
        prefix = s[: spare + join.subset]
        pick = np.array(list(itertools.combinations(range(len(prefix)), join.subset)))
        value = np.full(len(pick), 0x2545F491, dtype=np.uint64)
        for k in range(join.subset):
            value = value * _FACTORS[9] + prefix[pick[:, k]]
        out.append(W.mix(value))
        places.append(pick[:, 0])
    if 100 * n > join.percent * limit:
        out.append(W.mix(s[: spare + 1]))
        places.append(np.arange(spare + 1))
    both, place = 100 + join.percent, np.concatenate(places)
    return np.concatenate(out), (both * (n - place) - join.percent * n) // join.percent, documents[place] >= join.hot


def _parity(s: np.ndarray) -> bytes | None:
    """The parity bitmap of a set."""
    return np.packbits(np.bincount((s & np.uint64(_PARITY - 1)).astype(np.int64), minlength=_PARITY) & 1).tobytes() if len(s) else None


def _identity(s: np.ndarray) -> int | None:
    """A 64-bit hash of a set; null for the empty one."""
    return int(W.mix(W.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None


def _profiles(docs: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """(doc, n, sig, bits, keys, tops, hots): size, identity, parity bitmap and postings of every set; sig is null for an empty one.

    Of equal sets in one slice of a task only the first carries postings.
    """
    sizes, frequent, count = _statistics(docs, text, join)
    limit = boundary(sizes, count, join)
    order = docs.sparkSession.sparkContext.broadcast((frequent, count))

    def run(batches):
        for batch in W.slices(batches, 1):
            n, sig, keys, tops, hots, bits = [], [], [], [], [], []
            posted: set[int | None] = {None}
            for _, s in _sets(batch, 1, join.width):
                n.append(len(s))
                sig.append(_identity(s))
                bits.append(_parity(s))
                key, top, hot = (s[:0], s[:0], s[:0]) if sig[-1] in posted else _postings(s, limit, *order.value, join)
                posted.add(sig[-1])
                keys.append(key.view(np.int64))
                tops.append(top.astype(np.int32))
                hots.append(hot.astype(bool))
            bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys], dtype=np.int64))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, t), *x]))) for x, t in ((keys, np.int64), (tops, np.int32), (hots, bool))]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(bits, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "sig", "bits", "keys", "tops", "hots"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc {kind}, n long, sig long, bits binary, keys array<long>, tops array<int>, hots array<boolean>")


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits over a long column; its size does not grow with the rows."""
    cell = F.shiftrightunsigned(F.col(ids.columns[0]), 64 - bits)
    parts = ids.select(cell.alias("cell")).select(F.shiftright("cell", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(cell % 32 as int))").alias("b"))
    rows = parts.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def _small(df: DataFrame, join: Join) -> DataFrame:
    """A written table for the side of a join that may be sent to all tasks: so marked only if its rows are counted and few."""
    return F.broadcast(df) if df.count() <= join.broadcast_rows else df


def _hit(bitmap: np.ndarray, column, bits: int) -> np.ndarray:
    cell = (column.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[cell >> 5] >> (cell & 31).astype(np.uint32)) & np.uint32(1) == 1


def _possible(pairs: DataFrame, entities: DataFrame, join: Join) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets can link, by size and by bitmap.

    Bit i of a set's bitmap tells whether it has an odd number of shingles with hash i. The bits in which
    two bitmaps differ are at most as many as the shingles in which the sets differ, so no link is lost.
    Only entities that a fixed-size bitmap of the pairs lets through are shuffled.
    """
    spark, bits = pairs.sparkSession, join.sketch_bits
    mixed = F.xxhash64("sig").alias("h")
    bitmap = spark.sparkContext.broadcast(_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("sig")).select(mixed), bits))

    def named(batches):
        for batch in batches:
            yield batch.select([0, 1, 2]).filter(pa.array(_hit(bitmap.value, batch.column(3), bits)))

    entities = entities.select("sig", "n", "bits", mixed).mapInArrow(named, "sig long, n long, bits binary")
    left = _small(pairs, join).join(entities.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    both = left.join(entities.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    percent = join.percent

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
                apart = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
                sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                batch = batch.filter(pa.array(apart * (100 + percent) <= (100 - percent) * sizes))
            yield batch.select([0, 1])

    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(near, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, entities: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets link. Only texts that a fixed-size bitmap lets through are shuffled.

    Sets are sent as 48-bit prefixes of their hashes.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(entities, "sig").select("sig", F.xxhash64("doc").alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("h"), join.sketch_bits))
    bits = join.sketch_bits

    def run(batches):
        for batch in W.slices(batches, 0):
            hit = np.flatnonzero(_hit(bitmap.value, batch.column(1), bits))
            if not len(hit):
                continue
            some = batch.take(pa.array(hit))
            sets = [s for _, s in _sets(some, 0, join.width)]
            rows = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array([_identity(s) for s in sets], pa.int64()), pa.array(rows, pa.binary())], names=["h", "sig", "s"])

    sets = docs.select(F.col(text), F.xxhash64(F.col(doc_id)).alias("h")).mapInArrow(run, "h long, sig long, s binary")
    sets = wanted.join(sets, ["h", "sig"]).select("sig", "s")
    left = _small(pairs, join).join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
    percent = join.percent

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _wide(x.as_py()), _wide(y.as_py())
                both = np.sort(np.concatenate((p, q)))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long")


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _lists(profiles: DataFrame, join: Join) -> DataFrame:
    """(key, sig, n, top): lists of two entities or more, without members for which the list has no set of a fitting size.

    One exchange by key serves the bounds of a list and its members. Lists known to be long get their bounds from a
    partial aggregation instead, and meet them in a join, which adaptive execution splits.
    """
    each = profiles.select("sig", "n", F.explode(F.arrays_zip("keys", "tops", "hots")).alias("x"))
    posted = each.select(F.col("x.keys").alias("key"), "sig", "n", F.col("x.tops").alias("top"), F.col("x.hots").alias("hot"))
    bounds = {"low": F.min("sig"), "high": F.max("sig"), "least": F.min("n"), "most": F.max("n")}
    cold, hot = (posted.where(x).drop("hot") for x in ("not hot", "hot"))
    whole = Window.partitionBy("key")
    cold = cold.select("*", *[value.over(whole).alias(name) for name, value in bounds.items()]).where("low < high")
    ends = hot.groupBy("key").agg(*[value.alias(name) for name, value in bounds.items()]).where("low < high")
    fits = (F.col("top") >= F.col("least")) & (F.col("n") * join.percent <= F.col("most") * 100)
    members = (df.where(fits).groupBy("key", "sig").agg(F.max("n").alias("n"), F.max("top").alias("top")) for df in (cold, hot.join(ends, "key")))
    return next(members).unionByName(next(members))


def _links(docs: DataFrame, profiles: DataFrame, doc_id: str, text: str, join: Join, folder: str) -> DataFrame:
    """(node, root): components of the entities that link with another one."""
    lists = table(_lists(profiles, join), "lists", folder)
    listed = lists.select("sig").distinct()
    entities = profiles.join(listed, "sig", "left_semi").groupBy("sig").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    entities = table(entities, "entities", folder)
    found, place, number = None, None, 0
    while True:
        if found is None:
            lists = lists.withColumn("root", F.col("sig"))
        else:
            lists = lists.join(found.select(F.col("node").alias("sig"), "root"), "sig", "left").select("key", "sig", "n", "top", F.coalesce("root", "sig").alias("root"))
        state = lists.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.count_if(F.col("root") == F.col("sig")).alias("alone")
        )
        quota = _quota(F.col("members"), F.col("alone"), number, join)
        state = state.where("low < high").select("key", quota.alias("quota"))
        lists = table(lists.join(state, "key"), f"lists-{number}", folder)
        # what the round before wrote has had its last reader
        for old in (["lists"] if number == 0 else [f"{name}-{number - 1}" for name in ("lists", "pivots", "near", "pairs")]):
            remove(docs.sparkSession, f"{folder}/{old}")
        if lists.isEmpty():
            return found
        brief = ["sig", "n", "top", "root"]
        if number >= 2:  # few lists are left, and they may be long: a short bitmap goes with their members
            lists = lists.join(entities.select("sig", *_folded(F.col("bits"))), "sig")
            brief += ["b0", "b1"]
        rank = F.row_number().over(Window.partitionBy("key").orderBy("sig"))
        most = join.pivots[-1] * join.growth ** max(0, number - 1)
        pivots = lists.withColumn("k", rank).where(F.col("k") <= most).where(F.col("k") <= F.col("quota")).select("key", F.struct(*brief).alias("p"))
        pivots = table(pivots, f"pivots-{number}", folder)
        near = (F.col("n") <= F.col("p.top")) & (F.col("p.n") <= F.col("top")) & (F.col("root") != F.col("p.root"))
        if number >= 2:
            apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("p.b0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("p.b1")))
            near = near & (apart * (100 + join.percent) <= (F.col("n") + F.col("p.n")) * (100 - join.percent))
        pairs = lists.join(pivots, "key").where(near).select(F.greatest("sig", "p.sig").alias("a"), F.least("sig", "p.sig").alias("b")).distinct()
        pairs = table(_possible(table(pairs, f"near-{number}", folder), entities, join), f"pairs-{number}", folder)
        if not pairs.isEmpty():
            new = table(_verified(docs, pairs, entities, doc_id, text, join), f"edges-{number}", folder)
            before, place = place, f"{folder}/found-{number}"
            found = table(merged(found, new, f"{folder}/round-{number}"), f"found-{number}", folder)
            for old in (f"{folder}/round-{number}", f"{folder}/edges-{number}", before):
                if old:
                    remove(docs.sparkSession, old)
        lists = lists.join(pivots.select("key", F.col("p.sig").alias("sig")), ["key", "sig"], "left_anti").select("key", "sig", "n", "top")
        number += 1


def _folded(bits: Column) -> list[Column]:
    """The parity bitmap of 128 bits that follows from the long one, as two numbers."""
    words = [F.conv(F.hex(F.substring(bits, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(_PARITY // 64)]
    out = []
    for side in (0, 1):
        folded = words[side]
        for word in words[side + 2 :: 2]:
            folded = folded.bitwiseXOR(word)
        out.append(folded.alias(f"b{side}"))
    return out


def _quota(members: Column, alone: Column, number: int, join: Join) -> Column:
    """How many pivots a list gets in round ``number``: all its members if it is short.

    Members of a list that holds copies soon share a component, so few pivots do at first. A list most of
    whose members are still alone after a round must be compared pair by pair, and gets many. Both numbers grow
    by ``growth`` in each round, so the number of rounds grows with the logarithm of the longest list. Pairs that sizes and places rule out leave the join before it makes a row.
    """
    few, some, many = join.pivots
    scattered = alone * 100 >= members * join.scattered_percent
    grown = some * join.growth ** max(0, number - 1)
    long = F.lit(few) if number == 0 else F.when(scattered, F.lit(many * join.growth ** (number - 1))).otherwise(F.lit(grown))
    return F.when(members <= join.short, F.lit(join.short)).otherwise(long)


def join_components(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    profiles = table(_profiles(docs, doc_id, text, join), "profiles", folder)
    roots = _links(docs, profiles, doc_id, text, join, folder)
    rows = profiles.select("doc", "n", "sig")
    if roots is not None:
        rows = rows.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("doc", "n", F.coalesce("root", "sig").alias("root"))
    else:
        rows = rows.select("doc", "n", F.col("sig").alias("root"))
    lowest = rows.where("root is not null").groupBy("root").agg(F.min("doc").alias("low"))
    return rows.join(lowest, "root", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("low", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component, and every document without words."""
    rows = join_components(docs.select(doc_id, text), join, doc_id, text)
    keep = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, F.col(doc_id).eqNullSafe(F.col("_keep")), "left_semi")
    return kept.dropDuplicates([doc_id, text])
