"""Repair of conversations: the cheapest edits that give ``(system)? (user assistant)+``, or nothing.

Edits, in order of their initials: Delete a turn (3), Insert an empty turn of the user or the assistant (2), Keep
(0), Rerole to user or assistant (2). Blank turns and repeats of an earlier turn (same role and text) must go; a
truncated turn that stays costs 1. Among the cheapest series of edits the least in ASCII order is taken.

Least costs to the end are a vector of four numbers, one for each state (nothing yet, after the system, after a
user, after an assistant), computed from the last turn to the first (Viterbi). Long conversations are cut into
chunks that work at the same time: every chunk starts from a speculative vector at its end, that of the end of a
conversation. Fix-up passes hand each chunk the vector its successor really begins with and run it again, but
only until both runs differ by a constant, since then they take the same edits; passes end when no vector changed
otherwise. Stitched in this way, the vectors tell at every turn which edits lie on a cheapest path, and the
trace takes the least. A chunk's trace maps the state before it to the state after it; the maps of successive
chunks are composed by doubling until they no longer depend on the state before.

What is sorted and cut are turn numbers, role classes and digests, counted first (copies of a row are one row
with a number); deleted turns are only counted, so that all chunks of a conversation but those at the edges of
a task hold turns to decide on. Texts are joined to the edits at the end, by digest. A conversation that holds
a third of all rows lies in many ranges and chunks.

Defined results: null roles and texts, and empty roles, count as one space. Turns are sorted by number, nulls first;
turns of one number by role (system, user, assistant, others) and a digest of role and text. Null conversation
ids are one conversation. Extra columns are ignored. A conversation without turns has no row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from entityops.llm.storage import shared_folder, table

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# Role classes, and white space as the definition of a word has it.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
SOLID = "[^\\x20\\x09-\\x0D]"

# States: 0 nothing yet, 1 after the system, 2 after a user, 3 after an assistant; 0 and 3 may be the last.
_WANTED = (USER, USER, ASSISTANT, USER)
_AFTER_WANTED = (2, 2, 3, 2)
_FAR = 1 << 30


def _after(state: int, role: int) -> int | None:
    """The state after a turn of ``role``, if it may stand there."""
    if role == SYSTEM:
        return 1 if state == 0 else None
    return _AFTER_WANTED[state] if role == _WANTED[state] else None


def _with_inserts(costs) -> tuple[int, ...]:
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[_AFTER_WANTED[s]]) for s, c in enumerate(out)]
    return tuple(out)


END = _with_inserts((0, _FAR, _FAR, 0))


@cache
def _step(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs to the end before a turn, by state; ``code`` is its role class, plus 4 if it is truncated."""
    role, mark = code % 4, TRUNCATED * (code // 4)
    out = []
    for s in range(4):
        kept = _after(s, role)
        out.append(min(DELETE + after[s], REROLE + mark + after[_AFTER_WANTED[s]], _FAR if kept is None else mark + after[kept]))
    return _with_inserts(out)


def _relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


@cache
def _before(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    return _relative(_step(after, code))


@cache
def _edit(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    """The least series of edits up to and with one turn that lies on a cheapest path; the state after it; its cost."""
    here, role, mark = _step(after, code), code % 4, TRUNCATED * (code // 4)
    edits, paid = "", 0
    while True:
        kept, wanted = _after(state, role), _AFTER_WANTED[state]
        if DELETE + after[state] == here[state]:
            return edits + "D", state, paid + DELETE
        if INSERT + here[wanted] == here[state]:
            edits, state, paid = edits + "I", wanted, paid + INSERT
        elif kept is not None and mark + after[kept] == here[state]:
            return edits + "K", kept, paid + mark
        else:
            return edits + "R", wanted, paid + REROLE + mark


@cache
def _last_edits(state: int) -> str:
    edits = ""
    while END[state]:
        edits, state = edits + "I", _AFTER_WANTED[state]
    return edits


def vectors(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The cost vector after each turn; the vector before all of them is the first."""
    out = [after]
    for code in reversed(codes):
        out.append(_before(out[-1], code))
    return out[::-1]


def first_vector(codes: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        after = _before(after, code)
    return after


def fix_up(codes: bytes, used: tuple[int, ...], now: tuple[int, ...], first: tuple[int, ...]) -> tuple[int, ...]:
    """The first vector with ``now`` at the end, where ``used`` gave ``first``: both run until they differ by a constant."""
    for code in reversed(codes):
        if used == now:
            return first
        used, now = _before(used, code), _before(now, code)
    return now


def trace(codes: bytes, deleted: list[int], after: tuple[int, ...], state: int, last: bool) -> tuple[list[str], int, int]:
    """Edits of each turn and of what follows the last one, the state at the end and the cost.

    ``deleted`` has the number of turns that must go before each turn, and after the last one.
    """
    steps, cost = [], DELETE * sum(deleted)
    costs = vectors(codes, after)
    for k, code in enumerate(codes):
        edits, state, paid = _edit(costs[k + 1], code, state)
        steps.append("D" * deleted[k] + edits)
        cost += paid
    tail = _last_edits(state) if last else ""
    return [*steps, "D" * deleted[-1] + tail], state, cost + INSERT * len(tail)


def exit_state(codes: bytes, costs: list[tuple[int, ...]], state: int) -> int:
    for k, code in enumerate(codes):
        state = _edit(costs[k + 1], code, state)[1]
    return state


@dataclass(frozen=True)
class Repair:
    """``summary``: a row a conversation; ``turns``: the repaired conversations, a row a turn (see ``repair``)."""

    summary: DataFrame
    turns: DataFrame


_STATS = ["n_turns", "blank", "duplicate", "truncated", "illegal", "n_numbers"]


class _Cutter:
    """Chunks of a stream of sorted rows; closed at the end of a conversation, of the stream, or by size."""

    def __init__(self, size: int):
        self.size, self.no, self.rows, self.now = size, 0, [], None

    def add(self, conv, turn, role, key, kind, n):
        now = self.now
        if now is not None and (now["conv"] != conv or len(now["codes"]) >= self.size):
            self.close(more=now["conv"] == conv)
            now = None
        if now is None:
            now = self.now = {"conv": conv, "no": self.no, "codes": bytearray(), "deleted": [0], "keys": bytearray(), "first_role": role, "first_turn": turn, "last_role": None}
            now |= dict.fromkeys(_STATS, 0) | {"least": turn, "turn": None, "more": False}
            self.no += 1
            new_number = turn is not None
        else:
            now["illegal"] += not _legal(now["last_role"], role)
            new_number = turn != now["turn"]
        now["n_turns"] += n
        now["illegal"] += n - 1  # copies: no role may follow itself
        now["n_numbers"] += new_number
        if now["least"] is None:
            now["least"] = turn
        now["turn"], now["last_role"] = turn, role
        if kind == "blank":
            now["blank"] += n
            now["deleted"][-1] += n
        elif kind == "duplicate":
            now["duplicate"] += n
            now["deleted"][-1] += n
        else:
            now["codes"].append(role + 4 * (kind == "truncated"))
            now["keys"] += key
            now["truncated"] += kind == "truncated"
            now["duplicate"] += n - 1
            now["deleted"].append(n - 1)

    def close(self, more: bool = False, ends: bool = False):
        self.rows.append(self.now | {"more": more, "ends": ends})
        self.now = None


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _cut(sorted_rows: DataFrame, size: int) -> DataFrame:
    """Chunks of sorted rows (_c, turn, role, key, kind, n); ``part`` and ``no`` give their order."""
    conv = sorted_rows.schema["_c"].dataType
    fields = [("_c", conv), ("part", T.IntegerType()), ("no", T.LongType()), ("codes", T.BinaryType()), ("deleted", T.ArrayType(T.LongType())), ("keys", T.BinaryType())]
    fields += [(c, T.LongType()) for c in _STATS] + [("first_role", T.IntegerType()), ("last_role", T.IntegerType())]
    fields += [(c, T.LongType()) for c in ("first_turn", "least", "turn")] + [("more", T.BooleanType()), ("ends", T.BooleanType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, cutter = to_arrow_schema(schema), TaskContext.get().partitionId(), _Cutter(size)

        def out():
            rows, cutter.rows = cutter.rows, []
            columns = [[part if f.name == "part" else r["conv" if f.name == "_c" else f.name] for r in rows] for f in arrow]
            return pa.RecordBatch.from_arrays([pa.array(map(bytes, c) if pa.types.is_binary(f.type) else c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("_c", "turn", "role", "key", "kind", "n")]):
                cutter.add(*row)
                if len(cutter.rows) >= 1000 or cutter.rows and cutter.rows[-1]["more"]:
                    yield out()
        if cutter.now is not None:
            cutter.close(ends=True)
        if cutter.rows:
            yield out()

    return sorted_rows.select("_c", "turn", "role", "key", "kind", "n").mapInArrow(run, schema)


def _mapped(df: DataFrame, fn, **new) -> DataFrame:
    """``df`` with new columns, from ``fn`` of a row's dict to their values."""
    names = [c for c in df.columns if c not in new]
    kept = df.select(*names, *[c for c in new if c in df.columns])
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField(k, v) for k, v in new.items()])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [fn(r) for r in batch.to_pylist()]
            made = [pa.array([r[k] for r in rows], arrow.field(k).type) for k in new]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in names], *made], schema=arrow)

    return kept.mapInArrow(run, schema)


_VECTOR = T.ArrayType(T.IntegerType())


def _linked(chunks: DataFrame, folder: str) -> DataFrame:
    """Chunks with a neighbour of the same conversation, with ``next`` and ``prev`` (part, no) of it.

    Only chunks at an edge of a task, or closed by size, can have one.
    """
    ahead = Window.orderBy("part")
    parts = chunks.groupBy("part").agg(F.max("no").alias("_top")).select("part", F.lead("part").over(ahead).alias("_next_part"))
    more = chunks.where("more").select("part", (F.col("no") + 1).alias("no")).withColumn("_after_more", F.lit(True))
    edge = chunks.join(more, ["part", "no"], "left").where("no = 0 OR more OR ends OR _after_more").join(parts, "part")
    place = F.struct("part", "no")
    follows = F.when(F.col("more"), F.struct("part", (F.col("no") + 1).alias("no"))).when(F.col("ends"), F.struct(F.col("_next_part").alias("part"), F.lit(0).cast("long").alias("no")))
    edge = table(edge.select("_c", place.alias("at"), follows.alias("_follows"), "codes", "first_role", "last_role", "first_turn", "turn"), "edges", folder)
    n = edge.select(F.col("_c").alias("_nc"), F.col("at").alias("next"), F.col("first_role").alias("_next_role"), F.col("first_turn").alias("_next_turn"))
    ahead_of = edge.join(n, (F.col("_follows") == F.col("next")) & F.col("_c").eqNullSafe(F.col("_nc")), "left")
    legal = F.concat_ws(",", "last_role", "_next_role").isin([f"{a},{b}" for a in range(4) for b in range(4) if _legal(a, b)])
    ahead_of = ahead_of.select(
        "_c", "at", "codes", "next",
        (F.col("next").isNotNull() & ~legal).cast("long").alias("illegal_here"),
        F.coalesce((F.col("turn") == F.col("_next_turn")).cast("long"), F.lit(0)).alias("same_number"),
    )
    behind = ahead_of.where("next IS NOT NULL").select(F.col("next").alias("_at"), F.col("at").alias("prev"))
    return table(ahead_of.join(behind, F.col("at") == F.col("_at"), "left").drop("_at").where("next IS NOT NULL OR prev IS NOT NULL"), "linked", folder)


def _stitched(linked: DataFrame, folder: str) -> DataFrame:
    """``linked`` with ``used``, the vector at each chunk's end: speculation, then fix-up passes until none changes.

    A pass touches chunks whose successor begins with another vector than they assumed. Vectors become
    parallel within a few turns wherever a fault lets states meet; at worst there are as many passes as chunks.
    """
    current = _mapped(linked.withColumn("used", F.lit(None).cast(_VECTOR)), lambda r: {"used": list(END), "first": list(first_vector(r["codes"], END))}, used=_VECTOR, first=_VECTOR)
    current, number = table(current, "vectors-0", folder), 0
    while True:
        follows = current.select(F.col("at").alias("_n"), F.col("first").alias("really"))
        met = current.join(follows, F.col("next") == F.col("_n"), "left").drop("_n")
        if met.where("really IS NOT NULL AND really <> used").isEmpty():
            return current

        def again(r):
            if r["really"] is None or r["really"] == r["used"]:
                return {"used": r["used"], "first": r["first"]}
            return {"used": r["really"], "first": list(fix_up(r["codes"], tuple(r["used"]), tuple(r["really"]), tuple(r["first"])))}

        number += 1
        current = table(_mapped(met, again, used=_VECTOR, first=_VECTOR).drop("really"), f"vectors-{number}", folder)


def _entries(stitched: DataFrame, folder: str) -> DataFrame:
    """(at, used, next, entry, illegal_here, same_number): the state before each chunk, by composing the maps of the chunks before."""

    def exits(r):
        costs = vectors(r["codes"], tuple(r["used"]))
        found = [exit_state(r["codes"], costs, s) for s in range(4)]
        return {"exits": found if r["prev"] is not None else found[:1] * 4}

    maps = _mapped(stitched, exits, exits=_VECTOR).withColumn("back", F.col("prev"))
    current, number = table(maps, "maps-0", folder), 0
    fixed = F.array_min("exits") == F.array_max("exits")
    while not current.where(~fixed & F.col("back").isNotNull()).isEmpty():
        open_, done = current.where(~fixed & F.col("back").isNotNull()), current.where(fixed | F.col("back").isNull())
        before = current.select(F.col("at").alias("_b"), F.col("exits").alias("_e"), F.col("back").alias("_bb"))
        joined = open_.join(before, F.col("back") == F.col("_b"))
        composed = joined.withColumn("_x", F.transform("_e", lambda s: F.get("exits", s))).withColumns({"exits": F.col("_x"), "back": F.col("_bb")})
        number += 1
        current = table(done.unionByName(composed.select(*current.columns)), f"maps-{number}", folder)
    last = current.select(F.col("at").alias("_p"), F.get("exits", F.lit(0)).alias("entry"))
    return current.join(last, F.col("prev") == F.col("_p"), "left").select("at", "used", "next", F.coalesce("entry", F.lit(0)).alias("entry"), "illegal_here", "same_number")


def _key(conv: Column, role: Column, text: Column) -> Column:
    name = F.coalesce(F.concat(F.length(conv.cast("string")).cast("string"), F.lit(":"), conv.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit("/"), F.length(role).cast("string"), F.lit(":"), role, text)))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = 16384) -> Repair:
    """Faults, edits and repaired turns of every conversation.

    ``summary``: the conversation's id, gaps (turn numbers missing between the least and the largest), blank,
    duplicate, truncated (each turn counts for its first fault), illegal (neighbours that may not follow each other),
    cost, audit (initials of the edits). ``turns``: the id, part, no, at (their order), edit, role, text.
    """
    spark = turns.sparkSession
    folder = shared_folder(spark)
    named = F.when(F.coalesce(F.col(role), F.lit("")) == "", " ").otherwise(F.col(role))
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).cast("long").alias("turn"), named.alias("name"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("key", _key(F.col("_c"), F.col("name"), F.col("text")))
    initial = F.substring("name", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    solid = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", "")
    fault = F.when(solid == "", "blank").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    thin = rows.select("_c", "turn", kind.alias("role"), "key", fault.alias("fault"))
    thin = thin.groupBy("_c", "turn", "role", "key", "fault").agg(F.count("*").alias("n"))
    seen = thin.groupBy("key").agg(F.count("*").alias("_times"), F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null")).where("_times > 1")
    later = F.col("_times").isNotNull() & F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_first"))
    judged = thin.join(seen, "key", "left").withColumn("kind", F.when(F.col("fault") == "blank", "blank").when(later, "duplicate").otherwise(F.col("fault")))
    order = ["_c", "turn", "role", "key"]
    chunks = table(_cut(judged.repartitionByRange(*order).sortWithinPartitions(*order), chunk_turns), "chunks", folder)
    links = _entries(_stitched(_linked(chunks, folder), folder), folder)
    placed = chunks.withColumn("at", F.struct("part", "no")).join(links, "at", "left")

    def edits(r):
        follows = r["next"] is not None
        steps, _, cost = trace(r["codes"], r["deleted"], tuple(r["used"]) if follows else END, r["entry"] or 0, not follows)
        lines, state = [], r["entry"] or 0
        for k, step in enumerate(steps):
            for edit in step:
                if edit == "D":
                    continue
                made = _WANTED[state] if edit != "K" else r["codes"][k] % 4
                state = _after(state, made)
                lines.append({"edit": edit, "role": ROLE_NAMES[made] if edit != "K" else None, "key": None if edit == "I" else r["keys"][16 * k : 16 * k + 16]})
        return {"audit": "".join(steps), "cost": cost, "lines": lines}

    line = T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("key", T.BinaryType())])
    traced = _mapped(placed, edits, audit=T.StringType(), cost=T.LongType(), lines=T.ArrayType(line)).drop("codes", "deleted", "keys")
    traced = table(traced, "traced", folder)
    sums = {c: F.sum(c) for c in ("blank", "duplicate", "truncated", "cost")}
    numbers = F.sum("n_numbers") - F.coalesce(F.sum("same_number"), F.lit(0))
    summary = traced.groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("least") + 1 - numbers, F.lit(0)).alias("gaps"),
        *[v.alias(c) for c, v in sums.items() if c != "cost"],
        (F.sum("illegal") + F.coalesce(F.sum("illegal_here"), F.lit(0))).alias("illegal"),
        sums["cost"].alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    each = traced.select("_c", "part", "no", F.posexplode("lines").alias("at", "line")).select("_c", "part", "no", "at", "line.*")
    texts = rows.select("key", "name", "text").dropDuplicates(["key"])
    kept = each.where("key IS NOT NULL").join(texts, "key").select("_c", "part", "no", "at", "edit", F.coalesce("role", "name").alias("role"), "text")
    made = each.where("key IS NULL").select("_c", "part", "no", "at", "edit", "role", F.lit("").alias("text"))
    return Repair(summary.withColumnRenamed("_c", conv), kept.unionByName(made).withColumnRenamed("_c", conv))


def text_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256): digest of ``role:text``, newline-joined, of every repaired conversation.

    A digest takes its bytes in order, so one task streams through a conversation; it never holds more than a batch.
    """
    ordered = turns.select(F.col(conv).alias("_c"), "part", "no", "at", F.concat("role", F.lit(":"), "text").alias("line")).repartition("_c").sortWithinPartitions("_c", "part", "no", "at")
    schema = T.StructType([T.StructField("_c", ordered.schema["_c"].dataType), T.StructField("sha256", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, digest = to_arrow_schema(schema), None, None
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for conv_id, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist()):
                if digest is not None and conv_id == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv_id, hashlib.sha256()
                digest.update(line.encode())
            if len(out) >= 10000:
                yield batch_of(out)
                out = []
        if digest is not None:
            out.append((now, digest.hexdigest()))
        if out:
            yield batch_of(out)

    return ordered.select("_c", "line").mapInArrow(run, schema).withColumnRenamed("_c", conv)
