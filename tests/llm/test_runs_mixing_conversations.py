"""Periodic runs, source mixing and conversation repair on small tables, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from entityops.llm import conversations, mixing, periodic_runs
from entityops.llm.periodic_runs import Shape
from entityops.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
given = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not on this machine")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def plain_runs(words, least=6, times=4):
    """All maximal stretches for every period, each with its smallest one."""
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        i = p
        while i < n:
            begun = i
            while i < n and words[i] == words[i - p]:
                i += 1
            if i - begun + p >= max(least, times * p):
                out.setdefault((begun - p, i), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("shape", [Shape(), Shape(4, 2), Shape(10, 3)])
def test_runs_of_random_words(shape):
    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.choice("abcdefg"[: rng.choice([1, 2, 3, 5])]).encode() for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            if words:
                a = rng.randrange(len(words))
                p = rng.randint(1, (len(words) - a) // 3 + 1)
                for i in range(a, rng.randint(a, len(words))):
                    words[i] = words[a + (i - a) % p]
        want = plain_runs(words, shape.min_words, shape.min_repeats)
        assert periodic_runs.runs_of(words, shape) == want
        opens = periodic_runs._openings([words, words[2:]], shape.context)[0]
        assert periodic_runs.runs_of(words, shape, opens) == want


def test_long_texts_take_few_steps():
    rng = random.Random(1)
    for words in ([b"a"] * 20000, [b"a", b"b"] * 10000, [rng.choice([b"a", b"b"]) for _ in range(20000)]):
        periodic_runs.runs_of(words)
    assert periodic_runs.runs_of([b"a"] * 20000) == [(0, 20000, 1)]


def test_rows_of_every_kind_keep_their_runs(spark):
    rows = [(None, "a b " * 6, 1), (1, None, 2), (1, "", 3), (2, "x " * 9 + "\n", 4), (2, "x " * 9 + "\n", 4), (3, "é  \x0bé \fé  " * 3, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {(r.doc_id, r.text): r for r in periodic_runs.find_runs(table).collect()}
    assert found[None, "a b " * 6].runs == [(0, 12, 2)] and found[None, "a b " * 6].collapsed == "a b"
    assert found[1, None].runs == [] and found[1, None].collapsed == "" and found[1, ""].n_words == 0
    assert found[2, "x " * 9 + "\n"].runs == [(0, 9, 1)] and found[3, rows[5][1]].collapsed == "é "
    assert periodic_runs.find_runs(table.limit(0)).count() == 0


@given
def test_query_of_periodic_runs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = plain_runs(words), rows[d.doc_id]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        assert row.n_runs == len(runs) and row.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert row.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        found = (row.start, row.length, row.period, row.exponent_milli)
        assert found == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)


# mixing


def plain_mix(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by sharing again and again; rows are (id, text, source)."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit > epochs * sizes[s]}
        if not above:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: float(epochs * sizes[s]) for s in above}
        left -= sum(epochs * sizes[s] for s in above)
        free -= above
    return sizes, target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    sources = rng.sample(["a", "b", "é", "Z", None, "", "zz"], 5)
    rows = [(rng.choice([i, None]) if i % 9 == 0 else i, rng.choice([None, "", "x"] if i % 11 == 0 else [" w\n" * rng.randint(1, 40)]), rng.choice(sources[:1] * 4 + sources)) for i in range(400)]
    rows += rows[:50] + [(7, "one two", sources[0])] * 30
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    sizes, target = plain_mix(rows)
    out = mixing.mix_plan(table).collect()
    assert len(out) == len(rows) and sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, mixing.mix_plan(table.repartition(7)).collect())) == sorted(map(str, out))


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(1 + i % 17)), "abc"[i % 3], "x") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(table).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_texts(table, mixing.mix_plan(table)).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert rows[r.doc_id][1].startswith(r.text)
    assert all(got[i] == n for i, n in plan.items())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_plan(blank).collect()] == [(0.0, 0)] * 2


# conversations


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Every state of (rows read, what has been said) with its cheapest, then least, series of edits."""
    marks, best = faults(rows), {(0, ""): (0, "", ())}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for (k, last), (cost, audit, lines) in list(best.items()):
                for r in allowed[last] if k == i else ():
                    if r != "s":
                        new = (cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[r]))
                        best[i, r] = min(best.get((i, r), new), new)
        if i == len(rows):
            break
        (role, text), mark = rows[i], marks[i]
        for (k, last), (cost, audit, lines) in list(best.items()):
            if k != i:
                continue
            steps = [(last, (cost + 3, audit + "D", lines))]
            if mark not in ("blank", "duplicate"):
                extra = mark == "truncated"
                if role[:1] in allowed[last] and role[:1]:
                    steps.append((role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                steps += [(r, (cost + 2 + extra, audit + "R", (*lines, {"u": "user:", "a": "assistant:"}[r] + text))) for r in allowed[last] if r != "s"]
            for state, new in steps:
                best[i + 1, state] = min(best.get((i + 1, state), new), new)
    cost, audit, lines = min(best[len(rows), last] for last in ("", "a") if (len(rows), last) in best)
    turns = [r for r, _ in rows]
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, sha("\n".join(lines))


def gaps(turns):
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repaired_rows(spark, table, **options):
    done = conversations.repair(table, **options)
    digests = {r.conv_id: r.sha256 for r in conversations.text_digests(done.turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, sha(""))) for r in done.summary.collect()}


def test_vectors_meet_and_fix_ups_agree():
    rng = random.Random(2)
    for _ in range(300):
        codes, other = bytes(rng.randrange(8) for _ in range(rng.randint(0, 30))), bytes(rng.randrange(8) for _ in range(3))
        now = conversations.first_vector(other, conversations.END)
        first = conversations.first_vector(codes, conversations.END)
        assert conversations.fix_up(codes, conversations.END, now, first) == conversations.first_vector(codes, now)


@pytest.mark.parametrize("size", [1, 3, 16384])
def test_conversations_against_all_edits(spark, size):
    rng = random.Random(size)
    rows = []
    for conv in [None, *range(24)]:
        for turn in range(60 if conv == 3 else 25 if conv is None else rng.randint(1, 9)):
            number = None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2])
            rows += [(conv, number, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["a.", "b", "c!", f"{turn}.", f"{turn}?", "", None, " \n"]))] * rng.choice([1, 1, 1, 2])
    # turns in even numbers, so that the order of one number's turns is that of the docstring
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")
    found = repaired_rows(spark, table.repartition(5), chunk_turns=size)
    order = {c: k for k, c in enumerate("sua")}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if not r else r, " " if x is None else x) for c, t, r, x in rows if c == conv]

        def digest(role, text):
            name = "-" if conv is None else f"{len(str(conv))}:{conv}"
            return hashlib.md5(f"{name}/{len(role)}:{role}{text}".encode()).digest()

        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, order.get(x[1][0], 3), digest(x[1], x[2])))
        assert found[conv] == (gaps([t for t, _, _ in mine]), *plain_repair([(r, x) for _, r, x in mine])), conv
    assert repaired_rows(spark, table.limit(0)) == {}


@given
def test_query_of_conversations(spark):
    turns, given_ids = defaultdict(list), set()
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect():
        given_ids.add(r.conv_id)
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text
        turns[r.conv_id] += [(r.turn, "user" if h == 4 else r.role, text)] * {0: 0, 3: 2}.get(h, 1)
    rows = {r.conv_id: r for r in QUERIES["op11_conversation_repair"](spark, SF_DIR).collect()}
    assert set(rows) == given_ids
    for conv, row in rows.items():
        mine = sorted(turns[conv], key=lambda x: x[0])
        want = (gaps([t for t, _, _ in mine]), *plain_repair([(r, x) for _, r, x in mine])) if mine else (0, 0, 0, 0, 0, 0, "", sha(""))
        assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256) == want
