"""Duplicate search against all pairs: names alike, tax numbers, addresses, groups of any size."""

import random

import pytest

from entityops.operators import duplicates, match

FIELDS = {"tax": 25, "street": 15, "city": 15, "postal": 10, "country": 5}
DDL = "record_id long, name string, country string, street string, postal_code string, city string, tax array<struct<number:string,country:string,type_code:string,slot:string>>"


def brute(rows, top=5):
    """Every pair scored field by field."""
    out = {}
    for rid, *a in rows:
        found = []
        for oid, *b in rows:
            if rid == oid:
                continue
            (an, ac, ast, ap, ai, at), (bn, bc, bst, bp, bi, bt) = a, b
            x, y = set(an.split()), set(bn.split())
            j = len(x & y) / len(x | y) if x | y else 0
            name = round(100 * j) if j >= 0.5 else 0
            agree = {"tax": bool(set(at) & set(bt)), "street": ast == bst, "city": ai == bi, "postal": ap == bp, "country": ac == bc}
            known = {"tax": bool(at), "street": bool(ast), "city": bool(ai), "postal": bool(ap), "country": bool(ac)}
            if not (name or agree["tax"] or (ast and ai and agree["street"] and agree["city"])):
                continue
            weight = 30 * bool(an) + sum(w for f, w in FIELDS.items() if known[f])
            total = 30 * name + sum(100 * w for f, w in FIELDS.items() if known[f] and agree[f])
            found.append((-round(total / weight), oid))
        if found:
            out[rid] = [(oid, -s) for s, oid in sorted(found)[:top]]
    return out


def searched(spark, rows, **options):
    table = spark.createDataFrame([(i, n or None, c or None, s or None, p or None, t or None, [(x, None, None, None) for x in tax]) for i, n, c, s, p, t, tax in rows], DDL)
    got = {}
    for r in duplicates.search_duplicates(*match.blocking_request(table, ["record_id"]), **options).orderBy("record_id", "rank").collect():
        got.setdefault(r.record_id, []).append((r.candidate_id, round(100 * r.score)))
    return got


def generated(rng, n, hot):
    words = [f"w{k}" for k in range(14)]
    rows = []
    for i in range(n):
        name = "acme trading" if rng.random() < hot else " ".join(sorted(rng.sample(words, rng.randint(0, 4))))
        tax = sorted({rng.choice(["T1", "T2", "T3", "T4", f"U{i}"]) for _ in range(rng.randint(0, 2))})
        rows.append((i, name, rng.choice(["IN", "US", ""]), rng.choice(["high street", "low road", ""]), rng.choice(["1", "2", ""]), rng.choice(["paris", "rome", ""]), tax))
    return rows


@pytest.mark.parametrize(("seed", "small_group"), [(1, 64), (2, 3), (3, 0)])
def test_search_equals_all_pairs(spark, seed, small_group):
    rng = random.Random(seed)
    rows = generated(rng, 110, 0.35) + [(1000 + k, "acme trading", "IN", "high street", "1", "paris", ["T1"]) for k in range(20)]
    rng.shuffle(rows)
    assert searched(spark, rows, small_group=small_group) == brute(rows)


def test_search_of_nothing(spark):
    assert searched(spark, []) == {}
    assert searched(spark, [(1, "", "", "", "", "", []), (2, "", "", "", "", "", [])]) == {}


@pytest.mark.parametrize("least", [0.25, 0.34, 0.5, 0.6, 0.8, 1.0])
def test_no_name_alike_is_missed(spark, least):
    rng = random.Random(int(100 * least))
    names = list({tuple(sorted(rng.sample("abcdefghij", rng.randint(1, 7)))) for _ in range(150)})
    table = spark.createDataFrame([(k, list(t)) for k, t in enumerate(names)], "nid long, tokens array<string>")
    got = {(r.a, r.b): r.name_score for r in duplicates.similar_names(table, least).collect()}
    want = {}
    for i, x in enumerate(names):
        for k, y in enumerate(names):
            j = len({*x} & {*y}) / len({*x} | {*y})
            if j >= least:
                want[i, k] = round(100 * j)
    assert got == want


def test_names_compared_grow_with_the_names(spark):
    """Names of generated words, each word in about twenty names and two words in all of them."""
    compared = []
    for n in (1000, 4000):
        rng = random.Random(n)
        rows = [(k, ["company", "trading", *{f"w{rng.randrange(n // 7)}" for _ in range(3)}]) for k in range(n)]
        rows += [(n + k, [*t[:-1], "branch"]) for k, t in rows[: n // 10]]
        compared.append(duplicates.compared_names(spark.createDataFrame(rows, "nid long, tokens array<string>"), 0.5).count())
    assert 0 < compared[1] < 6 * compared[0] and compared[1] < 40 * 4400
