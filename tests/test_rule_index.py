"""Indexed rules against the compiled ones, scopes of any depth, and rule files with their extension block."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.operators import rule_index, rules
from entityops.sources import configs

DDL = "id int, country string, name string, total double, placed date, paid boolean, code string, rows array<struct<kind:string,iban:string,total:double,parts:array<struct<no:int,note:string>>>>"


def records(spark, n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = lambda: [(k, rng.choice(["x", None, " "])) for k in range(rng.randint(0, 3))]
        nested = rng.choice([None, [(rng.choice(["a", "b", None]), rng.choice(["DE1", "", None]), float(k), parts()) for k in range(rng.randint(0, 3))]])
        out.append((i, rng.choice(["aa", "BB ", "CC", None]), rng.choice(["Ann", "bob", "", None, "42"]), rng.choice([0.0, 5.5, 99.0, None]), rng.choice([dt.date(2024, 1, 1), dt.date(2024, 6, 5), None]), rng.choice([True, False, None]), rng.choice(["A1", "B-2", "2024-02-03", " "]), nested))
    return spark.createDataFrame(out, DDL)


def random_rules(rng, n, scopes=("$",)):
    fields = ["name", "total", "placed", "paid", "code", "gone", "iban", "kind"]
    literals = [(), ("Ann",), ("5.5",), ("99", "Ann"), ("2024-02-01",), ("True",), ("3",), ("A1", "B-2"), ("^[A-Z]",)]
    found = []
    for k in range(n):
        conditions = tuple(
            rules.Condition(rng.choice(fields), op, ("^[A-Z]",) if op == "matches" else ("3",) if op.startswith("length") or op == "dateWithinDays" else rng.choice(literals), rng.choice([*C.ACTION_TYPES, None]), tuple(rng.sample(fields, 2)))
            for op in rng.sample(C.BASE_OPERATORS + C.EXTRA_OPERATORS, 3)
        )
        dependencies = (rules.Dependency("conditional", conditions), *rng.choice([(), (rules.Dependency("atLeastOne", members=tuple(rng.sample(fields, 2))),)]))
        found.append(rules.Rule(rng.choice(fields), rng.choice([f"r{k}", None]), rng.random() < 0.3, rng.random() < 0.8, rng.choice([None, "^A"]), rng.choice(scopes), rng.choice(["active", "active", "draft"]), rng.choice([("save",), ("create", "save")]), dependencies))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_indexed_rules_equal_compiled_ones(spark, seed):
    rng = random.Random(seed)
    table, sets = records(spark, seed=seed), {c: random_rules(rng, 7, ("$", "$", "$.rows[*]")) for c in ("AA", "BB")}
    as_of = F.lit("2024-06-04").cast("date")
    got = rule_index.evaluate_rulesets(table, sets, ["id"], phase="save", as_of=as_of)
    want = [rules.evaluate_rules(table.where(F.upper(F.trim("country")) == c), r, ["id"], "save", as_of).select(got.columns) for c, r in sets.items()]
    assert sorted(map(str, got.collect())) == sorted(str(r) for w in want for r in w.collect())


def test_scopes_with_conditions_at_each_level(spark):
    table = records(spark, 40)
    for scope, inner in {
        "$.rows[?(@.kind=='a')].parts[*]": lambda r, p: r.kind == "a",
        "$.rows[*].parts[?(@.note!=\"x\")]": lambda r, p: p.note is not None and p.note != "x",
        "$.rows[?(@.total == 1.0)].parts[?(@.no==0)]": lambda r, p: r.total == 1.0 and p.no == 0,
        "$.rows[1].parts[*]": lambda r, p: r.total == 1.0,
    }.items():
        want = {(x.id, f"rows.{i}.parts.{k}") for x in table.collect() for i, r in enumerate(x["rows"] or []) for k, p in enumerate(r.parts) if inner(r, p)}
        assert {(r.id, r._path) for r in rule_index.scope_rows(table, scope, ["id"]).collect()} == want and want, scope
    for wrong in ("$..iban", "$.rows[1:2]", "$.rows[0,1]", "rows[*]", "$.rows[?(@.a<3)]", "@.iban", "$.rows[?(@.a.b=='c')]", "$.rows[(1)]", ""):
        with pytest.raises(ValueError, match="unsupported scope"):
            rule_index.scope_steps(wrong)


def test_last_rule_of_overlapping_scopes_gives_the_baseline(spark):
    table = spark.createDataFrame([(1, "AA", [("a", "x"), ("b", None)])], "id int, country string, rows array<struct<kind:string,iban:string>>")
    sets = {"AA": [rules.Rule("iban", "one", False, scope="$.rows[*]"), rules.Rule("iban", "two", True, scope="$.rows[?(@.kind=='b')]")]}
    got = {r.path: (r.is_required, r.rule_ids) for r in rule_index.evaluate_rulesets(table, sets, ["id"]).collect()}
    assert got == {"rows.0.iban": (False, ["one"]), "rows.1.iban": (True, ["two"])}
    row_rule = rules.Rule("iban", "three", scope="$.rows[*]", dependencies=(rules.Dependency("conditional", (rules.Condition("kind", "equals", ("b",), "makeRequired", ("iban",)),)),))
    for bind, required in ((False, [False, False]), (True, [False, True])):
        assert [r.is_required for r in rule_index.evaluate_rulesets(table, {"aa": [row_rule]}, ["id"], bind_rows=bind).orderBy("path").collect()] == required


def test_expressions_do_not_grow_with_the_rules(spark):
    table = records(spark, 5)

    def lambdas(n):
        made = [rules.Rule("name", f"r{k}", dependencies=(rules.Dependency("conditional", (rules.Condition("total", "gt", (str(k),), "makeRequired", ("name", "code")),)),)) for k in range(n)]
        plan = rule_index.evaluate_rulesets(table, {"AA": made, "BB": made[: n // 2]}, ["id"])
        plan.collect()
        return plan._jdf.queryExecution().analyzed().toString().count("lambdafunction")

    assert lambdas(10) == lambdas(1000)


def test_rule_files_with_the_extension_block(spark, tmp_path):
    x = [{"ruleId": "a.1", "status": "active", "phases": ["submit"], "scope": "$.rows[*]", "targets": ["@.iban"]}, {"ruleId": "a.2"}, None]
    for code, blocks in (("aa", x), ("bb", x[2:])):
        body = {"iso2CountryCode": code, "rules": [{"fieldName": f"f{k}", "isRequired": True} | ({"x": b} if b else {}) for k, b in enumerate(blocks)]}
        (tmp_path / f"{code}.json").write_text(json.dumps(body))
    sets = configs.load_rulesets(spark, str(tmp_path))
    assert {c: [(r.rule_id, r.status, r.scope, r.phases) for r in found] for c, found in sets.items()} == {
        "AA": [("a.1", "active", "$.rows[*]", ("submit",)), ("a.2", "draft", "$", configs.DEFAULT_PHASES), (None, "active", "$", configs.DEFAULT_PHASES)],
        "BB": [(None, "active", "$", configs.DEFAULT_PHASES)],
    }
    assert [r.field for r in rules.active(sets["AA"], "save")] == ["f2"] and [r.field for r in rules.active(sets["AA"], "submit")] == ["f0", "f2"]
    flat, _, _ = configs.read_rulesets(spark, str(tmp_path))
    got = {(r.country, r.field_name): (r.rule_id, r.status, r.scope, r.phases, r.targets) for r in flat.collect()}
    assert got["AA", "f0"] == ("a.1", "active", "$.rows[*]", ["submit"], ["@.iban"]) and got["AA", "f1"][1] == "draft" and got["BB", "f0"] == (None, None, "$", None, None)
    with pytest.raises(ValueError):
        configs.load_rulesets(spark, str(tmp_path), limit=2)
