"""Rule sets of many countries in one pass: conditions evaluated once into bits, actions indexed by their targets.

``rules.evaluate_rules`` builds one expression per field out of all rules. Here every different condition of a country is one
element of a bit array, computed once per record: the literals of one field and operator are data that one test runs
over. What each field's rules make of the bits is data as well. The expressions grow with the number of different pairs of
field and operator, and with nothing else.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from entityops.functions import text as T
from entityops.functions.ordering import last_row
from entityops.operators.rules import Rule, active, as_text, group_id, truthless

_STATE = """array<struct<field_name:string,ordinal:int,required:boolean,applicable:boolean,pattern:string,rule_id:string,groups:map<string,string>,
actions:array<struct<condition:int,kind:string,value:boolean,owner:string>>>>"""


# --- scopes ----------------------------------------------------------------------------------

_STEP = re.compile(
    r"\.(?P<name>\w+)(?:\[(?:(?P<all>\*)|(?P<at>\d+)|\?\(@\.(?P<field>\w+)\s*(?P<op>==|!=|=)\s*(?:'(?P<single>[^']*)'|\"(?P<double>[^\"]*)\"|(?P<bare>-?[\w.]+))\))\])?"
)


@dataclass(frozen=True)
class Step:
    """One level of a scope: a member, all elements of an array, one of them, or those whose field (not) equals a literal."""

    name: str
    kind: str = "member"
    at: int = 0
    field: str = ""
    equal: bool = True
    literal: str = ""


def scope_steps(scope: str) -> tuple[Step, ...]:
    """The levels of ``$``, ``$.a[*]``, ``$.a[0].b``, ``$.a[?(@.f=='v')].b[*]``; anything else is an error."""
    steps, place = [], 1
    while scope.startswith("$") and place < len(scope):
        found = _STEP.match(scope, place)
        if not found:
            break
        g = found.groupdict()
        if g["all"]:
            steps.append(Step(g["name"], "all"))
        elif g["at"] is not None:
            steps.append(Step(g["name"], "at", at=int(g["at"])))
        elif g["field"]:
            literal = next(v for v in (g["single"], g["double"], g["bare"]) if v is not None)
            literal = {"true": "True", "false": "False"}.get(literal, literal) if g["bare"] else literal
            steps.append(Step(g["name"], "where", field=g["field"], equal=g["op"] != "!=", literal=literal))
        else:
            steps.append(Step(g["name"]))
        place = found.end()
    if not scope.startswith("$") or place != len(scope):
        raise ValueError(f"unsupported scope {scope!r}")
    return tuple(steps)


def scope_rows(records: DataFrame, scope: str, keep: list[str]) -> DataFrame:
    """(keep, _path, _row): every row of a scope with its dotted path of names and indices.

    One lateral ``posexplode`` a level; a level's condition is applied before the next one is opened. An element without the
    field of a condition, or null, meets neither ``==`` nor ``!=``.
    """
    rows, holder = records, None
    path: Column = F.lit("")
    for number, step in enumerate(scope_steps(scope)):
        value = F.col(f"`{step.name}`") if holder is None else F.col(holder)[step.name]
        prefix = F.concat(path, F.lit(step.name if number == 0 else f".{step.name}"))
        if step.kind == "member":
            rows = rows.select(*keep, prefix.alias("_path"), value.alias("_row")).where("_row IS NOT NULL")
        elif step.kind == "at":
            rows = rows.select(*keep, F.concat(prefix, F.lit(f".{step.at}")).alias("_path"), F.get(value, F.lit(step.at)).alias("_row")).where("_row IS NOT NULL")
        else:
            rows = rows.select(*keep, prefix.alias("_path"), F.posexplode(value).alias("_at", "_row"))
            rows = rows.select(*keep, F.concat("_path", F.lit("."), F.col("_at").cast("string")).alias("_path"), "_row").where("_row IS NOT NULL")
            if step.kind == "where":
                struct = rows.schema["_row"].dataType
                if step.field not in struct.fieldNames():
                    return rows.where(F.lit(False))
                same = as_text(F.col("_row")[step.field], struct[step.field].dataType) == step.literal
                rows = rows.where(F.coalesce(same if step.equal else ~same, F.lit(False)))
        holder, path = "_row", F.col("_path")
    return rows


# --- the index -------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleIndex:
    """tests: by (field, operator) the different literals of each country; states: by (country, scope) what fields start with and their actions.

    A condition's bit is its place when the tests of its country are put one after the other.
    """

    tests: dict[tuple[str, str], dict[str, list[tuple[str, ...]]]]
    states: dict[tuple[str, str], list[dict]]


def build_index(rulesets: dict[str, list[Rule]], phase: str | None = None) -> RuleIndex:
    """The index of the rules that take part in ``phase``; countries are upper case codes."""
    tests: dict[tuple[str, str], dict[str, list[tuple[str, ...]]]] = {}
    acting = {c: [(r, d, x) for r in active(rules, phase) for d in r.dependencies if d.kind == "conditional" for x in d.conditions if x.action is not None] for c, rules in rulesets.items()}
    for country, found in acting.items():
        for _, _, c in found:
            literals = tests.setdefault((c.field, c.operator), {}).setdefault(country, {})
            literals.setdefault(c.values, len(literals))
    states: dict[tuple[str, str], list[dict]] = {}
    for country, rules in rulesets.items():
        live = active(rules, phase)
        starts, bits = {}, 0
        for key, by_country in tests.items():
            starts[key] = bits
            bits += len(by_country.get(country, {}))
        actions: dict[str, list[dict]] = {}
        groups: dict[str, dict[str, str]] = {}
        for owner in live:
            for dependency in owner.dependencies:
                if dependency.kind != "conditional":
                    for member in dependency.members:
                        groups.setdefault(member, {})[dependency.kind] = group_id(dependency.members)
        for owner, _, c in acting[country]:
            bit = starts[c.field, c.operator] + tests[c.field, c.operator][country][c.values]
            kind = "required" if c.action in ("makeRequired", "makeRequiredOneOf", "makeOptional") else "applicable"
            for target in dict.fromkeys(c.targets):
                actions.setdefault(target, []).append({"condition": bit, "kind": kind, "value": c.action != "makeOptional", "owner": owner.rule_id})
        by_scope: dict[str, dict[str, dict]] = {}
        for ordinal, rule in enumerate(live):
            by_scope.setdefault(rule.scope, {})[rule.field] = {
                "field_name": rule.field, "ordinal": ordinal, "required": rule.required, "applicable": rule.applicable, "pattern": rule.pattern,
                "rule_id": rule.rule_id, "groups": groups.get(rule.field), "actions": actions.get(rule.field, []),
            }
        states |= {(country, scope): list(by_field.values()) for scope, by_field in by_scope.items()}
    return RuleIndex({key: {c: list(values) for c, values in by_country.items()} for key, by_country in tests.items()}, states)


def _fields(df: DataFrame, row: StructType | None) -> dict[str, tuple[Column, object]]:
    found = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, StructType))}
    if row is not None:
        found |= {f.name: (F.col("_row")[f.name], f.dataType) for f in row.fields if not isinstance(f.dataType, (ArrayType, StructType))}
    return found


def _test(op: str, seen: dict[str, Column], x: Column, as_of: Column | None) -> Column:
    """``rules.predicate`` with literals from ``x`` (v: texts, n and d: the first as number and date); never null."""
    text, present, first = seen["text"], seen["present"], F.get(x["v"], F.lit(0))
    never = F.lit(False)

    def sure(c: Column) -> Column:
        return F.coalesce(c, never)

    def ordering(compare) -> Column:
        numeric = seen["number"].isNotNull() & x["n"].isNotNull()
        return present & sure(F.when(numeric, compare(seen["number"], x["n"])).otherwise(compare(seen["date"], x["d"])))

    today = as_of if as_of is not None else F.current_date()
    builders = {
        "exists": lambda: present,
        "isNotBlank": lambda: present,
        "notExists": lambda: ~present,
        "isBlank": lambda: ~present,
        "equals": lambda: present & sure(text == first),
        "notEquals": lambda: ~(present & sure(text == first)),
        "in": lambda: present & sure(F.array_contains(x["v"], text)),
        "notIn": lambda: ~(present & sure(F.array_contains(x["v"], text))),
        "eqIgnoreCase": lambda: present & sure(F.lower(text) == F.lower(first)),
        "gt": lambda: ordering(lambda a, b: a > b),
        "gte": lambda: ordering(lambda a, b: a >= b),
        "lt": lambda: ordering(lambda a, b: a < b),
        "lte": lambda: ordering(lambda a, b: a <= b),
        "startsWith": lambda: present & sure(F.startswith(text, first)),
        "endsWith": lambda: present & sure(F.endswith(text, first)),
        "contains": lambda: present & sure(F.contains(text, first)),
        "matches": lambda: present & sure(F.regexp_like(text, first)),
        "lengthEq": lambda: sure(seen["length"] == first.try_cast("int")),
        "lengthGte": lambda: sure(seen["length"] >= first.try_cast("int")),
        "lengthLte": lambda: sure(seen["length"] <= first.try_cast("int")),
        "dateBefore": lambda: sure(seen["date"] < x["d"]),
        "dateAfter": lambda: sure(seen["date"] > x["d"]),
        "dateWithinDays": lambda: sure(F.abs(F.datediff(today, seen["date"])) <= first.try_cast("int")),
    }
    return builders[op]()


_TYPED = "map<string,array<struct<v:array<string>,n:double,d:date>>>"


def _typed_literals(spark: SparkSession, index: RuleIndex) -> list[str]:
    """For each test, as JSON, the literals of each country with the first as number and as date, read as the records' values are."""
    typed = lambda x: F.struct(x.alias("v"), F.get(x, F.lit(0)).try_cast("double").alias("n"), T.iso_date(F.get(x, F.lit(0))).alias("d"))
    tables = []
    for (_, op), by_country in index.tests.items():
        values = {c: [[T.java_regex(v) for v in lit] if op == "matches" else list(lit) for lit in literals] for c, literals in by_country.items()}
        read = F.from_json(F.lit(json.dumps(values)), "map<string,array<array<string>>>")
        tables.append(F.to_json(F.transform_values(read, lambda _, lists: F.transform(lists, typed))))
    return list(spark.range(1).select(F.array(*tables)).first()[0]) if tables else []


def _tested(literals: Column, op: str, seen: dict[str, Column], as_of: Column | None) -> Column:
    return F.coalesce(F.transform(literals, lambda x: _test(op, seen, x, as_of)), F.array().cast("array<boolean>"))


def _with_bits(rows: DataFrame, index: RuleIndex, fields: dict, as_of: Column | None) -> DataFrame:
    """``rows`` with ``_bits``: whether each condition of the row's country holds. What tests need of a field is computed once."""
    names = rows.columns
    parts, prepared, typed = [], {}, _typed_literals(rows.sparkSession, index)
    for number, ((field, op), by_country) in enumerate(index.tests.items()):
        column, data_type = fields.get(field, (F.lit(None).cast("string"), None))
        text = as_text(column, data_type)
        if field not in prepared:
            at = f"_f{len(prepared)}"
            facts = {"text": text, "present": T.present(text), "number": text.try_cast("double"), "date": T.iso_date(text)}
            prepared[field] = (at, F.struct(*[c.alias(k) for k, c in facts.items()], F.length(F.when(truthless(column, data_type), F.lit("")).otherwise(F.coalesce(text, F.lit("")))).alias("length")).alias(at))
        at = prepared[field][0]
        seen = {k: F.col(f"{at}.{k}") for k in ("text", "present", "number", "date", "length")}
        table = F.from_json(F.lit(typed[number]), _TYPED)
        parts.append(_tested(F.element_at(table, F.col("_country")), op, seen, as_of))
    if not parts:
        return rows.withColumn("_bits", F.array().cast("array<boolean>"))
    # the generator keeps what is prepared from being repeated in every test
    held = F.explode(F.array(F.struct(*[c for _, c in prepared.values()]))).alias("_facts")
    ready = rows.select(*names, held).select(*names, *[F.col(f"_facts.{at}").alias(at) for at, _ in prepared.values()])
    return ready.select(*names, F.concat(*parts).alias("_bits"))


def _states_of(rows: DataFrame, index: RuleIndex, scope: str, keys: list[str], values: Column) -> DataFrame:
    """One row for each field that the rules of the row's country have in ``scope``."""
    plans = {code: states for (code, s), states in index.states.items() if s == scope}
    table = F.from_json(F.lit(json.dumps(plans)), f"map<string,{_STATE}>")
    wide = rows.withColumn("_values", values).select(*keys, "_path", "_bits", "_values", F.explode(F.element_at(table, F.col("_country"))).alias("_s"))

    def folded(kind: str, start: str) -> Column:
        return F.aggregate(F.filter("_hits", lambda a: a["kind"] == kind), F.col(f"_s.{start}"), lambda _, a: a["value"])

    wide = wide.withColumn("_hits", F.filter("_s.actions", lambda a: F.get("_bits", a["condition"])))
    name = F.col("_s.field_name")
    applicable = folded("applicable", "applicable")
    ids = F.array_distinct(F.array_compact(F.concat(F.array("_s.rule_id"), F.transform("_hits", lambda a: a["owner"]))))
    return wide.select(
        *keys, F.when(F.col("_path") == "", name).otherwise(F.concat_ws(".", "_path", name)).alias("path"), name.alias("field_name"),
        folded("required", "required").alias("is_required"), applicable.alias("is_applicable"), applicable.alias("is_visible"),
        F.col("_s.pattern").alias("regex_pattern"), ids.alias("rule_ids"), F.col("_s.groups").alias("groups"),
        F.element_at("_values", name).alias("value"), F.col("_s.ordinal").alias("_ordinal"),
    )


def evaluate_rulesets(
    records: DataFrame, rulesets: dict[str, list[Rule]], keys: list[str], country: str = "country", phase: str | None = None,
    as_of: Column | None = None, bind_rows: bool = False,
) -> DataFrame:
    """Effective state of every field instance, by the rules of the record's country; other countries' records have none.

    As ``rules.evaluate_rules``, with scopes of any depth and with conditions at each level. Where several scopes name one
    instance, its last rule gives the baseline. One narrow pass for each scope; only scopes that may name the same
    instance are brought together by record and path. ``bind_rows``: conditions see the fields of the row first.
    """
    rulesets = {k.strip().upper(): v for k, v in rulesets.items()}
    index = build_index(rulesets, phase)
    code = F.upper(F.trim(F.col(country)))
    known = records.where(code.isin(*rulesets)).withColumn("_country", code)
    top = _with_bits(known, index, _fields(records, None), as_of)
    shapes: dict[tuple[str, ...], list[DataFrame]] = {}
    plain = _fields(records, None)
    for scope in dict.fromkeys(s for _, s in index.states):
        wanted = {s["field_name"] for (_, sc), states in index.states.items() if sc == scope for s in states}
        if scope == "$":
            rows, fields = top.withColumn("_path", F.lit("")), plain
        else:
            rows = scope_rows(top, scope, records.columns + ["_country", "_bits"])
            kind = rows.schema["_row"].dataType
            fields = _fields(records, kind if isinstance(kind, StructType) else None)
            if bind_rows:
                rows = _with_bits(rows.drop("_bits"), index, fields, as_of)
        pairs = [x for name in sorted(wanted & set(fields)) for x in (F.lit(name), as_text(*fields[name]))]
        values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        shapes.setdefault(tuple(s.name for s in scope_steps(scope)), []).append(_states_of(rows, index, scope, keys, values))
    parts = []
    for same in shapes.values():
        together = reduce(DataFrame.unionByName, same)
        parts.append(together if len(same) == 1 else last_row(together, [*keys, "path"], [F.col("_ordinal")]))
    if not parts:
        raise ValueError("no rule takes part")
    return reduce(DataFrame.unionByName, parts).drop("_ordinal")
