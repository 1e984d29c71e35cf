"""Declarative validation rules, compiled to Catalyst expressions.

Rules are configuration: they are few, they come from files or a small table, and they are turned
into ``Column`` objects while the plan is built.  Evaluating them is then one narrow pass over the
records, without a join, a shuffle or Python per row, however many rules there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from entityops import constants as C
from entityops.functions import text as T
from entityops.functions.ordering import number_sorted


# --- predicates ------------------------------------------------------------------------------


def as_text(col: Column, data_type) -> Column:
    """The text a value has when compared with a literal; booleans are True and False."""
    if isinstance(data_type, BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    return col.cast("string")


def truthless(col: Column, data_type) -> Column:
    """Zero and false count as empty for the length operators."""
    if isinstance(data_type, BooleanType):
        return ~col
    if isinstance(data_type, NumericType):
        return col == 0
    return F.lit(False)


def predicate(op: str, col: Column, data_type, literals: list[str] | None = None, as_of: Column | None = None) -> Column:
    """One of the closed set of operators as a boolean that is never null."""
    values = literals or []
    first = values[0] if values else None
    text = as_text(col, data_type)
    present = T.present(text)
    never = F.lit(False)

    def sure(c: Column) -> Column:
        return F.coalesce(c, never)

    def ordering(compare) -> Column:
        if first is None:
            return never
        number, limit = text.try_cast("double"), F.lit(first).try_cast("double")
        numeric = number.isNotNull() & limit.isNotNull()
        by_number = compare(number, limit)
        by_date = compare(T.iso_date(text), T.iso_date(F.lit(first)))
        return present & sure(F.when(numeric, by_number).otherwise(by_date))

    def length(compare) -> Column:
        if first is None:
            return never
        size = F.length(F.when(truthless(col, data_type), F.lit("")).otherwise(F.coalesce(text, F.lit(""))))
        return compare(size, int(first))

    def dates(compare) -> Column:
        return never if first is None else sure(compare(T.iso_date(text), T.iso_date(F.lit(first))))

    def within() -> Column:
        if first is None or not first.lstrip("+-").isdigit():
            return never
        today = as_of if as_of is not None else F.current_date()
        return sure(F.abs(F.datediff(today, T.iso_date(text))) <= int(first))

    def literal(test) -> Column:
        return never if first is None else present & sure(test(first))

    builders = {
        "exists": lambda: present,
        "isNotBlank": lambda: present,
        "notExists": lambda: ~present,
        "isBlank": lambda: ~present,
        "equals": lambda: literal(lambda v: text == v),
        "notEquals": lambda: ~literal(lambda v: text == v),
        "in": lambda: present & sure(text.isin(*values)) if values else never,
        "notIn": lambda: ~(present & sure(text.isin(*values))) if values else F.lit(True),
        "eqIgnoreCase": lambda: literal(lambda v: F.lower(text) == v.lower()),
        "gt": lambda: ordering(lambda a, b: a > b),
        "gte": lambda: ordering(lambda a, b: a >= b),
        "lt": lambda: ordering(lambda a, b: a < b),
        "lte": lambda: ordering(lambda a, b: a <= b),
        "startsWith": lambda: literal(text.startswith),
        "endsWith": lambda: literal(text.endswith),
        "contains": lambda: literal(text.contains),
        "matches": lambda: literal(lambda v: text.rlike(T.java_regex(v))),
        "lengthEq": lambda: length(lambda a, b: a == b),
        "lengthGte": lambda: length(lambda a, b: a >= b),
        "lengthLte": lambda: length(lambda a, b: a <= b),
        "dateBefore": lambda: dates(lambda a, b: a < b),
        "dateAfter": lambda: dates(lambda a, b: a > b),
        "dateWithinDays": within,
    }
    if op not in builders:
        raise ValueError(f"unknown operator {op!r}")
    return builders[op]()


# --- rules as configuration ------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    values: tuple[str, ...] = ()
    action: str | None = None
    targets: tuple[str, ...] = ()

    def __post_init__(self):
        if self.operator not in C.BASE_OPERATORS + C.EXTRA_OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.action is not None and self.action not in C.ACTION_TYPES:
            raise ValueError(f"unknown action {self.action!r}")


@dataclass(frozen=True)
class Dependency:
    kind: str
    conditions: tuple[Condition, ...] = ()
    members: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in C.RULE_TYPES:
            raise ValueError(f"unknown rule type {self.kind!r}")


@dataclass(frozen=True)
class Rule:
    field: str
    rule_id: str | None = None
    required: bool = False
    applicable: bool = True
    pattern: str | None = None
    scope: str = "$"
    status: str = "active"
    phases: tuple[str, ...] = ("create", "save", "submit")
    dependencies: tuple[Dependency, ...] = field(default=())


def active(rules: list[Rule], phase: str | None) -> list[Rule]:
    """Rules without an id predate phases and always take part."""
    return [
        r for r in rules if r.rule_id is None or (r.status == "active" and (phase is None or phase in r.phases))
    ]


def active_rules(rules: DataFrame, phase: str | None) -> DataFrame:
    """The same filter on a rules table (rule_id, status, phases)."""
    wanted = F.col("status") == "active"
    if phase is not None:
        wanted = wanted & F.array_contains("phases", phase)
    return rules.where(F.col("rule_id").isNull() | F.coalesce(wanted, F.lit(False)))


def group_id(members: tuple[str, ...]) -> str:
    return "|".join(sorted(members))


class _Fields:
    """Finds the column behind a field name; unknown fields are null."""

    def __init__(self, df: DataFrame, row: tuple[str, StructType] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.row = row

    def __call__(self, name: str) -> tuple[Column, object]:
        if self.row is not None:
            column, struct = self.row
            if name in struct.fieldNames():
                return F.col(column)[name], struct[name].dataType
        if name in self.types and not isinstance(self.types[name], ArrayType):
            return F.col(f"`{name}`"), self.types[name]
        return F.lit(None).cast("string"), None


def _effective(rule: Rule, path: Column, rules: list[Rule], holds, value: Column) -> Column:
    """State of one field instance: baseline of its last rule, then actions in rule order."""
    required, applicable = F.lit(rule.required), F.lit(rule.applicable)
    visible = applicable
    ids = [F.lit(rule.rule_id)]
    groups: dict[str, str] = {}
    for owner in rules:
        for dependency in owner.dependencies:
            if dependency.kind != "conditional":
                if rule.field in dependency.members:
                    groups[dependency.kind] = group_id(dependency.members)
                continue
            for condition in dependency.conditions:
                if condition.action is None or rule.field not in condition.targets:
                    continue
                hit = holds(condition)
                if condition.action in ("makeRequired", "makeRequiredOneOf"):
                    required = F.when(hit, F.lit(True)).otherwise(required)
                elif condition.action == "makeOptional":
                    required = F.when(hit, F.lit(False)).otherwise(required)
                else:
                    applicable = F.when(hit, F.lit(True)).otherwise(applicable)
                    visible = F.when(hit, F.lit(True)).otherwise(visible)
                ids.append(F.when(hit, F.lit(owner.rule_id)))
    pairs = [F.lit(x) for kv in groups.items() for x in kv]
    grouped = F.create_map(*pairs) if pairs else F.lit(None)
    return F.struct(
        path.alias("path"),
        F.lit(rule.field).alias("field_name"),
        required.alias("is_required"),
        applicable.alias("is_applicable"),
        visible.alias("is_visible"),
        F.lit(rule.pattern).cast("string").alias("regex_pattern"),
        F.array_distinct(F.array_compact(F.array(*ids))).cast("array<string>").alias("rule_ids"),
        grouped.cast("map<string,string>").alias("groups"),
        value.alias("value"),
    )


def evaluate_rules(
    records: DataFrame, rules: list[Rule], keys: list[str], phase: str | None = None, as_of: Column | None = None,
    bind_rows: bool = False,
) -> DataFrame:
    """Effective state of every field instance of every record.

    Fields are columns of ``records``; scopes are ``$`` or ``$.array[*]``.  The value is carried
    along for the violation checks.  ``bind_rows``: conditions of row scoped rules see the row first
    (by default, as in the reference semantics, they see the record only).
    """
    live = active(rules, phase)
    names = _Fields(records)

    def holder(fields: _Fields):
        def holds(condition: Condition) -> Column:
            column, data_type = fields(condition.field)
            return predicate(condition.operator, column, data_type, list(condition.values), as_of)

        return holds

    parts = []
    roots: dict[str, Rule] = {r.field: r for r in live if r.scope == "$"}
    if roots:
        states = []
        for rule in roots.values():
            column, data_type = names(rule.field)
            states.append(_effective(rule, F.lit(rule.field), live, holder(names), as_text(column, data_type)))
        parts.append(records.select(*keys, F.inline(F.array(*states))))
    scopes: dict[str, dict[str, Rule]] = {}
    for rule in live:
        if rule.scope != "$":
            scopes.setdefault(rule.scope, {})[rule.field] = rule
    for scope, by_field in scopes.items():
        array = scope.removeprefix("$.").removesuffix("[*]")
        if f"$.{array}[*]" != scope or "." in array:
            raise ValueError(f"unsupported scope {scope!r}")
        struct = records.schema[array].dataType.elementType
        rows = records.select("*", F.posexplode(array).alias("_at", "_row"))
        seen = _Fields(records, ("_row", struct))
        states = []
        for rule in by_field.values():
            column, data_type = seen(rule.field)
            path = F.concat(F.lit(f"{array}."), F.col("_at").cast("string"), F.lit(f".{rule.field}"))
            states.append(_effective(rule, path, live, holder(seen if bind_rows else names), as_text(column, data_type)))
        parts.append(rows.select(*keys, F.inline(F.array(*states))))
    return reduce(DataFrame.unionByName, parts)


def violations(states: DataFrame) -> DataFrame:
    """Required but blank, and pattern mismatch, of applicable fields. (Our addition.)"""
    patterns = F.coalesce(
        F.col("regex_pattern").isNotNull() & T.present(F.col("value")) & ~F.regexp_like("value", F.col("regex_pattern")), F.lit(False)
    )
    kind = F.when(F.col("is_required") & T.blank(F.col("value")), F.lit("required")).when(patterns, F.lit("pattern"))
    return states.where("is_applicable").withColumn("violation", kind).where("violation IS NOT NULL")


def group_violations(records: DataFrame, rules: list[Rule], keys: list[str], phase: str | None = None) -> DataFrame:
    """Groups whose members break their constraint. (Our addition; groups are recorded, not checked, upstream.)"""
    names = _Fields(records)
    cells = []
    seen: set[tuple[str, str]] = set()
    for rule in active(rules, phase):
        for dependency in rule.dependencies:
            if dependency.kind == "conditional" or not dependency.members:
                continue
            mark = (dependency.kind, group_id(dependency.members))
            if mark in seen:
                continue
            seen.add(mark)
            filled = sum(F.when(T.present(as_text(*names(m))), 1).otherwise(0) for m in dependency.members)
            broken = {
                "atLeastOne": filled == 0,
                "allOrNone": (filled > 0) & (filled < len(dependency.members)),
                "mutuallyExclusive": filled > 1,
            }[dependency.kind]
            cells.append(F.when(broken, F.struct(F.lit(mark[0]).alias("kind"), F.lit(mark[1]).alias("group_id"))))
    if not cells:
        return records.select(*keys).withColumns({"kind": F.lit(""), "group_id": F.lit("")}).where(F.lit(False))
    return records.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def apply_ruleset(
    records: DataFrame, rules: list[Rule], keys: list[str], phase: str | None = None, as_of: Column | None = None
) -> DataFrame:
    """Filter, scope, predicates and effective state in one pass, reduced to the violations."""
    return violations(evaluate_rules(records, rules, keys, phase, as_of))


def expand_scope(records: DataFrame, keys: list[str], array: str, where: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows of ``$.array[*]`` with their dotted path; ``where`` is (field, '==' or '!=', literal)."""
    rows = records.select(*keys, F.posexplode(array).alias("_at", "row"))
    if where is not None:
        name, op, literal = where
        same = F.col("row")[name].cast("string") == literal
        rows = rows.where(F.coalesce(same if op == "==" else ~same, F.lit(False)))
    return rows.select(*keys, F.concat(F.lit(f"{array}."), F.col("_at").cast("string")).alias("path"), "row")


# --- importing -------------------------------------------------------------------------------


def slug(col: Column) -> Column:
    text = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(text == "", F.lit("field")).otherwise(text)


def _json_value(col: Column) -> Column:
    """One JSON value, lists with a blank after the comma."""
    text = F.to_json(F.array(col))
    return F.substring(text, 2, 1 << 30).substr(F.lit(1), F.length(text) - 2)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON object with sorted keys and without nulls, separators ``", "`` and ``": "``."""
    members = [
        F.when(columns[k].isNotNull(), F.concat(F.lit(f'"{k}": '), _json_value(columns[k]))) for k in sorted(columns)
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def import_rules(rows: DataFrame) -> DataFrame:
    """Rule ids ``country.group.field[.scope]`` with ``-n`` on repeats, and a content hash.

    rows: country, group_label, field_name, scope_key, ordinal (integer) and any body columns.
    """
    parts = [F.lower("country"), slug(F.col("group_label")), slug(F.col("field_name"))]
    scoped = F.when(T.present(F.col("scope_key")), slug(F.col("scope_key")))
    based = rows.withColumn("_base", F.concat_ws(".", *parts, scoped))
    numbered = number_sorted(based, ["_base"], [F.col("ordinal")], "_nth")
    body = {
        "fieldGroupLabel": F.col("group_label"), "fieldName": F.col("field_name"), "scopeKey": F.col("scope_key"),
    } | {c: F.col(c) for c in rows.columns if c not in ("country", "group_label", "field_name", "scope_key", "ordinal")}
    return numbered.select(
        *rows.columns,
        F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_nth").cast("string"))).alias("rule_id"),
        F.concat(F.lit("sha256:"), F.substring(F.sha2(canonical_json(body), 256), 1, 16)).alias("content_hash"),
    )
