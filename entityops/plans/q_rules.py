"""Registered queries of the rule engine and of the audits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.operators import audit, rule_index as X, rules as R
from entityops.plans import sql
from entityops.plans.registry import query
from entityops.sources import configs

AS_OF = "1998-06-01"


def order_records(t):
    """Orders with a few customer fields, under the names the rules use."""
    customer = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return t.orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("placed"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("+49"), F.col("o_custkey").cast("string"))).alias("phone"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit("  ")).when(F.col("o_custkey") % 5 == 0, F.lit("note")).alias("comment"),
        (F.col("c_acctbal") < 0).alias("overdrawn"),
    )


_RECORDS = """records AS (SELECT o_orderkey AS record_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total,
  CAST(o_orderdate AS DATE) AS placed, c_mktsegment AS segment, CASE WHEN o_custkey % 4 <> 0 THEN concat('+49', o_custkey) END AS phone,
  CASE WHEN o_custkey % 7 = 0 THEN '  ' WHEN o_custkey % 5 = 0 THEN 'note' END AS comment, c_acctbal < 0 AS overdrawn
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _p(col):
    return f"({col} IS NOT NULL AND trim({col}) <> '')"


# operator, column, literals, equivalent SQL condition
_TEXT = [
    ("exists", "comment", [], _p("comment")), ("notExists", "comment", [], f"NOT {_p('comment')}"),
    ("isBlank", "phone", [], f"NOT {_p('phone')}"), ("isNotBlank", "phone", [], _p("phone")),
    ("equals", "status", ["O"], "status = 'O'"), ("notEquals", "comment", ["note"], "NOT coalesce(comment = 'note', false)"),
    ("in", "segment", ["BUILDING", "MACHINERY"], "segment IN ('BUILDING', 'MACHINERY')"),
    ("notIn", "phone", ["+491", "+492"], "NOT coalesce(phone IN ('+491', '+492'), false)"),
    ("eqIgnoreCase", "segment", ["building"], "lower(segment) = 'building'"),
    ("startsWith", "priority", ["1-"], "starts_with(priority, '1-')"), ("endsWith", "priority", ["LOW"], "ends_with(priority, 'LOW')"),
    ("contains", "phone", ["9"], "coalesce(contains(phone, '9'), false)"),
    ("matches", "phone", [r"(?P<a>\d)5+$"], r"coalesce(regexp_matches(phone, '[0-9]5+$'), false)"),
    ("equals", "overdrawn", ["True"], "overdrawn"),
]
_ORDER = [
    ("gt", "total", ["150000"], "total > 150000"), ("gte", "total", ["150000.5"], "total >= 150000.5"),
    ("lt", "placed", ["1997-03-01"], "placed < DATE '1997-03-01'"), ("lte", "total", ["99999"], "total <= 99999"),
    ("gt", "status", ["1"], "false"), ("lengthEq", "phone", ["5"], "length(coalesce(phone, '')) = 5"),
    ("lengthGte", "comment", ["1"], "length(coalesce(comment, '')) >= 1"), ("lengthLte", "overdrawn", ["0"], "NOT coalesce(overdrawn, false)"),
    ("dateBefore", "placed", ["1996-01-01"], "placed < DATE '1996-01-01'"),
    ("dateAfter", "placed", ["1998-06-30T10:00:00"], "placed > DATE '1998-06-30'"),
    ("dateAfter", "status", ["1998-06-30"], "false"),
    ("dateWithinDays", "placed", ["45"], f"abs(date_diff('day', placed, DATE '{AS_OF}')) <= 45"),
]


def _predicates(t, specs):
    records = order_records(t)
    types = {f.name: f.dataType for f in records.schema.fields}
    as_of = F.lit(AS_OF).cast("date")
    return records.select(
        "record_id", *[R.predicate(op, F.col(c), types[c], lit, as_of).alias(f"p{i}_{op}") for i, (op, c, lit, _) in enumerate(specs)]
    )


def _predicate_sql(specs):
    cols = ", ".join(f"{cond} AS p{i}_{op}" for i, (op, _, _, cond) in enumerate(specs))
    return f"WITH {_RECORDS} SELECT record_id, {cols} FROM records"


@query("flt_1_rule_predicates_text", _predicate_sql(_TEXT))
def predicates_text(t):
    return _predicates(t, _TEXT)


@query("flt_1_rule_predicates_order_length_date", _predicate_sql(_ORDER))
def predicates_order(t):
    return _predicates(t, _ORDER)


def _when(field, op, values, action, *targets):
    return R.Dependency("conditional", (R.Condition(field, op, tuple(values), action, targets),))


RULES = [
    R.Rule("status", "r1", True, True, "^[FOP]$"),
    R.Rule("phone", "r2", False, True, None, dependencies=(
        _when("priority", "equals", ["1-URGENT"], "makeRequired", "phone"),
        _when("total", "lt", ["100000"], "makeOptional", "phone", "status"),
    )),
    R.Rule("comment", "r3", False, False, None, dependencies=(
        _when("segment", "in", ["BUILDING", "MACHINERY"], "makeApplicable", "comment"),
        _when("placed", "dateAfter", ["1998-01-01"], "makeRequired", "comment"),
    )),
    R.Rule("phone", "r4", False, True, r"^\+49[1-5]", dependencies=(R.Dependency("atLeastOne", members=("phone", "comment")),)),
    R.Rule("priority", "r5", True, True, "^9", status="draft"),
    R.Rule("priority", "r6", True, True, "^9", phases=("approve",)),
    R.Rule("segment", "r7", False, True, None, dependencies=(
        R.Dependency("mutuallyExclusive", members=("phone", "comment")),
        _when("overdrawn", "equals", ["True"], "makeRequiredOneOf", "segment"),
    )),
]
_STATES = f"""WITH {_RECORDS}, cond AS (SELECT *, priority = '1-URGENT' AS u, total < 100000 AS l, segment IN ('BUILDING', 'MACHINERY') AS s,
  placed > DATE '1998-01-01' AS a FROM records),
states AS (
  SELECT record_id, 'status' AS path, NOT l AS is_required, true AS is_applicable, '^[FOP]$' AS regex_pattern,
    concat_ws(',', 'r1', CASE WHEN l THEN 'r2' END) AS rule_ids, '' AS groups, status AS value FROM cond
  UNION ALL SELECT record_id, 'phone', u AND NOT l, true, '^\\+49[1-5]', concat_ws(',', 'r4', CASE WHEN u OR l THEN 'r2' END),
    'atLeastOne=comment|phone,mutuallyExclusive=comment|phone', phone FROM cond
  UNION ALL SELECT record_id, 'comment', a, s, NULL, 'r3', 'atLeastOne=comment|phone,mutuallyExclusive=comment|phone', comment FROM cond
  UNION ALL SELECT record_id, 'segment', overdrawn, true, NULL, 'r7', '', segment FROM cond)"""


def _states(t):
    return R.evaluate_rules(order_records(t), RULES, ["record_id"], "save", F.lit(AS_OF).cast("date"))


@query(
    "agg_1_effective_state",
    f"{_STATES} SELECT record_id, path, is_required, is_applicable, is_applicable AS is_visible, regex_pattern, rule_ids, groups FROM states",
)
def effective_state(t):
    entries = F.transform(F.array_sort(F.map_entries("groups")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _states(t).select(
        "record_id", "path", "is_required", "is_applicable", "is_visible", "regex_pattern",
        F.array_join("rule_ids", ",").alias("rule_ids"), F.coalesce(F.array_join(entries, ","), F.lit("")).alias("groups"),
    )


# --- many rules, several countries -----------------------------------------------------------

INDEXED_FIELDS = ("status", "priority", "segment", "phone", "comment")
INDEXED_COUNTRIES = ("AA", "BB", "CC")


def generated_ruleset(country: str, n: int) -> dict:
    """A rule set as a file holds it: ``n`` rules with one conditional action each; every ninth is a draft, every seventh for approval only."""
    rules = []
    for k in range(n):
        field, target = INDEXED_FIELDS[k % 5], INDEXED_FIELDS[(k * 7 + len(country) + ord(country[0])) % 5]
        limit = 1000 + (k * 37 + ord(country[0]) * 11) % 400 * 1000
        test = {"fieldName": "total", "operator": "gte" if k % 2 else "lt", "values": [str(limit)]} if k % 3 else {"fieldName": "priority", "operator": "startsWith", "values": [f"{1 + k % 5}-"]}
        action = ("makeRequired", "makeOptional", "makeApplicable")[k % 4 % 3]
        rules.append(
            {
                "fieldName": field, "isRequired": k % 11 == 0, "isApplicable": k % 13 != 0, "regexPattern": "^[A-Z0-9+]" if k % 17 == 0 else None,
                "dependencies": [{"ruleType": "conditional", "conditions": [test | {"action": {"targetFields": [target], "actionType": action}}]}],
                "x": {"ruleId": f"{country}{k}", "status": "draft" if k % 9 == 8 else "active", "phases": ["approve"] if k % 7 == 6 else None},
            }
        )
    return {"iso2CountryCode": country.lower(), "rules": rules}


def _indexed_sql(counts: dict[str, int]) -> str:
    """Rules and actions as tables, joined with the records; the last one that holds wins."""
    base, actions = [], []
    for country, n in counts.items():
        for k, r in enumerate(generated_ruleset(country, n)["rules"]):
            if r["x"]["status"] == "active" and r["x"]["phases"] is None:
                pattern = "NULL" if r["regexPattern"] is None else "'" + r["regexPattern"] + "'"
                base.append(f"('{country}', '{r['fieldName']}', {k}, {r['isRequired']}, {r['isApplicable']}, {pattern}, '{r['x']['ruleId']}')")
                c = r["dependencies"][0]["conditions"][0]
                limit = c["values"][0] if c["fieldName"] == "total" else "0"
                actions.append(f"('{country}', '{c['action']['targetFields'][0]}', {k}, '{c['operator']}', {limit}, '{c['values'][0]}', '{c['action']['actionType']}', '{r['x']['ruleId']}')")
    return f"""WITH r AS (SELECT o_orderkey AS record_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, c_mktsegment AS segment,
    CASE WHEN o_custkey % 4 <> 0 THEN concat('+49', o_custkey) END AS phone, CASE WHEN o_custkey % 7 = 0 THEN '  ' WHEN o_custkey % 5 = 0 THEN 'note' END AS comment,
    CASE c_nationkey % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'BB' WHEN 2 THEN 'CC' ELSE 'DD' END AS country FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT * FROM (VALUES {", ".join(base)}) v(country, field, k, req, app, pattern, id)),
s AS (SELECT country, field, arg_max(req, k) AS req, arg_max(app, k) AS app, arg_max(coalesce(pattern, ''), k) AS pattern, arg_max(id, k) AS id FROM b GROUP BY 1, 2),
a AS (SELECT * FROM (VALUES {", ".join(actions)}) v(country, field, k, op, lim, lit, kind, owner)),
h AS (SELECT r.record_id, a.field, arg_max(a.kind <> 'makeOptional', a.k) FILTER (a.kind <> 'makeApplicable') AS req, bool_or(a.kind = 'makeApplicable') AS app, count(*) AS hits, list(a.owner ORDER BY a.k) AS owners
      FROM r JOIN a ON a.country = r.country AND CASE a.op WHEN 'gte' THEN r.total >= a.lim WHEN 'lt' THEN r.total < a.lim ELSE starts_with(r.priority, a.lit) END GROUP BY 1, 2)
SELECT r.record_id, s.field AS path, coalesce(h.req, s.req) AS is_required, coalesce(nullif(h.app, false), s.app) AS is_applicable, s.pattern AS regex_pattern,
  CAST(1 + coalesce(len(list_filter(h.owners, lambda x: x <> s.id)), 0) AS INT) AS n_rules, coalesce(list_filter(h.owners, lambda x: x <> s.id)[-1], s.id) AS last_rule,
  CASE s.field WHEN 'status' THEN status WHEN 'priority' THEN priority WHEN 'segment' THEN segment WHEN 'phone' THEN phone ELSE comment END AS value
FROM r JOIN s ON s.country = r.country LEFT JOIN h ON h.record_id = r.record_id AND h.field = s.field"""


RULE_COUNTS = {"AA": 400, "BB": 350, "CC": 250}


@query("jn_1_rules_of_three_countries", _indexed_sql(RULE_COUNTS))
def rules_of_three_countries(t):
    """A thousand rules, read as files hold them with status and phases, over the orders of three countries and one without rules."""
    text = [(json.dumps(generated_ruleset(c, n)),) for c, n in RULE_COUNTS.items()]
    files = t.orders.sparkSession.createDataFrame(text, "line string").select(F.from_json("line", configs.RULESET_SCHEMA).alias("r")).select("r.*")
    nation = t.customer.select(F.col("c_custkey").alias("_k"), (F.col("c_nationkey") % 4).alias("_n"))
    country = F.when(F.col("_n") == 0, "AA").when(F.col("_n") == 1, "BB").when(F.col("_n") == 2, "CC").otherwise("DD")
    owner = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("_k")).join(nation, "_k").select("record_id", country.alias("country"))
    states = X.evaluate_rulesets(order_records(t).join(owner, "record_id"), configs.rules_by_country(files), ["record_id"], phase="save")
    return states.select(
        "record_id", "path", "is_required", "is_applicable", F.coalesce("regex_pattern", F.lit("")).alias("regex_pattern"),
        F.size("rule_ids").alias("n_rules"), F.element_at("rule_ids", -1).alias("last_rule"), "value",
    )


def _scoped(field, rule_id, scope, required, *dependencies):
    return R.Rule(field, rule_id, required, True, None, scope, dependencies=dependencies)


SCOPED_RULES = {
    "F": [
        _scoped("rate", "s1", "$.lines[*].taxes[*]", False, _when("total", "gte", ["150000"], "makeRequired", "rate")),
        _scoped("rate", "s2", "$.lines[?(@.flag=='R')].taxes[?(@.kind!='vat')]", True),
        _scoped("flag", "s3", "$.lines[0]", True),
    ],
    "O": [_scoped("rate", "s4", "$.lines[?(@.flag!='N')].taxes[*]", True, _when("total", "lt", ["50000"], "makeOptional", "rate"))],
}


@query(
    "jn_1_nested_scopes",
    """WITH l AS (SELECT l_orderkey, l_returnflag AS flag, l_tax AS tax, l_discount AS discount,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_tax, l_discount) - 1 AS i FROM lineitem),
o AS (SELECT o_orderkey AS record_id, o_orderstatus AS country, o_totalprice AS total FROM orders),
x AS (SELECT record_id, country, total, flag, i, 0 AS j, 'vat' AS kind, CAST(tax AS VARCHAR) AS rate FROM o JOIN l ON l_orderkey = record_id
  UNION ALL SELECT record_id, country, total, flag, i, 1, 'duty', CASE WHEN discount > 0.05 THEN NULL ELSE CAST(discount AS VARCHAR) END FROM o JOIN l ON l_orderkey = record_id)
SELECT record_id, concat('lines.', i, '.taxes.', j, '.rate') AS path, (flag = 'R' AND kind <> 'vat') OR total >= 150000 AS is_required,
  CASE WHEN flag = 'R' AND kind <> 'vat' THEN CASE WHEN total >= 150000 THEN 's2,s1' ELSE 's2' END ELSE 's1' END AS rule_ids, rate IS NULL AS is_blank FROM x WHERE country = 'F'
UNION ALL SELECT record_id, concat('lines.', i, '.flag'), true, 's3', flag IS NULL FROM x WHERE country = 'F' AND i = 0 AND j = 0
UNION ALL SELECT record_id, concat('lines.', i, '.taxes.', j, '.rate'), total >= 50000, 's4', rate IS NULL FROM x WHERE country = 'O' AND flag <> 'N'""",
)
def nested_scopes(t):
    """Conditions at two levels of nested arrays; two scopes of F name some of the same instances."""
    tax = lambda kind, rate: F.struct(F.lit(kind).alias("kind"), rate.alias("rate"))
    line = F.struct("l_linenumber", F.col("l_returnflag").alias("flag"), "l_tax", "l_discount")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    duty = lambda x: F.when(x["l_discount"] <= 0.05, x["l_discount"].cast("string"))
    nested = F.transform("_l", lambda x: F.struct(x["flag"].alias("flag"), F.array(tax("vat", x["l_tax"].cast("string")), tax("duty", duty(x))).alias("taxes")))
    orders = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("country"), F.col("o_totalprice").alias("total"))
    states = X.evaluate_rulesets(orders.join(lines, "record_id").select("record_id", "country", "total", nested.alias("lines")), SCOPED_RULES, ["record_id"])
    return states.select("record_id", "path", "is_required", F.array_join("rule_ids", ",").alias("rule_ids"), F.col("value").isNull().alias("is_blank"))


@query(
    "job_3_apply_ruleset",
    f"""{_STATES} SELECT record_id, path, value, CASE WHEN is_required AND NOT {_p('value')} THEN 'required' ELSE 'pattern' END AS violation
FROM states WHERE is_applicable AND ((is_required AND NOT {_p('value')})
  OR (regex_pattern IS NOT NULL AND {_p('value')} AND NOT regexp_matches(value, regex_pattern)))""",
)
def apply_ruleset(t):
    found = R.apply_ruleset(order_records(t), RULES, ["record_id"], "save", F.lit(AS_OF).cast("date"))
    return found.select("record_id", "path", "value", "violation")


@query(
    "job_3_group_violations",
    f"""WITH {_RECORDS} SELECT record_id, 'atLeastOne' AS kind, 'comment|phone' AS group_id FROM records WHERE NOT {_p('phone')} AND NOT {_p('comment')}
UNION ALL SELECT record_id, 'mutuallyExclusive', 'comment|phone' FROM records WHERE {_p('phone')} AND {_p('comment')}""",
)
def group_violations(t):
    return R.group_violations(order_records(t), RULES, ["record_id"], "save")


def part_rows(t):
    """Parts with the words of their name as nested rows."""
    words = F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")
    return t.part.select(
        F.col("p_partkey").alias("record_id"), "p_type", "p_size",
        F.transform(words, lambda w: F.struct(w.alias("word"), F.length(w).alias("size"))).alias("words"),
    )


_WORDS = """words AS (SELECT p_partkey AS record_id, p_type, p_size, w.word AS word, w.pos AS pos FROM part,
  LATERAL (SELECT unnest(string_split(concat(p_name, ' ', p_brand), ' ')) AS word,
                  generate_subscripts(string_split(concat(p_name, ' ', p_brand), ' '), 1) - 1 AS pos) w)"""


@query(
    "jn_2_expand_scope",
    f"WITH {_WORDS} SELECT record_id, concat('words.', pos) AS path, word FROM words WHERE word <> 'red'",
)
def expand_scope(t):
    return R.expand_scope(part_rows(t), ["record_id"], "words", ("word", "!=", "red")).select("record_id", "path", F.col("row.word").alias("word"))


@query(
    "jn_1_evaluate_rules_row_scope",
    f"""WITH {_WORDS} SELECT record_id, concat('words.', pos, '.word') AS path, p_size > 25 AS is_required,
  concat_ws(',', 'w1', CASE WHEN p_size > 25 THEN 'w2' END) AS rule_ids FROM words
UNION ALL SELECT p_partkey, 'p_type', true, 'w2' FROM part""",
)
def row_scope(t):
    rules = [
        R.Rule("word", "w1", scope="$.words[*]"),
        R.Rule("p_type", "w2", True, dependencies=(_when("p_size", "gt", ["25"], "makeRequired", "word"), _when("size", "gt", ["0"], "makeOptional", "word"))),
    ]
    return R.evaluate_rules(part_rows(t), rules, ["record_id"]).select("record_id", "path", "is_required", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(
    "flt_2_active_rules",
    """SELECT p_partkey AS rule_id FROM part WHERE p_type = 'ECONOMY' OR (p_size % 3 = 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""",
)
def active_rules(t):
    rules = t.part.select(
        "p_partkey", F.when(F.col("p_type") != "ECONOMY", F.col("p_partkey").cast("string")).alias("rule_id"),
        F.when(F.col("p_size") % 3 == 0, "active").otherwise("draft").alias("status"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.array(F.lit("save"), F.lit("submit"))).otherwise(F.array(F.lit("create"))).alias("phases"),
    )
    return R.active_rules(rules, "save").select(F.col("p_partkey").alias("rule_id"))


_SLUG = r"lower(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"


@query(
    "src_11_import_rules",
    f"""WITH based AS (SELECT *, concat_ws('.', lower(p_brand), lower(p_type), {_SLUG}, CASE WHEN p_size % 3 = 0 THEN concat('size-', p_size % 5) END) AS base FROM part),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS nth FROM based)
SELECT p_partkey AS ordinal, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', nth) END AS rule_id,
  'sha256:' || substr(sha256(concat('{{"fieldGroupLabel": "', p_type, '", "fieldName": "', p_name, '", "isRequired": ', p_size > 20,
    CASE WHEN p_size % 3 = 0 THEN concat(', "scopeKey": "Size ', p_size % 5, '"') ELSE '' END, '}}')), 1, 16) AS content_hash
FROM numbered""",
)
def import_rules(t):
    rows = t.part.select(
        F.col("p_brand").alias("country"), F.col("p_type").alias("group_label"), F.col("p_name").alias("field_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Size "), (F.col("p_size") % 5).cast("string"))).alias("scope_key"),
        F.col("p_partkey").alias("ordinal"), (F.col("p_size") > 20).alias("isRequired"),
    )
    return R.import_rules(rows).select("ordinal", "rule_id", "content_hash")


def nested_rulesets(t):
    """One ruleset per part, in the nested file shape."""
    condition = F.struct(
        F.lit("brand").alias("fieldName"), F.lit("equals").alias("operator"), F.array(F.col("p_brand")).alias("values"),
        F.struct(F.array(F.lit("size"), F.lit("type")).alias("targetFields"), F.lit("makeRequired").alias("actionType")).alias("action"),
    )
    dependency = F.struct(
        F.lit("conditional").alias("ruleType"), F.array(F.lit("size")).alias("applicableFields"), F.lit(None).cast("string").alias("errorMessage"),
        F.when(F.col("p_size") % 2 == 0, F.array(condition)).alias("conditions"),
    )
    rule = F.struct(
        F.col("p_name").alias("fieldName"), F.lit("Name").alias("displayLabel"), F.col("p_type").alias("fieldGroupLabel"),
        (F.col("p_size") > 20).alias("isRequired"), F.lit(True).alias("isApplicable"), F.lit(None).cast("string").alias("regexPattern"),
        F.array(dependency).alias("dependencies"),
    )
    return t.part.select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("iso2CountryCode"), F.array(rule, rule).alias("rules"))


@query(
    "src_1_ruleset_tables",
    """WITH r AS (SELECT *, concat('P', p_partkey) AS country, k FROM part CROSS JOIN (VALUES (0), (1)) v(k))
SELECT 'rule' AS part, country, k AS rule_no, p_name AS field, CAST(p_size > 20 AS VARCHAR) AS detail FROM r
UNION ALL SELECT 'condition', country, k, 'brand', concat('equals ', p_brand) FROM r WHERE p_size % 2 = 0
UNION ALL SELECT 'action', country, k, f, 'makeRequired' FROM r CROSS JOIN (VALUES ('size'), ('type')) x(f) WHERE p_size % 2 = 0""",
)
def ruleset_tables(t):
    rules, conditions, actions = configs.ruleset_tables(nested_rulesets(t))
    return (
        rules.select(F.lit("rule").alias("part"), "country", "rule_no", F.col("field_name").alias("field"), F.col("is_required").cast("string").alias("detail"))
        .unionByName(conditions.select(F.lit("condition").alias("part"), "country", "rule_no", F.col("field_name").alias("field"), F.concat_ws(" ", "operator", F.array_join("values", ",")).alias("detail")))
        .unionByName(actions.select(F.lit("action").alias("part"), "country", "rule_no", F.col("target_field").alias("field"), F.col("action_type").alias("detail")))
    )


@query(
    "agg_16_integrity_audit",
    """SELECT 'duplicate_key' AS finding, concat(l_orderkey, '|', l_linenumber) AS subject, count(*) AS rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'dangling_reference', concat('l_orderkey=', l_orderkey), count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey
UNION ALL SELECT 'unknown_code', concat('l_returnflag=', l_returnflag), count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag
UNION ALL SELECT 'inconsistent_columns', 'hold without reason', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' HAVING count(*) > 0""",
)
def integrity_audit(t):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_returnflag") == "R", "yes").alias("hold"),
        F.when(F.col("l_linestatus") == "F", "closed").otherwise(" ").alias("reason"),
    )
    settled = t.orders.where("o_orderstatus <> 'P'")
    return audit.integrity_audit(
        lines, ["l_orderkey", "l_linenumber"], {"l_orderkey": (settled, "o_orderkey")}, {"l_returnflag": ["A", "N"]}, {"hold": "reason"}
    )


@query(
    "agg_16_rule_ledger",
    """SELECT p_partkey AS rule_id, r.reason AS reason FROM part CROSS JOIN (VALUES ('no-inverse-effect', 2), ('cel-expression-not-projectable', 3),
  ('no-severity-field', 5), ('row-filter-not-representable', 7), ('extended-operator-only', 11)) r(reason, k) WHERE p_size % r.k = 0""",
)
def rule_ledger(t):
    size = F.col("p_size")
    rules = t.part.select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("field_name"),
        F.when(size % 2 == 0, F.array(F.lit("applyValidator"))).alias("effects"), F.when(size % 3 == 0, "a > b").alias("cel_expression"),
        F.when(size % 5 == 0, "warning").otherwise("error").alias("severity"), F.lit(None).cast("map<string,string>").alias("severity_by_phase"),
        F.when(size % 7 == 0, "$.rows[?(@.a=='x')]").otherwise("$").alias("scope"), F.when(size % 11 == 0, "matches").otherwise("equals").alias("operator"),
    )
    return audit.rule_ledger(rules, rules.select("rule_id", "field_name", "operator")).select("rule_id", "reason")


def identity_rows(t):
    """Identifiers computed from customers: some valid, some with a wrong check digit or shape."""
    key = F.col("c_custkey")
    digits4 = F.lpad((key % 10000).cast("string"), 4, "0")
    holder = F.element_at(F.array(*[F.lit(x) for x in "PCHFX"]), (key % 5 + 1).cast("int"))
    pan = F.concat(F.lit("abc"), holder, F.lit("d"), digits4, F.lit("f"))
    state = F.lpad((key % 40).cast("string"), 2, "0")
    other = F.concat(F.lit("ABCPD"), digits4, F.lit("F"))
    gstin = F.concat(state, F.when(key % 3 == 0, other).otherwise(F.upper(pan)), F.lit("1Z"), F.substr(F.lit(C.GSTIN_ALPHABET), (key % 36 + 1).cast("int"), F.lit(1)))
    nation = F.col("c_nationkey")
    return t.customer.select(
        key.alias("record_id"), nation,
        F.when(key % 9 != 0, pan).alias("pan"), F.when(key % 8 != 0, gstin).alias("gstin"),
        F.when(key % 2 == 0, F.concat(F.lit("HDFC0"), F.lpad(key.cast("string"), 6, "0"))).when(key % 3 == 0, F.lit("HDFC1")).alias("ifsc"),
        F.element_at(F.array(F.lit("MH"), F.lit(" ka"), F.lit("")), (key % 3 + 1).cast("int")).alias("region_code"),
        F.when(key % 4 == 0, key % 8 == 0).alias("is_natural_person"),
        F.element_at(F.array(F.lit("CN"), F.lit("AE"), F.lit("us "), F.lit("GB"), F.lit("IN")), (key % 5 + 1).cast("int")).alias("country"),
        F.when(key % 5 == 1, F.concat(F.lit("100"), F.lpad(key.cast("string"), 12, "0"))).when(key % 5 == 2, F.concat(F.lit("1-"), F.lpad(key.cast("string"), 8, "0")))
        .when(key % 5 == 3, F.concat(F.lit("GB"), F.lpad(key.cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("91350100M000100Y"), F.lpad((key % 100).cast("string"), 2, "0"))).alias("tax_id"),
        F.when(key % 2 == 0, F.concat(F.lit("SC"), F.lpad((key % 1000000).cast("string"), 6, "0"))).otherwise(F.lit("12")).alias("company_number"),
        F.lpad((key * 7919).cast("string"), 10, "0").alias("digits"),
        F.concat(F.lit("GB"), F.lpad((key % 98).cast("string"), 2, "0"), F.lit("WEST12345698765432")).alias("iban"),
    )


IDENTITIES = f"""ident AS (SELECT c_custkey AS record_id, c_nationkey, c_custkey AS k,
  CASE WHEN c_custkey % 9 <> 0 THEN concat('abc', ['P','C','H','F','X'][c_custkey % 5 + 1], 'd', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'f') END AS pan,
  CASE WHEN c_custkey % 8 <> 0 THEN concat(lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0'), CASE WHEN c_custkey % 3 = 0 THEN concat('ABCPD', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'F')
     ELSE upper(concat('abc', ['P','C','H','F','X'][c_custkey % 5 + 1], 'd', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'f')) END, '1Z', substr('{C.GSTIN_ALPHABET}', CAST(c_custkey % 36 + 1 AS INT), 1)) END AS gstin,
  CASE WHEN c_custkey % 2 = 0 THEN concat('HDFC0', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) WHEN c_custkey % 3 = 0 THEN 'HDFC1' END AS ifsc,
  nullif(['MH', ' ka', ''][c_custkey % 3 + 1], '') AS region_code, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 8 = 0 END AS person,
  ['CN','AE','US','GB','IN'][c_custkey % 5 + 1] AS country,
  CASE c_custkey % 5 WHEN 1 THEN concat('100', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) WHEN 2 THEN concat('1', lpad(CAST(c_custkey AS VARCHAR), 8, '0'))
    WHEN 3 THEN concat('GB', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) ELSE concat('91350100M000100Y', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')) END AS tax_id,
  CASE WHEN c_custkey % 2 = 0 THEN concat('SC', lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')) ELSE '12' END AS company_number,
  lpad(CAST(c_custkey * 7919 AS VARCHAR), 10, '0') AS digits, concat('GB', lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0'), 'WEST12345698765432') AS iban FROM customer)"""
_GST_SUM = " + ".join(
    f"((instr('{C.GSTIN_ALPHABET}', substr(gstin, {i}, 1)) - 1) * {1 if i % 2 else 2}) // 36 + ((instr('{C.GSTIN_ALPHABET}', substr(gstin, {i}, 1)) - 1) * {1 if i % 2 else 2}) % 36"
    for i in range(1, 15)
)
_GST_OK = f"regexp_matches(gstin, '{C.GSTIN_STRICT}') AND instr('{C.GSTIN_ALPHABET}', substr(gstin, 15, 1)) - 1 = (36 - ({_GST_SUM}) % 36) % 36"
_USCC_SUM = " + ".join(f"(instr('{C.USCC_ALPHABET}', substr(tax_id, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(C.USCC_WEIGHTS))
_USCC_OK = f"instr('{C.USCC_ALPHABET}', substr(tax_id, 18, 1)) - 1 = (31 - ({_USCC_SUM}) % 31) % 31"
_LUHN_OK = "list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN (len(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) ELSE (CAST(digits[i] AS INT) * 2) // 10 + (CAST(digits[i] AS INT) * 2) % 10 END)) % 10 = 0"
_IBAN_OK = f"CAST(array_to_string(list_transform(string_split(concat(substr(iban, 5), substr(iban, 1, 4)), ''), lambda c: CAST(instr('{C.GSTIN_ALPHABET}', c) - 1 AS VARCHAR)), '') AS HUGEINT) % 97 = 1"


@query(
    "agg_20_identifier_audit",
    f"""WITH {IDENTITIES}, cells AS (
  SELECT c_nationkey, 'pan' AS kind, regexp_matches(upper(pan), '{C.PAN}') AS ok FROM ident WHERE pan IS NOT NULL
  UNION ALL SELECT c_nationkey, 'gstin', regexp_matches(gstin, '{C.GSTIN_SHAPES}') FROM ident WHERE gstin IS NOT NULL
  UNION ALL SELECT c_nationkey, 'gstin_checked', {_GST_OK} FROM ident WHERE gstin IS NOT NULL
  UNION ALL SELECT c_nationkey, 'ifsc', regexp_matches(ifsc, '{C.IFSC}') FROM ident WHERE ifsc IS NOT NULL
  UNION ALL SELECT c_nationkey, 'uscc', k % 5 IN (0, 4) AND {_USCC_OK} FROM ident
  UNION ALL SELECT c_nationkey, 'luhn', {_LUHN_OK} FROM ident
  UNION ALL SELECT c_nationkey, 'iban', {_IBAN_OK} FROM ident)
SELECT c_nationkey, kind, count(*) AS checked, count(*) FILTER (ok) AS valid FROM cells GROUP BY ALL""",
)
def identifier_audit(t):
    columns = {"pan": "pan", "gstin": "gstin", "gstin_checked": "gstin", "ifsc": "ifsc", "uscc": "tax_id", "luhn": "digits", "iban": "iban"}
    return audit.identifier_audit(identity_rows(t), columns, ["c_nationkey"])


@query(
    "agg_20_email_verdicts_of_documents",
    r"""SELECT doc_id, word, regexp_matches(word, '^[a-zA-Z0-9+_.-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS ok
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE contains(word, '@')""",
)
def email_verdicts(t):
    words = t.documents.select("doc_id", F.explode(F.split("text", r"(?U)\s+")).alias("word")).where(F.col("word").contains("@"))
    return audit.identifier_verdicts(words, "email", "word").select("doc_id", "word", "ok")


@query(
    "jn_12_cross_field_checks",
    f"""WITH {IDENTITIES}, facts AS (SELECT *, CASE WHEN regexp_matches(substr(gstin, 3, 10), '{C.PAN}') THEN substr(gstin, 3, 10) END AS ep,
    {sql.case_of("substr(gstin, 1, 2)", C.STATE_REGION)} AS dr,
    CASE WHEN regexp_matches(upper(pan), '{C.PAN}') THEN CASE substr(upper(pan), 4, 1) WHEN 'P' THEN true WHEN 'X' THEN NULL ELSE false END END AS np FROM ident),
checks AS (
  SELECT record_id, 'pan_shape' AS check_id, CASE WHEN pan IS NOT NULL THEN CASE WHEN regexp_matches(upper(pan), '{C.PAN}') THEN 'pass' ELSE 'fail' END END AS status FROM facts
  UNION ALL SELECT record_id, 'gstin_shape', CASE WHEN gstin IS NOT NULL THEN CASE WHEN regexp_matches(gstin, '{C.GSTIN_SHAPES}') THEN 'pass' ELSE 'fail' END END FROM facts
  UNION ALL SELECT record_id, 'ifsc_shape', CASE WHEN ifsc IS NOT NULL THEN CASE WHEN regexp_matches(ifsc, '{C.IFSC}') THEN 'pass' ELSE 'fail' END END FROM facts
  UNION ALL SELECT record_id, 'gstin_contains_pan', CASE WHEN gstin IS NOT NULL AND pan IS NOT NULL THEN CASE WHEN ep IS NULL THEN 'warn' WHEN ep = upper(pan) THEN 'pass' ELSE 'fail' END END FROM facts
  UNION ALL SELECT record_id, 'gstin_state_vs_address_region', CASE WHEN gstin IS NOT NULL AND region_code IS NOT NULL AND dr IS NOT NULL THEN CASE WHEN dr = upper(trim(region_code)) THEN 'pass' ELSE 'warn' END END FROM facts
  UNION ALL SELECT record_id, 'pan_entity_type', CASE WHEN pan IS NOT NULL THEN CASE WHEN np IS NULL THEN 'warn' WHEN person IS NULL OR person = np THEN 'pass' ELSE 'warn' END END FROM facts)
SELECT * FROM checks WHERE status IS NOT NULL""",
)
def cross_field_checks(t):
    return audit.cross_field_checks(identity_rows(t), ["record_id"])


@query(
    "jn_12_locale_checks",
    f"""WITH {IDENTITIES} SELECT record_id, 'uscc_checksum' AS check_id, CASE WHEN {_USCC_OK} THEN 'pass' ELSE 'fail' END AS status FROM ident WHERE country = 'CN'
UNION ALL SELECT record_id, 'ae_trn_shape', CASE WHEN regexp_matches(tax_id, '{C.AE_TRN}') THEN 'pass' ELSE 'fail' END FROM ident WHERE country = 'AE'
UNION ALL SELECT record_id, 'us_ein_shape', CASE WHEN regexp_matches(tax_id, '{C.US_EIN}') THEN 'pass' ELSE 'fail' END FROM ident WHERE country = 'US'
UNION ALL SELECT record_id, 'gb_vat_shape', CASE WHEN regexp_matches(tax_id, '{C.GB_VAT}') THEN 'pass' ELSE 'fail' END FROM ident WHERE country = 'GB'
UNION ALL SELECT record_id, 'gb_crn_shape', CASE WHEN regexp_matches(company_number, '{C.GB_CRN}') THEN 'pass' ELSE 'fail' END FROM ident WHERE country = 'GB'""",
)
def locale_checks(t):
    return audit.locale_checks(identity_rows(t), ["record_id"])
