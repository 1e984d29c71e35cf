"""Readers of rulesets, playbooks and reference snapshots, and whole-config overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops.operators.rules import Condition, Dependency, Rule

RULESET_SCHEMA = """
iso2CountryCode string, vendorStatusReason string,
rules array<struct<fieldName string, displayLabel string, fieldGroupLabel string, scopeKey string, isRequired boolean,
  isApplicable boolean, isDocumentVerificationRequired boolean, regexPattern string, errorMessage string,
  dependencies array<struct<ruleType string, applicableFields array<string>, errorMessage string,
    conditions array<struct<fieldName string, operator string, values array<string>,
      action struct<targetFields array<string>, actionType string>>>>>,
  x struct<ruleId string, version int, status string, scope string, targets array<string>, phases array<string>>>>
"""
# The phases and the status of a rule whose extension names none.
DEFAULT_PHASES = ("create", "save", "submit")
DEFAULT_STATUS = "draft"
PLAYBOOK_SCHEMA = """
countryCode string, version int, nameFuzzyThreshold double, addressFuzzyThreshold double,
multiSourceFields map<string, array<string>>,
bindings array<struct<logicalFieldId string, label string, validator string, singleton boolean, needsResolution string,
  bind struct<kind string, taxTypeCode string, formPath string, field string, index int, key string, role string>>>,
documents array<struct<docType string, writable boolean, attributes array<string>>>,
connectors array<struct<id string, type string>>
"""


def ruleset_tables(rulesets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, conditions and actions of nested rulesets; list positions are kept as numbers."""
    country = F.upper(F.trim("iso2CountryCode")).alias("country")
    rules = rulesets.select(country, F.posexplode("rules").alias("rule_no", "r"))
    if "x" not in rules.schema["r"].dataType.fieldNames():
        rules = rules.withColumn("r", F.col("r").withField("x", F.lit(None).cast("struct<ruleId:string,status:string,scope:string,targets:array<string>,phases:array<string>>")))
    extended = F.col("r.x").isNotNull()
    flat = rules.select(
        "country", "rule_no", F.col("r.fieldName").alias("field_name"), F.col("r.fieldGroupLabel").alias("group_label"),
        F.coalesce("r.isRequired", F.lit(False)).alias("is_required"), F.coalesce("r.isApplicable", F.lit(True)).alias("is_applicable"),
        F.col("r.regexPattern").alias("regex_pattern"), F.col("r.x.ruleId").alias("rule_id"),
        F.when(extended, F.coalesce("r.x.status", F.lit(DEFAULT_STATUS))).alias("status"), F.coalesce("r.x.scope", F.lit("$")).alias("scope"),
        F.when(extended, F.coalesce("r.x.phases", F.array(*map(F.lit, DEFAULT_PHASES)))).alias("phases"), F.col("r.x.targets").alias("targets"),
    )
    dependencies = rules.select("country", "rule_no", F.posexplode("r.dependencies").alias("dependency_no", "d"))
    conditions = dependencies.select(
        "country", "rule_no", "dependency_no", F.col("d.ruleType").alias("rule_type"), F.posexplode("d.conditions").alias("condition_no", "c")
    )
    tests = conditions.select(
        "country", "rule_no", "dependency_no", "condition_no", "rule_type", F.col("c.fieldName").alias("field_name"), "c.operator", "c.values"
    )
    actions = conditions.select(
        "country", "rule_no", "dependency_no", "condition_no", F.col("c.action.actionType").alias("action_type"),
        F.explode("c.action.targetFields").alias("target_field"),
    )
    return flat, tests, actions


def read_rulesets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rulesets from JSON files, one object per file, with the schema declared and never inferred."""
    return ruleset_tables(spark.read.schema(RULESET_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True))


def rules_by_country(rulesets: DataFrame, limit: int = 10_000) -> dict[str, list[Rule]]:
    """The rules of every country as driver objects, ready to compile. Configuration: the size of each country's is checked."""

    def condition(c) -> Condition:
        action = c.action
        return Condition(
            c.fieldName, c.operator, tuple(c.values or ()), action.actionType if action else None,
            tuple(action.targetFields or ()) if action else (),
        )

    def rule(r) -> Rule:
        dependencies = tuple(
            Dependency(d.ruleType, tuple(condition(c) for c in d.conditions or ()), tuple(d.applicableFields or ())) for d in r.dependencies or ()
        )
        x = r.x
        return Rule(
            r.fieldName, x.ruleId if x else None, bool(r.isRequired), True if r.isApplicable is None else r.isApplicable, r.regexPattern,
            (x.scope if x else None) or "$", "active" if x is None else x.status or DEFAULT_STATUS,
            DEFAULT_PHASES if x is None or x.phases is None else tuple(x.phases), dependencies,
        )

    found: dict[str, list[Rule]] = {}
    rows = rulesets.select(F.upper(F.trim("iso2CountryCode")).alias("country"), F.inline("rules"))
    large = rows.groupBy("country").count().where(F.col("count") > limit).first()
    if large is not None:
        raise ValueError(f"more than {limit} rules for {large.country}")
    for row in rulesets.select(F.upper(F.trim("iso2CountryCode")).alias("country"), "rules").collect():
        found.setdefault(row.country, []).extend(rule(r) for r in row.rules or ())
    return found


def load_rulesets(spark: SparkSession, path: str, limit: int = 10_000) -> dict[str, list[Rule]]:
    """The rules of all countries, from JSON files with one rule set each."""
    return rules_by_country(spark.read.schema(RULESET_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True), limit)


def load_rules(spark: SparkSession, path: str, country: str, limit: int = 10_000) -> list[Rule]:
    """The rules of one country."""
    rows = spark.read.schema(RULESET_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)
    code = country.strip().upper()
    return rules_by_country(rows.where(F.upper(F.trim("iso2CountryCode")) == code), limit).get(code, [])


def playbook_tables(playbooks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bindings, documents and connectors of nested playbooks."""
    country = F.upper(F.trim("countryCode")).alias("country")
    bindings = playbooks.select(country, F.posexplode("bindings").alias("ordinal", "b")).select(
        "country", "ordinal", F.col("b.logicalFieldId").alias("logical_id"), F.col("b.label").alias("label"), F.col("b.bind.kind").alias("kind"),
        F.col("b.bind.taxTypeCode").alias("tax_type_code"), F.col("b.bind.formPath").alias("form_path"), F.col("b.bind.field").alias("field"),
        F.coalesce("b.bind.index", F.lit(0)).alias("index"), F.col("b.bind.key").alias("key"), F.col("b.validator").alias("validator"),
        F.coalesce("b.singleton", F.lit(False)).alias("singleton"), F.col("b.needsResolution").alias("needs_resolution"),
    )
    documents = playbooks.select(country, F.posexplode("documents").alias("ordinal", "d")).select(
        "country", "ordinal", F.col("d.docType").alias("doc_type"), F.coalesce("d.writable", F.lit(True)).alias("writable"),
        F.col("d.attributes").alias("attributes"),
    )
    connectors = playbooks.select(country, F.posexplode("connectors").alias("ordinal", "c")).select("country", "ordinal", "c.id", "c.type")
    return bindings, documents, connectors


def read_playbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return playbook_tables(spark.read.schema(PLAYBOOK_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True))


def resolve_overlay(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """The overlay replaces the whole configuration of a key; other keys keep the base. No field merge."""
    return overlay.unionByName(base.join(overlay.select(key).distinct(), key, "left_anti"))


def read_snapshot(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Reference snapshot stored by country; the filter prunes partitions."""
    table = spark.read.parquet(path)
    return table if country is None else reference_snapshot(table, country)


def reference_snapshot(table: DataFrame, country: str) -> DataFrame:
    return table.where(F.col("country") == country.strip().upper())
