"""Integrity and identifier audits over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import identifiers as I
from entityops.functions import text as T
from entityops.functions.rows import struct_rows

FINDING = ["finding", "subject", "rows"]


def integrity_audit(
    table: DataFrame,
    key: list[str],
    references: dict[str, tuple[DataFrame, str]] | None = None,
    codes: dict[str, list[str]] | None = None,
    requires: dict[str, str] | None = None,
) -> DataFrame:
    """Findings as rows (finding, subject, rows).

    Duplicate keys; values without a partner in a reference table; values outside a code list; rows
    where a column is set but the column it requires is not.  Every part is counted per value before
    anything is joined, so the joins see distinct values only.
    """

    def subject(prefix: str, *names: str):
        return F.concat(F.lit(prefix), F.concat_ws("|", *[F.col(n).cast("string") for n in names]))

    parts = [
        table.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .select(F.lit("duplicate_key").alias("finding"), subject("", *key).alias("subject"), "rows")
    ]
    for name, (reference, column) in (references or {}).items():
        used = table.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
        missing = used.join(reference.select(F.col(column).alias(name)), name, "left_anti")
        parts.append(missing.select(F.lit("dangling_reference").alias("finding"), subject(f"{name}=", name).alias("subject"), "rows"))
    for name, allowed in (codes or {}).items():
        unknown = table.where(F.col(name).isNotNull() & ~F.col(name).isin(*allowed)).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(unknown.select(F.lit("unknown_code").alias("finding"), subject(f"{name}=", name).alias("subject"), "rows"))
    for name, other in (requires or {}).items():
        broken = table.where(T.present(F.col(name)) & T.blank(F.col(other)))
        parts.append(
            broken.agg(F.count(F.lit(1)).alias("rows")).where("rows > 0")
            .select(F.lit("inconsistent_columns").alias("finding"), F.lit(f"{name} without {other}").alias("subject"), "rows")
        )
    return reduce(DataFrame.unionByName, parts)


def rule_ledger(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Features of a rules table that the base rule format cannot carry, with one of five reasons.

    rules: rule_id, field_name, effects (array), cel_expression, severity, severity_by_phase (map), scope;
    conditions: rule_id, field_name, operator.
    """
    flagged = rules.select(
        "rule_id", "field_name",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(F.size("effects"), F.lit(0)) > 0, F.lit("no-inverse-effect")),
                    F.when(T.present(F.col("cel_expression")), F.lit("cel-expression-not-projectable")),
                    F.when(
                        (F.col("severity") != "error") | (F.coalesce(F.size("severity_by_phase"), F.lit(0)) > 0), F.lit("no-severity-field")
                    ),
                    F.when(F.col("scope").contains("[?("), F.lit("row-filter-not-representable")),
                )
            )
        ).alias("reason"),
    )
    operators = conditions.where(~F.col("operator").isin(*C.BASE_OPERATORS)).select(
        "rule_id", "field_name", F.lit("extended-operator-only").alias("reason")
    )
    return flagged.unionByName(operators)


def identifier_verdicts(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Add ok, normalised and reason of one identifier column."""
    return df.withColumn("_v", I.run_validator(kind, F.col(column))).select(
        *df.columns, F.col("_v.ok").alias("ok"), F.col("_v.normalised").alias("normalised"), F.col("_v.reason").alias("reason")
    )


def identifier_audit(df: DataFrame, columns: dict[str, str], group: list[str]) -> DataFrame:
    """Conformance counts per group and kind; ``columns``: kind -> column."""
    cells = struct_rows(
        "kind present ok",
        *[(kind, T.present(F.col(c)), I.run_validator(kind, F.col(c))["ok"]) for kind, c in columns.items()],
    )
    return (
        df.select(*group, F.inline(cells))
        .where("present")
        .groupBy(*group, "kind")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if("ok").alias("valid"))
    )


def cross_field_checks(identities: DataFrame, keys: list[str]) -> DataFrame:
    """Consistency of pan, gstin, ifsc, region_code and is_natural_person; skipped checks are dropped."""
    pan, gstin, ifsc, region = (F.nullif(F.col(c), F.lit("")) for c in ("pan", "gstin", "ifsc", "region_code"))
    embedded, derived = I.embedded_pan(gstin), I.state_region(gstin)
    person, claimed = I.natural_person(pan), F.col("is_natural_person")

    def shape(kind, value):
        return F.when(value.isNotNull(), F.when(I.run_validator(kind, value)["ok"], F.lit("pass")).otherwise(F.lit("fail")))

    contains = F.when(
        gstin.isNotNull() & pan.isNotNull(),
        F.when(embedded.isNull(), F.lit("warn")).when(embedded == T.norm_id(pan), F.lit("pass")).otherwise(F.lit("fail")),
    )
    place = F.when(
        gstin.isNotNull() & region.isNotNull() & derived.isNotNull(),
        F.when(derived == F.upper(T.strip(region)), F.lit("pass")).otherwise(F.lit("warn")),
    )
    entity = F.when(
        pan.isNotNull(),
        F.when(person.isNull(), F.lit("warn")).when(claimed.isNull() | (claimed == person), F.lit("pass")).otherwise(F.lit("warn")),
    )
    cells = struct_rows(
        "check_id status",
        ("pan_shape", shape("pan", pan)),
        ("gstin_shape", shape("gstin", gstin)),
        ("ifsc_shape", shape("ifsc", ifsc)),
        ("gstin_contains_pan", contains),
        ("gstin_state_vs_address_region", place),
        ("pan_entity_type", entity),
    )
    return identities.select(*keys, F.inline(cells)).where("status IS NOT NULL")


def locale_checks(records: DataFrame, keys: list[str]) -> DataFrame:
    """Identifier check of the record's country: country, tax_id, company_number."""
    by_country = [("CN", "uscc_checksum", "uscc"), ("AE", "ae_trn_shape", "trn"), ("US", "us_ein_shape", "ein"), ("GB", "gb_vat_shape", "gb_vat")]
    country = F.upper(T.strip(F.col("country")))

    def verdict(kind, column):
        return F.when(
            T.present(F.col(column)), F.when(I.run_validator(kind, F.col(column))["ok"], F.lit("pass")).otherwise(F.lit("fail"))
        )

    rows = [(check, F.when(country == code, verdict(kind, "tax_id"))) for code, check, kind in by_country]
    rows.append(("gb_crn_shape", F.when(country == "GB", verdict("gb_crn", "company_number"))))
    return records.select(*keys, F.inline(struct_rows("check_id status", *rows))).where("status IS NOT NULL")
