"""Registry and directory payloads of different shapes, brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import text as T

HIT = ["record_id", "tax_id", "legal_name", "trading_name", "street", "city", "postal_code", "country", "source_type", "website"]


def _alias(payload: str, names: list[str]) -> Column:
    return T.first_present(*[F.element_at(F.col(payload), n) for n in names])


def is_inactive(status: Column) -> Column:
    return F.coalesce(F.lower(T.strip(status)).isin(*C.INACTIVE_STATUSES), F.lit(False))


def harmonise_tax_registry(payloads: DataFrame) -> DataFrame:
    """record_id, tax_id, payload map<string, string>, address map<string, string> -> one schema, active ones only."""
    legal = _alias("payload", C.REGISTRY_ALIASES["legal_name"])
    street = F.concat_ws(" ", *[T.strip_to_null(F.element_at("address", n)) for n in ("street", "bnm", "bno", "st", "addr", "address_line_1")])
    rows = payloads.withColumn("_status", _alias("payload", C.REGISTRY_ALIASES["status"]))
    return rows.where(~is_inactive(F.col("_status"))).select(
        "record_id", "tax_id", legal.alias("legal_name"), F.coalesce(_alias("payload", C.REGISTRY_ALIASES["trading_name"]), legal).alias("trading_name"),
        F.nullif(street, F.lit("")).alias("street"), _alias("address", C.REGISTRY_ALIASES["city"]).alias("city"),
        _alias("address", C.REGISTRY_ALIASES["postal_code"]).alias("postal_code"), F.lit("IN").alias("country"),
        F.lit("government_registry").alias("source_type"), F.lit(None).cast("string").alias("website"),
    )


def harmonise_company_register(payloads: DataFrame) -> DataFrame:
    """record_id, company_number, company_name and office map<string, string> -> one schema."""
    office = lambda n: F.element_at("office", n)
    street = F.concat_ws(" ", *[T.strip_to_null(office(n)) for n in ("premises", "address_line_1", "address_line_2")])
    return payloads.select(
        "record_id", F.col("company_number").alias("tax_id"), F.col("company_name").alias("legal_name"), F.col("company_name").alias("trading_name"),
        F.nullif(street, F.lit("")).alias("street"), T.first_present(office("locality"), office("region")).alias("city"),
        office("postal_code").alias("postal_code"), F.lit("GB").alias("country"), F.lit("government_registry").alias("source_type"),
        F.lit(None).cast("string").alias("website"),
    )


def directory_source(given: Column, bvd_id: Column, duns: Column) -> Column:
    """DNB or BVD: as given, else by which identifier is there, else BVD."""
    return F.when(given.isin("DNB", "BVD"), given).when(bvd_id.isNotNull(), F.lit("BVD")).when(duns.isNotNull(), F.lit("DNB")).otherwise(F.lit("BVD"))


def harmonise_directory(summaries: DataFrame) -> DataFrame:
    """Directory hits: the PRIMARY address or else the first, the first tax number, names filled from each other.

    summaries: record_id, company_name, legal_name, given_source, bvd_id, duns, country, url, combined_address,
    city, postal_code, addresses array<struct<type, street_number, street_name, floor, city, postal_code>>,
    tax_numbers array<string>.
    """
    primary = F.filter("addresses", lambda a: a["type"] == "PRIMARY")
    chosen = F.coalesce(F.try_element_at(primary, F.lit(1)), F.try_element_at("addresses", F.lit(1)))
    rows = summaries.withColumn("_a", chosen)
    street = F.nullif(F.concat_ws(" ", *[T.strip_to_null(F.col(f"_a.{n}")) for n in ("street_number", "street_name", "floor")]), F.lit(""))
    tax = F.try_element_at(F.filter("tax_numbers", lambda x: T.present(x)), F.lit(1))
    name, legal = T.strip_to_null(F.col("company_name")), T.strip_to_null(F.col("legal_name"))
    return rows.select(
        "record_id", T.strip(tax).alias("tax_id"), F.coalesce(legal, name).alias("legal_name"), F.coalesce(name, legal).alias("trading_name"),
        F.coalesce(street, F.col("combined_address")).alias("street"), T.first_present(F.col("_a.city"), F.col("city")).alias("city"),
        T.first_present(F.col("_a.postal_code"), F.col("postal_code")).alias("postal_code"), "country",
        directory_source(F.col("given_source"), F.col("bvd_id"), F.col("duns")).alias("source_type"), F.col("url").alias("website"),
    )
