"""Registered queries of the projections, guards, resolution and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions.ordering import first_row
from entityops.functions.rows import struct_rows
from entityops.operators import project as P
from entityops.operators import resolve as S
from entityops.plans import sql, views
from entityops.plans.q_rules import IDENTITIES as _IDENT
from entityops.plans.q_rules import identity_rows
from entityops.plans.registry import query

_USES = ("v_lines", "v_options")


# --- patches ---------------------------------------------------------------------------------


def envelopes(t):
    """One extracted document per customer, cycling through the national document types."""
    key = F.col("c_custkey")
    kinds = list(dict.fromkeys(row[0] for row in P.PATCH_SPEC))
    ids = identity_rows(t).select("record_id", "pan", "gstin", "ifsc")
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(ids, key == F.col("record_id"))
    name = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(" ")), F.when(key % 6 == 0, F.lit("!")).otherwise(F.lit("")))
    return base.select(
        key.alias("document_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % len(kinds) + 1).cast("int")).alias("doc_type"),
        (F.lit(70) + key % 30).cast("double").alias("_c"), "pan", "gstin", "ifsc", name.alias("holder_name"), name.alias("trade_name"),
        F.when(key % 4 != 0, name).alias("legal_name"), name.alias("company_name"), name.alias("firm_name"),
        F.when(key % 3 != 0, key.cast("string")).alias("account_number"), F.lit("  ").alias("bank_name"), F.concat(F.lit(" u"), key.cast("string")).alias("cin"),
        F.concat(F.lit("ie c"), key.cast("string")).alias("iec_code"), F.concat(key.cast("string"), F.lit(" ")).alias("registration_number"),
        key.cast("string").alias("licence_number"), F.lit(None).cast("string").alias("building_name"), (key % 50).cast("string").alias("street_number"),
        F.col("c_mktsegment").alias("street_name"), F.when(key % 2 == 0, "north#side").otherwise("north side").alias("district"),
        F.when(key % 5 != 0, F.lpad((key % 1000000).cast("string"), 6, "0")).otherwise("12345").alias("postal_code"), F.col("n_name").alias("city_name"),
    ).withColumn("confidence", F.col("_c") / 100).drop("_c")


_KINDS = list(dict.fromkeys(row[0] for row in P.PATCH_SPEC))
_NAME = "trim(replace(c_name, '#', ' ') || CASE WHEN k % 6 = 0 THEN '!' ELSE '' END)"
_COLUMN_SQL = {
    "pan": "upper(pan)", "gstin": "gstin", "holder_name": _NAME, "trade_name": _NAME, "company_name": _NAME, "firm_name": _NAME,
    "legal_name": f"CASE WHEN k % 4 <> 0 THEN {_NAME} END", "account_number": "CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END", "bank_name": "NULL",
    "ifsc": "ifsc", "cin": "concat('u', k)", "iec_code": "concat('IEC', k)", "registration_number": "CAST(k AS VARCHAR)", "licence_number": "CAST(k AS VARCHAR)",
    "building_name": "NULL", "street_number": "CAST(k % 50 AS VARCHAR)", "street_name": "c_mktsegment",
    "district": "CASE WHEN k % 2 = 0 THEN 'north#side' ELSE 'north side' END",
    "postal_code": "CASE WHEN k % 5 <> 0 THEN lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') ELSE '12345' END", "city_name": "n_name",
}


def _patch_rows() -> str:
    out = []
    for number, (doc_type, column, path, label, field, kind) in enumerate(P.PATCH_SPEC):
        position = number - next(i for i, r in enumerate(P.PATCH_SPEC) if r[0] == doc_type)
        value = _COLUMN_SQL[column]
        if kind == "region":
            value = sql.case_of("substr(gstin, 1, 2)", C.STATE_REGION)
        elif kind == "person":
            value = f"CASE WHEN regexp_matches(upper(pan), '{C.PAN}') AND substr(upper(pan), 4, 1) <> 'X' THEN CAST(substr(upper(pan), 4, 1) = 'P' AS VARCHAR) END"
        pattern = C.FIELD_PATTERNS.get(field)
        ok = f"regexp_matches(({value}), {sql.quote(pattern)})" if pattern else "true"
        sure = "true" if kind in ("plain", "id", "region", "person") else "false"
        need = {"city": "'cityCode'", "ifsc": "'bankingInstitutionCode'"}.get(kind, "NULL")
        out.append(
            f"SELECT k AS document_id, '{doc_type}' AS doc_type, {position} AS position, '{path}' AS path, {sql.quote(label)} AS label, {value} AS value, "
            f"confidence, {sql.quote(field) if field in ('TAXNO3', 'TAXNO4') else 'NULL'} AS tax_type_code, {need} AS needs_resolution, {ok} AS regex_ok, "
            f"confidence >= 0.8 AND {ok} AND {sure} AS pre_selected FROM env WHERE doc_type = '{doc_type}' AND ({value}) IS NOT NULL"
        )
    return "\nUNION ALL ".join(out)


@query(
    "prj_4_unpivot_patches",
    f"""WITH {_IDENT}, env AS (SELECT i.k, i.pan, i.gstin, i.ifsc, c_name, c_mktsegment, n_name, (70 + c_custkey % 30)::DOUBLE / 100 AS confidence,
  [{', '.join(sql.quote(k) for k in _KINDS)}][c_custkey % {len(_KINDS)} + 1] AS doc_type
  FROM customer JOIN nation ON customer.c_nationkey = n_nationkey JOIN ident i ON i.record_id = c_custkey)
{_patch_rows()}""",
)
def unpivot_patches(t):
    return P.unpivot_patches(envelopes(t)).drop("field_name")


_LOCALE_KINDS = ["CN_BUSINESS_LICENSE", "AE_TRADE_LICENSE", "US_W9", "GB_COMPANIES_HOUSE_CERTIFICATE", "US_VOIDED_CHECK", "GB_VAT_CERTIFICATE"]


def locale_envelopes(t):
    """Documents as locale envelopes: the whole text is a name, its lines in one a street, its last line a city."""
    key = F.col("doc_id")
    return t.documents.select(
        key.alias("document_id"), F.element_at(F.array(*[F.lit(k) for k in _LOCALE_KINDS]), (key % len(_LOCALE_KINDS) + 1).cast("int")).alias("doc_type"),
        ((F.lit(70) + key % 30) / 100).alias("confidence"), F.concat(F.lit(" t"), key.cast("string")).alias("tax_number"),
        F.when(key % 3 == 0, F.col("text")).alias("legal_name_native"), F.when(key % 2 == 0, F.lit("Romanised")).alias("legal_name_romanised"),
        F.when(key % 5 != 0, F.lit("English")).alias("legal_name"), F.lit(None).cast("string").alias("trading_name_native"),
        F.lit("Trade").alias("trading_name_romanised"), F.lit(None).cast("string").alias("trading_name"), F.replace("text", F.lit("\n"), F.lit(", ")).alias("street_name"),
        F.when(key % 4 == 0, F.substring_index("text", "\n", -1)).alias("city_name"), F.lit("9").alias("account_number"), F.lit(" ").alias("bank_name"),
    )


_LOCALE_ENV = f"""env AS (SELECT doc_id AS id, [{', '.join(sql.quote(k) for k in _LOCALE_KINDS)}][doc_id % {len(_LOCALE_KINDS)} + 1] AS kind, (70 + doc_id % 30)::DOUBLE / 100 AS conf,
  CASE WHEN doc_id % 3 = 0 THEN nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') END AS nat, CASE WHEN doc_id % 2 = 0 THEN 'Romanised' END AS rom,
  CASE WHEN doc_id % 5 <> 0 THEN 'English' END AS eng, nullif(regexp_replace(replace(text, chr(10), ', '), '^\\s+|\\s+$', '', 'g'), '') AS street,
  CASE WHEN doc_id % 4 = 0 THEN nullif(regexp_replace(string_split(text, chr(10))[-1], '^\\s+|\\s+$', '', 'g'), '') END AS city FROM documents)"""
_N = "coalesce(rom, eng)"
_DUAL = "kind IN ('CN_BUSINESS_LICENSE', 'AE_TRADE_LICENSE')"


@query(
    "prj_5_unpivot_locale_patches",
    f"""WITH {_LOCALE_ENV}, names AS (
  SELECT id, kind, conf, 'legalName' AS path, coalesce({_N}, nat) AS value, nat AS native FROM env WHERE {_DUAL}
  UNION ALL SELECT id, kind, conf, 'tradingName', 'Trade', NULL FROM env WHERE {_DUAL}),
addr AS (SELECT id, kind, conf, p.path AS path, CASE p.k WHEN 1 THEN street ELSE city END AS value FROM env
  CROSS JOIN (VALUES (1, 'postalAddresses.0.streetName'), (2, 'postalAddresses.0.cityName')) p(k, path) WHERE {_DUAL} OR kind = 'GB_COMPANIES_HOUSE_CERTIFICATE'),
plain AS (SELECT id, kind, conf, 'taxInformation.taxIdentificationNumbers.0.taxIdentificationNumber' AS path, concat('t', id) AS value, 'latin_id' AS pol, true AS sel FROM env
    WHERE kind IN ('CN_BUSINESS_LICENSE', 'US_W9', 'GB_VAT_CERTIFICATE')
  UNION ALL SELECT id, kind, conf, 'legalName', eng, CASE WHEN kind = 'US_W9' THEN 'english_only' END, true FROM env WHERE kind IN ('US_W9', 'GB_COMPANIES_HOUSE_CERTIFICATE', 'GB_VAT_CERTIFICATE')
  UNION ALL SELECT id, kind, conf, 'vendorBankAccounts.0.bankAccountNumber', '9', NULL, false FROM env WHERE kind = 'US_VOIDED_CHECK')
SELECT id AS document_id, path, value, conf >= 0.8 AND native IS NULL AS pre_selected, native AS native_value,
  CASE WHEN native IS NOT NULL THEN 'native_required' ELSE 'english_only' END AS field_policy,
  CASE WHEN native IS NULL THEN 'en' WHEN kind LIKE 'CN%' THEN 'zh' ELSE 'ar' END AS script, CASE WHEN native IS NOT NULL THEN CASE WHEN kind LIKE 'CN%' THEN 'C' ELSE 'A' END END AS charset_code
FROM names WHERE value IS NOT NULL
UNION ALL SELECT id, path, value, conf >= 0.8 AND NOT ({_DUAL} AND regexp_matches(value, '[^\\x00-\\x7F]')), CASE WHEN {_DUAL} AND regexp_matches(value, '[^\\x00-\\x7F]') THEN value END,
  CASE WHEN {_DUAL} AND regexp_matches(value, '[^\\x00-\\x7F]') THEN 'native_required' ELSE 'english_only' END,
  CASE WHEN NOT regexp_matches(value, '[^\\x00-\\x7F]') OR kind LIKE 'GB%' THEN 'en' WHEN kind LIKE 'CN%' THEN 'zh' ELSE 'ar' END,
  CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN CASE WHEN kind LIKE 'CN%' THEN 'C' WHEN kind LIKE 'AE%' THEN 'A' END END
FROM addr WHERE value IS NOT NULL
UNION ALL SELECT id, path, value, conf >= 0.8 AND sel, NULL, pol, NULL, NULL FROM plain WHERE value IS NOT NULL""",
)
def unpivot_locale(t):
    return P.unpivot_locale_patches(locale_envelopes(t)).select(
        "document_id", "path", "value", "pre_selected", "native_value", "field_policy", "script", "charset_code"
    )


@query(
    "flt_4_regex_gate",
    f"""WITH cells AS (SELECT c_custkey AS id, 'tradingName' AS field_name, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'postalCode', CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE '12' END FROM customer
  UNION ALL SELECT c_custkey, 'other', c_mktsegment FROM customer)
SELECT id, field_name, CASE field_name WHEN 'tradingName' THEN regexp_matches(value, {sql.quote(C.FIELD_PATTERNS['tradingName'])})
  WHEN 'postalCode' THEN regexp_matches(value, '^[0-9]{{6}}$') ELSE true END AS regex_ok FROM cells""",
)
def regex_gate(t):
    key = F.col("c_custkey")
    cells = struct_rows(
        "field_name value", ("tradingName", F.col("c_name")), ("postalCode", F.when(key % 3 == 0, F.lpad(key.cast("string"), 6, "0")).otherwise("12")),
        ("other", F.col("c_mktsegment")), ("TAXNO1", F.lit("x")), ("ibanNumber", F.lit("y")),
    )
    return P.regex_gate(t.customer.select(key.alias("id"), F.inline(cells))).select("id", "field_name", "regex_ok")


@query(
    "flt_3_doc_matches_country",
    """SELECT p_partkey AS id, p_size % 4 <> 0 AND starts_with(upper(concat(substr(p_name, 1, 2), '_', p_type)), concat(upper(substr(p_brand, 1, 1)), upper(substr(p_name, 2, 1)), '_')) AS ok FROM part""",
)
def doc_matches_country(t):
    country = F.concat(F.lower(F.substring("p_brand", 1, 1)), F.substring("p_name", 2, 1))
    kind = F.when(F.col("p_size") % 4 == 0, "unknown ").otherwise(F.concat(F.lit(" "), F.substring("p_name", 1, 2), F.lit("_"), "p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), P.doc_matches_country(country, kind).alias("ok"))


def _address(key, city, region):
    none = F.lit(None).cast("string")
    return F.struct(
        none.alias("building_name"), F.when(key % 3 == 0, key.cast("string")).alias("street_number"), F.lit(" ").alias("street_name"), none.alias("district"),
        city.alias("city_name"), region.alias("region_name"), F.when(key % 4 == 0, F.lit("P1 ")).alias("postal_code"),
    )


_ROLE_KINDS = ["IN_GST_CERTIFICATE", "IN_CERTIFICATE_OF_INCORPORATION", "IN_ADDRESS_PROOF", "IN_DEED_OF_PARTNERSHIP", "IN_UDYAM_CERTIFICATE", "IN_PAN_CARD"]


@query(
    "prj_6_address_candidates",
    f"""WITH base AS (SELECT s_suppkey AS id, [{', '.join(sql.quote(k) for k in _ROLE_KINDS)}][s_suppkey % 6 + 1] AS kind, n_name, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lines AS (SELECT id, kind, 0 AS at_no, CASE WHEN id % 5 <> 0 THEN n_name END AS city, concat_ws(', ', CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END, CASE WHEN id % 5 <> 0 THEN n_name END, CASE WHEN id % 5 <> 0 THEN r_name END,
    CASE WHEN id % 4 = 0 THEN 'P1' END) AS line FROM base
  UNION ALL SELECT id, kind, a, CASE a WHEN 1 THEN n_name END, concat_ws(', ', CASE WHEN (id + a) % 3 = 0 THEN CAST(id + a AS VARCHAR) END, CASE a WHEN 1 THEN n_name END, CASE WHEN (id + a) % 4 = 0 THEN 'P1' END)
    FROM base CROSS JOIN (VALUES (1), (2)) v(a) WHERE kind = 'IN_GST_CERTIFICATE')
SELECT id AS document_id, CASE WHEN at_no > 0 THEN concat(kind, ':apob:', at_no) ELSE concat(kind, ':', CASE kind WHEN 'IN_GST_CERTIFICATE' THEN 'principal_pob'
    WHEN 'IN_CERTIFICATE_OF_INCORPORATION' THEN 'registered_office' WHEN 'IN_ADDRESS_PROOF' THEN 'operational' WHEN 'IN_DEED_OF_PARTNERSHIP' THEN 'registered_address' ELSE 'plant' END) END AS candidate_key,
  CASE WHEN at_no > 0 THEN 'additional_pob' ELSE CASE kind WHEN 'IN_GST_CERTIFICATE' THEN 'principal_pob' WHEN 'IN_CERTIFICATE_OF_INCORPORATION' THEN 'registered_office'
    WHEN 'IN_ADDRESS_PROOF' THEN 'operational' WHEN 'IN_DEED_OF_PARTNERSHIP' THEN 'registered_office' ELSE 'plant' END END AS address_role,
  CASE WHEN at_no > 0 THEN concat_ws(' — ', concat('Additional place ', at_no), city) END AS label, line AS full_text
FROM lines WHERE kind <> 'IN_PAN_CARD' AND line <> ''""",
)
def address_candidates(t):
    key = F.col("s_suppkey")
    base = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    here = key % 5 != 0
    none = F.lit(None).cast("string")
    docs = base.select(
        key.alias("document_id"), F.element_at(F.array(*[F.lit(k) for k in _ROLE_KINDS]), (key % 6 + 1).cast("int")).alias("doc_type"), F.lit(0.9).alias("confidence"),
        _address(key, F.when(here, F.col("n_name")), F.when(here, F.col("r_name"))).alias("address"),
        F.array(_address(key + 1, F.col("n_name"), none), _address(key + 2, none, none)).alias("additional"),
    )
    found = P.address_candidates(docs)
    return found.select("document_id", "candidate_key", "address_role", F.when(F.col("address_role") == "additional_pob", F.col("label")).alias("label"), "full_text")


@query(
    "prj_7_address_search_line",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'Whole line' ELSE concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END, c_mktsegment,
  concat(r_name, ' X'), n_name, CASE WHEN c_custkey % 5 = 0 THEN '99' END) END AS line
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def search_line(t):
    key = F.col("c_custkey")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    some = key % 9 != 0
    parts = {
        "unit_number": F.when(some & (key % 2 == 0), key.cast("string")), "street_number": F.lit("  "), "street_name": F.when(some, F.concat(F.lit(" "), "c_mktsegment")),
        "subdivisions": F.when(some, F.array(F.col("r_name"), F.lit(" "), F.lit("X "))), "city": F.when(some, F.col("n_name")),
        "region": F.lit(None).cast("string"), "postal_code": F.when(some & (key % 5 == 0), "99"), "postal_address": F.lit(" Whole line "),
    }
    return rows.select(key.alias("id"), P.address_search_line(parts).alias("line"))


@query(
    "prj_8_select_result_to_patches",
    """WITH r AS (SELECT c_custkey AS id, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cells AS (SELECT id, 'streetName' AS f, c_mktsegment AS value FROM r
  UNION ALL SELECT id, 'cityName', CASE WHEN id % 3 = 0 THEN n_name WHEN id % 3 = 1 THEN concat('Sug ', n_name) ELSE 'Sub' END FROM r
  UNION ALL SELECT id, 'cityCode', CASE WHEN id % 3 = 1 THEN concat('G', id) END FROM r
  UNION ALL SELECT id, 'latitude', '1.5' FROM r
  UNION ALL SELECT id, 'regionCode', CASE WHEN id % 3 = 1 THEN 'SR' END FROM r
  UNION ALL SELECT id, 'regionName', CASE WHEN id % 2 = 0 THEN r_name WHEN id % 3 = 1 THEN 'Sug region' END FROM r
  UNION ALL SELECT id, 'iso2CountryCode', 'IN' FROM r)
SELECT id, concat('postalAddresses.0.', f) AS path, value FROM cells WHERE value IS NOT NULL""",
)
def select_result(t):
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))

    def code(kind, value):
        return F.struct(F.lit(kind).alias("alternativeCodeType"), value.alias("alternativeCode"))

    region = F.struct(F.lit("").alias("code"), F.when(key % 2 == 0, F.col("r_name")).alias("name"))
    suggestion = F.struct(
        F.concat(F.lit("Sug "), "n_name").alias("city_name"), F.array(code("UN", F.lit("u")), code("GEO_ID", F.concat(F.lit(" G"), key.cast("string")))).alias("codes"),
        F.struct(F.lit("SR").alias("code"), F.lit("Sug region").alias("name")).alias("region"),
    )
    subdivision = F.struct(F.lit("subCity").alias("label"), F.lit("Sub").alias("name"))
    results = rows.select(
        key.alias("id"), none.alias("unit_number"), F.lit("").alias("street_number"), F.col("c_mktsegment").alias("street_name"),
        F.when(key % 3 == 0, F.col("n_name")).otherwise(" ").alias("city"), none.alias("postal_code"), F.lit(1.5).alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        region.alias("region"), F.lit("IN").alias("country"), none.alias("postal_address"), F.when(key % 3 == 1, F.array(suggestion)).alias("suggestions"), F.array(subdivision).alias("subdivisions"),
    )
    return P.select_result_to_patches(results, ["id"]).select("id", "path", "value")


@query(
    "prj_11_split_mapped_unmapped",
    """SELECT document_id, path, 'patch' AS part, CASE WHEN confidence > 0.97 THEN 0.8::DOUBLE ELSE confidence END AS confidence, value AS shown, doc_type AS source_label FROM v_options WHERE NOT starts_with(path, '_unmapped')
UNION ALL SELECT document_id, path, 'hint', NULL, CASE WHEN value = '0' THEN '—' ELSE value END, doc_type FROM v_options WHERE starts_with(path, '_unmapped')""",
    _USES,
)
def split_mapped(t):
    value = F.when(F.col("path").startswith("_unmapped"), F.nullif("value", F.lit("0"))).otherwise(F.col("value"))
    patches = t.v_options().select("document_id", "doc_type", "path", "label", value.alias("value"), F.when(F.col("confidence") <= 0.97, F.col("confidence")).otherwise(0.0).alias("confidence"))
    mapped, hints = P.split_mapped_unmapped(patches)
    return mapped.select("document_id", "path", F.lit("patch").alias("part"), "confidence", F.col("value").alias("shown"), "source_label").unionByName(
        hints.select("document_id", "path", F.lit("hint").alias("part"), F.lit(None).cast("double").alias("confidence"), F.col("display").alias("shown"), "source_label")
    )


@query(
    "prj_11_registry_patches",
    """SELECT s_suppkey AS id, 'tradingName' AS path, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'fallback') AS value,
  CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 100)::DOUBLE / CASE WHEN s_suppkey % 100 > 1 THEN 100 ELSE 1 END WHEN 1 THEN 0.5 ELSE 0.88 END AS confidence FROM supplier""",
)
def registry_patches(t):
    key = F.col("s_suppkey")
    rows = t.supplier.select(
        key.alias("id"), F.when(key % 2 == 0, F.col("s_name")).alias("company_name"), F.lit("fallback").alias("fallback_name"), F.lit("DNB").alias("source_type"),
        F.when(key % 4 == 0, (key % 100).cast("string")).when(key % 4 == 1, "0.5").when(key % 4 == 2, "n/a").alias("match_score"),
    )
    return P.registry_patches(rows, ["id"]).select("id", "path", "value", "confidence")


def _envelope_pair(t, shift):
    key = F.col("o_orderkey")
    on = (key + shift) % 3 == 0
    return t.orders.select(
        key.alias("id"), F.lit(f"type{shift}").alias("doc_type"), F.when(on, F.col("o_orderstatus")).otherwise("" if shift else None).alias("status"),
        F.when((key + shift) % 2 == 0, F.array(F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(
            (key + shift) % 5 != 0,
            F.struct(F.when(on, F.lit(f"n{shift}")).alias("name"), ((key + shift * 7) % 10 / 10).alias("confidence")),
        ).alias("block"),
    )


@query(
    "prj_12_merge_envelopes",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS t FROM orders)
SELECT k AS id, 'type0' AS doc_type, CASE WHEN k % 3 = 0 THEN s WHEN (k + 1) % 3 = 0 THEN s END AS status, t AS tag,
  CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'n0' WHEN (k + 1) % 5 <> 0 AND (k + 1) % 3 = 0 THEN 'n1' END AS name,
  greatest(CASE WHEN k % 5 <> 0 THEN (k % 10)::DOUBLE / 10 END, CASE WHEN (k + 1) % 5 <> 0 THEN ((k + 7) % 10)::DOUBLE / 10 END) AS confidence FROM p""",
)
def merge_envelopes(t):
    merged = P.merge_envelopes(_envelope_pair(t, 0), _envelope_pair(t, 1), "id", keep=["doc_type"])
    return merged.select("id", "doc_type", F.nullif("status", F.lit("")).alias("status"), F.col("tags")[0].alias("tag"), "block.name", "block.confidence")


@query(
    "prj_13_salvage_blocks",
    """WITH b AS (SELECT bundle_id, document_id, path, value, confidence AS c FROM v_options)
SELECT document_id, path, CASE WHEN path = 'status' AND value = 'O' THEN 'ABCPD1234F' END AS pan,
  CASE WHEN path = 'status' THEN CASE WHEN c < 0.95 THEN 'proof' WHEN value = 'O' THEN 'iec holder' END END AS holder,
  CASE WHEN path = 'status' AND (c < 0.95 OR value = 'O') THEN greatest(CASE WHEN c < 0.95 THEN c END, CASE WHEN value = 'O' THEN 0.93 END, 0)::DOUBLE END AS pan_confidence,
  CASE WHEN path = 'flag' THEN CASE WHEN value = 'O' THEN 'abc pd1234f' ELSE 'x' END END AS licence, CASE WHEN path NOT IN ('status', 'flag') THEN 'CIN9' END AS registration
FROM b""",
    _USES,
)
def salvage_blocks(t):
    path, value, c = F.col("path"), F.col("value"), F.col("confidence")
    none = F.lit(None).cast("string")

    def block(**cells):
        return F.struct(*[v.alias(k) for k, v in cells.items()])

    rows = t.v_options().select(
        "document_id", "path",
        F.when(path == "status", "IN_PAN_CARD").when(path == "flag", "IN_MTO_IATA_CHA_CERTIFICATE").otherwise("IN_DEED_OF_PARTNERSHIP").alias("doc_type"),
        F.lit(None).cast("struct<pan:string,holder_name:string,confidence:double>").alias("pan"),
        block(iec_code=F.when(value == "O", "abc pd1234f").otherwise("x"), holder_name=F.lit("iec holder"), confidence=F.lit(0.93)).alias("iec"),
        F.lit(None).cast("struct<licence_number:string,holder_name:string,confidence:double>").alias("mto"),
        block(holder_name=F.when(c < 0.95, "proof"), confidence=c).alias("address_proof"),
        block(cin=F.lit("CIN9"), company_name=none, confidence=c).alias("coi"),
        F.lit(None).cast("struct<registration_number:string,firm_name:string,confidence:double>").alias("partnership"),
    )
    return P.salvage_blocks(rows).select(
        "document_id", "path", "pan.pan", F.col("pan.holder_name").alias("holder"), F.col("pan.confidence").alias("pan_confidence"),
        F.col("mto.licence_number").alias("licence"), F.col("partnership.registration_number").alias("registration"),
    )


def _gap_records(t):
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("id"), F.when(key % 3 != 0, F.col("c_name")).otherwise(" ").alias("tradingName"), F.when(key % 5 != 0, F.col("c_mktsegment")).alias("vendorGroupType"),
        F.when(key % 7 != 0, F.lit("c")).alias("city"), F.when(key % 2 == 0, F.lit("p")).otherwise("").alias("postal"),
    )


@query(
    "prj_14_find_gaps",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'tradingName' WHEN c_custkey % 5 = 0 THEN 'vendorGroupType' WHEN c_custkey % 7 = 0 OR c_custkey % 2 <> 0 THEN 'city' END AS gap_field FROM customer""",
)
def find_gaps(t):
    return P.find_gaps(_gap_records(t), ["id"], ["tradingName", "vendorGroupType"], ("city", "postal"))


@query(
    "prj_14_gap_table",
    """SELECT c_custkey AS id, 'tradingName' AS field FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'city' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'postal' FROM customer WHERE c_custkey % 2 <> 0""",
)
def gap_table(t):
    return P.gap_table(_gap_records(t), ["id"], ["tradingName", "city", "postal"]).select("id", "field")


@query(
    "prj_15_stage_gate",
    """WITH s AS (SELECT o_orderkey AS id, o_orderstatus, o_custkey, st FROM orders CROSS JOIN (VALUES ('address_enrich'), ('registry'), ('duplicate_precheck')) v(st)),
best AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'registry' ELSE 'address_enrich' END AS st, max(1 - l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT id, s.st AS stage, CASE WHEN c >= 0.97 THEN 'already_resolved' WHEN (s.st = 'address_enrich' AND o_orderstatus = 'P') OR (s.st = 'registry' AND o_custkey % 4 = 0) THEN 'input_missing' END AS reason
FROM s LEFT JOIN best b ON s.id = b.l_orderkey AND s.st = b.st""",
)
def stage_gate(t):
    records = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    resolved = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_linestatus") == "O", "registry").otherwise("address_enrich").alias("stage"),
        F.when(1 - F.col("l_discount") >= 0.97, 0.9).otherwise(0.2).alias("confidence"),
    )
    stages = {"address_enrich": F.col("o_orderstatus") == "P", "registry": F.col("o_custkey") % 4 == 0, "duplicate_precheck": F.lit(False)}
    return P.stage_gate(records, resolved, stages, "id").select("id", "stage", "reason")


@query(
    "prj_16_remap_paths",
    "SELECT option_key, CASE WHEN path = 'flag' THEN 'bankAccounts.0.flag' ELSE concat('x.vendorBankAccounts.', path) END AS path FROM v_options",
    _USES,
)
def remap_paths(t):
    path = F.col("path")
    moved = t.v_options().select("option_key", F.when(path == "flag", "vendorBankAccounts.0.flag").otherwise(F.concat(F.lit("x.vendorBankAccounts."), path)).alias("path"))
    return P.remap_paths(moved, "edit_bank_accounts")


@query("prj_20_doc_tiers", "SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#12', 'Brand#20') THEN 1 ELSE 2 END AS tier FROM part")
def doc_tiers(t):
    return P.doc_tiers(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc_type")), ["Brand#1", "Brand#12", "Brand#20"]).select("id", "tier")


# --- guards ----------------------------------------------------------------------------------


def _raw_scores(t):
    def text(cosine):
        return F.when(F.col("vec_id") % 7 == 0, "NaN").when(F.col("vec_id") % 11 == 0, "n/a").otherwise(F.floor(cosine * 400).cast("string"))

    turned, shifted = views.vector_cosines(F.col("embedding"))

    return t.embeddings.select(
        F.col("label").alias("grp"), F.concat(F.lit(" "), F.col("vec_id").cast("string"), F.lit(" ")).alias("id"), text(turned).alias("name_score"),
        F.when(F.col("vec_id") % 3 == 0, text(shifted)).alias("address_score"),
    )


def _vector_candidates(t):
    return t.embeddings.where("vec_id % 4 <> 1").select(F.col("label").alias("grp"), F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ordinal"))


@query(
    "prj_19_guard_scores",
    f"""WITH {views.COSINES_SQL}, r AS (SELECT label AS grp, CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 <> 0 THEN CAST(greatest(0, least(100, floor(turned * 400))) AS INT) END AS name_score,
  CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 3 = 0 THEN CAST(greatest(0, least(100, floor(shifted * 400))) AS INT) END AS address_score, vec_id FROM cosines)
SELECT grp, id, name_score, address_score FROM r WHERE vec_id % 4 <> 1 AND name_score IS NOT NULL""",
)
def guard_scores(t):
    return P.guard_scores(_raw_scores(t), _vector_candidates(t), "grp")


def _raw_verdicts(t):
    """Every vector is judged twice; the second verdict must not count."""
    key = F.col("vec_id")
    word = F.when(key % 5 == 0, "unsure").when(key % 2 == 0, " Same ").otherwise("DIFFERENT")
    rows = t.embeddings.select(F.col("label").alias("grp"), F.concat(F.lit(" "), key.cast("string")).alias("id"), word.alias("verdict"), F.lit(" why ").alias("reason"), (-key).alias("ordinal"))
    return rows.unionByName(rows.withColumns({"verdict": F.lit("likely"), "ordinal": F.lit(10_000_000) + F.col("ordinal")}))


@query(
    "prj_19_guard_verdicts",
    """SELECT label AS grp, CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 5 = 0 THEN 'likely' WHEN vec_id % 2 = 0 THEN 'same' ELSE 'different' END AS verdict, 'why' AS reason
FROM embeddings WHERE vec_id % 4 <> 1""",
)
def guard_verdicts(t):
    return P.guard_verdicts(_raw_verdicts(t), _vector_candidates(t), "grp")[0].select("grp", "id", "verdict", "reason")


@query(
    "prj_19_guard_ranking",
    """SELECT label AS grp, CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS tail, CASE WHEN vec_id % 3 = 0 THEN -vec_id ELSE vec_id END AS position
FROM embeddings WHERE vec_id % 4 <> 1""",
)
def guard_ranking(t):
    ranked = _raw_verdicts(t).where(F.trim("id").cast("int") % 3 == 0)
    return P.guard_verdicts(ranked, _vector_candidates(t), "grp")[1]


@query(
    "prj_19_guard_terms",
    """WITH raw AS (SELECT c_nationkey AS grp, c_mktsegment AS term, lower(c_mktsegment) AS k, min(c_custkey) AS o FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o) AS rank FROM raw)
SELECT grp, term, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3 AND NOT (k = 'building' AND grp % 2 = 0)""",
)
def guard_terms(t):
    raw = t.customer.select(F.col("c_nationkey").alias("grp"), F.concat(F.lit(" "), "c_mktsegment").alias("term"), F.col("c_custkey").alias("ordinal"))
    tried = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("grp"), F.lit("Building ").alias("term"))
    return P.guard_terms(raw, tried, "grp", 3)


@query(
    "prj_19_guard_suggestions",
    "SELECT bundle_id, path, option_key FROM v_options WHERE confidence >= 0.95",
    _USES,
)
def guard_suggestions(t):
    options = t.v_options(by_order=True)
    raw = options.select("bundle_id", F.concat(F.lit(" "), "path").alias("path"), F.when(F.col("confidence") >= 0.95, F.col("option_key")).otherwise("made-up").alias("option_key"))
    return P.guard_suggestions(raw, options)


# --- sets and resolution ---------------------------------------------------------------------


def patch_groups(t):
    """Two ordered groups of patches per order line."""
    rows = t.v_options(by_order=True).select(
        F.col("bundle_id").alias("record_id"), "path", "label", F.nullif("value", F.lit("0")).alias("value"), "confidence", F.col("doc_type").alias("source_label"),
        "needs_resolution", "ordinal",
    )
    again = rows.where("path = 'flag'").withColumns({"value": F.lower("value"), "ordinal": F.concat(F.lit("~"), "ordinal")})
    return rows.unionByName(again)


_GROUPS = """groups AS (SELECT bundle_id AS record_id, path, label, nullif(value, '0') AS value, confidence, doc_type AS source_label, needs_resolution, ordinal FROM v_options
  UNION ALL SELECT bundle_id, path, label, lower(nullif(value, '0')), confidence, doc_type, needs_resolution, concat('~', ordinal) FROM v_options WHERE path = 'flag'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, source_label, path ORDER BY ordinal) AS rn FROM groups) WHERE rn = 1)"""


def stored_orders(t):
    rows = t.dealt("orders", "o_orderkey").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("prio"), F.col("o_custkey").cast("string").alias("owner"))
    return S.to_long(rows, "o_orderkey", {"o_orderstatus": "status", "prio": "flag", "owner": "flag.owner"})


_STORED = """stored AS (SELECT o_orderkey AS record_id, 'status' AS path, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, 'flag', o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'
  UNION ALL SELECT o_orderkey, 'flag.owner', CAST(o_custkey AS VARCHAR) FROM orders)"""


@query(
    "set_1_merge_plan_options",
    f"""WITH {_GROUPS}, {_STORED} SELECT f.record_id, f.path, concat(source_label, ':', f.path) AS option_key, coalesce(s.value, '—') AS current_display,
  concat(coalesce(f.value, '—'), CASE WHEN needs_resolution = 'cityCode' THEN ' (will resolve to city code)' ELSE '' END) AS incoming_display,
  confidence >= 0.8 AND needs_resolution IS NULL AS pre_selected FROM firsts f LEFT JOIN stored s ON f.record_id = s.record_id AND f.path = s.path""",
    _USES,
)
def merge_plan_options(t):
    options, _ = S.merge_plan(patch_groups(t), stored_orders(t))
    return options.select("record_id", "path", "option_key", "current_display", "incoming_display", "pre_selected")


@query(
    "set_1_merge_plan_conflicts",
    f"WITH {_GROUPS} SELECT record_id, path, count(*) AS option_count FROM firsts GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT coalesce(value, 'null!')) > 1",
    _USES,
)
def merge_plan_conflicts(t):
    return S.merge_plan(patch_groups(t), stored_orders(t))[1].select("record_id", "path", "option_count")


@query(
    "set_2_last_write_union",
    f"WITH {_GROUPS} SELECT record_id, path, max_by(struct_pack(v := value), ordinal).v AS value, min(ordinal) AS position FROM groups GROUP BY ALL",
    _USES,
)
def last_write_union(t):
    return S.last_write_union(patch_groups(t))


@query(
    "set_3_apply_patches",
    f"""WITH {_GROUPS}, {_STORED}, written AS (SELECT record_id, path, max_by(struct_pack(v := value), ordinal).v AS value FROM groups GROUP BY ALL)
SELECT record_id, path, value FROM stored s WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.record_id = s.record_id AND (w.path = s.path OR starts_with(s.path, concat(w.path, '.'))))
UNION ALL SELECT * FROM written""",
    _USES,
)
def apply_patches(t):
    return S.apply_patches(stored_orders(t), patch_groups(t))


@query(
    "win_7_first_seen",
    f"WITH {_GROUPS} SELECT record_id, source_label, path, value FROM firsts",
    _USES,
)
def first_seen(t):
    return first_row(patch_groups(t), ["record_id", "source_label", "path"], [F.col("ordinal")]).select("record_id", "source_label", "path", "value")


def resolution_inputs(t):
    """Orders with a selected city, bank and plain option, and the nations and suppliers to resolve them."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t.orders.join(place, cust == F.col("c_custkey"))
    cells = struct_rows(
        "path value needs_resolution ordinal",
        (F.when(key % 10 == 0, "cityName").otherwise("postalAddresses.0.cityName"), F.when(key % 3 == 0, F.concat("n_name", F.lit("x"))).otherwise(F.lower("n_name")), "cityCode", 1),
        ("vendorBankAccounts.0.ifsc", F.concat(F.lit(" bk"), (cust % 200).cast("string")), "bankingInstitutionCode", 2),
        ("tradingName", F.col("o_orderpriority"), F.lit(None).cast("string"), 3),
    )
    options = rows.select(key.alias("record_id"), F.inline(cells)).withColumn("label", F.col("path"))
    cities = t.v_cityref().withColumn("subdivision_code", F.upper(F.substring("subdivision_name", 1, 2)))
    banks = t.supplier.select(
        F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("search_key"), F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("code"),
        F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("deleted"), F.col("s_suppkey").alias("ordinal"),
    )
    records = t.orders.select(key.alias("record_id"), F.lit("postalAddresses.0.regionCode").alias("path"), F.when(F.col("o_orderstatus") == "O", "AS").otherwise("").alias("value"))
    return options, cities, banks, records


_RESOLVE = """base AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderstatus, n_name, o_orderkey % 10 = 0 AS lost, o_orderkey % 3 = 0 AS wrong FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
scores AS (SELECT b.id, r.city_name, r.code, r.subdivision_name, upper(substr(r.subdivision_name, 1, 2)) AS sc, row_number() OVER (PARTITION BY b.id ORDER BY
    CASE WHEN r.city_name = b.n_name THEN 100 ELSE 85 END + CASE WHEN o_orderstatus <> 'O' THEN 0 WHEN upper(substr(r.subdivision_name, 1, 2)) = 'AS' THEN 25 ELSE -40 END DESC, r.ordinal) AS rn,
    CASE WHEN r.city_name = b.n_name THEN 100 ELSE 85 END + CASE WHEN o_orderstatus <> 'O' THEN 0 WHEN upper(substr(r.subdivision_name, 1, 2)) = 'AS' THEN 25 ELSE -40 END AS score
  FROM base b JOIN v_cityref r ON starts_with(r.city_name, b.n_name) WHERE NOT lost AND NOT wrong),
hit AS (SELECT * FROM scores WHERE rn = 1 AND score >= 60),
city AS (SELECT b.*, h.city_name, h.code, h.sc, h.subdivision_name FROM base b LEFT JOIN hit h ON b.id = h.id WHERE NOT lost),
bank AS (SELECT b.id, s.s_name, s.s_suppkey FROM base b LEFT JOIN supplier s ON s.s_suppkey = b.o_custkey % 200 AND s.s_acctbal >= 0)"""


@query(
    "jn_14_resolve_and_apply",
    f"""WITH {_RESOLVE} SELECT id AS record_id, 'tradingName' AS path, o_orderpriority AS value FROM base
UNION ALL SELECT id, 'postalAddresses.0.cityName', coalesce(city_name, CASE WHEN wrong THEN n_name || 'x' ELSE lower(n_name) END) FROM city
UNION ALL SELECT id, 'postalAddresses.0.cityCode', code FROM city WHERE code IS NOT NULL
UNION ALL SELECT id, 'postalAddresses.0.regionCode', coalesce(sc, CASE WHEN o_orderstatus = 'O' THEN 'AS' END) FROM city WHERE sc IS NOT NULL OR o_orderstatus = 'O'
UNION ALL SELECT id, 'postalAddresses.0.regionName', subdivision_name FROM city WHERE subdivision_name IS NOT NULL
UNION ALL SELECT id, 'vendorBankAccounts.0.bankingInstitutionCode', concat('BK', s_suppkey) FROM bank WHERE s_suppkey IS NOT NULL
UNION ALL SELECT id, 'vendorBankAccounts.0.bankName', s_name FROM bank WHERE s_suppkey IS NOT NULL""",
    ("v_cityref",),
)
def resolve_applied(t):
    return S.resolve_and_apply(*resolution_inputs(t))[0].select("record_id", "path", "value")


@query(
    "jn_14_resolve_skipped",
    f"""WITH {_RESOLVE} SELECT id AS record_id, 'cityName' AS path, 'invalid address path' AS reason FROM base WHERE lost
UNION ALL SELECT id, 'postalAddresses.0.cityName', 'city name applied only' FROM city WHERE code IS NULL
UNION ALL SELECT id, 'vendorBankAccounts.0.ifsc', 'no bank match' FROM bank WHERE s_suppkey IS NULL""",
    ("v_cityref",),
)
def resolve_skipped(t):
    return S.resolve_and_apply(*resolution_inputs(t))[1]
