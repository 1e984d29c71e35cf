"""Unpivots and normalising projections of extracted records. All of them are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from entityops import constants as C
from entityops.functions import identifiers as I
from entityops.functions import text as T
from entityops.functions.ordering import first_row, top_rows
from entityops.functions.rows import struct_rows
from entityops.operators.match import geo_code


# --- patches out of extraction columns -------------------------------------------------------


def field_regex_ok(field: Column, value: Column) -> Column:
    """Advisory pattern of the field; fields without one pass."""
    out = F
    for name, pattern in C.FIELD_PATTERNS.items():
        out = out.when(field == name, value.rlike(pattern))
    return out.otherwise(F.lit(True))


def regex_gate(patches: DataFrame) -> DataFrame:
    """Drop fields that do not apply and mark whether the value matches its field's pattern."""
    return patches.where(~F.coalesce(F.col("field_name").isin(*C.NOT_APPLICABLE_FIELDS), F.lit(False))).withColumn(
        "regex_ok", F.coalesce(field_regex_ok(F.col("field_name"), F.col("value")), F.lit(True))
    )


# What each document type proposes.
# (doc type, source column, path, label, field, kind); kinds: plain, weak (never pre-selected), id
# (white space removed), unmapped, region (from the state code), city, ifsc, person (from the holder type)
_ADDRESS_FIELDS = [
    ("building_name", "buildingName", "Building name"), ("street_number", "streetNumber", "Street/house number"),
    ("street_name", "streetName", "Street"), ("district", "district", "District"), ("postal_code", "postalCode", "Postal code"),
]


def _tax_path(slot: int) -> str:
    return f"taxInformation.taxIdentificationNumbers.{slot - 1}.taxIdentificationNumber"


def _address_spec(doc_type: str) -> list[tuple]:
    rows = [(doc_type, c, f"postalAddresses.0.{f}", label, f, "plain") for c, f, label in _ADDRESS_FIELDS]
    return rows + [(doc_type, "city_name", "postalAddresses.0.cityName", "City", None, "city")]


PATCH_SPEC = [
    ("IN_PAN_CARD", "pan", _tax_path(3), "India: TIN/PAN", "TAXNO3", "id"),
    ("IN_PAN_CARD", "pan", "taxInformation.isNaturalPerson", "Is natural person", "isNaturalPerson", "person"),
    ("IN_PAN_CARD", "holder_name", "tradingName", "Trading name", "tradingName", "weak"),
    ("IN_GST_CERTIFICATE", "gstin", _tax_path(4), "India: GSTIN", "TAXNO4", "id"),
    ("IN_GST_CERTIFICATE", "gstin", "postalAddresses.0.regionCode", "Region (state)", "regionCode", "region"),
    ("IN_GST_CERTIFICATE", "trade_name", "tradingName", "Trading name", "tradingName", "plain"),
    ("IN_GST_CERTIFICATE", "legal_name", "legalName", "Legal name", None, "plain"),
    *_address_spec("IN_GST_CERTIFICATE"),
    ("IN_CANCELLED_CHEQUE", "account_number", "vendorBankAccounts.0.bankAccountNumber", "Bank account number", "bankAccountNumber", "plain"),
    ("IN_CANCELLED_CHEQUE", "ifsc", "vendorBankAccounts.0.ifsc", "IFSC", None, "ifsc"),
    ("IN_CANCELLED_CHEQUE", "bank_name", "vendorBankAccounts.0.bankName", "Bank name", None, "weak"),
    ("IN_CERTIFICATE_OF_INCORPORATION", "cin", "_unmapped.cin", "CIN", None, "unmapped"),
    ("IN_CERTIFICATE_OF_INCORPORATION", "company_name", "tradingName", "Trading name", "tradingName", "weak"),
    ("IN_CERTIFICATE_OF_INCORPORATION", "company_name", "legalName", "Legal name", None, "weak"),
    ("IN_ADDRESS_PROOF", "holder_name", "tradingName", "Trading name", "tradingName", "weak"),
    *_address_spec("IN_ADDRESS_PROOF"),
    ("IN_IEC_CERTIFICATE", "iec_code", "_unmapped.iecCode", "IEC", None, "unmapped_id"),
    ("IN_IEC_CERTIFICATE", "holder_name", "tradingName", "Trading name", "tradingName", "weak"),
    ("IN_DEED_OF_PARTNERSHIP", "registration_number", "_unmapped.partnershipRegistrationNo", "Partnership registration number", None, "unmapped"),
    ("IN_DEED_OF_PARTNERSHIP", "firm_name", "tradingName", "Trading name", "tradingName", "weak"),
    ("IN_DEED_OF_PARTNERSHIP", "firm_name", "legalName", "Legal name", None, "weak"),
    *_address_spec("IN_DEED_OF_PARTNERSHIP"),
    ("IN_MTO_IATA_CHA_CERTIFICATE", "licence_number", "_unmapped.mtoLicenceNo", "MTO/IATA/CHA licence number", None, "unmapped"),
    ("IN_MTO_IATA_CHA_CERTIFICATE", "holder_name", "tradingName", "Trading name", "tradingName", "weak"),
]
LOCALE_SPEC = [
    ("CN_BUSINESS_LICENSE", "tax_number", _tax_path(1), "USCC", None, "latin_id"),
    ("CN_BUSINESS_LICENSE", "legal_name", "legalName", "Legal name", "legalName", "name"),
    ("CN_BUSINESS_LICENSE", "trading_name", "tradingName", "Trading name", "tradingName", "name"),
    *_address_spec("CN_BUSINESS_LICENSE"),
    ("CN_BANK_ACCOUNT_PERMIT", "account_number", "vendorBankAccounts.0.bankAccountNumber", "Bank account number", None, "plain"),
    ("CN_BANK_ACCOUNT_PERMIT", "bank_name", "vendorBankAccounts.0.bankName", "Bank name", None, "plain"),
    ("AE_TRADE_LICENSE", "registration_number", "_unmapped.tradeLicenseNumber", "Trade licence number", None, "unmapped"),
    ("AE_TRADE_LICENSE", "legal_name", "legalName", "Legal name", "legalName", "name"),
    ("AE_TRADE_LICENSE", "trading_name", "tradingName", "Trading name", "tradingName", "name"),
    *_address_spec("AE_TRADE_LICENSE"),
    ("AE_VAT_CERTIFICATE", "tax_number", _tax_path(1), "TRN", None, "latin_id"),
    ("AE_VAT_CERTIFICATE", "legal_name", "legalName", "Legal name", "legalName", "name"),
    ("US_W9", "tax_number", _tax_path(1), "EIN", None, "latin_id"),
    ("US_W9", "legal_name", "legalName", "Legal name", "legalName", "english"),
    ("US_W9", "trading_name", "tradingName", "Trading name", "tradingName", "english"),
    ("US_VOIDED_CHECK", "account_number", "vendorBankAccounts.0.bankAccountNumber", "Bank account number", None, "weak"),
    ("US_VOIDED_CHECK", "routing_number", "vendorBankAccounts.0.routingNumber", "Routing number", None, "weak"),
    ("US_VOIDED_CHECK", "bank_name", "vendorBankAccounts.0.bankName", "Bank name", None, "weak"),
    ("US_CERTIFICATE_OF_GOOD_STANDING", "registration_number", "_unmapped.stateRegistrationNumber", "State registration number", None, "unmapped"),
    ("US_CERTIFICATE_OF_GOOD_STANDING", "legal_name", "legalName", "Legal name", "legalName", "plain"),
    ("GB_COMPANIES_HOUSE_CERTIFICATE", "registration_number", "_unmapped.companyNumber", "Company number", None, "unmapped"),
    ("GB_COMPANIES_HOUSE_CERTIFICATE", "legal_name", "legalName", "Legal name", "legalName", "plain"),
    *_address_spec("GB_COMPANIES_HOUSE_CERTIFICATE"),
    ("GB_VAT_CERTIFICATE", "tax_number", _tax_path(1), "VAT number", None, "latin_id"),
    ("GB_VAT_CERTIFICATE", "legal_name", "legalName", "Legal name", "legalName", "plain"),
]


def _spec_cells(df: DataFrame, spec: list[tuple], cell) -> DataFrame:
    """Unfold the spec rows of the document's type, in spec order."""
    out = F
    for doc_type in dict.fromkeys(row[0] for row in spec):
        rows = [row for row in spec if row[0] == doc_type and row[1] in df.columns]
        if rows:
            out = out.when(F.col("doc_type") == doc_type, F.array(*[cell(n, *row[1:]) for n, row in enumerate(rows)]))
    return df.select("document_id", "doc_type", "confidence", F.inline(out.otherwise(F.array().cast("array<" + _CELL + ">"))))


_CELL = "struct<position:int,path:string,label:string,field_name:string,kind:string,value:string>"


def unpivot_patches(envelopes: DataFrame, spec: list[tuple] = PATCH_SPEC) -> DataFrame:
    """One row per proposed value of each document: document_id, doc_type, confidence and value columns in."""

    def cell(position, column, path, label, field, kind):
        raw = F.col(column)
        if kind in ("id", "ifsc", "unmapped_id"):
            value = F.nullif(T.norm_id(raw), F.lit(""))
        elif kind == "region":
            value = I.state_region(raw)
        elif kind == "person":
            value = I.natural_person(T.norm_id(raw)).cast("string")
        else:
            value = T.strip_to_null(raw)
        return F.struct(
            F.lit(position).alias("position"), F.lit(path).alias("path"), F.lit(label).alias("label"), F.lit(field).cast("string").alias("field_name"),
            F.lit(kind).alias("kind"), value.alias("value"),
        )

    rows = regex_gate(_spec_cells(envelopes, spec, cell).where("value IS NOT NULL"))
    sure = (F.col("confidence") >= C.PRE_SELECT_CONFIDENCE) & F.col("regex_ok") & F.col("kind").isin("plain", "id", "region", "person")
    return rows.select(
        "document_id", "doc_type", "position", "path", "label", "value", "confidence", "field_name",
        F.when(F.col("field_name").isin("TAXNO3", "TAXNO4"), F.col("field_name")).alias("tax_type_code"),
        F.when(F.col("kind") == "city", "cityCode").when(F.col("kind") == "ifsc", "bankingInstitutionCode").alias("needs_resolution"),
        "regex_ok", sure.alias("pre_selected"),
    )


def unpivot_locale_patches(envelopes: DataFrame) -> DataFrame:
    """Locale documents: names as (native, romanised, english) in ``<name>_native`` and so on.

    In countries that keep two records, a native name or a non-ASCII address part is never
    pre-selected and carries its script and character set.
    """
    country = F.substring("doc_type", 1, 2)
    dual, script, charset = F, F, F
    for code, (is_dual, default_script, charset_code, _) in C.LOCALE_PROFILES.items():
        dual = dual.when(country == code, F.lit(is_dual))
        script = script.when(country == code, F.lit(default_script))
        charset = charset.when(country == code, F.lit(charset_code))
    dual, script, charset = dual.otherwise(F.lit(False)), script.otherwise(F.lit("en")), charset.otherwise(F.lit(None))

    def cell(position, column, path, label, field, kind):
        english = T.strip_to_null(F.col(column))
        native = romanised = F.lit(None).cast("string")
        value = english
        if kind == "name":
            native = T.strip_to_null(F.col(f"{column}_native"))
            romanised = T.first_present(F.col(f"{column}_romanised"), F.col(column))
            value = F.coalesce(romanised, english, native)
        return F.struct(
            F.lit(position).alias("position"), F.lit(path).alias("path"), F.lit(label).alias("label"), F.lit(field).cast("string").alias("field_name"),
            F.lit("city" if column == "city_name" else "address" if path.startswith("postalAddresses") else kind).alias("kind"),
            value.alias("value"), native.alias("native"), romanised.alias("romanised"),
        )

    global_cell = _CELL[:-1] + ",native:string,romanised:string>"
    out = F
    for doc_type in dict.fromkeys(row[0] for row in LOCALE_SPEC):
        rows = [row for row in LOCALE_SPEC if row[0] == doc_type and row[1] in envelopes.columns]
        if rows:
            out = out.when(F.col("doc_type") == doc_type, F.array(*[cell(n, *row[1:]) for n, row in enumerate(rows)]))
    cells = envelopes.select(
        "document_id", "doc_type", "confidence", F.inline(out.otherwise(F.array().cast(f"array<{global_cell}>")))
    ).where("value IS NOT NULL")
    is_address = F.col("kind").isin("address", "city")
    foreign = is_address & F.col("value").rlike(T.NON_ASCII)
    native = F.when(F.col("kind") == "name", F.col("native")).when(foreign & dual, F.col("value"))
    scripted = F.when(F.col("kind") == "name", F.col("native").isNotNull()).otherwise(foreign)
    never = F.col("kind").isin("weak", "unmapped")
    policy = (
        F.when(F.col("kind") == "latin_id", "latin_id").when(F.col("kind") == "english", "english_only")
        .when((F.col("kind") == "name") | is_address, F.when(native.isNotNull(), "native_required").otherwise("english_only"))
    )
    return cells.select(
        "document_id", "doc_type", "position", "path", "label", "value", "confidence",
        ((F.col("confidence") >= C.PRE_SELECT_CONFIDENCE) & ~never & ~(dual & native.isNotNull())).alias("pre_selected"),
        native.alias("native_value"), F.when(F.col("kind") == "name", F.col("romanised")).alias("romanised_value"), policy.alias("field_policy"),
        F.when((F.col("kind") == "name") | is_address, F.when(scripted, script).otherwise("en")).alias("script"),
        F.when(scripted, charset).alias("charset_code"), F.when(F.col("kind") == "city", "cityCode").alias("needs_resolution"),
    )


# --- addresses -------------------------------------------------------------------------------

_LINE = ["building_name", "street_number", "street_name", "district", "city_name", "region_name", "postal_code"]


def _joined(struct: Column) -> Column:
    return F.concat_ws(", ", *[T.strip_to_null(struct[name]) for name in _LINE])


def address_candidates(envelopes: DataFrame) -> DataFrame:
    """One row per address role of a document; addresses without content are skipped.

    envelopes: document_id, doc_type, confidence, ``address`` struct and ``additional`` array of structs.
    """
    role = {
        "IN_GST_CERTIFICATE": ("principal_pob", "principal_pob"), "IN_CERTIFICATE_OF_INCORPORATION": ("registered_office", "registered_office"),
        "IN_ADDRESS_PROOF": ("operational", "operational"), "IN_DEED_OF_PARTNERSHIP": ("registered_office", "registered_address"),
        "IN_UDYAM_CERTIFICATE": ("plant", "plant"),
    }
    roles, keys = F, F
    for doc_type, (name, key) in role.items():
        roles, keys = roles.when(F.col("doc_type") == doc_type, F.lit(name)), keys.when(F.col("doc_type") == doc_type, F.lit(key))
    gst = F.col("doc_type") == "IN_GST_CERTIFICATE"
    none = F.array().cast(envelopes.schema["additional"].dataType)
    main = F.array(F.struct(F.lit(0).alias("at"), F.col("address").alias("address")))
    further = F.when(gst, F.coalesce("additional", none)).otherwise(none)
    listed = F.concat(main, F.transform(further, lambda a, i: F.struct((i + 1).alias("at"), a.alias("address"))))
    rows = envelopes.select("document_id", "doc_type", "confidence", roles.otherwise(F.lit(None)).alias("_role"), keys.otherwise(F.lit(None)).alias("_key"), F.inline(listed))
    extra = F.col("at") > 0
    city = T.strip_to_null(F.col("address.city_name"))
    return rows.where("_role IS NOT NULL").withColumn("full_text", _joined(F.col("address"))).where("full_text <> ''").select(
        "document_id", "doc_type",
        F.concat_ws(":", "doc_type", F.when(extra, F.concat(F.lit("apob:"), F.col("at").cast("string"))).otherwise(F.col("_key"))).alias("candidate_key"),
        F.when(extra, "additional_pob").otherwise(F.col("_role")).alias("address_role"),
        F.when(extra, F.concat_ws(" — ", F.concat(F.lit("Additional place "), F.col("at").cast("string")), city)).alias("label"),
        "full_text", "confidence", "address",
    )


def address_search_line(a: dict[str, Column]) -> Column:
    """Seven parts in order, blanks dropped, else the whole postal address.

    ``a``: unit_number, street_number, street_name, subdivisions (array of names), city, region,
    postal_code, postal_address.
    """
    names = F.concat_ws(" ", F.filter(F.transform(a["subdivisions"], T.strip), lambda s: s != ""))
    parts = [T.strip_to_null(a[k]) for k in ("unit_number", "street_number", "street_name")]
    parts += [F.nullif(names, F.lit(""))] + [T.strip_to_null(a[k]) for k in ("city", "region", "postal_code")]
    line = F.concat_ws(", ", *parts)
    return F.when(line != "", line).otherwise(F.coalesce(T.strip(a["postal_address"]), F.lit("")))


def select_result_to_patches(results: DataFrame, keys: list[str], base: str = "postalAddresses.0") -> DataFrame:
    """Patches from a chosen address: city by name, suggestion or sub-city; code by GEO or GEO_ID.

    results: unit_number, street_number, street_name, city, postal_code, latitude, longitude, region
    struct<code, name>, country, postal_address, suggestions array<struct<city_name, codes, region>>,
    subdivisions array<struct<label, name>>.
    """
    first = F.try_element_at("suggestions", F.lit(1))
    sub_city = F.try_element_at(F.filter("subdivisions", lambda s: s["label"] == "subCity"), F.lit(1))["name"]
    cells = struct_rows(
        "position field value",
        (1, "unitNumber", F.col("unit_number")), (2, "streetNumber", F.col("street_number")), (3, "streetName", F.col("street_name")),
        (4, "cityName", T.first_present(F.col("city"), first["city_name"], sub_city)),
        (5, "cityCode", T.strip(geo_code(first["codes"], ("GEO", "GEO_ID")))), (6, "postalCode", F.col("postal_code")),
        (7, "latitude", F.col("latitude").cast("string")), (8, "longitude", F.col("longitude").cast("string")),
        (9, "regionCode", F.coalesce(F.nullif(F.col("region.code"), F.lit("")), first["region"]["code"])),
        (10, "regionName", F.coalesce(F.nullif(F.col("region.name"), F.lit("")), first["region"]["name"])),
        (11, "iso2CountryCode", F.col("country")), (12, "postalAddress", F.col("postal_address")),
    )
    return results.select(*keys, F.inline(cells)).where("value IS NOT NULL AND value <> ''").select(
        *keys, "position", F.concat(F.lit(f"{base}."), F.col("field")).alias("path"), "value"
    )


# --- small record projections ----------------------------------------------------------------


def split_mapped_unmapped(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enrichment patches, read-only hints) of one patches table; a confidence of 0 or none becomes 0.8."""
    rows = patches.where(T.present(F.col("path")))
    unmapped = F.col("path").startswith("_unmapped")
    doc_type = F.coalesce("doc_type", F.lit("Document"))
    label = T.first_present(F.col("label"), F.element_at(F.split("path", r"\."), -1))
    mapped = rows.where(~unmapped).select(
        *[c for c in patches.columns if c not in ("label", "confidence", "doc_type")], label.alias("label"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.8)).alias("confidence"), F.lit("document").alias("source"), doc_type.alias("source_label"),
    )
    hints = rows.where(unmapped).select(
        *[c for c in patches.columns if c not in ("label", "confidence", "doc_type", "value")], T.first_present(F.col("label"), F.col("path")).alias("label"),
        F.coalesce(F.nullif("value", F.lit("")), F.lit(C.EMPTY_DISPLAY)).alias("display"), doc_type.alias("source_label"),
    )
    return mapped, hints


def registry_patches(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Trading name from a registry hit; scores above 1 are percentages, none counts as 88."""
    score = F.coalesce(F.col("match_score").try_cast("double"), F.when(F.col("match_score").isNull(), F.lit(88.0)))
    confidence = F.when(score > 1, score / 100).when(score.isNotNull(), score).otherwise(0.88)
    return summaries.select(
        *keys, F.lit("tradingName").alias("path"), T.first_present(F.col("company_name"), F.col("fallback_name")).alias("value"),
        confidence.alias("confidence"), F.lit("registry").alias("source"), F.coalesce("source_type", F.lit("Registry")).alias("source_label"),
    )


def _empty(col: Column, data_type) -> Column:
    if isinstance(data_type, ArrayType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull() | (col.cast("string") == "")


def _merged(a: Column, b: Column, data_type, name: str) -> Column:
    if isinstance(data_type, StructType):
        parts = [_merged(a[f.name], b[f.name], f.dataType, f.name).alias(f.name) for f in data_type.fields]
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*parts))
    if name == "confidence":
        return F.greatest(a, b)
    return F.when(_empty(a, data_type) & ~_empty(b, data_type), b).otherwise(a)


def merge_envelopes(primary: DataFrame, secondary: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Fill empty fields of the primary record from the secondary; nested blocks field by field.

    ``keep``: columns that always stay with the primary, such as the document type.
    """
    joined = primary.alias("p").join(secondary.alias("s"), key, "left")
    out = [F.col(key)]
    for f in primary.schema.fields:
        if f.name == key:
            continue
        mine = F.col(f"p.{f.name}")
        if f.name in keep or f.name not in secondary.columns:
            out.append(mine.alias(f.name))
        else:
            out.append(_merged(mine, F.col(f"s.{f.name}"), f.dataType, f.name).alias(f.name))
    return joined.select(*out)


def salvage_blocks(envelopes: DataFrame) -> DataFrame:
    """Move fields out of the wrong block when the document type was overridden.

    Blocks are structs: pan<pan, holder_name, confidence>, iec<iec_code, holder_name, confidence>,
    mto<licence_number, holder_name, confidence>, address_proof<holder_name, confidence>,
    coi<cin, company_name, confidence>, partnership<registration_number, firm_name, confidence>.
    """
    kind = F.col("doc_type")
    iec_code = F.nullif("iec.iec_code", F.lit(""))
    found = T.norm_id(iec_code)
    pan = F.when(iec_code.isNotNull() & found.rlike(C.PAN), found)
    proof = F.nullif("address_proof.holder_name", F.lit(""))
    holder = F.coalesce(proof, F.when(pan.isNotNull(), F.col("iec.holder_name")))
    sure = F.greatest(F.when(proof.isNotNull(), F.col("address_proof.confidence")), F.when(pan.isNotNull(), F.col("iec.confidence")), F.lit(0.0))

    def block(*cells: tuple[Column, str]) -> Column:
        return F.struct(*[c.alias(n) for c, n in cells])

    mto = block((iec_code, "licence_number"), (F.col("iec.holder_name"), "holder_name"), (F.col("iec.confidence"), "confidence"))
    new_pan = block((pan, "pan"), (holder, "holder_name"), (sure, "confidence"))
    partnership = block((F.col("coi.cin"), "registration_number"), (F.col("coi.company_name"), "firm_name"), (F.col("coi.confidence"), "confidence"))
    coi = block(
        (F.col("partnership.registration_number"), "cin"), (F.col("partnership.firm_name"), "company_name"), (F.col("partnership.confidence"), "confidence")
    )

    def fill(name: str, doc_type: str, ready: Column, value: Column) -> Column:
        return F.when(F.col(name).isNull() & (kind == doc_type) & ready, value).otherwise(F.col(name))

    return envelopes.withColumns(
        {
            "mto": fill("mto", "IN_MTO_IATA_CHA_CERTIFICATE", iec_code.isNotNull(), mto),
            "pan": fill("pan", "IN_PAN_CARD", pan.isNotNull() | holder.isNotNull(), new_pan),
            "partnership": fill("partnership", "IN_DEED_OF_PARTNERSHIP", F.col("coi").isNotNull(), partnership),
            "coi": fill("coi", "IN_CERTIFICATE_OF_INCORPORATION", F.col("partnership").isNotNull(), coi),
        }
    )


def find_gaps(records: DataFrame, keys: list[str], priority: list[str], pair: tuple[str, str] | None = None) -> DataFrame:
    """The first missing field of each record in priority order; ``pair`` counts as one field, asked last."""
    asked = [F.when(T.blank(F.col(f"`{name}`")), F.lit(name)) for name in priority]
    if pair is not None:
        asked.append(F.when(T.blank(F.col(f"`{pair[0]}`")) | T.blank(F.col(f"`{pair[1]}`")), F.lit(pair[0])))
    return records.select(*keys, F.coalesce(*asked).alias("gap_field"))


def gap_table(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Every missing field of every record, one row each."""
    cells = struct_rows("position field missing", *[(n, f, T.blank(F.col(f"`{f}`"))) for n, f in enumerate(fields)])
    return records.select(*keys, F.inline(cells)).where("missing").drop("missing")


def stage_gate(records: DataFrame, resolved: DataFrame, stages: dict[str, Column], key: str) -> DataFrame:
    """Whether each stage runs: a confident earlier result wins over a missing input.

    ``stages``: stage -> condition "input missing"; resolved: key, stage, confidence.
    """
    cells = struct_rows("stage missing", *[(name, missing) for name, missing in stages.items()])
    asked = records.select(key, F.inline(cells))
    known = resolved.groupBy(key, "stage").agg(F.max("confidence").alias("_confidence"))
    done = F.coalesce(F.col("_confidence") >= C.STAGE_RESOLVED_THRESHOLD, F.lit(False))
    reason = F.when(done, "already_resolved").when(F.col("missing"), "input_missing")
    return asked.join(known, [key, "stage"], "left").select(key, "stage", reason.isNull().alias("run"), reason.alias("reason"))


def remap_paths(patches: DataFrame, intent: str | None) -> DataFrame:
    """Bank patches move to the bank editor's prefix when that is the intent."""
    if intent != "edit_bank_accounts":
        return patches
    return patches.withColumn("path", F.regexp_replace("path", r"^vendorBankAccounts\.", "bankAccounts."))


def doc_tiers(requirements: DataFrame, writable: list[str] | None = None) -> DataFrame:
    """Tier 1 for document types with a write path, else tier 2."""
    known = C.WRITABLE_DOC_TYPES if writable is None else writable
    return requirements.withColumn("tier", F.when(F.col("doc_type").isin(*known), 1).otherwise(2))


def doc_matches_country(country: Column, doc_type: Column) -> Column:
    code, kind = F.upper(T.strip(country)), F.upper(T.strip(doc_type))
    ok = (code != "") & (kind != "") & (kind != "UNKNOWN") & kind.startswith(F.concat(code, F.lit("_")))
    return F.coalesce(ok, F.lit(False))


# --- guards on values from outside -----------------------------------------------------------


def _shown(text: Column, length: int | None) -> Column:
    return T.strip(text) if length is None else T.strip(text).substr(1, length)


def guard_verdicts(raw: DataFrame, candidates: DataFrame, group: str, reason_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, ranking) restricted to known ids.

    raw: group, id, verdict, reason, ordinal; candidates: group, id, ordinal.  The first verdict per id
    counts; reasons are whole unless ``reason_length`` is given; ids that were not ranked follow in their own order.
    """
    cleaned = raw.select(
        group, T.strip(F.col("id")).alias("id"), F.lower(T.strip(F.col("verdict"))).alias("verdict"),
        F.nullif(_shown(F.col("reason"), reason_length), F.lit("")).alias("reason"), "ordinal",
    ).where("id <> ''")
    known = cleaned.join(candidates.select(group, "id").distinct(), [group, "id"], "left_semi")
    verdicts = first_row(known.where(F.col("verdict").isin("same", "likely", "different")), [group, "id"], [F.col("ordinal")])
    ranked = known.groupBy(group, "id").agg(F.min("ordinal").alias("_rank"))
    ranking = candidates.join(ranked, [group, "id"], "left").select(
        group, "id", F.when(F.col("_rank").isNull(), 1).otherwise(0).alias("tail"), F.coalesce("_rank", "ordinal").alias("position")
    )
    return verdicts.drop("ordinal"), ranking


def guard_scores(raw: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Similarity scores of known ids, clamped to 0..100; rows without any usable score are dropped."""
    rows = raw.select(
        group, T.strip(F.col("id")).alias("id"), T.clamp_score(F.col("name_score")).alias("name_score"),
        T.clamp_score(F.col("address_score")).alias("address_score"),
    )
    return rows.where("name_score IS NOT NULL OR address_score IS NOT NULL").join(
        candidates.select(group, "id").distinct(), [group, "id"], "left_semi"
    )


def guard_terms(raw: DataFrame, tried: DataFrame, group: str, limit: int = 6) -> DataFrame:
    """New search terms: trimmed, distinct without regard to case, at most ``limit``, none tried before.

    raw: group, term, ordinal; tried: group, term.
    """
    rows = raw.select(group, T.strip(F.col("term")).alias("term"), "ordinal").where("term <> ''")
    rows = rows.withColumn("_key", F.lower("term"))
    distinct = first_row(rows, [group, "_key"], [F.col("ordinal")])
    listed = top_rows(distinct, [group], [F.col("ordinal")], limit)
    used = tried.select(group, F.lower(T.strip(F.col("term"))).alias("_key")).distinct()
    return listed.join(used, [group, "_key"], "left_anti").select(group, "term", "rank")


def guard_suggestions(raw: DataFrame, options: DataFrame) -> DataFrame:
    """Suggested options that exist for their path: bundle_id, path, option_key.

    Both sides meet in one aggregate, which tables that are dealt by bundle_id pass without an exchange.
    """
    rows = raw.select("bundle_id", T.strip(F.col("path")).alias("path"), T.strip(F.col("option_key")).alias("option_key"))
    key = ["bundle_id", "path", "option_key"]
    asked = rows.where("path <> '' AND option_key <> ''").withColumns({"_asked": F.lit(1), "_known": F.lit(False)})
    known = options.select(*key, F.lit(0).alias("_asked"), F.lit(True).alias("_known"))
    met = asked.unionByName(known).groupBy(*key).agg(F.sum("_asked").alias("_times"), F.max("_known").alias("_known")).where("_known AND _times > 0")
    return met.select(*key, F.explode(F.sequence(F.lit(1), "_times")).alias("_n")).drop("_n")


def guard_tax_assignments(raw: DataFrame) -> DataFrame:
    """Tax assignments with a slot code and a number."""
    return raw.where(F.col("tax_type_code").rlike("(?i)^TAXNO[0-9]+$") & T.present(F.col("number")))
