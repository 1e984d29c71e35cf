"""Applying patches to records in long form, and resolving values on the way.

A record is kept as rows (record_id, path, value); setting a value by dotted path is then an upsert,
and merging ordered groups of patches is a first-wins or last-wins aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import text as T
from entityops.functions.ordering import first_row, join_within, last_row
from entityops.functions.rows import struct_rows
from entityops.operators import match

PATH = ["record_id", "path"]


def read_value(records: DataFrame, path: str) -> DataFrame:
    """The value behind one dotted path of every record that has it."""
    return records.where(F.col("path") == path).select("record_id", "value")


def to_long(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Wide record to long form; ``fields``: column -> path. Nulls are left out."""
    cells = struct_rows("path value", *[(path, F.col(c).cast("string")) for c, path in fields.items()])
    return df.select(F.col(key).alias("record_id"), F.inline(cells)).where("value IS NOT NULL")


def last_write_union(patches: DataFrame) -> DataFrame:
    """Later patches overwrite earlier ones per path; the path keeps its first position."""
    return patches.groupBy(*PATH).agg(
        F.max_by(F.struct("value"), F.col("ordinal")).alias("_v"), F.min("ordinal").alias("position")
    ).select(*PATH, F.col("_v.value").alias("value"), "position")


def apply_patches(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records after the patches: untouched cells plus the last value of every patched path.

    A patch on a path drops what was stored below it, and what an earlier patch wrote below it, as
    replacing a nested value does.
    """
    written = last_row(patches.select(*PATH, "value", "ordinal"), PATH, [F.col("ordinal")]).withColumn("_stored", F.lit(False))
    stored = records.select(*PATH, "value", F.lit(None).cast(written.schema["ordinal"].dataType).alias("ordinal"), F.lit(True).alias("_stored"))
    parents = written.select("record_id", F.col("path").alias("_parent"), F.col("ordinal").alias("_parent_at"))
    patched = stored.join(written.select("record_id"), "record_id", "left_semi")
    cells = patched.unionByName(written).withColumn("_at", F.split("path", r"\."))
    # a stored cell also goes where its own path is written
    deepest = F.size("_at") - F.when(F.col("_stored"), 0).otherwise(1)
    above = F.transform(
        F.when(deepest > 0, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice("_at", F.lit(1), n), "."),
    )
    below = cells.select(*PATH, "_stored", "ordinal", F.explode(above).alias("_parent"))
    below = join_within(below, parents, ["record_id", "_parent"])
    gone = below.where(F.col("_stored") | (F.col("ordinal") < F.col("_parent_at"))).select(*PATH, "_stored")
    kept = join_within(stored.unionByName(written), gone, [*PATH, "_stored"], "left_anti")
    return kept.select(*PATH, "value")


def merge_plan(patches: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(options, conflicts) of ordered patch groups against the stored record.

    patches: record_id, path, label, value, confidence, source_label, needs_resolution, ordinal.  The first
    patch per source and path counts; a missing value is a value when conflicts are counted.
    """
    first = first_row(patches, ["record_id", "source_label", "path"], [F.col("ordinal")])
    current = master.select(*PATH, F.col("value").alias("_current"))
    options = join_within(first, current, PATH, "left").select(
        *PATH, F.coalesce("label", "path").alias("label"), "source_label", "value",
        F.concat_ws(":", "source_label", "path").alias("option_key"), T.display(F.col("_current")).alias("current_display"),
        T.display(F.col("value"), F.col("needs_resolution")).alias("incoming_display"), "confidence",
        ((F.coalesce("confidence", F.lit(0.0)) >= C.PRE_SELECT_CONFIDENCE) & F.col("needs_resolution").isNull()).alias("pre_selected"), "ordinal",
    )
    filled = F.count("value")
    conflicts = (
        options.groupBy(*PATH)
        .agg(
            F.count(F.lit(1)).alias("option_count"), filled.alias("_filled"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
            F.min_by("label", "ordinal").alias("label"),
        )
        .where("option_count > 1 AND (_lo <> _hi OR (_filled > 0 AND _filled < option_count))")
        .select(*PATH, "label", "option_count")
    )
    return options, conflicts


def resolve_and_apply(options: DataFrame, cities: DataFrame, banks: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, skipped) cells of the selected options.

    options: record_id, path, label, value, needs_resolution, ordinal and the country of the record; cities: see
    ``match_reference``; banks: see ``unique_lookup`` (search_key = upper code); records: long form.
    City options are matched with the region of the selected options or else of the record; bank
    options become up to five fields of the one matching bank; the rest is set as it is.  References with a country
    (ISO code in capitals) are searched in the country of the option only.
    """
    if "country" not in options.columns and "country" in {*cities.columns, *banks.columns}:
        raise ValueError("references of several countries need the country of each option")
    if "country" in options.columns:
        options = options.withColumn("country", F.upper(T.strip(F.col("country"))))
    city_scope, bank_scope = (["country"] if "country" in x.columns else [] for x in (cities, banks))
    needs = F.coalesce("needs_resolution", F.lit(""))
    base = F.regexp_extract("path", r"^(postalAddresses\.\d+)", 1)
    plain = options.where(~needs.isin("cityCode", "bankingInstitutionCode")).select("record_id", "path", "value", "ordinal")

    city = options.where(needs == "cityCode").withColumn("_base", base)
    lost = city.where("_base = ''").select("record_id", "path", F.lit("invalid address path").alias("reason"))
    city = city.where("_base <> ''")

    def hint(field: str) -> DataFrame:
        """Value of a sibling field: of the first selected option that has one, else of the record."""
        suffix = rf"^(postalAddresses\.\d+)\.{field}$"
        at = F.regexp_extract("path", suffix, 1).alias("_base")
        chosen = options.select("record_id", at, "value", "ordinal", F.lit(0).alias("_rank"))
        stored = records.select("record_id", at, "value", F.lit(None).cast(options.schema["ordinal"].dataType).alias("ordinal"), F.lit(1).alias("_rank"))
        both = chosen.unionByName(stored).where("_base <> '' AND value <> ''")
        return first_row(both, ["record_id", "_base"], [F.col("_rank"), F.col("ordinal")]).select("record_id", "_base", F.col("value").alias(f"_{field}"))

    asked = city
    for field in ("cityName", "regionCode", "regionName"):
        asked = asked.join(hint(field), ["record_id", "_base"], "left")
    own = F.col("path").endswith(".cityName")
    asked = asked.select(
        "record_id", "path", "_base", "ordinal", F.when(own, F.coalesce("value", F.lit(""))).otherwise(F.coalesce("_cityName", "value", F.lit(""))).alias("value"),
        F.col("_regionCode").alias("region_code"), F.col("_regionName").alias("region_name"), *city_scope,
    )
    found = match.match_reference(asked, cities)
    details = cities.select(
        *city_scope, F.col("city_name").alias("matched_name"), F.coalesce(F.nullif("code", F.lit("")), F.col("city_name")).alias("matched_code"),
        F.col("subdivision_code").alias("_sub_code"), F.col("subdivision_name").alias("_sub_name"),
    ).dropDuplicates([*city_scope, "matched_name", "matched_code"])
    found = found.join(details, [*city_scope, "matched_name", "matched_code"], "left")
    hit = F.col("matched_code").isNotNull()
    city_cells = struct_rows(
        "field value position",
        ("cityName", F.when(hit, F.col("matched_name")).otherwise(F.col("value")), 1), ("cityCode", F.col("matched_code"), 2),
        ("regionCode", F.when(hit, F.col("_sub_code")).otherwise(F.col("region_code")), 3),
        ("regionName", F.when(hit, F.col("_sub_name")).otherwise(F.col("region_name")), 4),
    )
    city_set = found.select("record_id", "_base", "ordinal", F.inline(city_cells)).where("value <> ''").select(
        "record_id", F.concat_ws(".", "_base", "field").alias("path"), "value", "ordinal", "position"
    )
    unresolved = found.where(~hit).select("record_id", "path", F.lit("city name applied only").alias("reason"))

    bank = options.where(needs == "bankingInstitutionCode").withColumn("code", F.upper(T.strip(F.coalesce("value", F.lit("")))))
    resolved = match.unique_lookup(bank.select(F.col("code").alias("search_key"), "code", *bank_scope), banks)
    banked = bank.join(resolved.drop("search_key"), ["code", *bank_scope], "left")
    bank_base = F.replace("path", F.lit(".ifsc"), F.lit(""))
    bank_fields = [("bankingInstitutionCode", "code"), ("bankName", "name"), ("swiftCode", "swift_code"), ("bankBranchName", "branch_name"), ("iso2CountryCode", "country")]
    bank_cells = struct_rows(
        "field value position", *[(field, F.col(f"resolved_{c}"), i) for i, (field, c) in enumerate(bank_fields, 1) if f"resolved_{c}" in banked.columns]
    )
    bank_set = banked.where("resolved_code IS NOT NULL").select("record_id", bank_base.alias("_base"), "ordinal", F.inline(bank_cells)).where("value <> ''").select(
        "record_id", F.concat_ws(".", "_base", "field").alias("path"), "value", "ordinal", "position"
    )
    unbanked = banked.where("resolved_code IS NULL").select("record_id", "path", F.lit("no bank match").alias("reason"))

    applied = plain.withColumn("position", F.lit(0)).unionByName(city_set).unionByName(bank_set)
    skipped = lost.unionByName(unresolved).unionByName(unbanked)
    return applied, skipped
