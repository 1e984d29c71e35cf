"""Adjudication of field values that several documents propose for the same bundle.

Everything works on the options table, one row per proposed value:

    bundle_id, document_id, doc_type, path, label, logical_id, value, display, confidence,
    pre_selected, needs_resolution, regex_ok, effective_date, ordinal, option_key

``ordinal`` carries the list order and settles every tie.  Lists of options (the members of a
conflict, the superseded values) are returned as rows, never as arrays, so a bundle of any size can
be processed.  ``path_profile`` folds all per-path questions into one partial aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import identifiers as I
from entityops.functions import text as T
from entityops.functions.ordering import first_row, join_within, number_groups, order_text, padded, top_rows

PATH_KEYS = ["bundle_id", "path"]


# --- flattening ------------------------------------------------------------------------------


def resolve_bindings(bindings: DataFrame, bank_prefix: str = "vendorBankAccounts") -> DataFrame:
    """Concrete path, resolution need and writability of each logical field binding."""
    slot = F.regexp_extract(F.upper("tax_type_code"), r"^TAXNO([0-9]+)$", 1)
    unmapped = F.concat(F.lit("_unmapped."), F.col("logical_id"))
    has_field = T.present(F.col("field"))
    path = (
        F.when(
            (F.col("kind") == "taxSlot") & (slot != ""),
            F.concat(
                F.lit("taxInformation.taxIdentificationNumbers."),
                (slot.cast("int") - 1).cast("string"),
                F.lit(".taxIdentificationNumber"),
            ),
        )
        .when((F.col("kind") == "scalar") & T.present(F.col("form_path")), F.col("form_path"))
        .when((F.col("kind") == "address") & has_field, F.concat(F.lit("postalAddresses.0."), F.col("field")))
        .when(
            (F.col("kind") == "bank") & has_field,
            F.concat(F.lit(bank_prefix + "."), F.coalesce(F.col("index"), F.lit(0)).cast("string"), F.lit("."), F.col("field")),
        )
        .when(F.col("kind") == "unmapped", F.concat(F.lit("_unmapped."), F.coalesce(F.col("key"), F.col("logical_id"))))
        .otherwise(unmapped)
    )
    implied = F.when((F.col("kind") == "address") & (F.col("field") == "cityName"), F.lit("cityCode")).when(
        (F.col("kind") == "bank") & (F.col("field") == "ifsc"), F.lit("bankingInstitutionCode")
    )
    writable = F.when(F.col("kind") == "taxSlot", slot != "").otherwise(F.col("kind").isin("scalar", "address", "bank"))
    return bindings.withColumns(
        {"path": path, "needs_resolution": F.coalesce("needs_resolution", implied), "writable": writable}
    )


def path_to_logical(options: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add the logical field of the first binding that owns the path.

    The few paths of a form would send all options to a few tasks, so the bindings are broadcast.
    """
    first = first_row(resolved.select("path", "logical_id", "ordinal"), ["path"], [F.col("ordinal")])
    return options.join(F.broadcast(first.select("path", "logical_id")), "path", "left")


def flatten_options(extractions: DataFrame, bindings: DataFrame, documents: DataFrame) -> DataFrame:
    """Explode ``patches`` into options; bindings override label and resolution need.

    Bindings and document types are as many as a form has, and are broadcast.

    extractions: bundle_id, document_id, doc_type, effective_date, ordinal,
    patches array<struct<path, value, label, confidence, pre_selected, needs_resolution, regex_ok>>
    """
    exploded = extractions.select(
        "bundle_id", "document_id", "doc_type", "effective_date", F.col("ordinal").alias("_doc"),
        F.posexplode("patches").alias("_at", "_p"),
    ).where(T.present(F.col("_p.path")))
    rows = exploded.select(
        "bundle_id", "document_id", F.coalesce("doc_type", F.lit("UNKNOWN")).alias("doc_type"), "effective_date",
        F.col("_p.path").alias("path"), F.col("_p.value").alias("value"), F.col("_p.label").alias("label"),
        F.coalesce("_p.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_p.pre_selected", F.lit(False)).alias("pre_selected"),
        F.col("_p.needs_resolution").alias("needs_resolution"),
        F.coalesce("_p.regex_ok", F.lit(True)).alias("regex_ok"),
        F.concat_ws("-", order_text(exploded, "_doc"), padded(F.col("_at"), 4)).alias("ordinal"),
    )
    bound = first_row(
        resolve_bindings(bindings).select(
            "path", F.col("logical_id"), T.strip_to_null(F.col("label")).alias("_label"), F.col("needs_resolution").alias("_needs"), "ordinal"
        ),
        ["path"],
        [F.col("ordinal")],
    ).drop("ordinal")
    writable = documents.select("doc_type", F.col("writable").alias("_writable"))
    needs = F.coalesce("_needs", "needs_resolution")
    selectable = (
        F.coalesce("_writable", F.lit(False)) & ~F.col("path").startswith("_unmapped") & needs.isNull()
    )
    return (
        rows.join(F.broadcast(bound), "path", "left")
        .join(F.broadcast(writable), "doc_type", "left")
        .select(
            "bundle_id", "document_id", "doc_type", "path",
            F.coalesce(T.first_present(F.col("label")), "_label", T.first_present(F.element_at(F.split("path", r"\."), -1))).alias("label"),
            "logical_id", "value", T.display(F.col("value"), needs).alias("display"), "confidence",
            (F.col("pre_selected") & selectable).alias("pre_selected"),
            needs.alias("needs_resolution"), "regex_ok", "effective_date", "ordinal",
            F.concat_ws("|", "document_id", "path").alias("option_key"),
        )
    )


def authority_rank(logical_id: Column, doc_type: Column) -> Column:
    """Rank of a document type for a field; lower is stronger."""

    def position(order: list[str]) -> Column:
        out = F
        for i, name in enumerate(order):
            out = out.when(doc_type == name, F.lit(i))
        return out.otherwise(F.lit(C.AUTHORITY_UNLISTED))

    return (
        F.when(logical_id == "legal_name", position(C.LEGAL_NAME_AUTHORITY))
        .when(logical_id == "trading_name", position(C.TRADING_NAME_AUTHORITY))
        .when(logical_id.startswith("bill_to"), position(C.ADDRESS_AUTHORITY))
        .otherwise(F.lit(C.AUTHORITY_OTHER_FIELD))
    )


# --- one aggregate for all per-path questions -------------------------------------------------


def path_profile(options: DataFrame) -> DataFrame:
    """Counts, value range, first option and freshness winner of each path.

    Two different values exist exactly when the smallest differs from the largest, so no distinct
    count (and no set of values) is needed.
    """
    brief = F.struct("option_key", "value", "effective_date")
    freshest = F.struct(
        F.col("effective_date").isNull(),
        -F.unix_date("effective_date"),
        authority_rank(F.col("logical_id"), F.col("doc_type")),
        -F.col("confidence"),
        F.col("ordinal"),
    )
    return options.groupBy(*PATH_KEYS).agg(
        F.count(F.lit(1)).alias("option_count"),
        F.count("value").alias("value_count"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min_by(F.struct("label", "logical_id"), F.col("ordinal")).alias("first"),
        F.min("ordinal").alias("first_ordinal"),
        F.min_by(brief, freshest).alias("fresh"),
    )


def _conflicting(null_counts: bool) -> Column:
    differ = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    if null_counts:
        differ = differ | ((F.col("value_count") > 0) & (F.col("value_count") < F.col("option_count")))
    return (F.col("option_count") > 1) & differ


def conflicts_of(profile: DataFrame, null_counts: bool = False) -> DataFrame:
    """Conflicting paths, each with the option that freshness prefers as its winner."""
    return profile.where(_conflicting(null_counts)).select(
        *PATH_KEYS,
        F.col("first.label").alias("label"),
        F.col("first.logical_id").alias("logical_id"),
        "option_count",
        F.col("low").alias("lowest_value"),
        F.col("high").alias("highest_value"),
        F.col("first_ordinal").alias("ordinal"),
        F.col("fresh.option_key").alias("winner_option_key"),
        F.col("fresh.value").alias("winner_value"),
    )


def detect_conflicts(options: DataFrame, null_counts: bool = False) -> DataFrame:
    """Paths with more than one option and more than one value; ``null_counts``: null is a value too."""
    return conflicts_of(path_profile(options), null_counts)


def conflict_options(options: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The options that take part in a conflict, one row each."""
    return join_within(options, conflicts.select(*PATH_KEYS), PATH_KEYS, "left_semi")


def freshness_of(profile: DataFrame, reuploads: DataFrame | None = None) -> DataFrame:
    """Preferred option of each contested path. ``reuploads``: bundles with a stored copy of a new type."""
    found = profile.where("option_count > 1")
    status = F.when(F.col("fresh.effective_date").isNull(), F.lit("unknown_date")).otherwise(F.lit("current"))
    if reuploads is not None:
        marks = reuploads.select("bundle_id").distinct().withColumn("_again", F.lit(True))
        found = found.join(marks, "bundle_id", "left")
        status = F.when(F.col("_again"), F.lit("superseded")).otherwise(status)
    return found.select(
        *PATH_KEYS,
        status.alias("status"),
        F.col("fresh.option_key").alias("preferred_option_key"),
        F.col("fresh.value").alias("preferred_value"),
        F.col("fresh.effective_date").alias("preferred_date"),
        (F.col("option_count") - 1).alias("superseded_count"),
    )


def freshness_rank(options: DataFrame, reuploads: DataFrame | None = None) -> DataFrame:
    return freshness_of(path_profile(options), reuploads)


def superseded_options(options: DataFrame, freshness: DataFrame) -> DataFrame:
    """Options that lost to the preferred one of their path (EXCEPT by key)."""
    contested = join_within(options, freshness.select(*PATH_KEYS), PATH_KEYS, "left_semi")
    winners = freshness.select("bundle_id", F.col("preferred_option_key").alias("option_key"))
    return join_within(contested, winners, ["bundle_id", "option_key"], "left_anti")


def conflict_winner(
    options: DataFrame,
    conflicts: DataFrame,
    preferred: DataFrame | None = None,
    name_threshold: float = 0.82,
    scale: str = "reference",
) -> DataFrame:
    """One winner per conflict, with the rule that chose it.

    Order of rules: freshness preference; the longer of two street or city values when one contains
    the other; the most confident of the names close to the first one; the most confident option.
    On the ``reference`` scale the name rule never applies (similarity is 0..1, the limit is 0..100);
    ``scale="unit"`` compares on one scale.
    """
    members = conflict_options(options, conflicts)
    text = F.coalesce("value", F.lit(""))
    base = members.groupBy(*PATH_KEYS).agg(
        F.min_by(F.struct("option_key", "value"), F.struct(-F.col("confidence"), F.col("ordinal"))).alias("_confident"),
        F.min_by(F.struct("logical_id", "value"), F.col("ordinal")).alias("_first"),
    )
    is_place = F.col("logical_id").isin("bill_to_street", "bill_to_city") | F.col("path").endswith("streetName")
    longest = top_rows(members.where(is_place), PATH_KEYS, [F.length(text).desc(), F.col("ordinal")], 2)
    pair = longest.groupBy(*PATH_KEYS).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("option_key", "value"))).alias("_top"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("_second"),
    )
    a, b = T.norm_name(F.col("_top.value")), T.norm_name(F.col("_second"))
    nested = (F.col("_top.value") != "") & (F.col("_second") != "") & (a.contains(b) | b.contains(a))
    place = pair.where(nested).select(*PATH_KEYS, F.col("_top").alias("_place"))
    limit = name_threshold * 100 if scale == "reference" else name_threshold
    result = join_within(base, place, PATH_KEYS, "left")
    named = F.lit(None).cast("struct<option_key string, value string>")
    if limit <= 1:
        firsts = base.select(*PATH_KEYS, F.coalesce("_first.value", F.lit("")).alias("_base"))
        names = join_within(members.where(F.col("logical_id").isin("trading_name", "legal_name")), firsts, PATH_KEYS)
        close = (
            names.where(T.token_sort_ratio(F.col("_base"), text) >= limit)
            .groupBy(*PATH_KEYS)
            .agg(F.min_by(F.struct("option_key", "value"), F.struct(-F.col("confidence"), F.col("ordinal"))).alias("_named"))
        )
        result = join_within(result, close, PATH_KEYS, "left")
        named = F.col("_named")
    fresh = F.lit(None).cast("struct<option_key string, value string>")
    if preferred is not None:
        chosen = preferred.select(
            *PATH_KEYS,
            F.struct(F.col("preferred_option_key").alias("option_key"), F.col("preferred_value").alias("value")).alias("_fresh"),
        )
        result = join_within(result, chosen, PATH_KEYS, "left")
        fresh = F.col("_fresh")
    winner = F.coalesce(fresh, F.col("_place"), named, F.col("_confident"))
    rule = (
        F.when(fresh.isNotNull(), F.lit("freshness"))
        .when(F.col("_place").isNotNull(), F.lit("longer_place"))
        .when(named.isNotNull(), F.lit("close_name"))
        .otherwise(F.lit("confidence"))
    )
    return result.select(
        *PATH_KEYS, winner["option_key"].alias("winner_option_key"), winner["value"].alias("winner_value"), rule.alias("rule")
    )


# --- checks ----------------------------------------------------------------------------------

CHECK_COLUMNS = ["bundle_id", "check_id", "status", "severity", "path", "logical_id", "reason", "ordinal"]


def bundle_checks(
    options: DataFrame, singletons: dict[str, str], name_checks: DataFrame | None = None
) -> DataFrame:
    """Identifier shape, singleton, embedded PAN, region and entity type checks of each bundle.

    ``singletons``: logical field -> validator, for the fields that may have one value per bundle.
    """
    text = F.coalesce("value", F.lit(""))
    verdicts = {logical: I.run_validator(validator, text, strict=False) for logical, validator in singletons.items()}

    def judged(part: str) -> Column:
        """One part of the verdict; a verdict taken as a whole would be made again for each of its parts."""
        out = F
        for logical, v in verdicts.items():
            out = out.when(F.col("logical_id") == logical, v[part])
        return out

    brief = F.struct("value", "path", "ordinal")

    def first_of(logical: str) -> Column:
        mine = F.col("logical_id") == logical
        return F.min_by(F.when(mine, brief), F.when(mine, F.col("ordinal")))

    def valid_of(logical: str) -> Column:
        return F.when((F.col("logical_id") == logical) & verdicts[logical]["ok"], verdicts[logical]["normalised"])

    # one pass for all that is asked of a bundle's fields, each of which is a column beside every identifier; the first
    # row of a bundle speaks for it
    firsts = {"gstin": "g", "pan": "p", "bill_to_region": "r"} | {x: f"_f{i}" for i, x in enumerate(singletons) if x not in ("gstin", "pan", "bill_to_region")}
    ranges = {x: (f"_lo{i}", f"_hi{i}") for i, x in enumerate(singletons)}
    by_order = Window.partitionBy("bundle_id").orderBy("ordinal")
    whole = by_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    identity = options.where(F.col("logical_id").isin(*firsts)).select(
        "bundle_id", "path", "logical_id", "value", "ordinal", (F.row_number().over(by_order) == 1).alias("_leads"),
        *[first_of(x).over(whole).alias(c) for x, c in firsts.items()], *[F.min(valid_of(x)).over(whole).alias(lo) for x, (lo, _) in ranges.items()],
        *[F.max(valid_of(x)).over(whole).alias(hi) for x, (_, hi) in ranges.items()],
    )
    gst = I.run_validator("gstin", F.col("g.value"))
    pan = I.run_validator("pan", F.col("p.value"))
    gst_ok = F.col("g").isNotNull() & gst["ok"]
    pan_ok = F.col("p").isNotNull() & pan["ok"]
    embedded = I.embedded_pan(F.col("g.value"))
    region = T.norm_id(F.col("r.value"))
    derived = I.state_region(F.col("g.value"))

    def row(when: Column, check_id: Column, status: Column, severity: Column, path: str, logical: Column, reason: Column, seq: Column):
        return F.when(
            when,
            F.struct(
                check_id.alias("check_id"), status.alias("status"), severity.alias("severity"), F.col(path).alias("path"),
                logical.alias("logical_id"), reason.alias("reason"), seq.alias("ordinal"),
            ),
        )

    def check(when: Column, check_id: str, status: Column, severity: Column, path: str, logical: str, reason: str, seq: Column):
        return row(F.col("_leads") & when, F.lit(check_id), status, severity, path, F.lit(logical), F.lit(reason), seq)

    shape = row(
        F.col("logical_id").isin(*singletons) & ~judged("ok"), F.concat(F.lit("identifier_shape_"), F.col("logical_id")), F.lit("fail"), F.lit("block"),
        "path", F.col("logical_id"), judged("reason"), F.concat(F.lit("1-"), F.col("ordinal")),
    )
    mismatch = embedded.isNotNull() & (embedded != pan["normalised"])
    several = [
        check(
            F.col(lo) != F.col(hi), f"id_{x}_singleton", F.lit("fail"), F.lit("block"), f"{firsts[x]}.path", x, "several values",
            F.concat(F.lit("2-"), F.col(f"{firsts[x]}.ordinal")),
        )
        for x, (lo, hi) in ranges.items()
    ]
    found = identity.select(
        "bundle_id",
        F.explode(
            F.array_compact(
                F.array(
                    shape,
                    *several,
                    check(
                        gst_ok & pan_ok, "cross_gstin_embeds_pan",
                        F.when(mismatch, F.lit("fail")).otherwise(F.lit("pass")),
                        F.when(mismatch, F.lit("block")).otherwise(F.lit("info")),
                        "g.path", "gstin", "embedded identifier", F.lit("3"),
                    ),
                    check(
                        gst_ok & F.col("r").isNotNull() & (region != "") & derived.isNotNull() & (derived != region),
                        "addr_region_vs_gstin", F.lit("warn"), F.lit("warn"), "g.path", "gstin", "region differs", F.lit("5"),
                    ),
                    check(
                        F.col("g").isNotNull() & pan_ok & I.natural_person(F.col("p.value")),
                        "entity_person_with_gst", F.lit("warn"), F.lit("warn"), "p.path", "pan", "natural person", F.lit("6"),
                    ),
                )
            )
        ).alias("_c"),
    ).select("bundle_id", "_c.*")
    parts = [found] + ([name_checks] if name_checks is not None else [])
    return reduce(DataFrame.unionByName, [p.select(*CHECK_COLUMNS) for p in parts])


def check_targets(options: DataFrame, checks: DataFrame) -> DataFrame:
    """(bundle_id, check_id, status, severity, ordinal, place, path, logical_id): all that a check is about.

    Place 0 is the first path. A field that may have one value only names every path that proposes it, and a
    tax identifier that embeds another registration number names both.
    """
    keep = ["bundle_id", "check_id", "status", "severity", "ordinal"]
    failed, check_id = F.coalesce(F.col("status") == "fail", F.lit(False)), F.col("check_id")
    several = F.coalesce(check_id == F.concat(F.lit("id_"), F.col("logical_id"), F.lit("_singleton")), F.lit(False))
    crossed = F.coalesce(check_id == "cross_gstin_embeds_pan", F.lit(False))
    # each check once for its own path and, if it names more, once to meet the paths of its bundle
    places = F.when(failed & (several | crossed), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    asked = checks.withColumns({"_several": several, "_crossed": crossed}).withColumn("place", F.explode(places))
    by_order = Window.partitionBy("bundle_id", "logical_id").orderBy(F.col("_at").asc_nulls_last())
    paths = (
        options.where(F.col("logical_id").isNotNull()).groupBy("bundle_id", "logical_id", "path").agg(F.min("ordinal").alias("_at"))
        .withColumn("_leads", F.row_number().over(by_order) == 1)
        .select(F.col("bundle_id").alias("_bundle"), F.col("logical_id").alias("_logical"), F.col("path").alias("_path"), "_leads")
    )
    more = (F.col("_several") & (F.col("logical_id") == F.col("_logical")) & (F.col("path") != F.col("_path"))) | (
        F.col("_crossed") & (F.col("_logical") == "pan") & F.col("_leads")
    )
    met = asked.join(paths, (F.col("bundle_id") == F.col("_bundle")) & (F.col("place") == 1) & more, "left")
    own = F.col("place") == 0
    return met.where(own | F.col("_bundle").isNotNull()).select(
        *keep, "place", F.when(own, F.col("path")).otherwise(F.col("_path")).alias("path"),
        F.when(own, F.col("logical_id")).otherwise(F.col("_logical")).alias("logical_id"),
    )


def min_pairwise_similarity(
    options: DataFrame, fields: dict[str, float]
) -> DataFrame:
    """The lowest ratio of two values of a multi-source field, and whether it is below the field's threshold.

    ``fields``: logical id -> threshold.  Values are reduced to the distinct ones first.  All are compared with
    one pivot per group, then with the value farthest from it; the lowest ratio so far is the bound.  By the
    triangle inequality of the edit distance, a pair is below the bound only if both its slacks add up to more
    than nothing, where the slack of a value is its distance to a pivot less what the bound allows its length.
    So values that even the largest slack of their group does not lift leave, one of each pair must have a slack
    of its own, and only such pairs are compared.
    """
    keys = ["bundle_id", "logical_id"]
    limit = F
    for name, value in fields.items():
        limit = limit.when(F.col("logical_id") == name, F.lit(value))
    values = (
        options.where(F.col("logical_id").isin(*fields))
        .select(*keys, T.strip(F.col("value")).alias("value"))
        .where("value <> ''")
        .distinct()
        .withColumn("_span", F.length(T.sorted_tokens(F.col("value"))))
    )
    first = (
        values.groupBy(*keys)
        .agg(F.min(F.struct("value", "_span")).alias("_p"), F.count(F.lit(1)).alias("distinct_values"))
        .where("distinct_values > 1")
    )

    def against(rows: DataFrame, pivots: DataFrame, distance: str) -> DataFrame:
        ratio = T.token_sort_ratio(F.col("_p.value"), F.col("value"))
        return (
            rows.join(pivots, keys)
            .where(F.col("value") != F.col("_p.value"))
            .withColumn("_ratio", ratio)
            .withColumn(distance, (1 - F.col("_ratio")) * (F.col("_p._span") + F.col("_span")))
            .drop("_p")
        )

    one = against(values, first, "_d1")
    bound = one.groupBy(*keys).agg(
        F.min("_ratio").alias("_bound"), F.min_by(F.struct("value", "_span"), F.struct("_ratio", "value")).alias("_p"), F.first("distinct_values").alias("distinct_values")
    )
    two = against(one.drop("_ratio", "distinct_values"), bound.where("distinct_values > 2").select(*keys, "_p"), "_d2")
    lower = bound.join(two.groupBy(*keys).agg(F.min("_ratio").alias("_second")), keys, "left")
    lower = lower.select(*keys, "distinct_values", F.least("_bound", "_second").alias("_bound"))
    slack = [(F.col(d) - (1 - F.col("_bound")) * F.col("_span") + 1e-9).alias(s) for d, s in (("_d1", "_s1"), ("_d2", "_s2"))]
    slacks = two.join(lower, keys).select(*keys, "value", *slack)
    most = slacks.groupBy(*keys).agg(F.max("_s1").alias("_m1"), F.max("_s2").alias("_m2")).where("_m1 > 0 AND _m2 > 0")
    open_ = slacks.join(most, keys).where("_s1 + _m1 > 0 AND _s2 + _m2 > 0")
    left = open_.where("_s1 > 0").select(*keys, F.struct(F.col("_s1").alias("s1"), F.col("value").alias("v"), F.col("_s2").alias("s2")).alias("a"))
    right = open_.select(*keys, F.struct(F.col("_s1").alias("s1"), F.col("value").alias("v"), F.col("_s2").alias("s2")).alias("b"))
    rest = (
        left.join(right, keys)
        .where("a > b AND a.s1 + b.s1 > 0 AND a.s2 + b.s2 > 0")
        .groupBy(*keys)
        .agg(F.min(T.token_sort_ratio(F.col("a.v"), F.col("b.v"))).alias("_rest"))
    )
    lowest = F.least("_bound", "_rest")
    return lower.join(rest, keys, "left").select(
        *keys, "distinct_values", lowest.alias("min_ratio"),
        F.when(lowest < limit.otherwise(F.lit(None)), F.lit("warn")).otherwise(F.lit("pass")).alias("status"),
    )


def similarity_checks(similarity: DataFrame) -> DataFrame:
    """Warning rows of ``min_pairwise_similarity`` in the checks shape."""
    return similarity.where("status = 'warn'").select(
        "bundle_id", F.concat(F.lit("name_conflict_"), F.col("logical_id")).alias("check_id"),
        F.lit("warn").alias("status"), F.lit("warn").alias("severity"), F.lit(None).cast("string").alias("path"),
        "logical_id", F.lit("values differ").alias("reason"), F.lit("4").alias("ordinal"),
    )


def overlap_existing(new_documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings, observations): stored documents whose type is uploaded again, and all stored ones."""
    stored = existing.where(T.present(F.col("doc_type")))
    types = new_documents.where(T.present(F.col("doc_type"))).select("bundle_id", "doc_type").distinct()
    warned = join_within(stored, types, ["bundle_id", "doc_type"], "left_semi").select(
        "bundle_id", F.concat(F.lit("duplicate_doc_type_"), F.col("doc_type")).alias("check_id"),
        F.lit("warn").alias("status"), F.lit("warn").alias("severity"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("logical_id"), F.lit("stored earlier").alias("reason"),
        F.concat(F.lit("7-"), order_text(stored, "ordinal")).alias("ordinal"),
    )
    observed = stored.select("bundle_id", "doc_type", "ordinal", F.replace("doc_type", F.lit("_"), F.lit(" ")).alias("message"))
    return warned, observed


def merge_cached(live: DataFrame, cached: DataFrame) -> DataFrame:
    """Add cached extractions for types and ids that the live batch lacks; first cached per type wins.

    live: bundle_id, document_id, doc_type, effective_date, ordinal, patches.
    cached: bundle_id, filename, doc_type, effective_date, ordinal, summary map<path, value>.
    """
    named = cached.where(T.present(F.col("doc_type"))).withColumn(
        "document_id", F.concat_ws(":", F.lit("cached"), "doc_type", F.coalesce("filename", F.lit("cached")))
    )
    new = named.join(live.select("bundle_id", "doc_type").distinct(), ["bundle_id", "doc_type"], "left_anti").join(
        live.select("bundle_id", "document_id").distinct(), ["bundle_id", "document_id"], "left_anti"
    )
    first = first_row(new.drop("filename"), ["bundle_id", "doc_type"], [F.col("ordinal")])
    patch_type = live.schema["patches"].dataType.simpleString()
    patches = F.transform(
        F.filter(F.map_entries("summary"), lambda e: (e["key"] != "") & ~e["key"].startswith("_unmapped")),
        lambda e: F.struct(
            e["key"].alias("path"), e["value"].alias("value"), e["key"].alias("label"), F.lit(0.85).alias("confidence"),
            F.lit(False).alias("pre_selected"), F.lit(None).cast("string").alias("needs_resolution"), F.lit(True).alias("regex_ok"),
        ),
    ).cast(patch_type)
    restored = first.select(
        "bundle_id", "document_id", "doc_type", "effective_date", F.concat(F.lit("~"), order_text(first, "ordinal")).alias("ordinal"),
        patches.alias("patches"), F.lit(True).alias("from_cache"),
    )
    return live.withColumn("from_cache", F.lit(False)).unionByName(restored)


def compare_to_master(options: DataFrame, master: DataFrame) -> DataFrame:
    """Warn where the first proposed value of a path differs from the stored one.

    master: bundle_id, path, value, value_type ('boolean' or anything else).
    """
    first = first_row(options.select(*PATH_KEYS, "label", "value", "ordinal"), PATH_KEYS, [F.col("ordinal")])
    known = master.where(T.present(F.col("value"))).select(*PATH_KEYS, F.col("value").alias("current"), "value_type")
    joined = join_within(first, known, PATH_KEYS)
    current, incoming = T.strip(F.col("current")), T.strip(F.col("value"))
    is_id = F.col("path").contains("taxIdentification") | F.col("path").endswith("gstin") | F.col("path").contains("postalCode")
    kind = F.coalesce("value_type", F.lit("string"))
    fuzzy = ~is_id & (kind != "boolean")
    alike = T.token_sort_ratio(F.when(fuzzy, current), F.when(fuzzy, incoming)) >= 0.92
    truth = F.col("value").isNotNull() & (F.lower(incoming).isin("", "false", "0") == F.lower(current).isin("", "false", "0"))
    same = (
        F.when(kind == "boolean", truth)
        .when(F.coalesce(incoming, F.lit("")) == "", F.lit(False))
        .when(is_id, T.norm_id(current) == T.norm_id(incoming))
        .otherwise(alike)
    )
    return joined.where(~same).select(
        "bundle_id", F.concat(F.lit("form_mismatch_"), F.col("path")).alias("check_id"), F.lit("warn").alias("status"),
        F.lit("warn").alias("severity"), "path", F.lit(None).cast("string").alias("logical_id"),
        F.concat(current, F.lit(" / "), F.coalesce("value", F.lit(C.EMPTY_DISPLAY))).alias("reason"),
        F.concat(F.lit("8-"), F.col("ordinal")).alias("ordinal"),
    )


def clear_preselect(options: DataFrame, checks: DataFrame) -> DataFrame:
    """In bundles with a blocking failure, drop the pre-selection of first failed paths and all failed fields."""
    failed = check_targets(options, checks).where("status = 'fail'")
    # a bundle has no more failed paths and fields than a form has
    bad = (
        failed.groupBy("bundle_id")
        .agg(
            F.max(F.col("severity") == "block").alias("_block"), F.collect_set(F.when(F.col("place") == 0, F.col("path"))).alias("_bad_paths"),
            F.collect_set("logical_id").alias("_bad_fields"),
        )
        .where("_block")
    )
    hit = F.coalesce(F.array_contains("_bad_paths", F.col("path")), F.lit(False)) | F.coalesce(F.array_contains("_bad_fields", F.col("logical_id")), F.lit(False))
    marked = options.join(bad, "bundle_id", "left")
    return marked.withColumn("pre_selected", F.col("pre_selected") & ~hit).select(*options.columns)


def clear_identity_preselect(patches: DataFrame, failed_checks: DataFrame, locale: bool = False) -> DataFrame:
    """Document variant: a failed identity check clears only the identifier slots."""
    ids = (
        ["uscc_checksum", "ae_trn_shape", "us_ein_shape", "gb_vat_shape", "gb_crn_shape"]
        if locale
        else ["gstin_contains_pan", "pan_shape", "gstin_shape"]
    )
    hit = (
        failed_checks.where((F.col("status") == "fail") & F.col("check_id").isin(*ids))
        .select("document_id").distinct().withColumn("_hit", F.lit(True))
    )
    slot = F.col("tax_type_code").isin("TAXNO1") if locale else F.col("tax_type_code").isin("TAXNO3", "TAXNO4")
    slot = F.coalesce(slot, F.lit(False))
    if locale:
        slot = slot | F.col("path").startswith("_unmapped.")
    clear = F.coalesce("_hit", F.lit(False)) & slot
    return patches.join(hit, "document_id", "left").withColumn("pre_selected", F.col("pre_selected") & ~clear).drop("_hit")


# --- verdicts --------------------------------------------------------------------------------

VERDICT_COLUMNS = ["bundle_id", "path", "label", "action", "option_key", "ordinal"]


def field_verdicts(
    options: DataFrame, conflicts: DataFrame, checks: DataFrame, winners: DataFrame | None = None, scale: str = "reference",
    name_threshold: float = 0.82,
) -> DataFrame:
    """Verdicts of contested, rejected, accepted and suggested fields, in that precedence.

    Without ``winners`` the conflicts bring their own (``conflicts_of``).
    """
    won = ["winner_option_key", "winner_value"]
    contested = conflicts if winners is None else join_within(conflicts.drop(*won), winners.select(*PATH_KEYS, *won), PATH_KEYS)
    action = F.lit("steward_required")
    if scale != "reference":
        members = join_within(options, contested.select(*PATH_KEYS, *won), PATH_KEYS).where("option_key <> winner_option_key")
        close = members.where(
            T.token_sort_ratio(F.coalesce("winner_value", F.lit("")), F.coalesce("value", F.lit(""))) >= name_threshold
        ).select(*PATH_KEYS).distinct().withColumn("_close", F.lit(True))
        contested = join_within(contested, close, PATH_KEYS, "left")
        action = F.when(F.col("_close"), F.lit("suggest")).otherwise(action)
    blocked = check_targets(options, checks).where("status = 'fail' AND severity = 'block' AND path IS NOT NULL")
    accept = F.col("pre_selected") & F.col("needs_resolution").isNull()
    suggest = F.col("needs_resolution").isNotNull() & (F.col("confidence") >= C.AUTO_APPLY_THRESHOLD)
    free = ~F.col("path").startswith("_unmapped") & (accept | suggest)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: int, label: Column, action: Column, key: Column) -> DataFrame:
        ordinal = F.col("ordinal").cast("string")
        return df.select(*PATH_KEYS, label.alias("label"), action.alias("action"), key.alias("option_key"), ordinal.alias("ordinal"), F.lit(kind).alias("_kind"))

    parts = [
        rows(contested, 1, F.col("label"), action, F.col("winner_option_key")),
        rows(blocked, 2, none, F.lit("reject"), none),
        rows(options, 3, F.col("label"), F.when(free, F.when(accept, F.lit("accept")).otherwise(F.lit("suggest"))), F.col("option_key")),
    ]
    if winners is not None:
        parts.append(rows(conflicts, 1, none, none, none))
    # conflicts, checks and options of a path meet in one window, so that each of them is made once
    kind, path = F.col("_kind"), Window.partitionBy(*PATH_KEYS)
    option = kind == 3
    met = reduce(DataFrame.unionByName, parts).withColumns(
        {
            "_taken": F.max(kind < 3).over(path), "_held": F.max(option).over(path),
            "_owner": F.min_by(F.when(option, F.struct("label")), F.when(option, F.struct("ordinal"))).over(path),
        }
    )
    # a null key meets nothing
    keyed = F.col("bundle_id").isNotNull() & F.col("path").isNotNull()
    stays = F.when(kind == 2, keyed & F.col("_held")).when(option, ~(keyed & F.col("_taken"))).otherwise(F.lit(True))
    return met.where(F.col("action").isNotNull() & stays).select(
        *PATH_KEYS, F.when(kind == 2, F.col("_owner.label")).otherwise(F.col("label")).alias("label"), "action", "option_key",
        F.concat(kind.cast("string"), F.lit("-"), F.col("ordinal")).alias("ordinal"),
    )


def auto_apply(
    verdicts: DataFrame, options: DataFrame, superseded: DataFrame | None = None, mode: str = "agent",
    alignment: DataFrame | None = None,
) -> DataFrame:
    """Values that may be written without a person: accepted ones, and suggestions when allowed."""
    chosen = verdicts.where("option_key IS NOT NULL")
    suggest = F.lit(mode == "steward")
    if alignment is not None:
        chosen = chosen.join(alignment.select("bundle_id", "alignment_score"), "bundle_id", "left")
        suggest = suggest | (F.coalesce("alignment_score", F.lit(0.0)) >= C.AUTO_APPLY_THRESHOLD)
    chosen = chosen.where((F.col("action") == "accept") | ((F.col("action") == "suggest") & suggest))
    if superseded is not None:
        chosen = chosen.join(superseded.select("bundle_id", "option_key"), ["bundle_id", "option_key"], "left_anti")
    picked = chosen.select("bundle_id", "option_key", F.col("ordinal").alias("_verdict")).join(
        options.where(T.present(F.col("path")) & ~F.col("path").startswith("_unmapped")), ["bundle_id", "option_key"]
    )
    confidence = F.when(F.col("confidence") == 0, F.lit(0.8)).otherwise(F.coalesce("confidence", F.lit(0.8)))
    rows = picked.select(
        *PATH_KEYS, "label", "value", confidence.alias("confidence"), F.lit("document").alias("source"),
        F.col("doc_type").alias("source_label"), "needs_resolution", "_verdict",
    )
    return first_row(rows, PATH_KEYS, [F.col("_verdict")]).drop("_verdict")


def needs_corroboration(
    documents: DataFrame, candidates: DataFrame, conflicts: DataFrame, verdicts: DataFrame, enabled: bool = True
) -> DataFrame:
    """Bundles worth a second look: several documents or addresses, a conflict, or a steward decision."""

    def flag(df: DataFrame, documents: int = 0, addresses: int = 0, contested: int = 0) -> DataFrame:
        return df.groupBy("bundle_id").agg(
            (F.count(F.lit(1)) * documents).alias("d"), (F.count(F.lit(1)) * addresses).alias("a"),
            (F.count(F.lit(1)) * contested).alias("c"),
        )

    merged = (
        flag(documents, documents=1)
        .unionByName(flag(candidates, addresses=1))
        .unionByName(flag(conflicts, contested=1))
        .unionByName(flag(verdicts.where("action = 'steward_required'"), contested=1))
        .groupBy("bundle_id")
        .agg(F.sum("d").alias("documents"), F.sum("a").alias("addresses"), F.sum("c").alias("contested"))
    )
    wanted = (F.col("documents") >= 2) | (F.col("addresses") > 1) | (F.col("contested") > 0)
    return merged.select("bundle_id", (F.lit(enabled) & wanted).alias("needs_corroboration"))


def bundle_summary(documents: DataFrame, conflicts: DataFrame, checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts per bundle and a short text made from them."""
    zero = F.lit(0)
    names = ["documents", "conflicts", "mismatches", "duplicates", "blocking", "accepts", "rejects", "stewards"]

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        return df.select("bundle_id", *[counts.get(n, zero).cast("long").alias(n) for n in names])

    def one(condition: Column) -> Column:
        return F.when(condition, F.lit(1)).otherwise(zero)

    check, action = F.col("check_id"), F.col("action")
    events = (
        part(documents, documents=F.lit(1))
        .unionByName(part(conflicts, conflicts=F.lit(1)))
        .unionByName(
            part(
                checks, mismatches=one(check.startswith("form_mismatch_")), duplicates=one(check.startswith("duplicate_doc_type_")),
                blocking=one((F.col("status") == "fail") & (F.col("severity") == "block")),
            )
        )
        .unionByName(
            part(verdicts, accepts=one(action == "accept"), rejects=one(action == "reject"), stewards=one(action == "steward_required"))
        )
    )
    counts = events.groupBy("bundle_id").agg(*[F.sum(n).alias(n) for n in names])
    calm = (F.col("conflicts") == 0) & (F.col("mismatches") == 0) & (F.col("blocking") == 0)

    def say(condition: Column, *pieces) -> Column:
        return F.when(condition, F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in pieces]))

    text = F.concat_ws(
        " ",
        say(F.lit(True), F.col("documents"), " document(s)."),
        say(F.col("conflicts") > 0, F.col("conflicts"), " field(s) disagree."),
        say(F.col("mismatches") > 0, F.col("mismatches"), " value(s) differ from the record."),
        say(F.col("duplicates") > 0, "Earlier copies exist."),
        say(F.col("blocking") > 0, F.col("blocking"), " blocking issue(s)."),
        say(calm & (F.col("accepts") > 0), F.col("accepts"), " field(s) ready to apply."),
        say(calm & (F.col("accepts") == 0), "Review before applying."),
        say((F.col("stewards") > 0) & (F.col("conflicts") > 0), "A choice is required."),
        say(F.col("rejects") > 0, F.col("rejects"), " field(s) cannot be applied."),
    )
    return counts.withColumn("summary", text)


def audit_trail(
    options: DataFrame, checks: DataFrame, conflicts: DataFrame, verdicts: DataFrame, observed: DataFrame | None = None
) -> DataFrame:
    """Numbered observe, rule, compare and recommend steps of each bundle."""

    def steps(df: DataFrame, phase: int, kind: str, ref: Column) -> DataFrame:
        return df.select(
            "bundle_id", F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), ref.alias("ref"), order_text(df, "ordinal").alias("ordinal")
        )

    parts = [
        steps(options, 1, "observe", F.col("option_key")),
        steps(checks.where("status <> 'skip'"), 2, "rule", F.col("check_id")),
        steps(conflicts, 3, "compare", F.col("path")),
        steps(verdicts, 4, "recommend", F.coalesce("option_key", "path")),
    ]
    if observed is not None:
        parts.append(steps(observed, 5, "observe", F.col("doc_type")))
    rows = reduce(DataFrame.unionByName, parts)
    return number_groups(rows, ["bundle_id"], [F.col("phase"), F.col("ordinal"), F.col("ref")], "step", sizes=options)


# --- address candidates ----------------------------------------------------------------------


def _near_postal(a: Column, b: Column) -> Column:
    """Equal, or six characters with at most one difference."""
    six = (F.length(a) == 6) & (F.length(b) == 6)
    differing = sum(F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0) for i in range(1, 7))
    return (a != "") & (b != "") & ((a == b) | (six & (differing <= 1)))


def _bare(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]+", "")


def street_superset(a: Column, b: Column, divisor: float = 100.0, bare: tuple[Column, Column] | None = None) -> Column:
    """1 for streets of the same letters and digits, 0.92 if one has those of the other; ``bare`` has both sides reduced to them."""
    na, nb = bare or (_bare(a), _bare(b))
    return (
        F.when((na == "") | (nb == ""), F.lit(0.0))
        .when(na == nb, F.lit(1.0))
        .when(na.contains(nb) | nb.contains(na), F.lit(0.92))
        .otherwise(T.token_sort_ratio(a, b) / divisor)
    )


def score_address_candidates(candidates: DataFrame, master: DataFrame, scale: str = "reference") -> DataFrame:
    """Alignment of each address candidate with the stored address of its bundle.

    candidates: bundle_id, candidate_key, address_role, full_text, confidence, ordinal and the five
    scored fields; master: bundle_id and the same fields.  The ``reference`` scale divides the
    similarity by 100 once more and never reaches the 85 limit; ``unit`` uses 0..1 throughout.
    """
    names = list(C.ADDRESS_WEIGHTS)
    known = master.select("bundle_id", *[T.strip(F.coalesce(F.col(n), F.lit(""))).alias(f"m_{n}") for n in names])
    rows = candidates.join(known, "bundle_id", "left").withColumns(
        {f"m_{n}": F.coalesce(f"m_{n}", F.lit("")) for n in names} | {f"c_{n}": F.coalesce(n, F.lit("")) for n in names}
    )
    empty = reduce(lambda a, b: a & b, [F.col(f"m_{n}") == "" for n in names])
    divisor = 100.0 if scale == "reference" else 1.0
    full = F.coalesce("full_text", F.lit(""))
    pins = F.regexp_extract_all(full, F.lit(r"\b(\d{6})\b"), F.lit(1))
    postal = F.col("m_postalCode")
    hit = _near_postal(postal, F.col("c_postalCode")) | F.exists(pins, lambda p: _near_postal(postal, p))
    # each measure once, in projections of their own
    measures = {"_empty": empty, "_ok_postalCode": hit, "_bare_m": _bare(F.col("m_streetName")), "_bare_c": _bare(F.col("c_streetName"))}
    for name in names[1:]:
        m, c = F.col(f"m_{name}"), F.col(f"c_{name}")
        measures[f"_both_{name}"] = (m != "") & (c != "")
        measures[f"_inside_{name}"] = F.lower(full).contains(F.lower(m))
    rows = rows.withColumns(measures)
    judged = {"_s_postalCode": F.when(F.col("_ok_postalCode"), F.lit(1.0)).otherwise(F.lit(0.0))}
    near, direct = {}, {}
    for name in names[1:]:
        both, inside = F.col(f"_both_{name}"), F.col(f"_inside_{name}")
        m, c = [F.when(both, F.col(x)) for x in (f"m_{name}", f"c_{name}")]
        alike = T.token_sort_ratio(m, c)
        direct[f"_direct_{name}"] = inside if scale == "reference" else inside | (alike >= 0.85)
        near[f"_near_{name}"] = street_superset(m, c, divisor, (F.col("_bare_m"), F.col("_bare_c"))) if name == "streetName" else alike / divisor
    rows = rows.withColumns(near | direct)
    for name in names[1:]:
        both, direct_, near_ = F.col(f"_both_{name}"), F.col(f"_direct_{name}"), F.col(f"_near_{name}")
        judged[f"_s_{name}"] = F.when(~both, F.lit(0.0)).when(direct_, F.lit(1.0)).otherwise(near_)
        judged[f"_ok_{name}"] = both & (direct_ | ((near_ >= 0.9) if name == "streetName" else F.lit(False)))
    rows = rows.withColumns(judged)
    bonus = F
    for role, value in C.ROLE_BONUS.items():
        bonus = bonus.when(F.col("address_role") == role, F.lit(value))
    unaided = F.least(F.lit(1.0), F.lit(0.5) + bonus.otherwise(F.lit(0.0)) + F.coalesce("confidence", F.lit(0.0)) * 0.35)
    weights = {n: F.when(F.col(f"m_{n}") != "", F.lit(C.ADDRESS_WEIGHTS[n])) for n in names}
    total = sum(F.coalesce(weights[n], F.lit(0.0)) for n in names)
    earned = sum(F.coalesce(weights[n] * F.col(f"_s_{n}"), F.lit(0.0)) for n in names)
    blank = F.col("_empty")
    aligned = F.when(blank, unaided).when(total == 0, F.lit(0.0)).otherwise(earned / total)
    ok = {n: F.col(f"_ok_{n}") for n in names}
    gap = {n: ~ok[n] & ((F.col(f"m_{n}") != "") | (F.col(f"c_{n}") != "")) for n in names}
    gap["postalCode"] = ((postal != "") & ~ok["postalCode"]) | (blank & (F.col("c_postalCode") != ""))

    def named(flags: dict[str, Column]) -> Column:
        return F.concat_ws(",", *[F.when(flags[n], F.lit(n)) for n in names])

    return rows.select(
        "bundle_id", "candidate_key", "address_role", "ordinal",
        F.bround(aligned, 3).alias("alignment_score"),
        F.when(blank, F.lit("")).otherwise(named(ok)).alias("matched_fields"), named(gap).alias("gaps"),
    )


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Flag the best aligned candidate of each bundle; ties keep the first.

    Scored candidates are dealt by bundle already, so a window over the bundle needs no exchange and scores are
    computed once.
    """
    best = Window.partitionBy("bundle_id").orderBy(-F.col("alignment_score"), "ordinal", "candidate_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scored.select(
        *scored.columns, (F.col("candidate_key") == F.first("candidate_key").over(best)).alias("recommended"),
        F.first("alignment_score").over(best).alias("bundle_alignment"),
    )


def conflict_winner_from_freshness(conflicts: DataFrame, freshness: DataFrame) -> DataFrame:
    """Winners when freshness is known: every contested path has a preferred option."""
    return join_within(conflicts.select(*PATH_KEYS), freshness, PATH_KEYS).select(
        *PATH_KEYS, F.col("preferred_option_key").alias("winner_option_key"), F.col("preferred_value").alias("winner_value"),
        F.lit("freshness").alias("rule"),
    )


def contested(profile: DataFrame) -> DataFrame:
    """Profile rows of the conflicting paths."""
    return profile.where(_conflicting(False))
