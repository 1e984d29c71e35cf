"""Trust in a record, from the sources that were found for it.

Two tables go in: ``sources`` (record_id, source_id, connector_id, source_type, mode, authority,
ordinal, and optionally completeness for address reviews and verdict for an outside opinion) and
``evidence`` (record_id, source_id, field, score, status).  Evidence is folded to one row per source
first, so a record with very many sources is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import identifiers as I
from entityops.functions import text as T
from entityops.functions.ordering import first_row, number_sorted
from entityops.functions.rows import struct_rows
from entityops.operators.match import field_weight

SOURCE_KEYS = ["record_id", "source_id"]
ADDRESS = "bill_to_address"


def connector_gate(records: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Whether a record is verified at all, with the reason when it is not.

    records: record_id, country; playbooks: country, status (one row per country).
    """
    books = playbooks.select(F.upper(T.strip(F.col("country"))).alias("_country"), F.col("status").alias("playbook_status"))
    joined = records.withColumn("_country", F.upper(T.strip(F.col("country")))).join(books, "_country", "left")
    reason = (
        F.when(F.col("playbook_status").isNull(), F.lit("no playbook"))
        .when(F.col("playbook_status").isin("off", "registry_only"), F.concat(F.lit("playbook is "), F.col("playbook_status")))
    )
    return joined.select(*records.columns, "playbook_status", reason.isNotNull().alias("skipped"), reason.alias("skip_reason"))


def planned_connectors(playbooks: DataFrame) -> DataFrame:
    """Connector types per country in order; the web fallback adds two more unless listed."""
    extra = F.array(F.lit("company_registry_lookup"), F.lit("company_website_probe"))
    listed = F.col("connectors")
    all_types = F.when(F.col("fallback"), F.concat(listed, F.array_except(extra, listed))).otherwise(listed)
    return playbooks.select("country", F.posexplode(all_types).alias("ordinal", "connector_type"))


def format_hits(records: DataFrame) -> DataFrame:
    """Hits of the built-in format connectors: record_id, country, tax_id -> one row per valid identifier."""
    tax = F.upper(T.strip(F.col("tax_id")))
    compact = F.replace(tax, F.lit(" "), F.lit(""))
    hit = (
        F.when(I.gstin_checksum_ok(tax) & (F.col("country") == "IN"), F.struct(F.lit("in_gstin").alias("c"), tax.alias("t"), F.lit(1.0).alias("a")))
        .when(tax.rlike(C.PAN) & (F.col("country") == "IN"), F.struct(F.lit("in_pan").alias("c"), tax.alias("t"), F.lit(0.9).alias("a")))
        .when(compact.rlike(C.GB_CRN) & (F.col("country") == "GB"), F.struct(F.lit("gb_company_number").alias("c"), compact.alias("t"), F.lit(0.85).alias("a")))
    )
    return records.withColumn("_h", hit).where("_h IS NOT NULL").select(
        "record_id", F.col("_h.c").alias("connector_id"), F.lit("format_validator").alias("source_type"), F.lit("format_check").alias("mode"),
        F.col("_h.t").alias("tax_id"), F.col("_h.a").alias("authority"),
    )


def drop_format_hits_with_live(hits: DataFrame) -> DataFrame:
    """Format hits give way to a live registry hit of the same record and identifier."""
    live = (
        hits.where((F.col("mode") == "live_registry") & T.present(F.col("tax_id")))
        .select("record_id", F.upper("tax_id").alias("_tax")).distinct().withColumn("_live", F.lit(True))
    )
    droppable = F.col("connector_id").isin("gb_company_number", "in_gstin")
    marked = hits.withColumn("_tax", F.when(droppable, F.upper("tax_id"))).join(live, ["record_id", "_tax"], "left")
    return marked.where("_live IS NULL").select(*hits.columns)


# --- sources ---------------------------------------------------------------------------------


def source_scores(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per source: match score, correlation score and the field scores later steps ask for."""
    known = F.col("status") != "unknown"
    weight = field_weight(F.col("field"))
    mean = F.try_divide(F.sum(F.when(known, F.col("score") * weight)), F.sum(F.when(known, weight)))
    identity = F.col("field").isin(*C.IDENTITY_FIELDS)
    isolated = F.col("field").isin(*C.ISOLATED_FIELDS)

    def score_of(field: str) -> Column:
        return F.max(F.when(known & (F.col("field") == field), F.col("score")))

    folded = evidence.groupBy(*SOURCE_KEYS).agg(
        F.coalesce(T.half_even(mean), F.lit(0)).alias("weighted"), F.count_if(known).alias("compared"),
        F.count_if(known & identity).alias("_identity"), F.count_if(known & ~isolated).alias("_other"),
        score_of("tax").alias("tax_score"), score_of("tradingName").alias("name_score"),
    )
    joined = sources.join(folded, SOURCE_KEYS, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("weighted", "compared", "_identity", "_other")}
    )
    lonely = (F.col("_identity") == 0) & ((F.col("_other") == 0) | F.col("tax_score").isNotNull())
    correlation = (
        F.when(F.col("compared") == 0, 0).when(lonely, T.half_even(F.col("weighted") * 0.55)).otherwise(F.col("weighted"))
    )
    completeness = F.col("completeness") if "completeness" in sources.columns else F.lit(None).cast("int")
    return joined.withColumns(
        {
            "match_score": F.coalesce(completeness, F.col("weighted")),
            "correlation_score": correlation,
            "isolated": F.col("_identity") == 0,
        }
    ).drop("_identity", "_other", "weighted", *(["completeness"] if "completeness" in sources.columns else []))


def best_record(scored: DataFrame) -> DataFrame:
    """The source with the highest score x authority of each record; the first wins a tie."""
    picked = first_row(scored, ["record_id"], [-(F.col("match_score") * F.col("authority")), F.col("ordinal")])
    return picked.select("record_id", "source_id", "match_score", "authority")


def best_with_address(scored: DataFrame) -> DataFrame:
    """Best source apart from the address review, and the address review, side by side."""
    address = F.col("connector_id") == ADDRESS
    weighed = F.struct(-(F.col("match_score") * F.col("authority")), F.col("ordinal"))
    return scored.groupBy("record_id").agg(
        F.min_by(F.when(~address, F.col("match_score")), F.when(~address, weighed)).alias("best_score"),
        F.min_by(F.when(address, F.col("match_score")), F.when(address, F.col("ordinal"))).alias("address_score"),
    ).withColumn(
        "composite",
        F.when(
            F.col("best_score").isNotNull() & F.col("address_score").isNotNull(),
            T.half_even(F.col("best_score") * 0.65 + F.col("address_score") * 0.35),
        ).otherwise(F.coalesce("best_score", "address_score", F.lit(0))),
    )


def rank_sources(scored: DataFrame) -> DataFrame:
    """Sources by score x authority, highest first, stable."""
    strength = F.col("match_score") * F.col("authority")
    return number_sorted(scored, ["record_id"], [-strength, F.col("ordinal")], "rank")


def correlation(scored: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """Best correlated source per record, and whether only isolated fields matched.

    opinions: record_id, verdict (same, likely, different), score, fields (array) - an outside view
    that can raise the score, or pull it to 35 and mark the record isolated.
    """
    usable = scored.where(F.col("connector_id") != ADDRESS)
    best = F.min_by(
        F.struct("source_id", "correlation_score", "compared", "isolated"),
        F.struct(-F.col("correlation_score"), -F.col("compared"), F.col("ordinal")),
    )
    found = scored.select("record_id").distinct().join(usable.groupBy("record_id").agg(best.alias("b")), "record_id", "left")
    out = found.select(
        "record_id", F.coalesce("b.correlation_score", F.lit(0)).alias("correlation_score"),
        F.coalesce("b.compared", F.lit(0)).alias("correlated_fields"), F.coalesce("b.isolated", F.lit(True)).alias("isolated"),
        F.col("b.source_id").alias("best_source_id"),
    )
    if opinions is None:
        return out
    view = opinions.select("record_id", F.col("verdict").alias("_v"), F.col("score").alias("_s"), F.col("fields").alias("_f"))
    different = F.coalesce(F.col("_v") == "different", F.lit(False))
    agrees = F.col("_v").isin("same", "likely") & F.arrays_overlap("_f", F.array(*[F.lit(x) for x in C.IDENTITY_FIELDS]))
    return out.join(view, "record_id", "left").select(
        "record_id",
        F.when(different, F.least("correlation_score", F.lit(35))).otherwise(F.greatest("correlation_score", F.coalesce("_s", F.lit(0)))).alias("correlation_score"),
        F.greatest("correlated_fields", F.coalesce(F.size("_f"), F.lit(0)).cast("long")).alias("correlated_fields"),
        F.when(different, True).when(F.coalesce(agrees, F.lit(False)), False).otherwise(F.col("isolated")).alias("isolated"),
        "best_source_id",
    )


def trust_score(scored: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Composite score of each record after the ordered caps and boosts, with its band.

    ``related``: correlation with outside opinions; without it, it is derived in the same aggregate.
    """
    c = F.col
    address = c("connector_id") == ADDRESS
    weighed = F.struct(-(c("match_score") * c("authority")), c("ordinal"))
    close = F.struct(-c("correlation_score"), -c("compared"), c("ordinal"))
    verdict = c("verdict") if "verdict" in scored.columns else F.lit(None).cast("string")
    per = scored.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.min_by(F.when(~address, F.struct("match_score", "tax_score")), F.when(~address, weighed)).alias("best"),
        F.min_by(F.struct("match_score", "tax_score"), c("ordinal")).alias("first"),
        F.min_by(F.when(address, c("match_score")), F.when(address, c("ordinal"))).alias("addr"),
        F.min_by(F.when(c("connector_id") == "in_gstin_live", F.struct("name_score")), F.when(c("connector_id") == "in_gstin_live", c("ordinal"))).alias("live"),
        F.min_by(F.when(~address, F.struct("isolated")), F.when(~address, close)).alias("near"),
        F.bool_or(F.coalesce(verdict == "different", F.lit(False))).alias("disputed"),
        F.bool_or(c("mode") == "live_registry").alias("confirmed"),
    )
    if related is not None:
        per = per.join(related.select("record_id", c("isolated").alias("_isolated")), "record_id", "left")
        isolated = F.coalesce("_isolated", F.lit(True))
    else:
        isolated = F.coalesce("near.isolated", F.lit(True))

    def cap(score: Column, condition: Column, limit: int) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.least(score, F.lit(limit))).otherwise(score)

    def boost(score: Column, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.least(F.lit(100), score + 5)).otherwise(score)

    steps = [
        lambda s: F.when(
            c("best").isNotNull() & c("addr").isNotNull(), T.half_even(c("best.match_score") * 0.65 + c("addr") * 0.35)
        ).otherwise(F.coalesce("best.match_score", "addr", F.lit(0))),
        lambda s: cap(s, c("addr") < 70, 55),
        lambda s: cap(s, isolated, 60),
        lambda s: boost(s, (c("sources") >= 2) & (F.when(c("best").isNotNull(), c("best.tax_score")).otherwise(c("first.tax_score")) >= 85)),
        lambda s: boost(s, (c("live.name_score") >= 85) & (c("addr") >= 70)),
        lambda s: cap(s, c("disputed"), 30),
        lambda s: cap(s, ~c("confirmed"), 70),
    ]
    # one projection per step: nested conditionals would repeat the earlier ones in every branch
    per = per.withColumn("trust_score", F.lit(0))
    for step in steps:
        per = per.withColumn("trust_score", step(F.col("trust_score")))
    return per.select("record_id", "trust_score", T.trust_band(c("trust_score")).alias("trust_band"), "sources", isolated.alias("isolated"))


def verification_scope(sources: DataFrame) -> DataFrame:
    """Disclaimer class of each record from the modes and types of its sources."""
    flags = sources.groupBy("record_id").agg(
        F.bool_and(F.col("mode") == "format_check").alias("only_format"), F.bool_or(F.col("mode") == "format_check").alias("format"),
        F.bool_or(F.col("mode") == "live_registry").alias("live"),
        F.bool_or(F.col("source_type").isin("commercial_directory", "company_website")).alias("web"),
    )
    scope = (
        F.when(F.col("only_format") & ~F.col("web"), F.lit("format_only"))
        .when(F.col("only_format"), F.lit("format_and_web"))
        .when(F.col("live") & F.col("format"), F.lit("mixed_live"))
    )
    return flags.select("record_id", scope.alias("scope"))


def first_seen_notes(notes: DataFrame) -> DataFrame:
    """Distinct notes per record with the place of their first appearance."""
    return notes.groupBy("record_id", "note").agg(F.min("ordinal").alias("first_seen"))


def shared_fields(evidence: DataFrame, fields: list[str]) -> DataFrame:
    """Which of ``fields`` a source compared, and whether any (set intersection per source)."""
    known = F.collect_set(F.when(F.col("status") != "unknown", F.col("field")))  # at most one entry per field name
    wanted = F.array(*[F.lit(f) for f in fields])
    return evidence.groupBy(*SOURCE_KEYS).agg(known.alias("_k")).select(
        *SOURCE_KEYS, F.array_join(F.array_sort(F.array_intersect("_k", wanted)), ",").alias("shared"),
        F.arrays_overlap("_k", wanted).alias("overlaps"),
    )


# --- address review --------------------------------------------------------------------------


def address_evidence(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """Presence and format rows of one address per record.

    addresses: street_number, street_name, building_name, city, postal_code, address_country, country
    (upper case), tax_id.
    """
    c = F.col
    street = T.strip_to_null(F.concat_ws(" ", *[T.strip_to_null(c(x)) for x in ("street_number", "street_name", "building_name")]))
    postal = T.strip_to_null(c("postal_code"))
    postal_score = (
        F.when(postal.isNull(), 0)
        .when(c("country") == "IN", F.when(postal.rlike(C.PIN), 100).otherwise(40))
        .when(c("country") == "GB", F.when(F.replace(F.upper(postal), F.lit("  "), F.lit(" ")).rlike(C.GB_POSTCODE), 100).otherwise(50))
        .otherwise(100)
    )
    entered = F.upper(T.first_present(c("address_country"), c("country")))
    country_score = F.when(entered == F.upper("country"), 100).otherwise(0)
    state = F.when(
        c("country") == "IN", F.when(F.coalesce(I.run_validator("gstin_checked", c("tax_id"))["ok"], F.lit(False)), 100).otherwise(-1)
    )

    def presence(col: Column) -> Column:
        return F.when(col.isNull(), 0).otherwise(100)

    cells = struct_rows(
        "field score",
        ("street", presence(street)), ("city", presence(T.strip_to_null(c("city")))), ("postalCode", postal_score),
        ("country", country_score), ("gstinState", state),
    )
    return addresses.select(*keys, F.inline(cells)).where("score IS NOT NULL").select(
        *keys, "field", F.greatest("score", F.lit(0)).alias("score"),
        F.when(F.col("score") < 0, F.lit("unknown")).otherwise(T.trust_status(F.col("score"))).alias("status"),
    )


def address_completeness(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the known rows, at most 65 without a street, with a flag below 70."""
    known = F.col("status") != "unknown"
    score = F.coalesce(T.half_even(F.try_divide(F.sum(F.when(known, F.col("score"))), F.count_if(known))), F.lit(0))
    folded = address_evidence(addresses, keys).groupBy(*keys).agg(
        score.alias("_mean"), F.max(F.when(F.col("field") == "street", F.col("score"))).alias("_street"),
        F.max(F.when(F.col("field") == "city", F.col("score"))).alias("_city"),
    )
    limited = F.when(F.col("_street") == 0, F.least("_mean", F.lit(65))).otherwise(F.col("_mean"))
    notes = F.concat_ws(
        ",", F.when(F.col("_street") == 0, F.lit("street missing")), F.when(limited < 70, F.lit("incomplete")),
        F.when((F.col("_street") == 0) & (F.col("_city") == 0), F.lit("no content")),
    )
    return folded.select(*keys, limited.alias("completeness"), notes.alias("notes"))


def verify_entities(
    records: DataFrame, playbooks: DataFrame, sources: DataFrame, evidence: DataFrame, opinions: DataFrame | None = None
) -> DataFrame:
    """Gate, format clean-up, evidence, correlation, trust and band of every record."""
    gated = connector_gate(records, playbooks)
    live = gated.where(~F.col("skipped")).select("record_id")
    hits = drop_format_hits_with_live(sources.join(live, "record_id", "left_semi"))
    scored = source_scores(hits, evidence)
    trust = trust_score(scored, None if opinions is None else correlation(scored, opinions))
    scope = verification_scope(hits)
    return (
        gated.join(trust, "record_id", "left").join(scope, "record_id", "left")
        .select(
            "record_id", "skipped", "skip_reason",
            F.when(~F.col("skipped"), F.coalesce("trust_score", F.lit(0))).alias("trust_score"),
            F.when(~F.col("skipped"), F.coalesce("trust_band", F.lit("insufficient"))).alias("trust_band"), "scope",
        )
    )
