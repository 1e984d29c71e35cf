"""Composite jobs: whole pipelines a user starts with one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.functions import identifiers as I
from entityops.functions import text as T
from entityops.operators import adjudicate as A
from entityops.operators import corpus as K
from entityops.operators import match as M
from entityops.operators import project as P
from entityops.operators import resolve as S
from entityops.sources import keyed


@dataclass
class Adjudication:
    """Tables an adjudication run produces, all keyed by bundle_id."""

    options: DataFrame
    checks: DataFrame
    conflicts: DataFrame
    freshness: DataFrame
    candidates: DataFrame
    verdicts: DataFrame
    trail: DataFrame
    summary: DataFrame


def adjudicate(
    extractions: DataFrame, bindings: DataFrame, documents: DataFrame, singletons: dict[str, str], master: DataFrame,
    cached: DataFrame | None = None, existing: DataFrame | None = None, candidates: DataFrame | None = None,
    master_addresses: DataFrame | None = None, multi_source: dict[str, float] | None = None, name_threshold: float = 0.82, scale: str = "reference",
) -> Adjudication:
    """Cached merge, options, checks, existing documents, master comparison, clearing, conflicts,
    addresses, freshness, verdicts, trail and summary.

    Nothing is written: options are many times wider than the extractions, so each step unfolds them anew. Extractions,
    master and existing documents that are dealt by bundle_id are grouped and joined where they lie.
    """
    if cached is not None:
        extractions = A.merge_cached(extractions, cached).drop("from_cache")
    proposed = A.flatten_options(extractions, bindings, documents)
    named = None
    if multi_source:
        named = A.similarity_checks(A.min_pairwise_similarity(proposed, multi_source))
    checks = A.bundle_checks(proposed, singletons, named)
    observed = reuploads = None
    if existing is not None:
        warned, observed = A.overlap_existing(extractions, existing)
        checks = checks.unionByName(warned.select(*A.CHECK_COLUMNS))
        reuploads = warned.select("bundle_id")
    checks = checks.unionByName(A.compare_to_master(proposed, master).select(*A.CHECK_COLUMNS))
    options = A.clear_preselect(proposed, checks)
    profile = A.path_profile(proposed)
    conflicts = A.conflicts_of(profile)
    freshness = A.freshness_of(profile, reuploads)
    verdicts = A.field_verdicts(options, conflicts, checks, None, scale, name_threshold)
    ranked = None
    if candidates is not None and master_addresses is not None:
        ranked = A.rank_candidates(A.score_address_candidates(candidates, master_addresses, scale))
    return Adjudication(
        options, checks, conflicts, freshness, ranked, verdicts, A.audit_trail(options, checks, conflicts, verdicts, observed),
        A.bundle_summary(extractions.select("bundle_id"), conflicts, checks, verdicts),
    )


def enrich(
    records: DataFrame, extracted: DataFrame, resolved: DataFrame, cities: DataFrame, key: str = "record_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stage decisions, merged options, record cells after the automatic patches).

    records: wide, with name, country, city, postal_code; extracted: patches of earlier extraction (see
    ``merge_plan``); resolved: key, stage, confidence.  Only stages that should run contribute: the
    address stage resolves the city, the duplicate stage reports the best duplicate.
    """
    stages = {
        "address_enrich": T.blank(F.col("city")) & T.blank(F.col("postal_code")), "registry": T.blank(F.col("name")), "duplicate_precheck": F.lit(False),
    }
    gate = P.stage_gate(records, resolved, stages, key)
    wanted = gate.where("stage = 'address_enrich' AND run").select(key)
    asked = records.join(wanted, key, "left_semi").select(
        key, F.col("city").alias("value"), F.lit(None).cast("string").alias("region_code"), F.lit(None).cast("string").alias("region_name")
    )
    found = M.match_reference(asked, cities).where("matched_code IS NOT NULL")
    address = found.select(
        F.col(key).alias("record_id"), F.lit("postalAddresses.0.cityCode").alias("path"), F.lit("City code").alias("label"), F.col("matched_code").alias("value"),
        F.lit(0.85).alias("confidence"), F.lit("External address service").alias("source_label"), F.lit(None).cast("string").alias("needs_resolution"),
        F.lit("~address").alias("ordinal"),
    )
    patches = extracted.unionByName(address)
    stored = S.to_long(records, key, {"name": "tradingName", "country": "country", "city": "postalAddresses.0.cityName", "postal_code": "postalAddresses.0.postalCode"})
    options, conflicts = S.merge_plan(patches, stored)
    safe = options.where("pre_selected").join(conflicts.select("record_id", "path"), ["record_id", "path"], "left_anti")
    after = S.apply_patches(stored, safe.select("record_id", "path", "value", "ordinal"))
    return gate, options, after


def corpus_profile(documents: DataFrame, text: str = "text", classify_text: str | None = None) -> DataFrame:
    """Documents, exact copies and e-mail addresses per source, language and document type."""
    classified = K.classify_corpus(documents, text=classify_text or text)
    words = F.split(F.col(text), r"(?U)\s+")
    emails = F.size(F.filter(F.filter(words, lambda w: w.contains("@")), lambda w: I.run_validator("email", w)["ok"]))
    facts = classified.select("doc_id", "source", "lang", F.coalesce("doc_type", F.lit("none")).alias("doc_type"), emails.alias("emails"))
    copies = keyed.exact_duplicates(documents, "doc_id", text).where("is_duplicate").select("doc_id", F.lit(1).alias("_copy"))
    return facts.join(copies, "doc_id", "left").groupBy("source", "lang", "doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.count("_copy").alias("copies"), F.sum("emails").alias("emails")
    )
