"""Matching of records with reference rows, registry hits and each other.

Values and signatures are made distinct before anything is joined, candidate pairs come from
equi-joins on keys that every qualifying pair must share, and Python sees strings only (the ratio).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import text as T
from entityops.functions.ordering import first_row, top_rows
from entityops.functions.rows import struct_rows
from entityops.operators.duplicates import meet, similar_names
from entityops.session import materialise

MIN_REFERENCE_SCORE = 60
QUESTIONS_PER_PART = 100_000


# --- reference data --------------------------------------------------------------------------


def _grams(col: Column) -> Column:
    """Every substring of one to three characters."""
    at = F.sequence(F.lit(1), F.length(col))
    cut = F.transform(at, lambda i: F.array(*[F.substr(col, i, F.lit(n)) for n in (1, 2, 3)]))
    return F.array_distinct(F.flatten(cut))


def geo_code(codes: Column, kinds: tuple[str, ...] = ("GEO",)) -> Column:
    """First alternative code of the wanted kinds in an array of (alternativeCodeType, alternativeCode)."""
    return F.try_element_at(F.filter(codes, lambda c: c["alternativeCodeType"].isin(*kinds)), F.lit(1))["alternativeCode"]


def match_reference(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Best reference row for each value: exact 100, prefix 85, contained 60, adjusted by region hints.

    values: value, region_code, region_name and optionally country; reference: ordinal, city_name,
    code, subdivision_code, subdivision_name and optionally country.  A qualifying pair always has the
    value inside the reference name, so both sides meet on the first three characters of the value
    and every three characters of the name; only distinct values take part.
    """
    scope = ["country"] if "country" in values.columns and "country" in reference.columns else []
    keys = ["value", "region_code", "region_name", *scope]
    distinct = values.select(*keys).distinct().withColumn("_target", F.lower(T.strip(F.col("value")))).where("_target <> ''")
    distinct = distinct.withColumn("_gram", F.substring("_target", 1, 3))
    name = F.lower(T.strip(F.col("city_name")))
    rows = reference.select(
        *scope, F.col("ordinal").alias("_ordinal"), F.col("city_name").alias("matched_name"), name.alias("_name"),
        F.coalesce(F.nullif("code", F.lit("")), F.col("city_name")).alias("matched_code"),
        F.upper(T.strip(F.coalesce("subdivision_code", F.lit("")))).alias("_code"),
        F.lower(T.strip(F.coalesce("subdivision_name", F.lit("")))).alias("_region"),
        F.explode(_grams(name)).alias("_gram"),
    )
    pairs = distinct.join(rows, [*scope, "_gram"]).where(F.col("_name").contains(F.col("_target")))
    hint_code, hint_name = F.upper(T.strip(F.col("region_code"))), F.lower(T.strip(F.col("region_name")))
    base = F.when(F.col("_name") == F.col("_target"), 100).when(F.col("_name").startswith(F.col("_target")), 85).otherwise(60)
    by_code = (
        F.when(F.coalesce("region_code", F.lit("")) == "", 0).when(F.col("_code") == hint_code, 25).when(F.col("_code") != "", -40).otherwise(0)
    )
    alike = (F.col("_region") != "") & (F.col("_region").contains(hint_name) | hint_name.contains(F.col("_region")))
    by_name = F.when((F.coalesce("region_name", F.lit("")) != "") & alike, 10).otherwise(0)
    scored = pairs.withColumn("match_score", base + by_code + by_name)
    best = first_row(
        scored.select(*keys, "matched_name", "matched_code", "match_score", "_ordinal"), keys, [-F.col("match_score"), F.col("_ordinal")]
    ).where(F.col("match_score") >= MIN_REFERENCE_SCORE)
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "matched_name", "matched_code", "match_score")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return values.join(best, same, "left").select(*values.columns, "matched_name", "matched_code", "match_score")


def unique_lookup(keys: DataFrame, master: DataFrame, top: int = 5) -> DataFrame:
    """The only live master row behind a search key, or the only one with exactly the wanted code.

    keys: search_key, code and optionally country; master: search_key, code, name, deleted, ordinal and optionally
    country, swift_code, branch_name, which come back with the prefix ``resolved_``.  The search returns the first
    ``top`` rows of its key and country, so the master side is cut to those before the join.
    """
    scope = ["country"] if "country" in keys.columns and "country" in master.columns else []
    more = [c for c in ("country", "swift_code", "branch_name") if c in master.columns]
    found = top_rows(master, ["search_key", *scope], [F.col("ordinal")], top).where(~F.coalesce("deleted", F.lit(False))).select(
        "search_key", *scope, *[F.col(c).alias(f"_{c}") for c in ("code", "name", *more)]
    )
    wanted = keys.select("search_key", "code", *scope).distinct()
    exact = F.upper(T.strip(F.col("_code"))) == F.upper(T.strip(F.col("code")))
    row = F.struct(*[f"_{c}" for c in ("code", "name", *more)])
    return (
        wanted.join(found, ["search_key", *scope])
        .groupBy("search_key", "code", *scope)
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(exact).alias("_exact"), F.min(row).alias("_any"), F.min(F.when(exact, row)).alias("_hit")
        )
        .withColumn("_pick", F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_exact") == 1, F.col("_hit")))
        .where(T.present(F.col("_pick._code")))
        .select("search_key", "code", *scope, *[F.col(f"_pick._{c}").alias(f"resolved_{c}") for c in ("code", "name", *more)])
    )


# --- evidence --------------------------------------------------------------------------------


LEFT_TEXTS = ["name", "legal_name", "city", "street", "postal_code"]
RIGHT_TEXTS = ["found_name", "found_legal_name", "found_tax_id", "found_city", "found_street", "found_postal_code"]


def _marks(values: list[Column]) -> Column:
    """Which of the values are present, one bit each."""
    return reduce(lambda x, y: x + y, [F.when(T.present(v), 1 << i).otherwise(0) for i, v in enumerate(values)])


def left_texts(records: DataFrame) -> DataFrame:
    """What ``score_pairs`` compares of the left side, in normal form; the columns it is made of are dropped.

    Made of the records before they are paired, it costs once per record and not once per pair.
    """
    c = F.col
    tax = F.array_join(F.coalesce("tax_ids", F.array().cast("array<string>")), " · ")
    raw = [*LEFT_TEXTS, "tax_ids", "country"]
    return records.withColumn("_tax", tax).select(
        *[x for x in records.columns if x not in raw], *[T.norm_text(c(x)).alias(f"_n_{x}") for x in LEFT_TEXTS],
        T.norm_text(c("_tax")).alias("_n_tax"), T.tax_parts(c("_tax")).alias("_parts"), F.upper("country").alias("_u_country"),
        _marks([c("name"), c("_tax"), c("city"), c("street"), c("postal_code"), c("country")]).alias("_left_known"),
    )


def right_texts(records: DataFrame) -> DataFrame:
    """The same of the right side."""
    c = F.col
    raw = [*RIGHT_TEXTS, "found_country"]
    found_name = T.first_present(c("found_name"), c("found_legal_name"))
    return records.select(
        *[x for x in records.columns if x not in raw], *[T.norm_text(c(x)).alias(f"_n_{x}") for x in RIGHT_TEXTS],
        F.upper("found_country").alias("_u_found_country"),
        _marks([found_name, c("found_tax_id"), c("found_city"), c("found_street"), c("found_postal_code"), c("found_country")]).alias("_right_known"),
    )


def score_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Six rows of evidence per pair; a side without a value makes the field unknown.

    Left columns: name, legal_name, tax_ids (array), city, street, postal_code, country; the right
    columns carry the prefix ``found_`` (tax_id instead of tax_ids). Either side may have gone through ``left_texts``
    or ``right_texts`` before it was paired.
    """
    c = F.col
    if "_left_known" not in pairs.columns:
        pairs = left_texts(pairs)
    if "_right_known" not in pairs.columns:
        pairs = right_texts(pairs)
    n = lambda x: c(f"_n_{x}")

    def equal(a: Column, b: Column) -> Column:
        return F.when((a != "") & (b != "") & (a == b), 100).otherwise(0)

    name = F.greatest(
        T.ratio_of(n("name"), n("found_name")), T.ratio_of(n("name"), n("found_legal_name")), T.ratio_of(n("legal_name"), n("found_legal_name"))
    )
    city = F.greatest(T.ratio_of(n("city"), n("found_city")), T.jaccard_of(n("city"), n("found_city")))
    ready = pairs.withColumn("_part", T.tax_part(c("_parts"), n("found_tax_id")))
    cells = struct_rows(
        "field ordinal bit raw",
        ("tradingName", 1, 1, name),
        ("tax", 2, 2, T.tax_score(c("_parts"), c("_part"), n("tax"), n("found_tax_id"))),
        ("city", 3, 4, city),
        ("street", 4, 8, T.jaccard_of(n("street"), n("found_street"))),
        ("postalCode", 5, 16, equal(n("postal_code"), n("found_postal_code"))),
        ("country", 6, 32, equal(c("_u_country"), c("_u_found_country"))),
    )
    left, right = c("_left_known").bitwiseAND(c("bit")) != 0, c("_right_known").bitwiseAND(c("bit")) != 0
    known = left & right
    return ready.select(*keys, "_left_known", "_right_known", F.inline(cells)).select(
        *keys, "field", "ordinal", F.when(known, c("raw")).otherwise(0).alias("score"),
        F.when(known, T.trust_status(c("raw"))).otherwise(F.lit("unknown")).alias("status"),
        F.when(~left, F.lit("missing left")).when(~right, F.lit("missing right")).alias("skip_reason"),
    )


def field_weight(field: Column) -> Column:
    out = F
    for name, weight in C.FIELD_WEIGHTS.items():
        out = out.when(field == name, F.lit(weight))
    return out.otherwise(F.lit(C.DEFAULT_FIELD_WEIGHT))


def overall_weighted(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the known fields, half-even, with compared and skipped counts."""
    known = F.col("status") != "unknown"
    weight = field_weight(F.col("field"))
    mean = F.try_divide(F.sum(F.when(known, F.col("score") * weight)), F.sum(F.when(known, weight)))
    return evidence.groupBy(*keys).agg(
        F.coalesce(T.half_even(mean), F.lit(0)).alias("score"), F.count_if(known).alias("compared"), F.count_if(~known).alias("skipped")
    )


def overall_mean(evidence: DataFrame, keys: list[str]) -> DataFrame:
    known = F.col("status") != "unknown"
    return evidence.groupBy(*keys).agg(
        F.coalesce(T.half_even(F.try_divide(F.sum(F.when(known, F.col("score"))), F.count_if(known))), F.lit(0)).alias("score"),
        F.count_if(known).alias("compared"), F.count_if(~known).alias("skipped"),
    )


def blend_semantic(evidence: DataFrame, similarity: DataFrame, keys: list[str], candidate: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, overall): name and street scores raised, never lowered, by an outside similarity.

    similarity: ``candidate``, name_score, address_score, note; unknown fields stay unknown.
    """
    joined = evidence.join(first_row(similarity, [candidate], [F.col("note")]), candidate, "left")
    offered = F.when(F.col("field") == "tradingName", F.col("name_score")).when(F.col("field") == "street", F.col("address_score"))
    raised = F.coalesce((F.col("status") != "unknown") & (offered > F.col("score")), F.lit(False))
    blended = joined.withColumn("raised", raised).withColumns(
        {
            "status": F.when(F.col("raised"), T.blend_status(offered)).otherwise(F.col("status")),
            "score": F.when(F.col("raised"), offered).otherwise(F.col("score")).cast("int"),
        }
    ).select(*evidence.columns, "raised", "note")
    known = F.col("status") != "unknown"
    overall = blended.groupBy(*keys).agg(
        F.coalesce(T.half_even(F.try_divide(F.sum(F.when(known, F.col("score"))), F.count_if(known))), F.lit(0)).alias("overall_score"),
        F.count_if(known).alias("compared"), F.count_if("raised").alias("raised_fields"), F.max("note").alias("note"),
    )
    return blended, overall


# --- duplicates ------------------------------------------------------------------------------


def blocking_request(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(request, tax rows): the fields a duplicate search uses, and its tax numbers one per row.

    records: name, country, street, postal_code, city, tax array<struct<number, country, type_code, slot>>.
    Opaque city codes are dropped; the default slot counts every tax row, blank ones included.
    """
    city = T.strip(F.col("city"))
    request = records.select(
        *keys, T.strip(F.coalesce("name", F.lit(""))).alias("name"), "country", "street", "postal_code",
        F.when(city.rlike(C.CITY_NAME), city).alias("city"),
    )
    rows = records.select(*keys, F.col("country").alias("_country"), F.posexplode("tax").alias("_at", "_t"))
    taxes = rows.where(T.present(F.col("_t.number"))).select(
        *keys, T.strip(F.col("_t.number")).alias("number"), T.first_present(F.col("_t.country"), F.col("_country")).alias("country"),
        F.col("_t.type_code").alias("type_code"),
        T.first_present(F.col("_t.slot"), F.concat(F.lit("TAXNO"), (F.col("_at") + 1).cast("string"))).alias("slot"),
    )
    return request, taxes


def duplicate_candidates(records: DataFrame, min_jaccard: float = 0.5, top: int = 5) -> DataFrame:
    """The ``top`` most similar other records of each record, exact, for any number of copies.

    records: record_id, name, country, postal_code; names of any script.  Only distinct names are paired: two names can reach
    ``min_jaccard`` only if they share two of their rarest tokens (``duplicates.similar_names``).  Within a name, records differ only in country and postal code, and a record's score depends
    on which of the two agree.  The first ``top + 1`` ids of a name alone, of a name with a country, with
    a postal code and with both therefore hold every record that can be among the best.
    """
    w = C.FIELD_WEIGHTS
    keyed = records.select(
        "record_id", T.norm_words(F.col("name")).alias("name"), F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce(F.col("postal_code").cast("string"), F.lit("")).alias("postal"),
    ).where("name <> ''")
    # the smallest record id of a name stands for the name, and likewise for a group of equal records
    ids = keyed.groupBy("name").agg(F.min("record_id").alias("nid"))
    rows = meet(keyed, ids, "name").select("record_id", "nid", "country", "postal")
    names = ids.select("nid", F.array_distinct(F.split("name", " ")).alias("tokens"))
    pairs = similar_names(names, min_jaccard)

    def heads(*fields: str) -> DataFrame:
        """First ids of each (name, fields)."""
        return top_rows(rows, ["nid", *fields], [F.col("record_id")], top + 1, "_n").select(
            F.col("nid").alias("b"), F.col("record_id").alias("candidate_id"), F.col("country").alias("c2"), F.col("postal").alias("p2")
        )

    groups = rows.groupBy("nid", "country", "postal").agg(F.min("record_id").alias("gid"))
    asked = materialise(meet(groups.select("gid", F.col("nid").alias("a"), F.col("country").alias("c1"), F.col("postal").alias("p1")), pairs, "a"))
    # a question gets up to top + 1 answers four times, so parts are counted by questions and not by the size of
    # their rows; both sides are dealt, or the join takes the number of parts of the side that is not
    parts = max(-(-asked.count() // QUESTIONS_PER_PART), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    same_country, same_postal = F.col("c1") == F.col("c2"), F.col("p1") == F.col("p2")

    def answers(*fields: str) -> DataFrame:
        """Questions met with the first ids that agree in these fields."""
        first = heads(*fields)
        one = ["b"] + [{"country": "c1", "postal": "p1"}[f] for f in fields]
        two = ["b"] + [{"country": "c2", "postal": "p2"}[f] for f in fields]
        same = reduce(lambda x, y: x & y, [F.col(f"q.{x}") == F.col(f"h.{y}") for x, y in zip(one, two, strict=True)])
        return meet(asked.repartition(parts, *one).alias("q"), first.repartition(parts, *two).alias("h"), same).drop(F.col("h.b"))

    found = reduce(
        DataFrame.unionByName,
        [
            answers().where(~same_country & ~same_postal),
            answers("country").where(~same_postal),
            answers("postal").where(~same_country),
            answers("country", "postal"),
        ],
    )
    total, weight = F.col("name_score") * w["tradingName"], F.lit(w["tradingName"])
    for one, two, field in (("c1", "c2", "country"), ("p1", "p2", "postalCode")):
        known = (F.col(one) != "") & (F.col(two) != "")
        total = total + F.when(known & (F.col(one) == F.col(two)), 100 * w[field]).otherwise(0)
        weight = weight + F.when(known, w[field]).otherwise(0)
    scored = found.select("gid", "candidate_id", "name_score", F.rint(total / weight).cast("int").alias("score"))
    nearest = top_rows(scored, ["gid"], [-F.col("score"), F.col("candidate_id")], top + 1)
    lists = nearest.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "name_score", "score"))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["candidate_id"] != F.col("record_id")), 1, top)
    return (
        meet(meet(rows, groups, ["nid", "country", "postal"]).select("record_id", "gid"), lists, "gid")
        .select("record_id", F.posexplode(others).alias("_at", "_c"))
        .select(
            "record_id", (F.col("_at") + 1).alias("rank"), F.col("_c.candidate_id").alias("candidate_id"),
            F.col("_c.name_score").alias("name_score"), (F.col("_c.score") / 100).alias("score"),
        )
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, ranked."""
    return top_rows(df, keys, order, k)
