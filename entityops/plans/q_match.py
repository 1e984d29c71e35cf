"""Registered queries of matching, evidence, trust and duplicate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions.rows import struct_rows
from entityops.operators import duplicates as D
from entityops.operators import match as M
from entityops.operators import trust as U
from entityops.plans import sql, views
from entityops.plans.registry import query


# --- reference data --------------------------------------------------------------------------


def city_reference(t):
    return t.v_cityref().withColumn(
        "subdivision_code", F.when(F.col("ordinal") % 4 != 0, F.upper(F.substring("subdivision_name", 1, 2)))
    )


def city_values(t):
    """Customers name their nation exactly, by prefix, by an inner part or wrongly, with region hints."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key, name = F.col("c_custkey"), F.col("n_name")
    return t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("record_id"),
        F.when(key % 4 == 0, F.lower(name)).when(key % 4 == 1, F.concat(F.lit(" "), F.substring(name, 1, 8), F.lit(" ")))
        .when(key % 4 == 2, F.substring(name, 4, 20)).otherwise(F.concat(name, F.lit("zz"))).alias("value"),
        F.when(key % 3 == 0, F.lower(F.substring("r_name", 1, 2))).when(key % 3 == 1, F.lit("EU")).alias("region_code"),
        F.when(key % 2 == 0, F.lower(F.substring("r_name", 1, 4))).alias("region_name"),
    )


_VALUES = """vals AS (SELECT c_custkey AS record_id, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN concat(' ', substr(n_name, 1, 8), ' ')
    WHEN 2 THEN substr(n_name, 4, 20) ELSE concat(n_name, 'zz') END AS value,
  CASE c_custkey % 3 WHEN 0 THEN lower(substr(r_name, 1, 2)) WHEN 1 THEN 'EU' END AS region_code,
  CASE WHEN c_custkey % 2 = 0 THEN lower(substr(r_name, 1, 4)) END AS region_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
refs AS (SELECT *, CASE WHEN ordinal % 4 <> 0 THEN upper(substr(subdivision_name, 1, 2)) END AS subdivision_code FROM v_cityref),
matched AS (SELECT v.record_id, r.city_name, r.code, r.ordinal,
    CASE WHEN lower(city_name) = lower(trim(value)) THEN 100 WHEN starts_with(lower(city_name), lower(trim(value))) THEN 85 ELSE 60 END
    + CASE WHEN region_code IS NULL THEN 0 WHEN subdivision_code = upper(region_code) THEN 25 WHEN subdivision_code IS NOT NULL THEN -40 ELSE 0 END
    + CASE WHEN region_name IS NOT NULL AND (contains(lower(subdivision_name), region_name) OR contains(region_name, lower(subdivision_name))) THEN 10 ELSE 0 END AS score
  FROM vals v JOIN refs r ON contains(lower(city_name), lower(trim(value)))),
best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, ordinal) AS rn FROM matched)"""


@query(
    "jn_3_match_reference",
    f"""WITH {_VALUES} SELECT v.record_id, b.city_name AS matched_name, b.code AS matched_code, b.score AS match_score
FROM vals v LEFT JOIN best b ON v.record_id = b.record_id AND b.rn = 1 AND b.score >= 60""",
    ("v_cityref",),
)
def match_reference(t):
    return M.match_reference(city_values(t), city_reference(t)).select("record_id", "matched_name", "matched_code", "match_score")


@query(
    "jn_4_unique_lookup",
    """WITH master AS (SELECT s_nationkey AS search_key, concat('BK', s_suppkey) AS code, s_name AS name, s_acctbal < 1000 AS deleted,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier),
keys AS (SELECT DISTINCT c_nationkey AS search_key, concat('bk', c_custkey % 100, ' ') AS code FROM customer),
cand AS (SELECT k.search_key, k.code, m.code AS mcode, m.name, upper(trim(k.code)) = m.code AS exact FROM keys k JOIN master m
  ON k.search_key = m.search_key AND m.rn <= 5 AND NOT m.deleted),
agg AS (SELECT search_key, code, count(*) AS n, count(*) FILTER (exact) AS e, min(mcode) AS any_code, min(name) AS any_name,
  min(mcode) FILTER (exact) AS hit_code, min(name) FILTER (exact) AS hit_name FROM cand GROUP BY ALL)
SELECT search_key, code, CASE WHEN n = 1 THEN any_code ELSE hit_code END AS resolved_code, CASE WHEN n = 1 THEN any_name ELSE hit_name END AS resolved_name
FROM agg WHERE n = 1 OR e = 1""",
)
def unique_lookup(t):
    master = t.supplier.select(
        F.col("s_nationkey").alias("search_key"), F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("code"),
        F.col("s_name").alias("name"), (F.col("s_acctbal") < 1000).alias("deleted"), F.col("s_suppkey").alias("ordinal"),
    )
    keys = t.customer.select(
        F.col("c_nationkey").alias("search_key"), F.concat(F.lit("bk"), (F.col("c_custkey") % 100).cast("string"), F.lit(" ")).alias("code")
    )
    return M.unique_lookup(keys, master)


# --- evidence --------------------------------------------------------------------------------


def trading_pairs(t):
    """Customer and supplier of every order line, once per pair; their texts are in normal form before they are paired."""
    pairs = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("ck"), F.col("l_suppkey").alias("sk")).distinct()
    )
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    left = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ck"), F.replace("c_name", F.lit("Customer"), F.lit("Trader")).alias("name"),
        F.concat(F.col("c_mktsegment"), F.lit(" Ltd")).alias("legal_name"),
        F.array(F.concat(F.lit("T-"), F.col("c_custkey").cast("string")), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("tax_ids"),
        F.col("n_name").alias("city"), F.concat_ws(" ", "r_name", "c_mktsegment", F.lit("road")).alias("street"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("p "), (F.col("c_custkey") % 10).cast("string"))).alias("postal_code"), F.col("r_name").alias("country"),
    )
    right = t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("sk"), F.when(F.col("s_suppkey") % 6 != 0, F.replace("s_name", F.lit("Supplier"), F.lit("Trader"))).alias("found_name"),
        F.lit("Machinery").alias("found_legal_name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
        .otherwise(F.concat(F.lit("T "), F.col("s_suppkey").cast("string"))).alias("found_tax_id"),
        F.col("n_name").alias("found_city"), F.concat_ws(" ", "r_name", F.lit("Building Road")).alias("found_street"),
        F.concat(F.lit("P-"), (F.col("s_suppkey") % 10).cast("string")).alias("found_postal_code"), F.lower("r_name").alias("found_country"),
    )
    return pairs.join(M.left_texts(left), "ck").join(M.right_texts(right), "sk")


_PAIRS = """pairs AS (SELECT DISTINCT o_custkey AS ck, l_suppkey AS sk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
wide AS (SELECT ck, sk, replace(c_name, 'Customer', 'Trader') AS name, concat(c_mktsegment, ' Ltd') AS legal_name, concat('T-', c_custkey, ' · N', c_nationkey) AS tax,
    p.n_name AS city, concat(p.r_name, ' ', c_mktsegment, ' road') AS street, CASE WHEN c_custkey % 5 <> 0 THEN concat('p ', c_custkey % 10) END AS postal, p.r_name AS country,
    CASE WHEN s_suppkey % 6 <> 0 THEN replace(s_name, 'Supplier', 'Trader') END AS fname, 'Machinery' AS flegal,
    CASE WHEN s_suppkey % 3 = 0 THEN concat('n', s_nationkey) ELSE concat('T ', s_suppkey) END AS ftax,
    q.n_name AS fcity, concat(q.r_name, ' Building Road') AS fstreet, concat('P-', s_suppkey % 10) AS fpostal, lower(q.r_name) AS fcountry
  FROM pairs JOIN customer ON ck = c_custkey JOIN place p ON c_nationkey = p.n_nationkey JOIN supplier ON sk = s_suppkey JOIN place q ON s_nationkey = q.n_nationkey)"""


def _ratio_table(name: str, left: str, right: str) -> str:
    a, b = sql.norm_text(left), sql.norm_text(right)
    return (
        f"{name} AS (SELECT x, y, CAST(round_even({sql.similarity('a', 'b')}, 0) AS INT) AS r FROM "
        f"(SELECT DISTINCT {left} AS x, {right} AS y, {a} AS a, {b} AS b FROM wide WHERE {left} IS NOT NULL AND {right} IS NOT NULL))"
    )


def _jaccard(a: str, b: str) -> str:
    x, y = f"string_split({sql.norm_text(a)}, ' ')", f"string_split({sql.norm_text(b)}, ' ')"
    return (
        f"CASE WHEN {sql.norm_text(a)} = {sql.norm_text(b)} THEN 100 ELSE CAST(round_even(len(list_intersect({x}, {y}))::DOUBLE "
        f"/ len(list_distinct(list_concat({x}, {y}))) * 100, 0) AS INT) END"
    )


@query(
    "jn_5_score_pairs",
    f"""WITH {_PAIRS}, {_ratio_table('nn', 'name', 'fname')}, {_ratio_table('nl', 'name', 'flegal')}, {_ratio_table('ll', 'legal_name', 'flegal')},
{_ratio_table('cc', 'city', 'fcity')},
taxes AS (SELECT ck, sk, {sql.norm_text('tax')} AS a, {sql.norm_text('ftax')} AS b, list_transform(list_filter(regexp_split_to_array(tax, '[·,;/\\s]+'), lambda p: trim(p) <> ''),
    lambda p: trim(regexp_replace(regexp_replace(lower(p), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS parts FROM wide),
related AS (SELECT *, list_filter(parts, lambda p: p <> '' AND (contains(b, p) OR contains(p, b)))[1] AS part FROM taxes),
pick AS (SELECT *, coalesce(part, a) AS u FROM related),
tr AS (SELECT u, b, CAST(round_even({sql.similarity('u', 'b')}, 0) AS INT) AS r FROM (SELECT DISTINCT u, b FROM pick)),
ts AS (SELECT ck, sk, CASE WHEN a = p.b OR list_contains(parts, p.b) THEN 100 WHEN part IS NOT NULL THEN greatest(r, 85) ELSE r END AS r
  FROM pick p JOIN tr ON p.u = tr.u AND p.b = tr.b),
raw AS (
  SELECT ck, sk, 'tradingName' AS field, true AS known, greatest(coalesce(nn.r, 0), coalesce(nl.r, 0), coalesce(ll.r, 0)) AS score FROM wide
    LEFT JOIN nn ON name = nn.x AND fname = nn.y LEFT JOIN nl ON name = nl.x AND flegal = nl.y LEFT JOIN ll ON legal_name = ll.x AND flegal = ll.y
  UNION ALL SELECT ck, sk, 'tax', true, ts.r FROM ts
  UNION ALL SELECT ck, sk, 'city', true, greatest(cc.r, {_jaccard('city', 'fcity')}) FROM wide JOIN cc ON city = cc.x AND fcity = cc.y
  UNION ALL SELECT ck, sk, 'street', true, {_jaccard('street', 'fstreet')} FROM wide
  UNION ALL SELECT ck, sk, 'postalCode', postal IS NOT NULL, CASE WHEN {sql.norm_text('postal')} = {sql.norm_text('fpostal')} THEN 100 ELSE 0 END FROM wide
  UNION ALL SELECT ck, sk, 'country', true, CASE WHEN upper(country) = upper(fcountry) THEN 100 ELSE 0 END FROM wide)
SELECT ck, sk, field, CASE WHEN known THEN score ELSE 0 END AS score,
  CASE WHEN NOT known THEN 'unknown' WHEN score >= 85 THEN 'match' WHEN score >= 50 THEN 'partial' ELSE 'mismatch' END AS status,
  CASE WHEN NOT known THEN 'missing left' END AS skip_reason FROM raw""",
)
def score_pairs(t):
    return M.score_pairs(trading_pairs(t), ["ck", "sk"]).drop("ordinal")


def evidence(t):
    return t.v_evidence().withColumnRenamed("state", "status")


_WEIGHTED = f"""weighted AS (SELECT record_id, source_id,
    coalesce(CAST(round_even(sum(score * {sql.weight('field')}) FILTER (state <> 'unknown')::DOUBLE / sum({sql.weight('field')}) FILTER (state <> 'unknown'), 0) AS INT), 0) AS score,
    count(*) FILTER (state <> 'unknown') AS compared, count(*) FILTER (state = 'unknown') AS skipped,
    count(*) FILTER (state <> 'unknown' AND field IN ('tradingName', 'city', 'street', 'postalCode')) AS ident,
    max(score) FILTER (state <> 'unknown' AND field = 'tax') AS tax_score, max(score) FILTER (state <> 'unknown' AND field = 'tradingName') AS name_score
  FROM v_evidence GROUP BY record_id, source_id)"""
_EV = ("v_lines", "v_evidence")


@query("agg_2_overall_weighted", f"WITH {_WEIGHTED} SELECT record_id, source_id, score, compared, skipped FROM weighted", _EV)
def overall_weighted(t):
    return M.overall_weighted(evidence(t), U.SOURCE_KEYS)


@query(
    "agg_3_overall_mean",
    """SELECT record_id, source_id, coalesce(CAST(round_even(avg(score) FILTER (state <> 'unknown'), 0) AS INT), 0) AS score,
  count(*) FILTER (state <> 'unknown') AS compared, count(*) FILTER (state = 'unknown') AS skipped FROM v_evidence GROUP BY record_id, source_id""",
    _EV,
)
def overall_mean(t):
    return M.overall_mean(evidence(t), U.SOURCE_KEYS)


def similarity(t):
    """Outside similarity per vector: whole scores from two cosines over all of its components."""

    def points(cosine):
        return F.least(F.lit(100), F.floor(F.abs(cosine) * 400 + 0.5)).cast("int")

    turned, shifted = views.vector_cosines(F.col("embedding"))
    return t.embeddings.select(
        F.col("vec_id").alias("candidate"), points(turned).alias("name_score"), points(shifted).alias("address_score"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("note"),
    )


def blend_input(t):
    """Evidence of each order line about its part, the candidate being one of the vectors."""
    lines = t.v_lines().select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), "line_key").alias("source_id"), F.col("l_partkey").alias("candidate"), "l_quantity"
    )
    quantity = F.col("l_quantity").cast("int")
    cells = struct_rows(
        "field score status",
        ("tradingName", quantity * 2, F.when(quantity % 7 == 0, "unknown").otherwise("partial")), ("street", quantity, "mismatch"),
        ("country", 100, "match"),
    )
    return lines.select("source_id", "candidate", F.inline(cells))


_BLEND = f"""{views.COSINES_SQL}, sim AS (SELECT vec_id, CAST(least(100, floor(abs(turned) * 400 + 0.5)) AS INT) AS ns,
    CAST(least(100, floor(abs(shifted) * 400 + 0.5)) AS INT) AS ads, concat('label ', label) AS note FROM cosines),
ev AS (SELECT concat(l_orderkey, ':', line_key) AS source_id, l_partkey AS candidate, f.field AS field,
    CASE f.k WHEN 1 THEN CAST(l_quantity AS INT) * 2 WHEN 2 THEN CAST(l_quantity AS INT) ELSE 100 END AS score,
    CASE f.k WHEN 1 THEN CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'unknown' ELSE 'partial' END WHEN 2 THEN 'mismatch' ELSE 'match' END AS status
  FROM v_lines CROSS JOIN (VALUES (1, 'tradingName'), (2, 'street'), (3, 'country')) f(k, field)),
up AS (SELECT e.*, s.note, CASE field WHEN 'tradingName' THEN ns WHEN 'street' THEN ads END AS offer FROM ev e LEFT JOIN sim s ON candidate = vec_id),
blended AS (SELECT source_id, candidate, field, note, coalesce(status <> 'unknown' AND offer > score, false) AS raised,
    CASE WHEN status <> 'unknown' AND offer > score THEN offer ELSE score END AS score,
    CASE WHEN status <> 'unknown' AND offer > score THEN CASE WHEN offer >= 85 THEN 'match' WHEN offer >= 60 THEN 'partial' ELSE 'mismatch' END ELSE status END AS status FROM up)"""


@query("jn_6_blend_semantic", f"WITH {_BLEND} SELECT source_id, field, score, status, raised FROM blended", ("v_lines",))
def blend_semantic(t):
    return M.blend_semantic(blend_input(t), similarity(t), ["source_id"], "candidate")[0].select("source_id", "field", "score", "status", "raised")


@query(
    "jn_6_blend_overall",
    f"""WITH {_BLEND} SELECT source_id, CAST(round_even(avg(score) FILTER (status <> 'unknown'), 0) AS INT) AS overall_score,
  count(*) FILTER (status <> 'unknown') AS compared, count(*) FILTER (raised) AS raised_fields, max(note) AS note FROM blended GROUP BY source_id""",
    ("v_lines",),
)
def blend_overall(t):
    return M.blend_semantic(blend_input(t), similarity(t), ["source_id"], "candidate")[1]


# --- trust -----------------------------------------------------------------------------------


def sources(t):
    """Order lines as sources of their order: four connectors, some with a dissenting verdict."""
    n = F.col("l_linenumber") % 4
    live = (n == 1) & (F.col("l_returnflag") != "R")
    return t.v_lines().select(
        F.col("l_orderkey").alias("record_id"), F.col("line_key").alias("source_id"),
        F.when(n == 0, "bill_to_address").when(n == 1, "in_gstin_live").when(n == 2, "in_gstin").otherwise("commercial_directory").alias("connector_id"),
        F.when(n == 3, "commercial_directory").when(live, "government_registry").otherwise("format_validator").alias("source_type"),
        F.when(live, "live_registry").when(n == 3, "web_enrichment").otherwise("format_check").alias("mode"),
        (1 - F.col("l_discount")).alias("authority"), F.concat(F.when(n == 2, "t").otherwise("T"), (F.col("l_suppkey") % 5).cast("string")).alias("tax_id"),
        F.when(n == 0, F.col("l_quantity").cast("int") * 2).alias("completeness"),
        F.when((n == 3) & (F.round(F.col("l_tax") * 100) == 8), "different").alias("verdict"), F.col("line_key").alias("ordinal"),
    )


_SOURCES = """sources AS (SELECT l_orderkey AS record_id, line_key AS source_id, line_key AS ordinal,
    CASE l_linenumber % 4 WHEN 0 THEN 'bill_to_address' WHEN 1 THEN 'in_gstin_live' WHEN 2 THEN 'in_gstin' ELSE 'commercial_directory' END AS connector_id,
    CASE WHEN l_linenumber % 4 = 3 THEN 'commercial_directory' WHEN l_linenumber % 4 = 1 AND l_returnflag <> 'R' THEN 'government_registry' ELSE 'format_validator' END AS source_type,
    CASE WHEN l_linenumber % 4 = 1 AND l_returnflag <> 'R' THEN 'live_registry' WHEN l_linenumber % 4 = 3 THEN 'web_enrichment' ELSE 'format_check' END AS mode,
    1 - l_discount AS authority, concat(CASE WHEN l_linenumber % 4 = 2 THEN 't' ELSE 'T' END, l_suppkey % 5) AS tax_id,
    CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS INT) * 2 END AS completeness,
    CASE WHEN l_linenumber % 4 = 3 AND round(l_tax * 100) = 8 THEN 'different' END AS verdict FROM v_lines)"""
_SCORED = f"""{_WEIGHTED}, {_SOURCES}, scored AS (SELECT s.*, coalesce(s.completeness, w.score) AS match_score, w.compared, w.ident, w.tax_score, w.name_score,
    CASE WHEN w.compared = 0 THEN 0 WHEN w.ident = 0 THEN CAST(round_even(w.score * 0.55::DOUBLE, 0) AS INT) ELSE w.score END AS corr
  FROM sources s JOIN weighted w USING (record_id, source_id))"""


@query(
    "jn_7_drop_format_hits_with_live",
    f"""WITH {_SOURCES} SELECT record_id, source_id, connector_id FROM sources s WHERE NOT (connector_id IN ('gb_company_number', 'in_gstin')
  AND EXISTS (SELECT 1 FROM sources l WHERE l.record_id = s.record_id AND l.mode = 'live_registry' AND upper(l.tax_id) = upper(s.tax_id)))""",
    ("v_lines",),
)
def drop_format_hits(t):
    return U.drop_format_hits_with_live(sources(t)).select("record_id", "source_id", "connector_id")


_BEST = "row_number() OVER (PARTITION BY record_id ORDER BY match_score * authority DESC, ordinal)"


@query(
    "win_3_best_record",
    f"WITH {_SCORED}, r AS (SELECT *, {_BEST} AS rn FROM scored) SELECT record_id, source_id, match_score, authority FROM r WHERE rn = 1",
    _EV,
)
def best_record(t):
    return U.best_record(U.source_scores(sources(t), evidence(t)))


@query("srt_3_rank_sources", f"WITH {_SCORED} SELECT record_id, source_id, match_score, {_BEST} AS rank FROM scored", _EV)
def rank_sources(t):
    return U.rank_sources(U.source_scores(sources(t), evidence(t))).select("record_id", "source_id", "match_score", "rank")


_COMPOSITE = f"""best AS (SELECT record_id, match_score AS b, tax_score AS btax FROM (SELECT *, {_BEST} AS rn FROM scored WHERE connector_id <> 'bill_to_address') WHERE rn = 1),
addr AS (SELECT record_id, match_score AS a, tax_score AS atax FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ordinal) AS rn FROM scored WHERE connector_id = 'bill_to_address') WHERE rn = 1),
comp AS (SELECT coalesce(best.record_id, addr.record_id) AS record_id, b, a, btax, atax,
    CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN CAST(round_even(b * 0.65::DOUBLE + a * 0.35::DOUBLE, 0) AS INT) ELSE coalesce(b, a) END AS composite
  FROM best FULL JOIN addr ON best.record_id = addr.record_id)"""


@query("jn_15_best_with_address", f"WITH {_SCORED}, {_COMPOSITE} SELECT record_id, b AS best_score, a AS address_score, composite FROM comp", _EV)
def best_with_address(t):
    return U.best_with_address(U.source_scores(sources(t), evidence(t)))


_CORR = """near AS (SELECT record_id, corr, compared, ident = 0 AS isolated, source_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id
    ORDER BY corr DESC, compared DESC, ordinal) AS rn FROM scored WHERE connector_id <> 'bill_to_address') WHERE rn = 1)"""


@query(
    "agg_5_correlation",
    f"""WITH {_SCORED}, {_CORR}, ids AS (SELECT DISTINCT record_id FROM sources),
view AS (SELECT o_orderkey AS record_id, CASE o_orderstatus WHEN 'F' THEN 'same' WHEN 'P' THEN 'different' ELSE 'likely' END AS v,
  CAST(floor(o_totalprice / 5000) AS INT) AS s, CASE WHEN o_orderpriority = '5-LOW' THEN ['city', 'tax'] ELSE ['tax'] END AS f FROM orders WHERE o_custkey % 3 = 0)
SELECT i.record_id, CASE WHEN v = 'different' THEN least(coalesce(corr, 0), 35) ELSE greatest(coalesce(corr, 0), coalesce(s, 0)) END AS correlation_score,
  greatest(coalesce(compared, 0), coalesce(len(f), 0)) AS correlated_fields,
  CASE WHEN v = 'different' THEN true WHEN v IN ('same', 'likely') AND list_contains(f, 'city') THEN false ELSE coalesce(isolated, true) END AS isolated,
  source_id AS best_source_id
FROM ids i LEFT JOIN near n ON i.record_id = n.record_id LEFT JOIN view w ON i.record_id = w.record_id""",
    _EV,
)
def correlation(t):
    status = F.col("o_orderstatus")
    opinions = t.orders.where("o_custkey % 3 = 0").select(
        F.col("o_orderkey").alias("record_id"), F.when(status == "F", "same").when(status == "P", "different").otherwise("likely").alias("verdict"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("city"), F.lit("tax"))).otherwise(F.array(F.lit("tax"))).alias("fields"),
    )
    return U.correlation(U.source_scores(sources(t), evidence(t)), opinions)


_TRUST = f"""{_COMPOSITE}, {_CORR},
flags AS (SELECT record_id, count(*) AS n, bool_or(coalesce(verdict = 'different', false)) AS disputed, bool_or(mode = 'live_registry') AS confirmed,
    arg_min(tax_score, ordinal) AS ftax FROM scored GROUP BY record_id),
live AS (SELECT record_id, name_score AS ln FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ordinal) AS rn FROM scored WHERE connector_id = 'in_gstin_live') WHERE rn = 1),
s1 AS (SELECT f.*, a, ln, coalesce(isolated, true) AS isolated, CASE WHEN b IS NOT NULL THEN btax ELSE atax END AS tx, CASE WHEN a < 70 THEN least(composite, 55) ELSE composite END AS s
  FROM flags f LEFT JOIN comp USING (record_id) LEFT JOIN near USING (record_id) LEFT JOIN live USING (record_id)),
s2 AS (SELECT * REPLACE (CASE WHEN isolated THEN least(s, 60) ELSE s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN n >= 2 AND tx >= 85 THEN least(100, s + 5) ELSE s END AS s) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN ln >= 85 AND a >= 70 THEN least(100, s + 5) ELSE s END AS s) FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN disputed THEN least(s, 30) ELSE s END AS s) FROM s4),
final AS (SELECT * REPLACE (CASE WHEN NOT confirmed THEN least(s, 70) ELSE s END AS s) FROM s5)"""


@query(
    "agg_6_trust_score",
    f"""WITH {_SCORED}, {_TRUST} SELECT record_id, s AS trust_score, CASE WHEN s >= 85 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS trust_band,
  n AS sources, isolated FROM final""",
    _EV,
)
def trust_score(t):
    return U.trust_score(U.source_scores(sources(t), evidence(t)))


_SCOPE = """CASE WHEN bool_and(mode = 'format_check') AND NOT bool_or(source_type IN ('commercial_directory', 'company_website')) THEN 'format_only'
  WHEN bool_and(mode = 'format_check') THEN 'format_and_web' WHEN bool_or(mode = 'live_registry') AND bool_or(mode = 'format_check') THEN 'mixed_live' END"""


@query("agg_22_verification_scope", f"WITH {_SOURCES} SELECT record_id, {_SCOPE} AS scope FROM sources GROUP BY record_id", ("v_lines",))
def verification_scope(t):
    return U.verification_scope(sources(t))


@query(
    "agg_22_first_seen_notes",
    f"WITH {_SOURCES} SELECT record_id, source_type AS note, min(ordinal) AS first_seen FROM sources GROUP BY ALL",
    ("v_lines",),
)
def first_seen_notes(t):
    return U.first_seen_notes(sources(t).withColumnRenamed("source_type", "note"))


@query(
    "set_5_shared_fields",
    """SELECT record_id, source_id, array_to_string(list_sort(list(field) FILTER (state <> 'unknown' AND field IN ('tradingName', 'city', 'street', 'postalCode'))), ',') AS shared,
  true AS overlaps FROM v_evidence GROUP BY ALL""",
    _EV,
)
def shared_fields(t):
    return U.shared_fields(evidence(t), C.IDENTITY_FIELDS)


def playbooks(t):
    """One trust playbook per nation, except every fifth."""
    key = F.col("n_nationkey")
    return t.nation.where(key % 5 != 4).select(
        F.lower("n_name").alias("country"), F.element_at(F.array(F.lit("live"), F.lit("off"), F.lit("registry_only"), F.lit("pilot")), (key % 4 + 1).cast("int")).alias("status"),
        F.array(F.lit("bill_to_address_review"), F.when(key % 2 == 0, "company_registry_lookup").otherwise("in_gstin_format")).alias("connectors"),
        (key % 3 == 0).alias("fallback"),
    )


_GATE = """gated AS (SELECT entity_id AS record_id, country, status, CASE WHEN status IS NULL THEN 'no playbook' WHEN status IN ('off', 'registry_only')
    THEN concat('playbook is ', status) END AS skip_reason FROM v_company LEFT JOIN
  (SELECT n_name, ['live', 'off', 'registry_only', 'pilot'][n_nationkey % 4 + 1] AS status FROM nation WHERE n_nationkey % 5 <> 4) ON country = n_name)"""


@query(
    "flt_5_connector_gate",
    f"WITH {_GATE} SELECT record_id, status AS playbook_status, skip_reason IS NOT NULL AS skipped, skip_reason FROM gated",
    ("v_company",),
)
def connector_gate(t):
    records = t.v_company().select(F.col("entity_id").alias("record_id"), "country")
    return U.connector_gate(records, playbooks(t)).drop("country")


@query(
    "flt_5_planned_connectors",
    """WITH b AS (SELECT lower(n_name) AS country, ['bill_to_address_review', CASE WHEN n_nationkey % 2 = 0 THEN 'company_registry_lookup' ELSE 'in_gstin_format' END] AS c,
    n_nationkey % 3 = 0 AS f FROM nation WHERE n_nationkey % 5 <> 4),
x AS (SELECT country, CASE WHEN NOT f THEN c WHEN c[2] = 'company_registry_lookup' THEN list_concat(c, ['company_website_probe'])
    ELSE list_concat(c, ['company_registry_lookup', 'company_website_probe']) END AS c FROM b)
SELECT country, CAST(generate_subscripts(c, 1) - 1 AS INT) AS ordinal, unnest(c) AS connector_type FROM x""",
)
def planned_connectors(t):
    return U.planned_connectors(playbooks(t))


def addresses(t):
    """Customer addresses in three countries, with gaps and format errors."""
    key = F.col("c_custkey")
    gstin = F.concat(
        F.lit("27AAPFU0939F1Z"), F.when(key % 2 == 0, "V").otherwise("A")
    )
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("record_id"), F.when(key % 7 != 0, F.lit("12 ")).alias("street_number"), F.when(key % 7 != 0, F.col("c_mktsegment")).alias("street_name"),
        F.lit(" ").alias("building_name"), F.when(key % 5 != 0, F.col("n_name")).alias("city"),
        F.when(key % 11 == 0, " ").when(key % 3 == 0, F.lpad((key % 1000000).cast("string"), 6, "0")).otherwise(F.concat(F.lit("ab"), (key % 10).cast("string"), F.lit(" 1yz"))).alias("postal_code"),
        F.when(key % 4 == 0, "in").when(key % 4 == 1, "GB").alias("address_country"),
        F.element_at(F.array(F.lit("IN"), F.lit("GB"), F.lit("DE")), (key % 3 + 1).cast("int")).alias("country"), gstin.alias("tax_id"),
    )


_ADDR = f"""a AS (SELECT c_custkey AS record_id, c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN 1 END AS street, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS city,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') ELSE concat('ab', c_custkey % 10, ' 1yz') END AS postal,
    coalesce(CASE c_custkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'GB' END, ['IN', 'GB', 'DE'][c_custkey % 3 + 1]) AS entered, ['IN', 'GB', 'DE'][c_custkey % 3 + 1] AS country FROM customer),
rows AS (SELECT record_id, 'street' AS field, CASE WHEN street IS NULL THEN 0 ELSE 100 END AS score FROM a
  UNION ALL SELECT record_id, 'city', CASE WHEN city IS NULL THEN 0 ELSE 100 END FROM a
  UNION ALL SELECT record_id, 'postalCode', CASE WHEN postal IS NULL THEN 0 WHEN country = 'IN' THEN CASE WHEN regexp_matches(postal, '^[0-9]{{6}}$') THEN 100 ELSE 40 END
    WHEN country = 'GB' THEN CASE WHEN regexp_matches(upper(postal), '^[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}}$') THEN 100 ELSE 50 END ELSE 100 END FROM a
  UNION ALL SELECT record_id, 'country', CASE WHEN entered = country THEN 100 ELSE 0 END FROM a
  UNION ALL SELECT record_id, 'gstinState', CASE WHEN k % 2 = 0 THEN 100 ELSE -1 END FROM a WHERE country = 'IN')"""


@query(
    "agg_4_address_completeness",
    f"""WITH {_ADDR}, m AS (SELECT record_id, CAST(round_even(avg(score) FILTER (score >= 0), 0) AS INT) AS mean, max(score) FILTER (field = 'street') AS st,
    max(score) FILTER (field = 'city') AS ci FROM rows GROUP BY record_id), l AS (SELECT *, CASE WHEN st = 0 THEN least(mean, 65) ELSE mean END AS completeness FROM m)
SELECT record_id, completeness, concat_ws(',', CASE WHEN st = 0 THEN 'street missing' END, CASE WHEN completeness < 70 THEN 'incomplete' END,
  CASE WHEN st = 0 AND ci = 0 THEN 'no content' END) AS notes FROM l""",
)
def address_completeness(t):
    return U.address_completeness(addresses(t), ["record_id"])


@query(
    "job_2_verify_entities",
    f"""WITH {_SOURCES.replace('sources AS', 'allsources AS')}, book AS (SELECT o_orderkey AS record_id, ['live', 'off', 'registry_only', 'pilot'][n_nationkey % 4 + 1] AS status, n_nationkey % 5 = 4 AS none
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
gated AS (SELECT record_id, CASE WHEN none THEN 'no playbook' WHEN status IN ('off', 'registry_only') THEN concat('playbook is ', status) END AS skip_reason FROM book),
sources AS (SELECT s.* FROM allsources s WHERE s.record_id IN (SELECT record_id FROM gated WHERE skip_reason IS NULL)
  AND NOT (connector_id IN ('gb_company_number', 'in_gstin') AND EXISTS (SELECT 1 FROM allsources l WHERE l.record_id = s.record_id AND l.mode = 'live_registry' AND upper(l.tax_id) = upper(s.tax_id)))),
{_SCORED.replace(_SOURCES + ', ', '')}, {_TRUST}, scopes AS (SELECT record_id, {_SCOPE} AS scope FROM sources GROUP BY record_id)
SELECT g.record_id, skip_reason IS NOT NULL AS skipped, skip_reason, CASE WHEN skip_reason IS NULL THEN coalesce(s, 0) END AS trust_score,
  CASE WHEN skip_reason IS NULL THEN CASE WHEN s IS NULL THEN 'insufficient' WHEN s >= 85 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END END AS trust_band, scope
FROM gated g LEFT JOIN final f ON g.record_id = f.record_id LEFT JOIN scopes c ON g.record_id = c.record_id""",
    _EV,
)
def verify_entities(t):
    records = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("record_id"), F.col("n_name").alias("country"))
    )
    return U.verify_entities(records, playbooks(t), sources(t), evidence(t))


# --- duplicates ------------------------------------------------------------------------------


@query(
    "prj_9_blocking_request",
    """SELECT p_partkey AS record_id, 'request' AS part, concat_ws('|', p_name, p_type, CASE WHEN p_size % 3 = 0 THEN 'City of ' || p_name END) AS content FROM part
UNION ALL SELECT p_partkey, 'tax', concat_ws('|', concat('T', p_size), CASE WHEN p_size % 2 = 0 THEN 'DE' ELSE p_type END, CASE WHEN p_size % 5 = 0 THEN 'TAXNO9' ELSE 'TAXNO2' END) FROM part
UNION ALL SELECT p_partkey, 'tax', concat_ws('|', p_brand, p_type, 'TAXNO3') FROM part""",
)
def blocking_request(t):
    size = F.col("p_size")

    def row(number, country=None, slot=None):
        return F.struct(
            number.alias("number"), (country if country is not None else F.lit(None).cast("string")).alias("country"),
            F.lit(None).cast("string").alias("type_code"), (slot if slot is not None else F.lit(None).cast("string")).alias("slot"),
        )

    records = t.part.select(
        F.col("p_partkey").alias("record_id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.col("p_type").alias("country"),
        F.lit(None).cast("string").alias("street"), F.lit(None).cast("string").alias("postal_code"),
        F.when(size % 3 == 0, F.concat(F.lit(" City of "), "p_name")).otherwise("GEO42").alias("city"),
        F.array(
            row(F.lit(" ")), row(F.concat(F.lit("T"), size.cast("string")), F.when(size % 2 == 0, "DE"), F.when(size % 5 == 0, "TAXNO9")), row(F.col("p_brand"))
        ).alias("tax"),
    )
    request, taxes = M.blocking_request(records, ["record_id"])
    return request.select("record_id", F.lit("request").alias("part"), F.concat_ws("|", "name", "country", "city").alias("content")).unionByName(
        taxes.select("record_id", F.lit("tax").alias("part"), F.concat_ws("|", "number", "country", "slot").alias("content"))
    )


@query(
    "jn_13_duplicate_candidates",
    """WITH n AS (SELECT p_partkey AS id, list_distinct(string_split(replace(lower(concat(p_name, ' ', p_brand)), '#', ' '), ' ')) AS tk, p_type, p_size FROM part),
p AS (SELECT a.id AS record_id, b.id AS candidate_id, len(list_intersect(a.tk, b.tk))::DOUBLE / len(list_distinct(list_concat(a.tk, b.tk))) AS j,
    a.p_type = b.p_type AS c, a.p_size = b.p_size AS z FROM n a JOIN n b ON a.id <> b.id AND len(list_intersect(a.tk, b.tk)) >= 2),
s AS (SELECT *, CAST(round_even(j * 100, 0) AS INT) AS name_score, CAST(round_even((round_even(j * 100, 0) * 30 + CASE WHEN c THEN 500 ELSE 0 END + CASE WHEN z THEN 1000 ELSE 0 END) / 45, 0) AS INT) AS sc
  FROM p WHERE j >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY sc DESC, candidate_id) AS rank FROM s)
SELECT record_id, CAST(rank AS INT) AS rank, candidate_id, name_score, sc / 100 AS score FROM r WHERE rank <= 5""",
)
def duplicate_candidates(t):
    names = t.v_names().select("record_id", "name", F.col("kind").alias("country"), F.col("size").alias("postal_code"))
    return M.duplicate_candidates(names)


@query(
    "jn_13_search_duplicates",
    """WITH r AS (SELECT p_partkey AS id, list_distinct(string_split(replace(lower(concat(p_name, ' ', p_brand)), '#', ' '), ' ')) AS tk, upper(p_type) AS country, CAST(p_size % 7 AS VARCHAR) AS postal,
    CASE WHEN p_size % 4 = 0 THEN '' ELSE 'street ' || p_size END AS street, CASE WHEN p_size % 3 = 0 THEN 'city of ' || lower(p_name) ELSE '' END AS city,
    list_concat(CASE WHEN p_size % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['T' || p_partkey % 997] END, CASE WHEN p_size % 2 = 0 THEN [upper(p_brand)] ELSE CAST([] AS VARCHAR[]) END) AS tax FROM part),
p AS (SELECT a.id AS record_id, b.id AS candidate_id, len(list_intersect(a.tk, b.tk))::DOUBLE / len(list_distinct(list_concat(a.tk, b.tk))) AS j,
    CASE WHEN len(a.tax) > 0 THEN CASE WHEN list_has_any(a.tax, b.tax) THEN 100 ELSE 0 END END AS tax_score, CASE WHEN a.street <> '' THEN CASE WHEN a.street = b.street THEN 100 ELSE 0 END END AS street_score,
    CASE WHEN a.city <> '' THEN CASE WHEN a.city = b.city THEN 100 ELSE 0 END END AS city_score, CASE WHEN a.postal = b.postal THEN 100 ELSE 0 END AS postal_score,
    CASE WHEN a.country = b.country THEN 100 ELSE 0 END AS country_score FROM r a JOIN r b ON a.id <> b.id),
s AS (SELECT *, CASE WHEN j >= 0.5 THEN CAST(round_even(j * 100, 0) AS INT) ELSE 0 END AS name_score FROM p WHERE j >= 0.5 OR tax_score = 100 OR (street_score = 100 AND city_score = 100)),
w AS (SELECT *, CAST(round_even((name_score * 30 + coalesce(tax_score, 0) * 25 + coalesce(street_score, 0) * 15 + coalesce(city_score, 0) * 15 + postal_score * 10 + country_score * 5)
    / (45 + CASE WHEN tax_score IS NULL THEN 0 ELSE 25 END + CASE WHEN street_score IS NULL THEN 0 ELSE 15 END + CASE WHEN city_score IS NULL THEN 0 ELSE 15 END), 0) AS INT) AS sc FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY sc DESC, candidate_id) AS rank FROM w)
SELECT record_id, CAST(rank AS INT) AS rank, candidate_id, name_score, tax_score, street_score, city_score, postal_score, country_score, sc / 100 AS score FROM k WHERE rank <= 5""",
)
def search_duplicates(t):
    """Requests as PRJ-9 builds them: opaque city codes and blank tax numbers go, half of the records share a brand's tax number."""
    size = F.col("p_size")
    row = lambda number: F.struct(number.alias("number"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("type_code"), F.lit(None).cast("string").alias("slot"))
    records = t.part.select(
        F.col("p_partkey").alias("record_id"), F.concat(F.lit("  "), "p_name", F.lit(" "), "p_brand").alias("name"), F.col("p_type").alias("country"), (size % 7).cast("string").alias("postal_code"),
        F.when(size % 4 != 0, F.concat(F.lit("Street "), size.cast("string"))).alias("street"), F.when(size % 3 == 0, F.concat(F.lit("City of "), "p_name")).otherwise("GEO42").alias("city"),
        F.array(row(F.when(size % 5 == 0, " ").otherwise(F.concat(F.lit("T"), (F.col("p_partkey") % 997).cast("string")))), row(F.when(size % 2 == 0, F.col("p_brand")))).alias("tax"),
    )
    return D.search_duplicates(*M.blocking_request(records, ["record_id"]))


@query(
    "srt_1_top_k_per_group",
    """SELECT block, record_id, size, CAST(rank AS INT) AS rank FROM (SELECT block, record_id, size, row_number() OVER (PARTITION BY block ORDER BY size DESC, record_id) AS rank FROM v_names) WHERE rank <= 10""",
    ("v_names",),
)
def top_k(t):
    return M.top_k(t.v_names(), ["block"], [-F.col("size"), F.col("record_id")], 10).select("block", "record_id", "size", "rank")
