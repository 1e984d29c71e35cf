"""Registered queries of the adjudication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions.rows import struct_rows
from entityops.operators import adjudicate as A
from entityops.plans import sql
from entityops.plans.registry import query

CONFLICTS = """conflicts AS (
  SELECT bundle_id, path, min(ordinal) AS ordinal, count(*) AS option_count, min(value) AS low, max(value) AS high
  FROM v_options GROUP BY bundle_id, path HAVING count(*) > 1 AND count(DISTINCT value) > 1)"""
_RANK = """CASE WHEN logical_id = 'legal_name' THEN
        CASE doc_type WHEN 'IN_CERTIFICATE_OF_INCORPORATION' THEN 0 WHEN 'IN_GST_CERTIFICATE' THEN 1 ELSE 40 END
      WHEN logical_id = 'trading_name' THEN
        CASE doc_type WHEN 'IN_GST_CERTIFICATE' THEN 0 WHEN 'IN_CERTIFICATE_OF_INCORPORATION' THEN 2 WHEN 'IN_ADDRESS_PROOF' THEN 3 ELSE 40 END
      WHEN logical_id LIKE 'bill\\_to%' ESCAPE '\\' THEN
        CASE doc_type WHEN 'IN_ADDRESS_PROOF' THEN 0 WHEN 'IN_GST_CERTIFICATE' THEN 1 ELSE 2 END
      ELSE 50 END"""
FRESH = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bundle_id, path
      ORDER BY effective_date DESC, {_RANK}, confidence DESC, ordinal) AS rn,
    count(*) OVER (PARTITION BY bundle_id, path) AS n FROM v_options),
fresh AS (SELECT * FROM ranked WHERE n > 1 AND rn = 1)"""
# checks used by verdict queries: orders whose total ends high block their 'flag' field
_CHECKS_SQL = """checks AS (
  SELECT o_orderkey AS bundle_id, 'identifier_shape_x' AS check_id, 'fail' AS status, 'block' AS severity,
         'flag' AS path, 'trading_name' AS logical_id, 'shape' AS reason, '1' AS ordinal
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey, 'addr_region_vs_gstin', 'warn', 'warn', 'band', 'bill_to_city', 'region', '5'
  FROM orders WHERE o_orderstatus = 'O')"""
CLEARED = """cleared AS (
  SELECT o.* REPLACE (o.pre_selected AND NOT coalesce(b.bad, false) AS pre_selected) FROM v_options o
  LEFT JOIN (SELECT DISTINCT bundle_id, path, logical_id, true AS bad FROM checks WHERE status = 'fail') b
    ON o.bundle_id = b.bundle_id AND (o.path = b.path OR o.logical_id = b.logical_id))"""
VERDICTS = """verdicts AS (
  SELECT c.bundle_id, c.path, c.path AS label, 'steward_required' AS action, f.option_key, '1-' || c.ordinal AS ordinal
  FROM conflicts c JOIN fresh f ON c.bundle_id = f.bundle_id AND c.path = f.path
  UNION ALL
  SELECT k.bundle_id, k.path, k.path, 'reject', NULL, '2-' || k.ordinal FROM checks k
  WHERE k.status = 'fail' AND k.severity = 'block' AND EXISTS (
    SELECT 1 FROM v_options o WHERE o.bundle_id = k.bundle_id AND o.path = k.path)
  UNION ALL
  SELECT bundle_id, path, label, CASE WHEN pre_selected AND needs_resolution IS NULL THEN 'accept' ELSE 'suggest' END,
         option_key, '3-' || ordinal
  FROM cleared o
  WHERE NOT starts_with(path, '_unmapped') AND ((pre_selected AND needs_resolution IS NULL)
        OR (needs_resolution IS NOT NULL AND confidence >= 0.85))
    AND NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.bundle_id = o.bundle_id AND c.path = o.path)
    AND NOT EXISTS (SELECT 1 FROM checks k WHERE k.bundle_id = o.bundle_id AND k.path = o.path
                    AND k.status = 'fail' AND k.severity = 'block'))"""
_ALL = f"WITH {CONFLICTS}, {FRESH}, {_CHECKS_SQL}, {CLEARED}, {VERDICTS}"
_USES = ("v_lines", "v_options")


def order_checks(t):
    rows = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("bundle_id"), "o_orderpriority", "o_orderstatus")

    def part(df, *texts):
        names = [c for c in A.CHECK_COLUMNS if c != "bundle_id"]
        return df.select("bundle_id", *[F.lit(v).alias(n) for n, v in zip(names, texts)])

    return part(
        rows.where("o_orderpriority = '1-URGENT'"), "identifier_shape_x", "fail", "block", "flag", "trading_name", "shape", "1"
    ).unionByName(
        part(rows.where("o_orderstatus = 'O'"), "addr_region_vs_gstin", "warn", "warn", "band", "bill_to_city", "region", "5")
    )


def stages(t):
    """Options after clearing, conflicts, freshness and verdicts, from one path profile."""
    checks = order_checks(t)
    proposed = t.v_options(by_order=True)
    options = A.clear_preselect(proposed, checks)
    profile = A.path_profile(proposed)
    conflicts = A.conflicts_of(profile)
    freshness = A.freshness_of(profile)
    verdicts = A.field_verdicts(options, conflicts, checks)
    return options, checks, profile, conflicts, freshness, verdicts


@query(
    "job_1_lite_conflicts_with_freshness",
    f"""WITH {CONFLICTS}, {FRESH}
SELECT c.bundle_id, c.path, c.option_count, c.low AS lowest_value, c.high AS highest_value,
       f.option_key AS preferred_option_key, f.value AS preferred_value, f.effective_date AS preferred_date,
       'current' AS status
FROM conflicts c JOIN fresh f ON c.bundle_id = f.bundle_id AND c.path = f.path""",
    _USES,
)
def conflicts_with_freshness(t):
    profile = A.path_profile(t.v_options(by_order=True))
    status = F.when(F.col("fresh.effective_date").isNull(), F.lit("unknown_date")).otherwise(F.lit("current"))
    return A.contested(profile).select(
        "bundle_id", "path", "option_count", F.col("low").alias("lowest_value"), F.col("high").alias("highest_value"),
        F.col("fresh.option_key").alias("preferred_option_key"), F.col("fresh.value").alias("preferred_value"),
        F.col("fresh.effective_date").alias("preferred_date"), status.alias("status"),
    )


@query(
    "agg_7_detect_conflicts",
    f"WITH {CONFLICTS} SELECT bundle_id, path, option_count, low AS lowest_value, high AS highest_value, ordinal FROM conflicts",
    _USES,
)
def detect_conflicts(t):
    return A.detect_conflicts(t.v_options(by_order=True)).select("bundle_id", "path", "option_count", "lowest_value", "highest_value", "ordinal")


_NULLABLE = "CASE WHEN value = '0' THEN NULL ELSE value END"


@query(
    "agg_7_detect_conflicts_null_is_a_value",
    f"""SELECT bundle_id, path, count(*) AS option_count, min(v) AS lowest_value, max(v) AS highest_value
FROM (SELECT *, {_NULLABLE} AS v FROM v_options)
GROUP BY bundle_id, path HAVING count(*) > 1 AND count(DISTINCT coalesce(v, 'null')) > 1""",
    _USES,
)
def detect_conflicts_null(t):
    options = t.v_options(by_order=True).withColumn("value", F.nullif("value", F.lit("0")))
    return A.detect_conflicts(options, null_counts=True).select("bundle_id", "path", "option_count", "lowest_value", "highest_value")


@query(
    "agg_7_conflict_members",
    f"WITH {CONFLICTS} SELECT o.bundle_id, o.path, o.option_key, o.value FROM v_options o SEMI JOIN conflicts USING (bundle_id, path)",
    _USES,
)
def conflict_members(t):
    options = t.v_options(by_order=True)
    return A.conflict_options(options, A.detect_conflicts(options)).select("bundle_id", "path", "option_key", "value")


@query(
    "win_1_freshness_rank",
    f"""WITH {FRESH}, again AS (SELECT o_orderkey AS bundle_id FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT bundle_id, path, CASE WHEN bundle_id IN (SELECT bundle_id FROM again) THEN 'superseded' ELSE 'current' END AS status,
  option_key AS preferred_option_key, value AS preferred_value, effective_date AS preferred_date, n - 1 AS superseded_count
FROM fresh""",
    _USES,
)
def freshness_rank(t):
    again = t.dealt("orders", "o_orderkey").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("bundle_id"))
    return A.freshness_rank(t.v_options(by_order=True), again)


@query(
    "set_4_superseded_except",
    f"WITH {FRESH} SELECT bundle_id, path, option_key FROM ranked WHERE n > 1 AND rn > 1",
    _USES,
)
def superseded(t):
    options = t.v_options(by_order=True)
    return A.superseded_options(options, A.freshness_rank(options)).select("bundle_id", "path", "option_key")


_PLACE = """place AS (
  SELECT bundle_id, path, max(CASE WHEN lr = 1 THEN option_key END) AS option_key, max(CASE WHEN lr = 1 THEN value END) AS top,
         max(CASE WHEN lr = 2 THEN value END) AS second
  FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, path ORDER BY length(value) DESC, ordinal) AS lr FROM opts
        WHERE path = 'band') WHERE lr <= 2 GROUP BY bundle_id, path)"""


@query(
    "win_2_conflict_winner",
    f"""WITH opts AS (SELECT * REPLACE (CASE WHEN path = 'band' THEN concat('Street ', repeat(value, CAST(value AS INT) + 1)) ELSE value END AS value)
  FROM v_options),
conflicts AS (SELECT bundle_id, path FROM opts GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT value) > 1),
{_PLACE},
sure AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, path ORDER BY confidence DESC, ordinal) AS cr FROM opts),
joined AS (SELECT s.bundle_id, s.path, s.option_key, s.value, p.option_key AS place_key, p.top,
    p.top <> '' AND p.second <> '' AND (contains({sql.norm_name('top')}, {sql.norm_name('second')})
      OR contains({sql.norm_name('second')}, {sql.norm_name('top')})) AS nested
  FROM conflicts JOIN sure s USING (bundle_id, path) LEFT JOIN place p USING (bundle_id, path) WHERE cr = 1)
SELECT bundle_id, path, CASE WHEN nested THEN place_key ELSE option_key END AS winner_option_key,
  CASE WHEN nested THEN top ELSE value END AS winner_value, CASE WHEN nested THEN 'longer_place' ELSE 'confidence' END AS rule
FROM joined""",
    _USES,
)
def conflict_winner(t):
    options = t.v_options(by_order=True).withColumn(
        "value",
        F.when(
            F.col("path") == "band", F.concat(F.lit("Street "), F.expr("repeat(value, cast(value as int) + 1)"))
        ).otherwise(F.col("value")),
    )
    return A.conflict_winner(options, A.detect_conflicts(options))


@query(
    "agg_13_field_verdicts",
    f"{_ALL} SELECT bundle_id, path, label, action, option_key, ordinal FROM verdicts",
    _USES,
)
def field_verdicts(t):
    return stages(t)[5]


@query(
    "flt_7_auto_apply",
    f"""{_ALL}, pool AS (
  SELECT v.bundle_id, v.option_key, v.ordinal, v.action FROM verdicts v
  JOIN orders ON o_orderkey = v.bundle_id
  WHERE v.action = 'accept' OR (v.action = 'suggest' AND o_totalprice / 500000 >= 0.85)),
live AS (SELECT * FROM pool WHERE option_key NOT IN (SELECT option_key FROM ranked WHERE n > 1 AND rn > 1)),
picked AS (SELECT o.*, l.ordinal AS vo, row_number() OVER (PARTITION BY o.bundle_id, o.path ORDER BY l.ordinal) AS pick
  FROM live l JOIN v_options o ON l.bundle_id = o.bundle_id AND l.option_key = o.option_key
  WHERE NOT starts_with(o.path, '_unmapped'))
SELECT bundle_id, path, label, value, confidence, 'document' AS source, doc_type AS source_label, needs_resolution
FROM picked WHERE pick = 1""",
    _USES,
)
def auto_apply(t):
    options, _, _, _, freshness, verdicts = stages(t)
    alignment = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("bundle_id"), (F.col("o_totalprice") / 500000).alias("alignment_score"))
    applicable = verdicts.where("action IN ('accept', 'suggest')")
    return A.auto_apply(applicable, options, A.superseded_options(applicable, freshness), alignment=alignment)


@query(
    "flt_8_clear_preselect",
    f"WITH {_CHECKS_SQL}, {CLEARED} SELECT bundle_id, option_key, pre_selected FROM cleared",
    _USES,
)
def clear_preselect(t):
    return A.clear_preselect(t.v_options(by_order=True), order_checks(t)).select("bundle_id", "option_key", "pre_selected")


@query(
    "flt_8_clear_identity_preselect",
    """WITH patches AS (SELECT document_id, path, CASE path WHEN 'status' THEN 'TAXNO3' WHEN 'flag' THEN 'TAXNO4' END AS slot,
       confidence >= 0.95 AS pre FROM v_options),
failed AS (SELECT DISTINCT document_id FROM v_options WHERE path = 'band' AND value = '0')
SELECT document_id, path, pre AND NOT (slot IS NOT NULL AND document_id IN (SELECT document_id FROM failed)) AS pre_selected
FROM patches""",
    _USES,
)
def clear_identity(t):
    options = t.v_options()
    patches = options.select(
        "document_id", "path", F.when(F.col("path") == "status", "TAXNO3").when(F.col("path") == "flag", "TAXNO4").alias("tax_type_code"),
        (F.col("confidence") >= 0.95).alias("pre_selected"),
    )
    checks = options.where("path = 'band'").select(
        "document_id", F.lit("pan_shape").alias("check_id"), F.when(F.col("value") == "0", "fail").otherwise("pass").alias("status")
    )
    return A.clear_identity_preselect(patches, checks).select("document_id", "path", "pre_selected")


@query(
    "flt_9_needs_corroboration",
    f"""{_ALL}, docs AS (SELECT l_orderkey AS bundle_id, count(*) AS n FROM lineitem GROUP BY ALL),
addr AS (SELECT o_orderkey AS bundle_id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS n FROM orders)
SELECT coalesce(d.bundle_id, a.bundle_id) AS bundle_id,
  coalesce(d.n, 0) >= 2 OR coalesce(a.n, 0) > 1
  OR coalesce(d.bundle_id, a.bundle_id) IN (SELECT bundle_id FROM conflicts)
  OR coalesce(d.bundle_id, a.bundle_id) IN (SELECT bundle_id FROM verdicts WHERE action = 'steward_required') AS needs_corroboration
FROM docs d FULL JOIN addr a ON d.bundle_id = a.bundle_id""",
    _USES,
)
def needs_corroboration(t):
    _, _, _, conflicts, _, verdicts = stages(t)
    documents = t.dealt("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("bundle_id"))
    orders = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("bundle_id"), "o_orderstatus")
    candidates = orders.select("bundle_id").unionByName(orders.where("o_orderstatus = 'P'").select("bundle_id"))
    return A.needs_corroboration(documents, candidates, conflicts, verdicts)


@query(
    "agg_14_bundle_summary",
    f"""{_ALL}, docs AS (SELECT l_orderkey AS bundle_id, count(*) AS documents FROM lineitem GROUP BY ALL),
cs AS (SELECT bundle_id, count(*) AS conflicts FROM conflicts GROUP BY ALL),
ks AS (SELECT bundle_id, count(*) FILTER (status = 'fail' AND severity = 'block') AS blocking FROM checks GROUP BY ALL),
vs AS (SELECT bundle_id, count(*) FILTER (action = 'accept') AS accepts, count(*) FILTER (action = 'reject') AS rejects,
         count(*) FILTER (action = 'steward_required') AS stewards FROM verdicts GROUP BY ALL),
ids AS (SELECT bundle_id FROM docs UNION SELECT bundle_id FROM ks)
SELECT bundle_id, coalesce(documents, 0) AS documents, coalesce(conflicts, 0) AS conflicts, coalesce(blocking, 0) AS blocking,
  coalesce(accepts, 0) AS accepts, coalesce(rejects, 0) AS rejects, coalesce(stewards, 0) AS stewards,
  concat_ws(' ', concat(coalesce(documents, 0), ' document(s).'),
    CASE WHEN conflicts > 0 THEN concat(conflicts, ' field(s) disagree.') END,
    CASE WHEN blocking > 0 THEN concat(blocking, ' blocking issue(s).') END,
    CASE WHEN coalesce(conflicts, 0) = 0 AND coalesce(blocking, 0) = 0 THEN
      CASE WHEN accepts > 0 THEN concat(accepts, ' field(s) ready to apply.') ELSE 'Review before applying.' END END,
    CASE WHEN stewards > 0 AND conflicts > 0 THEN 'A choice is required.' END,
    CASE WHEN rejects > 0 THEN concat(rejects, ' field(s) cannot be applied.') END) AS summary
FROM ids LEFT JOIN docs USING (bundle_id) LEFT JOIN cs USING (bundle_id) LEFT JOIN ks USING (bundle_id) LEFT JOIN vs USING (bundle_id)""",
    _USES,
)
def bundle_summary(t):
    _, checks, _, conflicts, _, verdicts = stages(t)
    documents = t.dealt("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("bundle_id"))
    return A.bundle_summary(documents, conflicts, checks, verdicts).drop("mismatches", "duplicates")


@query(
    "agg_15_audit_trail",
    f"""{_ALL}, steps AS (
  SELECT bundle_id, 1 AS phase, 'observe' AS kind, option_key AS ref, ordinal FROM cleared
  UNION ALL SELECT bundle_id, 2, 'rule', check_id, ordinal FROM checks WHERE status <> 'skip'
  UNION ALL SELECT bundle_id, 3, 'compare', path, ordinal FROM conflicts
  UNION ALL SELECT bundle_id, 4, 'recommend', coalesce(option_key, path), ordinal FROM verdicts)
SELECT bundle_id, phase, kind, ref, ordinal,
  row_number() OVER (PARTITION BY bundle_id ORDER BY phase, ordinal, ref) AS step FROM steps""",
    _USES,
)
def audit_trail(t):
    options, checks, _, conflicts, _, verdicts = stages(t)
    return A.audit_trail(options, checks, conflicts, verdicts)


_BINDINGS = [
    ("flag", "Flag", "scalar", "flag", 1), ("status", "Status", "scalar", "status", 2),
    ("city", "City", "address", "cityName", 3), ("ifsc", "IFSC", "bank", "ifsc", 4), ("tax4", "Tax", "taxSlot", "TAXNO4", 5),
    ("twin", "Twin", "scalar", "status", 6), ("tax", "Tax note", "unmapped", "tax", 7), ("odd", "Odd", "mystery", "x", 8),
]


def bindings_frame(spark):
    rows = [
        (
            lid, label, kind, arg if kind == "taxSlot" else None, arg if kind == "scalar" else None,
            arg if kind in ("address", "bank") else None, 0, arg if kind == "unmapped" else None, None, o,
        )
        for lid, label, kind, arg, o in _BINDINGS
    ]
    return spark.createDataFrame(
        rows,
        "logical_id string, label string, kind string, tax_type_code string, form_path string, field string, index int, "
        "key string, needs_resolution string, ordinal int",
    )


def extractions_of(t, by_order=False):
    """One extraction per order line, with its proposed values as nested patches."""
    quantity = F.col("l_quantity").cast("int")

    def patch(path, value, label=None, needs=None):
        return F.struct(
            F.lit(path).alias("path"), value.alias("value"), F.lit(label).cast("string").alias("label"),
            (1 - F.col("l_discount")).alias("confidence"), (F.col("l_discount") <= 0.05).alias("pre_selected"),
            F.lit(needs).cast("string").alias("needs_resolution"), F.lit(True).alias("regex_ok"),
        )

    return t.v_lines(by_order).select(
        F.col("l_orderkey").alias("bundle_id"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("line_key")).alias("document_id"),
        F.concat(F.lit("DOC_"), F.col("l_returnflag")).alias("doc_type"),
        F.col("l_shipdate").cast("date").alias("effective_date"), F.col("line_key").alias("ordinal"),
        F.array(
            patch("status", F.col("l_linestatus")), patch("flag", F.col("l_returnflag"), "Return flag"),
            patch("postalAddresses.0.cityName", F.nullif(F.concat(F.lit("City "), (quantity % 7).cast("string")), F.lit("City 0"))),
            patch("vendorBankAccounts.0.ifsc", (quantity % 5 == 0).cast("string")), patch("_unmapped.tax", F.col("l_tax").cast("string")),
            patch("", F.lit("x")), patch("vendor.extra", F.lit("y")),
        ).alias("patches"),
    )


@query(
    "prj_1_flatten_options",
    """WITH patches AS (
  SELECT l_orderkey AS bundle_id, concat(l_orderkey, ':', line_key) AS document_id, concat('DOC_', l_returnflag) AS doc_type,
    p.path, CASE p.k WHEN 0 THEN l_linestatus WHEN 1 THEN l_returnflag
      WHEN 2 THEN nullif(concat('City ', CAST(l_quantity AS INT) % 7), 'City 0')
      WHEN 3 THEN CAST(CAST(l_quantity AS INT) % 5 = 0 AS VARCHAR) WHEN 4 THEN CAST(l_tax AS VARCHAR) ELSE 'y' END AS value,
    p.label, p.logical_id, p.needs, 1 - l_discount AS confidence, l_discount <= 0.05 AS pre, concat(line_key, '-000', p.k) AS ordinal
  FROM v_lines CROSS JOIN (VALUES (0, 'status', 'Status', 'status', NULL), (1, 'flag', 'Return flag', 'flag', NULL),
    (2, 'postalAddresses.0.cityName', 'City', 'city', 'cityCode'), (3, 'vendorBankAccounts.0.ifsc', 'IFSC', 'ifsc', 'bankingInstitutionCode'),
    (4, '_unmapped.tax', 'Tax note', 'tax', NULL), (6, 'vendor.extra', 'extra', NULL, NULL)) p(k, path, label, logical_id, needs))
SELECT bundle_id, document_id, doc_type, path, label, logical_id, value, confidence, needs AS needs_resolution, ordinal,
  concat(CASE WHEN value IS NULL OR value = '' THEN '—' WHEN value = 'true' THEN 'Yes' WHEN value = 'false' THEN 'No' ELSE value END,
    CASE needs WHEN 'cityCode' THEN ' (will resolve to city code)' WHEN 'bankingInstitutionCode' THEN ' (will resolve via bank master)' ELSE '' END) AS display,
  pre AND doc_type <> 'DOC_R' AND NOT starts_with(path, '_unmapped') AND needs IS NULL AS pre_selected
FROM patches""",
    ("v_lines",),
)
def flatten_options(t):
    documents = t.spark.createDataFrame([("DOC_A", True), ("DOC_N", True), ("DOC_R", False)], "doc_type string, writable boolean")
    return A.flatten_options(extractions_of(t), bindings_frame(t.spark), documents).select(
        "bundle_id", "document_id", "doc_type", "path", "label", "logical_id", "value", "confidence", "needs_resolution",
        "ordinal", "display", "pre_selected",
    )


@query(
    "jn_11_path_to_logical",
    """SELECT option_key, path, CASE path WHEN 'status' THEN 'status' WHEN 'flag' THEN 'flag' WHEN '_unmapped.tax' THEN 'tax' END AS logical_id
FROM v_options""",
    _USES,
)
def path_to_logical(t):
    options = t.v_options().select("option_key", "path")
    return A.path_to_logical(options, A.resolve_bindings(bindings_frame(t.spark))).select("option_key", "path", "logical_id")


@query(
    "agg_11_bundle_checks",
    f"""WITH judged AS (
  SELECT *, upper(regexp_replace(value, '\\s+', '', 'g')) AS nv FROM v_idoptions),
valid AS (SELECT *, CASE logical_id WHEN 'pan' THEN regexp_matches(nv, '{C.PAN}')
     WHEN 'gstin' THEN regexp_matches(nv, '{C.GSTIN_SHAPES}') END AS ok FROM judged),
firsts AS (SELECT bundle_id,
    arg_min(nv, ordinal) FILTER (logical_id = 'gstin') AS g, arg_min(nv, ordinal) FILTER (logical_id = 'pan') AS p,
    arg_min(nv, ordinal) FILTER (logical_id = 'bill_to_region') AS r FROM valid GROUP BY bundle_id),
facts AS (SELECT *, regexp_matches(g, '{C.GSTIN_SHAPES}') AS gok, regexp_matches(p, '{C.PAN}') AS pok,
    CASE WHEN regexp_matches(substr(g, 3, 10), '{C.PAN}') THEN substr(g, 3, 10) END AS ep,
    {sql.case_of("substr(g, 1, 2)", C.STATE_REGION)} AS dr FROM firsts)
SELECT bundle_id, 'identifier_shape_' || logical_id AS check_id, 'fail' AS status, 'block' AS severity, path, logical_id, 'shape' AS reason
FROM valid WHERE logical_id IN ('pan', 'gstin') AND NOT ok
UNION ALL
SELECT bundle_id, 'id_' || logical_id || '_singleton', 'fail', 'block', min(path), logical_id, 'several values'
FROM valid WHERE ok GROUP BY bundle_id, logical_id HAVING count(DISTINCT nv) > 1
UNION ALL
SELECT bundle_id, 'cross_gstin_embeds_pan', CASE WHEN ep <> p THEN 'fail' ELSE 'pass' END, CASE WHEN ep <> p THEN 'block' ELSE 'info' END,
  'form.gstin', 'gstin', 'embedded identifier' FROM facts WHERE gok AND pok
UNION ALL
SELECT bundle_id, 'addr_region_vs_gstin', 'warn', 'warn', 'form.gstin', 'gstin', 'region differs' FROM facts
WHERE gok AND r <> '' AND dr <> r
UNION ALL
SELECT bundle_id, 'entity_person_with_gst', 'warn', 'warn', 'form.pan', 'pan', 'natural person' FROM facts
WHERE g IS NOT NULL AND pok AND substr(p, 4, 1) = 'P'""",
    ("v_lines", "v_idoptions"),
)
def bundle_checks(t):
    return A.bundle_checks(t.v_idoptions(by_order=True), {"pan": "pan", "gstin": "gstin"}).drop("ordinal")


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


@query(
    "agg_12_min_pairwise_similarity",
    f"""WITH vals AS (SELECT DISTINCT p_brand || p_type AS bundle_id, p_name AS v, {_SORTED.format('p_name')} AS s FROM part),
pairs AS (SELECT a.bundle_id, a.s AS x, b.s AS y FROM vals a JOIN vals b ON a.bundle_id = b.bundle_id AND a.v < b.v)
SELECT bundle_id, 'trading_name' AS logical_id, round(min({sql.similarity('x', 'y')} / 100.0::DOUBLE), 9) AS min_ratio,
  CASE WHEN min({sql.similarity('x', 'y')} / 100.0::DOUBLE) < 0.82::DOUBLE THEN 'warn' ELSE 'pass' END AS status FROM pairs GROUP BY bundle_id""",
)
def min_pairwise(t):
    options = t.part.select(
        F.concat("p_brand", "p_type").alias("bundle_id"), F.lit("trading_name").alias("logical_id"), F.col("p_name").alias("value")
    )
    return A.min_pairwise_similarity(options, {"trading_name": 0.82, "bill_to_street": 0.75}).select(
        "bundle_id", "logical_id", F.round("min_ratio", 9).alias("min_ratio"), "status"
    )


@query(
    "jn_9_overlap_existing",
    """WITH newdocs AS (SELECT DISTINCT l_orderkey AS bundle_id, concat('DOC_', l_returnflag) AS doc_type FROM lineitem),
stored AS (SELECT o_orderkey AS bundle_id, CASE o_orderstatus WHEN 'F' THEN 'DOC_R' WHEN 'O' THEN 'DOC_N' ELSE ' ' END AS doc_type FROM orders)
SELECT s.bundle_id, 'duplicate_doc_type_' || s.doc_type AS name, 'warn' AS kind FROM stored s SEMI JOIN newdocs n
  ON s.bundle_id = n.bundle_id AND s.doc_type = n.doc_type WHERE trim(s.doc_type) <> ''
UNION ALL SELECT bundle_id, replace(doc_type, '_', ' '), 'observe' FROM stored WHERE trim(doc_type) <> ''""",
)
def overlap_existing(t):
    new = t.dealt("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("bundle_id"), F.concat(F.lit("DOC_"), "l_returnflag").alias("doc_type"))
    stored = t.dealt("orders", "o_orderkey").select(
        F.col("o_orderkey").alias("bundle_id"),
        F.when(F.col("o_orderstatus") == "F", "DOC_R").when(F.col("o_orderstatus") == "O", "DOC_N").otherwise(" ").alias("doc_type"),
        F.col("o_orderdate").alias("ordinal"),
    )
    warned, observed = A.overlap_existing(new, stored)
    return warned.select("bundle_id", F.col("check_id").alias("name"), F.lit("warn").alias("kind")).unionByName(
        observed.select("bundle_id", F.col("message").alias("name"), F.lit("observe").alias("kind"))
    )


@query(
    "jn_8_merge_cached",
    """WITH live AS (SELECT l_orderkey AS bundle_id, concat(l_orderkey, ':', line_key) AS document_id, concat('DOC_', l_returnflag) AS doc_type, line_key
  FROM v_lines WHERE l_linestatus = 'O'),
cached AS (SELECT l_orderkey AS bundle_id, concat('DOC_', l_returnflag) AS doc_type, concat('f', l_linenumber, '.pdf') AS filename, line_key,
    l_returnflag, l_tax FROM v_lines WHERE l_linestatus = 'F'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, doc_type ORDER BY line_key) AS rn FROM cached c
  WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.bundle_id = c.bundle_id AND l.doc_type = c.doc_type))
SELECT bundle_id, document_id, doc_type, false AS from_cache, 7 AS patch_count, NULL AS flag_value FROM live
UNION ALL SELECT bundle_id, concat('cached:', doc_type, ':', filename), doc_type, true, 1, l_returnflag FROM fresh WHERE rn = 1""",
    ("v_lines",),
)
def merge_cached(t):
    live = extractions_of(t).where(F.col("patches")[0]["value"] == "O")
    cached = t.v_lines().where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("bundle_id"), F.concat(F.lit("DOC_"), "l_returnflag").alias("doc_type"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("l_shipdate").cast("date").alias("effective_date"), F.col("line_key").alias("ordinal"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("_unmapped.tax"), F.col("l_tax").cast("string")).alias("summary"),
    )
    merged = A.merge_cached(live, cached)
    return merged.select(
        "bundle_id", "document_id", "doc_type", "from_cache", F.size("patches").alias("patch_count"),
        F.when(F.col("from_cache"), F.col("patches")[0]["value"]).alias("flag_value"),
    )


@query(
    "jn_10_compare_to_master",
    f"""WITH opts AS (SELECT bundle_id, 'taxIdentification.status' AS path, value, ordinal FROM v_options WHERE path = 'status'
  UNION ALL SELECT bundle_id, 'name', concat('order ', value, ' priority'), ordinal FROM v_options WHERE path = 'flag'
  UNION ALL SELECT bundle_id, 'natural', CASE WHEN value = '0' THEN 'false' ELSE 'true' END, ordinal FROM v_options WHERE path = 'band'),
first AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, path ORDER BY ordinal) AS rn FROM opts),
master AS (SELECT o_orderkey AS bundle_id, 'taxIdentification.status' AS path, lower(o_orderstatus) AS current FROM orders
  UNION ALL SELECT o_orderkey, 'name', concat('priority ', CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE o_orderstatus END, ' order') FROM orders
  UNION ALL SELECT o_orderkey, 'natural', CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END FROM orders),
joined AS (SELECT f.bundle_id, f.path, f.value, m.current, {_SORTED.format('f.value')} AS x, {_SORTED.format('m.current')} AS y
  FROM first f JOIN master m ON f.bundle_id = m.bundle_id AND f.path = m.path WHERE rn = 1 AND trim(m.current) <> '')
SELECT bundle_id, path, concat(current, ' / ', value) AS reason FROM joined
WHERE NOT CASE path WHEN 'natural' THEN value = current WHEN 'name' THEN {sql.similarity('x', 'y')} / 100.0::DOUBLE >= 0.92::DOUBLE
  ELSE upper(value) = upper(current) END""",
    _USES,
)
def compare_to_master(t):
    options = t.v_options(by_order=True)
    path, value = F.col("path"), F.col("value")
    mapped = options.where(path.isin("status", "flag", "band")).withColumns(
        {
            "value": F.when(path == "flag", F.concat(F.lit("order "), value, F.lit(" priority")))
            .when(path == "band", F.when(value == "0", "false").otherwise("true")).otherwise(value),
            "path": F.when(path == "status", "taxIdentification.status").when(path == "flag", "name").otherwise("natural"),
        }
    )
    status = F.col("o_orderstatus")
    cells = struct_rows(
        "path value value_type",
        ("taxIdentification.status", F.lower(status), "string"),
        ("name", F.concat(F.lit("priority "), F.when(status == "O", "N").otherwise(status), F.lit(" order")), "string"),
        ("natural", F.when(status == "P", "").when(status == "O", "true").otherwise("false"), "boolean"),
    )
    master = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("bundle_id"), F.inline(cells))
    return A.compare_to_master(mapped, master).select("bundle_id", "path", "reason")


def address_candidates(t):
    """Suppliers of an order's lines propose addresses for the order."""
    lines = t.v_lines().select(F.col("l_orderkey").alias("bundle_id"), "l_suppkey", "line_key", "l_discount", "l_linenumber")
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    six = F.lpad((key * 37 % 1000000).cast("string"), 6, "0")
    return lines.join(place, F.col("l_suppkey") == key).select(
        "bundle_id", F.concat_ws(":", F.col("bundle_id").cast("string"), "line_key").alias("candidate_key"),
        F.element_at(F.array(*[F.lit(r) for r in C.ROLE_BONUS]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("address_role"),
        F.concat_ws(", ", F.col("n_name"), F.col("r_name"), six).alias("full_text"), (1 - F.col("l_discount")).alias("confidence"),
        F.col("line_key").alias("ordinal"), F.when(key % 4 != 0, six).alias("postalCode"), F.col("n_name").alias("cityName"),
        F.col("r_name").alias("district"), F.concat(F.lit("Dock "), (key % 9).cast("string")).alias("streetName"),
        F.lit(None).cast("string").alias("buildingName"),
    )


def stored_addresses(t):
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    blank = F.col("o_orderstatus") == "P"
    key = F.col("o_custkey")

    def unless(col):
        return F.when(~blank, col)

    return t.orders.join(place, key == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("bundle_id"), unless(F.lpad((key * 37 % 1000000).cast("string"), 6, "0")).alias("postalCode"),
        unless(F.col("n_name")).alias("cityName"), unless(F.col("r_name")).alias("district"),
        unless(F.concat(F.lit("dock-"), (key % 9).cast("string"))).alias("streetName"),
        unless(F.when(key % 2 == 0, "Hall")).alias("buildingName"),
    )


_PIN_DIFF = " + ".join(f"CASE WHEN substr(mp, {i}, 1) <> substr({{0}}, {i}, 1) THEN 1 ELSE 0 END" for i in range(1, 7))
_ROLES = ", ".join(sql.quote(r) for r in C.ROLE_BONUS)
_SCORED = f"""WITH cand AS (SELECT l_orderkey AS bundle_id, concat(l_orderkey, ':', line_key) AS candidate_key, line_key AS ordinal,
    [{_ROLES}][l_linenumber % 5 + 1] AS address_role, 1 - l_discount AS confidence, lpad(CAST(s_suppkey * 37 % 1000000 AS VARCHAR), 6, '0') AS six,
    CASE WHEN s_suppkey % 4 <> 0 THEN lpad(CAST(s_suppkey * 37 % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS cp, n_name AS cc, r_name AS cd,
    'Dock ' || (s_suppkey % 9) AS cs, concat_ws(', ', n_name, r_name, lpad(CAST(s_suppkey * 37 % 1000000 AS VARCHAR), 6, '0')) AS full_text
  FROM v_lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mast AS (SELECT o_orderkey AS bundle_id, o_orderstatus = 'P' AS empty, lpad(CAST(o_custkey * 37 % 1000000 AS VARCHAR), 6, '0') AS mp,
    n_name AS mc, r_name AS md, 'dock-' || (o_custkey % 9) AS ms, CASE WHEN o_custkey % 2 = 0 THEN 'Hall' ELSE '' END AS mb
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT c.*, m.* EXCLUDE (bundle_id), coalesce(m.empty, true) AS blank FROM cand c LEFT JOIN mast m ON c.bundle_id = m.bundle_id),
h AS (SELECT *, CASE WHEN (cp <> '' AND ({_PIN_DIFF.format('cp')}) <= 1) OR ({_PIN_DIFF.format('six')}) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ph,
    contains(lower(full_text), lower(mc)) AS ch, contains(lower(full_text), lower(md)) AS dh,
    regexp_replace(lower(ms), '[^a-z0-9]', '', 'g') AS na, regexp_replace(lower(cs), '[^a-z0-9]', '', 'g') AS nb,
    {sql.similarity('mc', 'cc')} / 100.0::DOUBLE / 100.0::DOUBLE AS cr, {sql.similarity('xd', 'yd')} / 100.0::DOUBLE / 100.0::DOUBLE AS dr
  FROM (SELECT *, {_SORTED.format('md')} AS xd, {_SORTED.format('cd')} AS yd FROM j WHERE NOT blank)),
w AS (SELECT *, CASE WHEN na = nb THEN 1.0::DOUBLE WHEN contains(na, nb) OR contains(nb, na) THEN 0.92::DOUBLE
    ELSE {sql.similarity('xs', 'ys')} / 100.0::DOUBLE / 100.0::DOUBLE END AS sr
    FROM (SELECT *, {_SORTED.format('ms')} AS xs, {_SORTED.format('cs')} AS ys FROM h)),
scored AS (SELECT bundle_id, candidate_key, ordinal, address_role,
    round_even((0.25::DOUBLE * ph + 0.2::DOUBLE * CASE WHEN ch THEN 1 ELSE cr END + 0.15::DOUBLE * CASE WHEN dh THEN 1 ELSE dr END + 0.2::DOUBLE * sr)
      / (0.25::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE + 0.2::DOUBLE + CASE WHEN mb <> '' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 3) AS alignment_score,
    concat_ws(',', CASE WHEN ph = 1 THEN 'postalCode' END, CASE WHEN ch THEN 'cityName' END, CASE WHEN dh THEN 'district' END,
      CASE WHEN sr >= 0.9 THEN 'streetName' END) AS matched_fields,
    concat_ws(',', CASE WHEN ph = 0 THEN 'postalCode' END, CASE WHEN NOT ch THEN 'cityName' END, CASE WHEN NOT dh THEN 'district' END,
      CASE WHEN sr < 0.9 THEN 'streetName' END, CASE WHEN mb <> '' THEN 'buildingName' END) AS gaps FROM w
  UNION ALL SELECT bundle_id, candidate_key, ordinal, address_role,
    round_even(least(1.0::DOUBLE, 0.5::DOUBLE + CASE address_role WHEN 'operational' THEN 0.15::DOUBLE WHEN 'additional_pob' THEN 0.1::DOUBLE
      WHEN 'principal_pob' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + confidence * 0.35::DOUBLE), 3), '',
    concat_ws(',', CASE WHEN cp <> '' THEN 'postalCode' END, 'cityName', 'district', 'streetName') FROM j WHERE blank)"""


@query(
    "agg_21_score_address_candidates",
    f"{_SCORED} SELECT bundle_id, candidate_key, address_role, alignment_score, matched_fields, gaps FROM scored",
    ("v_lines",),
)
def score_addresses(t):
    return A.score_address_candidates(address_candidates(t), stored_addresses(t)).drop("ordinal")


@query(
    "win_4_rank_candidates",
    f"""{_SCORED} SELECT bundle_id, candidate_key, alignment_score,
  row_number() OVER (PARTITION BY bundle_id ORDER BY alignment_score DESC, ordinal) = 1 AS recommended,
  max(alignment_score) OVER (PARTITION BY bundle_id) AS bundle_alignment FROM scored""",
    ("v_lines",),
)
def rank_candidates(t):
    scored = A.score_address_candidates(address_candidates(t), stored_addresses(t))
    return A.rank_candidates(scored).select("bundle_id", "candidate_key", "alignment_score", "recommended", "bundle_alignment")


_ID_PATHS = "SELECT * REPLACE (concat('form.', logical_id, CASE WHEN logical_id = 'pan' AND starts_with(ordinal, '02') THEN '.second' ELSE '' END) AS path) FROM v_idoptions"
_ID_TARGETS = f"""opts AS ({_ID_PATHS}),
valid AS (SELECT *, upper(regexp_replace(value, '\\s+', '', 'g')) AS nv,
    regexp_matches(upper(regexp_replace(value, '\\s+', '', 'g')), CASE logical_id WHEN 'pan' THEN '{C.PAN}' ELSE '{C.GSTIN_SHAPES}' END) AS ok
  FROM opts WHERE logical_id IN ('pan', 'gstin')),
firsts AS (SELECT bundle_id, arg_min(nv, ordinal) FILTER (logical_id = 'gstin') AS g, arg_min(ok, ordinal) FILTER (logical_id = 'gstin') AS gok,
    arg_min(path, ordinal) FILTER (logical_id = 'gstin') AS gpath, arg_min(nv, ordinal) FILTER (logical_id = 'pan') AS p,
    arg_min(ok, ordinal) FILTER (logical_id = 'pan') AS pok, arg_min(path, ordinal) FILTER (logical_id = 'pan') AS ppath FROM valid GROUP BY 1),
crossed AS (SELECT * FROM firsts WHERE gok AND pok AND regexp_matches(substr(g, 3, 10), '{C.PAN}') AND substr(g, 3, 10) <> p),
several AS (SELECT bundle_id, logical_id FROM valid WHERE ok GROUP BY ALL HAVING count(DISTINCT nv) > 1),
targets AS (
  SELECT bundle_id, concat('identifier_shape_', logical_id) AS check_id, path, logical_id, true AS leads FROM valid WHERE NOT ok
  UNION SELECT bundle_id, concat('id_', logical_id, '_singleton'), path, logical_id, row_number() OVER (PARTITION BY bundle_id, logical_id ORDER BY ordinal) = 1
    FROM valid SEMI JOIN several USING (bundle_id, logical_id)
  UNION SELECT bundle_id, 'cross_gstin_embeds_pan', gpath, 'gstin', true FROM crossed
  UNION SELECT bundle_id, 'cross_gstin_embeds_pan', ppath, 'pan', false FROM crossed)"""


def identifier_options(t):
    """Identifier proposals in the options shape; the second line of an order has its own path."""
    second = (F.col("logical_id") == "pan") & F.col("ordinal").startswith("02")
    return t.v_idoptions(by_order=True).withColumns(
        {
            "path": F.concat(F.lit("form."), "logical_id", F.when(second, ".second").otherwise("")),
            "label": F.col("logical_id"),
            "pre_selected": F.lit(True),
            "needs_resolution": F.lit(None).cast("string"),
            "option_key": F.col("ordinal"),
        }
    )


def identifier_checks(options):
    return A.bundle_checks(options, {"pan": "pan", "gstin": "gstin"})


@query(
    "agg_11_check_targets",
    f"WITH {_ID_TARGETS} SELECT DISTINCT bundle_id, check_id, path, logical_id FROM targets",
    ("v_lines", "v_idoptions"),
)
def check_targets(t):
    """Every path and field of a failed check."""
    options = identifier_options(t)
    failed = A.check_targets(options, identifier_checks(options)).where("status = 'fail'")
    return failed.select("bundle_id", "check_id", "path", "logical_id").distinct()


@query(
    "flt_8_clear_all_targets",
    f"""WITH {_ID_TARGETS} SELECT bundle_id, ordinal AS option_key, NOT EXISTS (SELECT 1 FROM targets k
  WHERE k.bundle_id = o.bundle_id AND ((k.leads AND k.path = o.path) OR k.logical_id = o.logical_id)) AS pre_selected FROM opts o""",
    ("v_lines", "v_idoptions"),
)
def clear_all_targets(t):
    """A mismatch of two identifiers clears the options of both."""
    options = identifier_options(t)
    return A.clear_preselect(options, identifier_checks(options)).select("bundle_id", "option_key", "pre_selected")


@query(
    "agg_13_reject_all_targets",
    f"WITH {_ID_TARGETS} SELECT DISTINCT bundle_id, path, logical_id AS label FROM targets",
    ("v_lines", "v_idoptions"),
)
def reject_all_targets(t):
    """A mismatch of two identifiers rejects the paths of both."""
    options = identifier_options(t)
    checks = identifier_checks(options)
    profile = A.path_profile(options.withColumns({"display": F.col("value"), "doc_type": F.lit("DOC"), "effective_date": F.lit(None).cast("date"), "document_id": F.col("ordinal"), "regex_ok": F.lit(True)}))
    verdicts = A.field_verdicts(options, A.conflicts_of(profile), checks)
    return verdicts.where("action = 'reject'").select("bundle_id", "path", "label").distinct()
