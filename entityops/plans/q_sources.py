"""Registered queries of the sources, sinks and keyed tables, and of the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.plans import jobs
from entityops.plans.q_adjudicate import address_candidates, bindings_frame, extractions_of, stored_addresses
from entityops.plans.registry import query
from entityops.sources import configs, feedback, keyed, registry, uploads


@query(
    "src_2_playbook_tables",
    """SELECT 'binding' AS part, concat('S', s_suppkey) AS country, 0 AS ordinal, concat(s_name, '/scalar') AS item FROM supplier
UNION ALL SELECT 'binding', concat('S', s_suppkey), 1, 'tax/taxSlot' FROM supplier
UNION ALL SELECT 'document', concat('S', s_suppkey), 0, concat('DOC/', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END) FROM supplier
UNION ALL SELECT 'connector', concat('S', s_suppkey), 0, 'c1/in_pan_format' FROM supplier WHERE s_suppkey % 3 = 0""",
)
def playbook_tables(t):
    none = F.lit(None).cast("string")

    def bind(logical, kind, form_path=none, slot=none):
        inner = F.struct(
            F.lit(kind).alias("kind"), slot.alias("taxTypeCode"), form_path.alias("formPath"), none.alias("field"), F.lit(None).cast("int").alias("index"), none.alias("key"), none.alias("role"),
        )
        return F.struct(
            logical.alias("logicalFieldId"), F.lit("L").alias("label"), none.alias("validator"), F.lit(None).cast("boolean").alias("singleton"), none.alias("needsResolution"), inner.alias("bind")
        )

    key = F.col("s_suppkey")
    books = t.supplier.select(
        F.concat(F.lit("s"), key.cast("string")).alias("countryCode"),
        F.array(bind(F.col("s_name"), "scalar", F.lit("a.b")), bind(F.lit("tax"), "taxSlot", slot=F.lit("TAXNO2"))).alias("bindings"),
        F.array(F.struct(F.lit("DOC").alias("docType"), F.when(key % 2 != 0, False).alias("writable"), F.array(F.lit("x")).alias("attributes"))).alias("documents"),
        F.when(key % 3 == 0, F.array(F.struct(F.lit("c1").alias("id"), F.lit("in_pan_format").alias("type")))).alias("connectors"),
    )
    bindings, documents, connectors = configs.playbook_tables(books)

    def part(df, name, *cols):
        return df.select(F.lit(name).alias("part"), "country", "ordinal", F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("item"))

    return part(bindings, "binding", "logical_id", "kind").unionByName(part(documents, "document", "doc_type", "writable")).unionByName(
        part(connectors, "connector", "id", "type")
    )


@query(
    "src_3_resolve_overlay",
    """WITH base AS (SELECT c_custkey AS country, c_name AS setting FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer),
overlay AS (SELECT o_custkey AS country, concat('order ', o_orderkey) AS setting FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM overlay UNION ALL SELECT * FROM base WHERE country NOT IN (SELECT country FROM overlay)""",
)
def resolve_overlay(t):
    base = t.customer.select(F.col("c_custkey").alias("country"), F.explode(F.array("c_name", "c_mktsegment")).alias("setting"))
    overlay = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("country"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("setting"))
    return configs.resolve_overlay(base, overlay, "country")


@query(
    "src_4_feedback_rows",
    """WITH f AS (SELECT ordinal, country, rating, sha256(concat(ordinal, chr(1), country)) AS h FROM v_feedback)
SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS "feedbackId", '2024-02-01T00:00:00+00:00' AS "createdAt", ordinal, rating FROM f""",
    ("v_feedback",),
)
def feedback_rows(t):
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return feedback.feedback_rows(t.v_feedback(), ["ordinal", "country"], stamp).select("feedbackId", "createdAt", "ordinal", "rating")


@query(
    "src_6_upload_scan",
    """WITH u AS (SELECT doc_id, doc_id % 6 AS k, octet_length(encode(text)) AS n FROM documents),
s AS (SELECT doc_id, k, CASE k WHEN 0 THEN 0 WHEN 1 THEN n + 5 WHEN 2 THEN n + 3 WHEN 3 THEN n + 8 WHEN 4 THEN n + 4 ELSE n END AS size FROM u)
SELECT doc_id, CASE WHEN size = 0 THEN 400 WHEN size > 4000 THEN 413 WHEN k IN (3, 5) THEN 415 ELSE 200 END AS status,
  CASE WHEN size > 0 AND size <= 4000 THEN CASE k WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END END AS mime FROM s""",
)
def upload_scan(t):
    key, body = F.col("doc_id") % 6, F.col("text").cast("binary")
    heads = {1: "255044462D", 2: "FFD8FF", 3: "89504E470D0A1A0A", 4: "504B0304"}
    content = F.when(key == 0, F.lit(b"").cast("binary"))
    for k, head in heads.items():
        content = content.when(key == k, F.concat(F.unhex(F.lit(head)), body))
    files = t.documents.select("doc_id", content.otherwise(body).alias("content"))
    allowed = [m for _, m in C.SIGNATURES if m != "image/png"]
    verdict = uploads.upload_verdict(F.col("content"), F.octet_length("content"), 4000, allowed)
    return files.select("doc_id", verdict.alias("v")).select("doc_id", "v.status", "v.mime")


@query(
    "src_7_exact_duplicates",
    """SELECT doc_id, source, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY source, text) AS first_id, min(doc_id) OVER (PARTITION BY source, text) <> doc_id AS is_duplicate FROM documents""",
)
def exact_duplicates(t):
    return keyed.exact_duplicates(t.documents, "doc_id", "text", ["source"])


@query(
    "src_8_reference_snapshot",
    "SELECT n_name AS city_name, n_nationkey AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def reference_snapshot(t):
    table = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("country"), F.col("n_name").alias("city_name"), F.col("n_nationkey").alias("ordinal")
    )
    return configs.reference_snapshot(table, " asia").select("city_name", "ordinal")


@query(
    "src_9_update_by_key",
    """WITH up AS (SELECT l_orderkey, arg_max(concat('cache ', l_partkey), line_key) AS v FROM v_lines WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(v, o_orderpriority) AS o_orderpriority, CASE WHEN v IS NOT NULL THEN 'extracted' ELSE o_orderstatus END AS o_orderstatus
FROM orders LEFT JOIN up ON o_orderkey = l_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)""",
    ("v_lines",),
)
def update_by_key(t):
    updates = t.v_lines().where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("cache "), F.col("l_partkey").cast("string")).alias("o_orderpriority"), F.col("line_key").alias("ordinal")
    )
    deletes = t.lineitem.where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    table = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return keyed.update_by_key(table, updates, "o_orderkey", "o_orderpriority", "o_orderstatus", deletes=deletes)


@query("src_9_list_by_scope", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey")
def list_by_scope(t):
    return keyed.list_by_scope(t.orders, "o_orderpriority", "1-URGENT", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


def _table(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.upper("p_brand").alias("country"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("doc"), F.col("p_size").alias("sort_order"))


def _changes(t):
    key = F.col("p_partkey")
    op = F.when(key % 4 == 0, "update").when(key % 4 == 1, "delete").otherwise("insert")
    own = F.concat(F.lower("p_name"), F.lit(" "), key.cast("string"), F.lit(" "))
    other = F.concat(F.col("p_name"), F.lit(" "), (key + 1).cast("string"))
    first = t.part.select(
        op.alias("op"), F.when(op == "insert", key + 1_000_000_000).when(key % 8 == 1, key + 2_000_000_000).otherwise(key).alias("id"), F.lower("p_brand").alias("country"),
        F.when(key % 3 == 0, own).when(key % 3 == 1, F.concat(F.lit("new "), F.col("p_type"))).otherwise(other).alias("doc"), F.lit(1).alias("sort_order"), key.alias("ordinal"),
    )
    again = first.where("op = 'update' AND id % 5 = 0").withColumn("ordinal", F.col("ordinal") + 10_000_000_000)
    return first.unionByName(again)


_CHANGES = """tab AS (SELECT p_partkey AS id, upper(p_brand) AS country, concat(upper(p_name), ' ', p_partkey) AS doc, p_size AS sort_order FROM part),
ops AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'update' WHEN p_partkey % 4 = 1 THEN 'delete' ELSE 'insert' END AS op, * FROM part),
ch1 AS (SELECT op, CASE WHEN op = 'insert' THEN p_partkey + 1000000000 WHEN p_partkey % 8 = 1 THEN p_partkey + 2000000000 ELSE p_partkey END AS id, upper(p_brand) AS country,
  upper(CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' ', p_partkey) WHEN 1 THEN concat('new ', p_type) ELSE concat(p_name, ' ', p_partkey + 1) END) AS doc, 1 AS sort_order, p_partkey AS ordinal FROM ops),
ch AS (SELECT * FROM ch1 UNION ALL SELECT op, id, country, doc, sort_order, ordinal + 10000000000 FROM ch1 WHERE op = 'update' AND id % 5 = 0),
one AS (SELECT c.*, h.id AS holder, CASE WHEN c.ordinal > min(c.ordinal) OVER (PARTITION BY c.id) THEN 'repeated row' WHEN op <> 'insert' AND k.id IS NULL THEN 'unknown row'
    WHEN op = 'insert' AND k.id IS NOT NULL THEN 'row exists' END AS r1
  FROM ch c LEFT JOIN tab k ON k.id = c.id LEFT JOIN tab h ON h.country = c.country AND h.doc = c.doc),
two AS (SELECT o.* REPLACE (coalesce(r1, CASE WHEN op <> 'delete' AND holder <> id AND NOT EXISTS (
    SELECT 1 FROM one d WHERE d.op = 'delete' AND d.r1 IS NULL AND d.id = o.holder AND d.ordinal < o.ordinal) THEN 'key taken' END) AS r1) FROM one o),
judged AS (SELECT *, coalesce(r1, CASE WHEN op <> 'delete' AND ordinal > min(ordinal) FILTER (op <> 'delete' AND r1 IS NULL) OVER (PARTITION BY country, doc)
    THEN 'key claimed earlier' END) AS reason FROM two)"""


@query(
    "src_10_apply_changes",
    f"""WITH {_CHANGES} SELECT * FROM tab WHERE id NOT IN (SELECT id FROM judged WHERE reason IS NULL AND op <> 'insert')
UNION ALL SELECT id, country, doc, sort_order FROM judged WHERE reason IS NULL AND op <> 'delete'""",
)
def apply_changes(t):
    return keyed.apply_changes(_table(t), _changes(t), "id", ["country", "doc"])[0]


@query("src_10_rejected_changes", f"WITH {_CHANGES} SELECT id, op, ordinal, reason FROM judged WHERE reason IS NOT NULL")
def rejected_changes(t):
    return keyed.apply_changes(_table(t), _changes(t), "id", ["country", "doc"])[1].select("id", "op", "ordinal", "reason")


@query(
    "src_10_seed_missing",
    """SELECT o_custkey AS country, o_orderpriority AS doc FROM orders UNION ALL SELECT c_custkey, 'seed' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def seed_missing(t):
    table = t.orders.select(F.col("o_custkey").alias("country"), F.col("o_orderpriority").alias("doc"))
    return keyed.seed_missing(table, t.customer.select(F.col("c_custkey").alias("country"), F.lit("seed").alias("doc")), "country")


def _pairs(**cells):
    return F.map_filter(F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


@query(
    "src_12_harmonise_registry",
    """WITH c AS (SELECT c_custkey AS k, *, CASE c_custkey % 5 WHEN 0 THEN 'Cancelled ' WHEN 1 THEN 'Active' WHEN 2 THEN 'suspended' END AS st FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey AS k, * FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT concat('C', k) AS record_id, concat('G', k) AS tax_id, c_name AS legal_name, CASE WHEN k % 2 = 0 THEN c_mktsegment ELSE c_name END AS trading_name,
  CASE WHEN k % 3 = 0 THEN concat('Bay ', c_mktsegment) WHEN k % 3 = 1 THEN 'Old road' END AS street, n_name AS city, CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) END AS postal_code, 'IN' AS country, 'government_registry' AS source_type
FROM c WHERE st IS NULL OR lower(trim(st)) NOT IN ('cancelled', 'canceled', 'inactive', 'suspended', 'provisional')
UNION ALL SELECT concat('R', k), CAST(k AS VARCHAR), s_name, s_name, concat('Unit ', k), n_name, NULL, 'GB', 'government_registry' FROM s
UNION ALL SELECT concat('D', k), CASE WHEN k % 2 = 0 THEN concat('T', k) END, s_name, s_name, CASE WHEN k % 3 = 0 THEN '1 Main' WHEN k % 3 = 1 THEN '2 Side' ELSE 'combined' END,
  CASE WHEN k % 3 = 2 THEN n_name WHEN k % 3 = 0 THEN 'P-city' ELSE 'F-city' END, NULL, n_name, CASE k % 4 WHEN 0 THEN 'BVD' WHEN 1 THEN 'DNB' WHEN 2 THEN 'DNB' ELSE 'BVD' END FROM s""",
)
def harmonise_registry(t):
    none = F.lit(None).cast("string")
    k = F.col("c_custkey")
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(k % 5 == 0, "Cancelled ").when(k % 5 == 1, "Active").when(k % 5 == 2, "suspended")
    gst = registry.harmonise_tax_registry(
        customers.select(
            F.concat(F.lit("C"), k.cast("string")).alias("record_id"), F.concat(F.lit("G"), k.cast("string")).alias("tax_id"),
            _pairs(sts=status, lgnm=F.col("c_name"), tradeNam=F.when(k % 2 == 0, F.col("c_mktsegment")), legalName=F.lit(" ")).alias("payload"),
            _pairs(
                loc=F.col("n_name"), pin=F.when(k % 4 == 0, k.cast("string")), bnm=F.when(k % 3 == 0, "Bay "), st=F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, "Old road"),
            ).alias("address"),
        )
    )
    n = F.col("s_suppkey")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    house = registry.harmonise_company_register(
        suppliers.select(
            F.concat(F.lit("R"), n.cast("string")).alias("record_id"), n.cast("string").alias("company_number"), F.col("s_name").alias("company_name"),
            _pairs(premises=F.concat(F.lit(" Unit "), n.cast("string")), region=F.col("n_name")).alias("office"),
        )
    )

    def address(kind, number, street, city):
        return F.struct(
            F.lit(kind).alias("type"), F.lit(number).alias("street_number"), F.lit(street).alias("street_name"), none.alias("floor"), F.lit(city).alias("city"), none.alias("postal_code")
        )

    first, primary = address("OTHER", "2", "Side", "F-city"), address("PRIMARY", "1", "Main", "P-city")
    directory = registry.harmonise_directory(
        suppliers.select(
            F.concat(F.lit("D"), n.cast("string")).alias("record_id"), F.when(n % 2 == 0, F.col("s_name")).otherwise("").alias("company_name"), F.col("s_name").alias("legal_name"),
            F.when(n % 4 == 1, "DNB").otherwise("?").alias("given_source"), F.when(n % 4 == 0, "x").alias("bvd_id"), F.when(n % 4 == 2, "y").alias("duns"), F.col("n_name").alias("country"), none.alias("url"),
            F.lit("combined").alias("combined_address"), F.col("n_name").alias("city"), none.alias("postal_code"),
            F.when(n % 3 == 0, F.array(first, primary)).when(n % 3 == 1, F.array(first)).alias("addresses"),
            F.when(n % 2 == 0, F.array(F.lit(" "), F.concat(F.lit("T"), n.cast("string")))).alias("tax_numbers"),
        )
    )
    return gst.unionByName(house).unionByName(directory).drop("website")


# --- composite jobs --------------------------------------------------------------------------


def _full_adjudication(t):
    documents = t.spark.createDataFrame([("DOC_A", True), ("DOC_N", True), ("DOC_R", False)], "doc_type string, writable boolean")
    orders = t.dealt("orders", "o_orderkey")
    master = orders.select(
        F.col("o_orderkey").alias("bundle_id"), F.lit("status").alias("path"), F.col("o_orderstatus").alias("value"), F.lit("string").alias("value_type")
    )
    existing = orders.where("o_orderpriority = '2-HIGH'").select(
        F.col("o_orderkey").alias("bundle_id"), F.lit("DOC_A").alias("doc_type"), F.col("o_orderkey").alias("ordinal")
    )
    return jobs.adjudicate(
        extractions_of(t, by_order=True), bindings_frame(t.spark), documents, {"ifsc": "ifsc"}, master, existing=existing,
        candidates=address_candidates(t), master_addresses=stored_addresses(t), multi_source={"flag": 0.82},
    )


_ADJ = """opts AS (SELECT l_orderkey AS bundle_id, concat(l_orderkey, ':', line_key, '|', p.path) AS option_key, p.path AS path, p.k AS k, line_key, 1 - l_discount AS confidence, l_shipdate,
    CASE p.k WHEN 0 THEN l_linestatus WHEN 1 THEN l_returnflag WHEN 2 THEN nullif(concat('City ', CAST(l_quantity AS INT) % 7), 'City 0')
      WHEN 3 THEN CAST(CAST(l_quantity AS INT) % 5 = 0 AS VARCHAR) WHEN 4 THEN CAST(l_tax AS VARCHAR) ELSE 'y' END AS value, p.needs AS needs, concat(line_key, '-000', p.k) AS ordinal,
    l_discount <= 0.05 AND l_returnflag <> 'R' AND p.k IN (0, 1, 6) AS pre
  FROM v_lines CROSS JOIN (VALUES (0, 'status', NULL), (1, 'flag', NULL), (2, 'postalAddresses.0.cityName', 'cityCode'), (3, 'vendorBankAccounts.0.ifsc', 'bankingInstitutionCode'),
    (4, '_unmapped.tax', NULL), (6, 'vendor.extra', NULL)) p(k, path, needs)),
conf AS (SELECT bundle_id, path FROM opts GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT value) > 1),
fresh AS (SELECT bundle_id, path, option_key FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, path ORDER BY l_shipdate DESC, confidence DESC, ordinal) AS rn FROM opts) WHERE rn = 1)"""


@query(
    "job_1_adjudicate_verdicts",
    f"""WITH {_ADJ} SELECT c.bundle_id, c.path, 'steward_required' AS action, f.option_key FROM conf c JOIN fresh f ON c.bundle_id = f.bundle_id AND c.path = f.path
UNION ALL SELECT bundle_id, path, 'reject', NULL FROM opts WHERE path = 'vendorBankAccounts.0.ifsc'
UNION ALL SELECT bundle_id, path, CASE WHEN needs IS NULL THEN 'accept' ELSE 'suggest' END, option_key FROM opts o WHERE k NOT IN (3, 4) AND ((pre AND needs IS NULL) OR (needs IS NOT NULL AND confidence >= 0.85))
  AND NOT EXISTS (SELECT 1 FROM conf c WHERE c.bundle_id = o.bundle_id AND c.path = o.path)""",
    ("v_lines",),
)
def adjudicate_verdicts(t):
    return _full_adjudication(t).verdicts.select("bundle_id", "path", "action", "option_key")


@query(
    "job_1_adjudicate_checks",
    f"""WITH {_ADJ} SELECT bundle_id, 'identifier_shape_ifsc' AS check_id, 'fail' AS status FROM opts WHERE k = 3
UNION ALL SELECT DISTINCT bundle_id, 'name_conflict_flag', 'warn' FROM conf WHERE path = 'flag'
UNION ALL SELECT o_orderkey, 'duplicate_doc_type_DOC_A', 'warn' FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT o.bundle_id, 'form_mismatch_status', 'warn' FROM (SELECT bundle_id, arg_min(value, ordinal) AS v FROM opts WHERE k = 0 GROUP BY bundle_id) o JOIN orders ON o_orderkey = o.bundle_id WHERE v <> o_orderstatus""",
    ("v_lines",),
)
def adjudicate_checks(t):
    return _full_adjudication(t).checks.select("bundle_id", "check_id", "status")


def _enrichment(t):
    key = F.col("c_custkey")
    nation = t.nation.select("n_nationkey", "n_name")
    records = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("record_id"), F.when(key % 6 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("country"),
        F.when(key % 4 != 0, F.lower("n_name")).alias("city"), F.lit(None).cast("string").alias("postal_code"),
    )
    extracted = t.orders.select(
        F.col("o_custkey").alias("record_id"), F.lit("tradingName").alias("path"), F.lit("Name").alias("label"), F.concat(F.lit("Doc "), F.col("o_orderstatus")).alias("value"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0.7).otherwise(0.9).alias("confidence"), F.col("o_orderpriority").alias("source_label"), F.lit(None).cast("string").alias("needs_resolution"),
        F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("ordinal"),
    )
    resolved = t.customer.where("c_custkey % 5 = 0").select(key.alias("record_id"), F.lit("address_enrich").alias("stage"), F.lit(0.9).alias("confidence"))
    cities = t.v_cityref().withColumn("subdivision_code", F.lit(None).cast("string"))
    return jobs.enrich(records, extracted, resolved, cities)


_ENRICH = """recs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name, c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN lower(n_name) END AS city, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
pool AS (SELECT o_custkey AS id, 'tradingName' AS path, concat('Doc ', o_orderstatus) AS value, CASE WHEN o_orderpriority = '5-LOW' THEN 0.7 ELSE 0.9 END AS c, o_orderpriority AS src, concat('o', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS o FROM orders
  UNION ALL SELECT id, 'postalAddresses.0.cityCode', concat('GEO', n_nationkey), 0.85, 'External address service', '~address' FROM recs WHERE id % 5 <> 0 AND id % 4 <> 0),
opts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, src, path ORDER BY o) AS rn FROM pool) WHERE rn = 1),
bad AS (SELECT id, path FROM opts GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT value) > 1),
safe AS (SELECT id, path, arg_max(value, o) AS value FROM opts o WHERE c >= 0.8 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.id = o.id AND b.path = o.path) GROUP BY ALL),
stored AS (SELECT id, 'tradingName' AS path, name AS value FROM recs WHERE name IS NOT NULL UNION ALL SELECT id, 'country', c_mktsegment FROM recs UNION ALL SELECT id, 'postalAddresses.0.cityName', city FROM recs WHERE city IS NOT NULL)"""


@query(
    "job_4_enrich_records",
    f"WITH {_ENRICH} SELECT id AS record_id, path, value FROM stored s WHERE NOT EXISTS (SELECT 1 FROM safe w WHERE w.id = s.id AND w.path = s.path) UNION ALL SELECT * FROM safe",
)
def enrich_records(t):
    return _enrichment(t)[2]


@query(
    "job_4_enrich_options",
    f"""WITH {_ENRICH} SELECT o.id AS record_id, o.path, concat(src, ':', o.path) AS option_key, coalesce(s.value, '—') AS current_display, o.value AS incoming_display, c >= 0.8 AS pre_selected
FROM opts o LEFT JOIN stored s ON o.id = s.id AND o.path = s.path""",
)
def enrich_options(t):
    return _enrichment(t)[1].select("record_id", "path", "option_key", "current_display", "incoming_display", "pre_selected")
