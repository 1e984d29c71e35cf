"""The shared inputs of the registered queries.

Each view turns a whole base table into the shape an operator works on (proposals, evidence, names,
query log and so on).  It exists twice: as a DataFrame here, and as plain SQL for the oracle.  None
of the DataFrame versions shuffles except for joins with dimension tables and where a caller asks for
lines that are dealt by their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops.functions.ordering import padded
from entityops.functions.rows import struct_rows


LINES_PER_PART = 60_000


def _line_key():
    return F.concat_ws(
        "-",
        padded(F.col("l_linenumber"), 2),
        padded(F.col("l_partkey"), 12),
        padded(F.col("l_suppkey"), 12),
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


def vector_cosines(vector):
    """Cosines of a vector with itself turned round and with itself moved on by one place, from components in thousandths."""
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("long"))

    def dot(other):
        return F.aggregate(F.zip_with(q, other, lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x).cast("double")

    moved = F.concat(F.slice(q, F.lit(2), F.size(q)), F.slice(q, 1, 1))
    return F.try_divide(dot(F.reverse(q)), dot(q)), F.try_divide(dot(moved), dot(q))


COSINES_SQL = """whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000 + 0.5) AS BIGINT)) AS q FROM embeddings),
dots AS (SELECT vec_id, label, list_sum(list_transform(list_zip(q, list_reverse(q)), lambda z: z[1] * z[2]))::DOUBLE AS t,
    list_sum(list_transform(list_zip(q, list_concat(q[2:], q[1:1])), lambda z: z[1] * z[2]))::DOUBLE AS s, list_sum(list_transform(q, lambda x: x * x))::DOUBLE AS n FROM whole),
cosines AS (SELECT vec_id, label, CASE WHEN n > 0 THEN t / n END AS turned, CASE WHEN n > 0 THEN s / n END AS shifted FROM dots)"""


class Tables:
    """Base tables by attribute, derived views by method."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._parts: int | None = None

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table dealt by the number of its order into as many parts as the lines need.

        What is made of the parts can be grouped and joined by order without another exchange, so narrow lines are
        shuffled once and not the wide rows made of them, and a part is small enough to be sorted in memory.
        """
        if self._parts is None:
            lines = -(-self.lineitem.count() // LINES_PER_PART)
            self._parts = max(lines, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return getattr(self, name).repartition(self._parts, key)

    def v_lines(self, by_order: bool = False) -> DataFrame:
        lines = self.dealt("lineitem", "l_orderkey") if by_order else self.lineitem
        return lines.withColumn("line_key", _line_key())

    def v_proposals(self, by_order: bool = False) -> DataFrame:
        """Each order line is a document that proposes a value for four fields of its order."""
        cells = struct_rows(
            "k path value",
            (1, "status", F.col("l_linestatus")),
            (2, "flag", F.col("l_returnflag")),
            (3, "band", (F.col("l_quantity").cast("int") % 3).cast("string")),
            (4, "_unmapped.tax", F.round(F.col("l_tax") * 100).cast("int").cast("string")),
        )
        return (
            self.v_lines(by_order)
            .select(
                F.col("l_orderkey").alias("bundle_id"),
                F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("line_key")).alias("document_id"),
                F.concat(F.lit("DOC_"), F.col("l_returnflag")).alias("doc_type"),
                (1 - F.col("l_discount")).alias("confidence"),
                F.col("l_shipdate").cast("date").alias("effective_date"),
                "line_key",
                F.inline(cells),
            )
            .select(
                "bundle_id", "document_id", "doc_type", "path", "value", "confidence", "effective_date",
                F.concat_ws("-", "line_key", F.col("k").cast("string")).alias("ordinal"),
            )
        )

    def v_options(self, by_order: bool = False) -> DataFrame:
        """Proposals in the full options shape, with real document types and logical fields."""
        kind = F.col("doc_type")
        path = F.col("path")
        return self.v_proposals(by_order).select(
            "bundle_id", "document_id",
            F.when(kind == "DOC_A", "IN_GST_CERTIFICATE").when(kind == "DOC_N", "IN_ADDRESS_PROOF")
            .otherwise("IN_CERTIFICATE_OF_INCORPORATION").alias("doc_type"),
            "path", path.alias("label"),
            F.when(path == "status", "legal_name").when(path == "flag", "trading_name")
            .when(path == "band", "bill_to_city").alias("logical_id"),
            "value", F.col("value").alias("display"), "confidence",
            ((F.col("confidence") >= 0.95) & ~path.startswith("_unmapped")).alias("pre_selected"),
            F.when(path == "band", F.lit("cityCode")).alias("needs_resolution"),
            F.lit(True).alias("regex_ok"), "effective_date", "ordinal",
            F.concat_ws("|", "document_id", "path").alias("option_key"),
        )

    def v_idoptions(self, by_order: bool = False) -> DataFrame:
        """Each order line proposes a tax identifier, a registration number and a region."""
        letter = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "N", "C").otherwise("F")
        digits = F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0")
        last = F.when(F.col("l_linestatus") == "O", "F").otherwise("5")
        state = F.lpad((F.col("l_suppkey") % 40).cast("string"), 2, "0")
        region = F.when(F.col("l_linenumber") % 3 == 0, "MH").when(F.col("l_linenumber") % 3 == 1, "KA").otherwise("dl ")
        cells = struct_rows(
            "logical_id value",
            ("pan", F.concat(F.lit("abc"), letter, F.lit("D"), digits, last)),
            ("gstin", F.concat(state, F.lit("ABCPD"), digits, F.lit("F1Z5"))),
            ("bill_to_region", region),
        )
        return self.v_lines(by_order).select(
            F.col("l_orderkey").alias("bundle_id"), F.inline(cells), "line_key", (1 - F.col("l_discount")).alias("confidence"),
        ).select(
            "bundle_id", "logical_id", "value", F.concat(F.lit("form."), F.col("logical_id")).alias("path"), "confidence",
            F.concat_ws("-", "line_key", "logical_id").alias("ordinal"),
        )

    def v_company(self) -> DataFrame:
        place = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region")
        )
        suppliers = self.supplier.select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"),
            F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"),
            F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source_type"),
        )
        customers = self.customer.select(
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"),
            F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"),
            F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source_type"),
        )
        return (
            suppliers.unionByName(customers)
            .join(place, F.col("nk") == F.col("n_nationkey"))
            .select("entity_id", "name", "country", "region", "balance", "source_type")
        )

    def v_evidence(self) -> DataFrame:
        """Field scores of each source (order line) for each record (order)."""
        quantity = F.col("l_quantity").cast("int")
        cells = struct_rows(
            "field ordinal score state",
            ("tradingName", 1, quantity * 2, F.when(quantity % 5 == 0, F.lit("unknown")).otherwise(F.lit("compared"))),
            ("tax", 2, F.when(F.col("l_returnflag") == "N", 100).otherwise(40), "compared"),
            ("city", 3, F.when(F.col("l_linestatus") == "O", 90).otherwise(55), "compared"),
            ("country", 4, 100, "compared"),
        )
        return self.v_lines().select(
            F.col("l_orderkey").alias("record_id"),
            F.col("line_key").alias("source_id"),
            (1 - F.col("l_discount")).alias("authority"),
            F.inline(cells),
        )

    def v_names(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("record_id"),
            F.concat_ws(" ", "p_name", "p_brand").alias("name"),
            F.col("p_brand").alias("block"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
        )

    def v_cityref(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("city_name"),
            F.concat(F.lit("GEO"), F.col("n_nationkey").cast("string")).alias("code"),
            F.col("r_name").alias("subdivision_name"),
        )

    def v_feedback(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("ordinal"), "ts",
            F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("country"),
            F.concat(F.lit("conn_"), (F.col("event_id") % 3).cast("string")).alias("connector"),
            F.when(F.col("event_type").isin("error", "click"), F.lit("not_helpful"))
            .otherwise(F.lit("helpful")).alias("rating"),
        )

    def v_generations(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            "event_id", "ts",
            F.when(kind == "view", "extract.envelope").when(kind == "click", "nl_search.parse")
            .when(kind == "purchase", "company_search.similarity").when(kind == "error", "pytest.case")
            .otherwise("something.else").alias("name"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            (F.col("event_id") % 700).alias("input_tokens"),
            (F.col("event_id") % 90).alias("output_tokens"),
            F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value") / 1000).alias("cost"),
        )

    def v_runs(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), "ts",
            F.when(kind == "signup", "RUN_STARTED").when(kind == "purchase", "RUN_FINISHED")
            .when(kind == "click", "TOOL_CALL_START").when(kind == "view", "STEP_FINISHED")
            .otherwise("BAD_FRAME").alias("type"),
        )

    def v_policies(self) -> DataFrame:
        place = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        suffix = F.when(
            F.col("c_custkey") % 2 == 0, F.concat(F.lit("_"), F.upper(F.substring("r_name", 1, 2)))
        ).otherwise(F.lit(""))
        return self.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("user:"), F.col("c_nationkey").cast("string")).alias("user_name"),
            F.col("c_custkey").alias("ordinal"),
            F.concat(F.lit("country:"), F.col("n_name"), suffix).alias("object_id"),
            F.concat(F.lit("rel"), (F.col("c_custkey") % 3).cast("string")).alias("relation"),
            F.col("c_mktsegment").alias("policy_condition"),
        )

    def v_queries(self) -> DataFrame:
        """A query log; nation numbers choose among spoken country names so every outcome occurs."""
        key = F.col("c_custkey")
        place = F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))
        spoken = F.element_at(F.array(*[F.lit(x) for x in SPOKEN]), (F.col("n_nationkey") % len(SPOKEN) + 1))
        text = key.cast("string")
        number = (key + 10000).cast("string")
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            key.alias("query_id"),
            F.when(key % 11 == 0, F.concat(F.lit("all vendors in "), spoken))
            .when(key % 11 == 1, F.concat(F.lit("erp code "), number))
            .when(key % 11 == 2, F.concat(F.col("c_mktsegment"), F.lit(" trading in "), place))
            .when(key % 11 == 3, F.concat(F.lit("tax id AB"), (key + 1000000).cast("string"), F.lit("Z")))
            .when(key % 11 == 4, F.concat(F.lit("pending workflow "), spoken))
            .when(key % 11 == 5, F.concat(F.lit("  IN"), (key + 100000).cast("string"), F.lit(" ")))
            .when(key % 11 == 6, F.concat(F.lit("sap mdg bp code: "), number))
            .when(key % 11 == 7, F.concat(F.lit("with draft "), spoken))
            .when(key % 11 == 8, F.concat(F.col("c_mktsegment"), F.lit(" "), spoken, F.lit(" tax 27"), number, F.lit("Q9")))
            .when(key % 11 == 9, number)
            .otherwise(F.concat(F.lit("inactive "), F.col("c_mktsegment"), F.lit(" no"), text, F.lit(" from mumbai")))
            .alias("query"),
        )


SPOKEN = ["India", "united kingdom", "Czechia", "country br", "Mumbai, India", "in DE", "Narnia", "uk"]

SQL_VIEWS: dict[str, str] = {
    "v_lines": """
SELECT *, concat(lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), '-', lpad(CAST(l_partkey AS VARCHAR), 12, '0'), '-',
       lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), '-', strftime(l_shipdate, '%Y%m%d')) AS line_key FROM lineitem""",
    "v_proposals": """
SELECT l_orderkey AS bundle_id, concat(l_orderkey, ':', line_key) AS document_id,
       concat('DOC_', l_returnflag) AS doc_type, p.path AS path,
       CASE p.k WHEN 1 THEN l_linestatus WHEN 2 THEN l_returnflag
                WHEN 3 THEN CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR)
                ELSE CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) END AS value,
       1 - l_discount AS confidence, CAST(l_shipdate AS DATE) AS effective_date,
       concat(line_key, '-', p.k) AS ordinal
FROM v_lines CROSS JOIN (VALUES (1, 'status'), (2, 'flag'), (3, 'band'), (4, '_unmapped.tax')) p(k, path)""",
    "v_options": """
SELECT bundle_id, document_id, CASE doc_type WHEN 'DOC_A' THEN 'IN_GST_CERTIFICATE' WHEN 'DOC_N' THEN 'IN_ADDRESS_PROOF'
         ELSE 'IN_CERTIFICATE_OF_INCORPORATION' END AS doc_type, path, path AS label,
       CASE path WHEN 'status' THEN 'legal_name' WHEN 'flag' THEN 'trading_name' WHEN 'band' THEN 'bill_to_city' END AS logical_id,
       value, value AS display, confidence, confidence >= 0.95 AND NOT starts_with(path, '_unmapped') AS pre_selected,
       CASE WHEN path = 'band' THEN 'cityCode' END AS needs_resolution, true AS regex_ok, effective_date, ordinal,
       concat(document_id, '|', path) AS option_key FROM v_proposals""",
    "v_idoptions": """
SELECT l_orderkey AS bundle_id, f.logical_id AS logical_id,
       CASE f.k WHEN 1 THEN concat('abc', CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'C' ELSE 'F' END, 'D',
                     lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0'), CASE WHEN l_linestatus = 'O' THEN 'F' ELSE '5' END)
            WHEN 2 THEN concat(lpad(CAST(l_suppkey % 40 AS VARCHAR), 2, '0'), 'ABCPD',
                     lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0'), 'F1Z5')
            ELSE CASE l_linenumber % 3 WHEN 0 THEN 'MH' WHEN 1 THEN 'KA' ELSE 'dl ' END END AS value,
       concat('form.', f.logical_id) AS path, 1 - l_discount AS confidence, concat(line_key, '-', f.logical_id) AS ordinal
FROM v_lines CROSS JOIN (VALUES (1, 'pan'), (2, 'gstin'), (3, 'bill_to_region')) f(k, logical_id)""",
    "v_company": """
SELECT concat('S', s_suppkey) AS entity_id, s_name AS name, n_name AS country, r_name AS region,
       s_acctbal AS balance, 'supplier' AS source_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('C', c_custkey), c_name, n_name, r_name, c_acctbal, 'customer'
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_evidence": """
SELECT l_orderkey AS record_id, line_key AS source_id, f.field AS field, f.k AS ordinal,
       CASE f.k WHEN 1 THEN CAST(l_quantity AS INT) * 2
                WHEN 2 THEN CASE WHEN l_returnflag = 'N' THEN 100 ELSE 40 END
                WHEN 3 THEN CASE WHEN l_linestatus = 'O' THEN 90 ELSE 55 END ELSE 100 END AS score,
       CASE WHEN f.k = 1 AND CAST(l_quantity AS INT) % 5 = 0 THEN 'unknown' ELSE 'compared' END AS state,
       1 - l_discount AS authority
FROM v_lines CROSS JOIN (VALUES (1, 'tradingName'), (2, 'tax'), (3, 'city'), (4, 'country')) f(k, field)""",
    "v_names": """
SELECT p_partkey AS record_id, concat(p_name, ' ', p_brand) AS name, p_brand AS block, p_type AS kind,
       p_size AS size FROM part""",
    "v_cityref": """
SELECT n_nationkey AS ordinal, n_name AS city_name, concat('GEO', n_nationkey) AS code,
       r_name AS subdivision_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_feedback": """
SELECT event_id AS ordinal, ts, concat('C', user_id % 4) AS country, concat('conn_', event_id % 3) AS connector,
       CASE WHEN event_type IN ('error', 'click') THEN 'not_helpful' ELSE 'helpful' END AS rating FROM events""",
    "v_generations": """
SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'extract.envelope' WHEN 'click' THEN 'nl_search.parse'
         WHEN 'purchase' THEN 'company_search.similarity' WHEN 'error' THEN 'pytest.case'
         ELSE 'something.else' END AS name,
       concat('m', user_id % 3) AS model, event_id % 700 AS input_tokens, event_id % 90 AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value / 1000 END AS cost FROM events""",
    "v_runs": """
SELECT user_id AS run_id, event_id AS ordinal, ts,
       CASE event_type WHEN 'signup' THEN 'RUN_STARTED' WHEN 'purchase' THEN 'RUN_FINISHED'
         WHEN 'click' THEN 'TOOL_CALL_START' WHEN 'view' THEN 'STEP_FINISHED' ELSE 'BAD_FRAME' END AS type
FROM events""",
    "v_policies": """
SELECT concat('user:', c_nationkey) AS user_name, c_custkey AS ordinal,
       concat('country:', n_name, CASE WHEN c_custkey % 2 = 0 THEN concat('_', upper(substr(r_name, 1, 2))) ELSE '' END)
         AS object_id, concat('rel', c_custkey % 3) AS relation, c_mktsegment AS policy_condition
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_queries": """
SELECT c_custkey AS query_id,
  CASE c_custkey % 11
    WHEN 0 THEN concat('all vendors in ', spoken)
    WHEN 1 THEN concat('erp code ', c_custkey + 10000)
    WHEN 2 THEN concat(c_mktsegment, ' trading in ', replace(n_name, '_', ' '))
    WHEN 3 THEN concat('tax id AB', c_custkey + 1000000, 'Z')
    WHEN 4 THEN concat('pending workflow ', spoken)
    WHEN 5 THEN concat('  IN', c_custkey + 100000, ' ')
    WHEN 6 THEN concat('sap mdg bp code: ', c_custkey + 10000)
    WHEN 7 THEN concat('with draft ', spoken)
    WHEN 8 THEN concat(c_mktsegment, ' ', spoken, ' tax 27', c_custkey + 10000, 'Q9')
    WHEN 9 THEN CAST(c_custkey + 10000 AS VARCHAR)
    ELSE concat('inactive ', c_mktsegment, ' no', c_custkey, ' from mumbai') END AS query
FROM (SELECT *, (["India", "united kingdom", "Czechia", "country br", "Mumbai, India", "in DE", "Narnia", "uk"])
        [n_nationkey % 8 + 1] AS spoken
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""".replace('"', "'"),
}
_NEEDS = {
    "v_proposals": ("v_lines",), "v_evidence": ("v_lines",), "v_idoptions": ("v_lines",),
    "v_options": ("v_lines", "v_proposals"),
}


def with_views(body: str, uses: tuple[str, ...]) -> str:
    """Put the SQL of the views in front of ``body`` (which may itself start with WITH)."""
    names: list[str] = []
    for name in uses:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in names:
                names.append(needed)
    if not names:
        return body.strip()
    prefix = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in names)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{text[5:]}"
    return f"WITH {prefix}\n{text}"
