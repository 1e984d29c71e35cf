"""Registered queries of usage, feedback, access, runs and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.operators import usage as G
from entityops.plans import sql
from entityops.plans.registry import query
from entityops.streaming import operators as X
from entityops.streaming import stateful as S

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


_FEATURE = "CASE " + " ".join(
    f"WHEN starts_with(trim(name), {sql.quote(p)}) THEN {sql.quote(f)}" for f, ps in C.FEATURE_CATALOG for p in ps
) + " ELSE 'other' END"
_TEST = "(" + " OR ".join(f"starts_with(lower(name), {sql.quote(p)})" for p in C.TEST_NAME_PREFIXES) + ")"
_GUESS = "(input_tokens::DECIMAL(20,0) * 0.000002::DECIMAL(10,8) + output_tokens::DECIMAL(20,0) * 0.000008::DECIMAL(10,8))"
_COST = f"CASE WHEN cost > 0 THEN CAST(cost AS DECIMAL(28,12)) ELSE CAST({_GUESS} AS DECIMAL(28,12)) END"
_EST = "NOT (cost > 0) AND (input_tokens <> 0 OR output_tokens <> 0)"
_GEN = ("v_generations",)


@query("prj_22_estimate_cost", f"SELECT event_id, CAST({_COST} AS DOUBLE) AS cost_usd, {_EST} AS estimated FROM v_generations", _GEN)
def estimate_cost(t):
    return G.estimate_cost(t.v_generations()).select("event_id", F.col("cost_usd").cast("double").alias("cost_usd"), "estimated")


@query("prj_23_feature_of", f"SELECT event_id, {_FEATURE} AS feature FROM v_generations", _GEN)
def feature_of(t):
    return t.v_generations().select("event_id", G.feature_of(F.col("name")).alias("feature"))


@query("flt_6_exclude_test_traces", f"SELECT event_id, name FROM v_generations WHERE NOT {_TEST}", _GEN)
def exclude_tests(t):
    return G.exclude_test_traces(t.v_generations()).select("event_id", "name")


def _summary_sql(include_tests: bool) -> str:
    keep = "true" if include_tests else f"NOT {_TEST}"
    totals = "(SELECT count(*) AS g, sum(CAST(cost AS DECIMAL(28,12))) AS cost, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM f)"
    body = f"""WITH f AS (SELECT * FROM v_generations WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND ts <= TIMESTAMP '{AS_OF}'),
byname AS (SELECT name, count(*) AS g, sum(CAST(cost AS DECIMAL(28,12))) AS cost, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM f GROUP BY name),
bymodel AS (SELECT model, count(*) AS g, sum(CAST(cost AS DECIMAL(28,12))) AS cost, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM f GROUP BY model),
feat AS (SELECT {_FEATURE} AS key, g, {_COST} AS c, input_tokens + output_tokens AS tk, {_EST} AS e FROM byname WHERE {keep}),
tot AS ({'SELECT g, ' + _COST + ' AS c, input_tokens + output_tokens AS tk, ' + _EST + ' AS e FROM ' + totals if include_tests else 'SELECT g, c, tk, e FROM feat'})
SELECT 'feature' AS level, key, CAST(sum(g) AS BIGINT) AS generations, CAST(sum(c) AS DOUBLE) AS cost_usd, CAST(sum(tk) AS BIGINT) AS tokens, bool_or(e) AS estimated FROM feat GROUP BY key
UNION ALL SELECT 'model', model, CAST(sum(g) AS BIGINT), CAST(sum({_COST}) AS DOUBLE), CAST(sum(input_tokens + output_tokens) AS BIGINT), bool_or({_EST}) FROM bymodel GROUP BY model
UNION ALL SELECT 'total', 'all', CAST(sum(g) AS BIGINT), CAST(sum(c) AS DOUBLE), CAST(sum(tk) AS BIGINT), bool_or(e) FROM tot"""
    return body


@query("agg_8_usage_summary", _summary_sql(False), _GEN)
def usage_summary(t):
    return G.usage_summary(t.v_generations(), as_of(), 20)


@query("agg_8_usage_summary_with_tests", _summary_sql(True), _GEN)
def usage_summary_tests(t):
    return G.usage_summary(t.v_generations(), as_of(), 20, include_tests=True)


@query("agg_8_feature_trace_names", f"SELECT DISTINCT {_FEATURE} AS feature, name FROM v_generations", _GEN)
def feature_names(t):
    return G.feature_trace_names(t.v_generations())


@query(
    "srt_2_recent_generations",
    f"""SELECT event_id, {_FEATURE} AS feature, CAST({_COST} AS DOUBLE) AS cost_usd FROM (SELECT * FROM v_generations WHERE NOT {_TEST} ORDER BY ts DESC, event_id DESC LIMIT 250)""",
    _GEN,
)
def recent_generations(t):
    return G.recent_generations(t.v_generations(), 250).select("event_id", "feature", F.col("cost_usd").cast("double").alias("cost_usd"))


# --- feedback --------------------------------------------------------------------------------


@query("src_5_recent_feedback", "SELECT ordinal, rating FROM (SELECT * FROM v_feedback WHERE country = 'C2' ORDER BY ts DESC, ordinal DESC LIMIT 500)", ("v_feedback",))
def recent_feedback(t):
    return G.recent_feedback(t.v_feedback(), "c2").select("ordinal", "rating")


@query(
    "win_6_tail_n",
    "SELECT country, ordinal FROM (SELECT country, ordinal, row_number() OVER (PARTITION BY country ORDER BY ts DESC, ordinal DESC) AS rn FROM v_feedback) WHERE rn <= 8",
    ("v_feedback",),
)
def tail_n(t):
    return G.tail_n(t.v_feedback(), [F.col("ts"), F.col("ordinal")], 8, ["country"]).select("country", "ordinal")


@query(
    "agg_9_feedback_hints",
    """WITH latest AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY ts DESC, ordinal DESC) AS age FROM v_feedback),
rated AS (SELECT country, connector AS subject, rating FROM latest WHERE age <= 500 UNION ALL SELECT country, 'conn_x', rating FROM latest WHERE age <= 500),
c AS (SELECT country, subject, count(*) AS n, count(*) FILTER (rating = 'not_helpful') AS bad, CASE subject WHEN 'conn_2' THEN 1 WHEN 'conn_x' THEN 2 WHEN 'conn_0' THEN 3 ELSE 4 END AS o FROM rated GROUP BY country, subject
  UNION ALL SELECT country, 'country', count(*), count(*) FILTER (rating = 'not_helpful'), 9 FROM latest WHERE age <= 8 GROUP BY country),
h AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY o) AS hint_no FROM c WHERE n >= 8 AND bad / n >= 0.4)
SELECT country, subject, CAST(floor(bad / n * 100) AS BIGINT) AS percent, CAST(hint_no AS INT) AS hint_no FROM h WHERE hint_no <= 3""",
    ("v_feedback",),
)
def feedback_hints(t):
    rows = t.v_feedback().withColumn("connector_ids", F.array(F.col("connector"), F.lit("conn_x")))
    order = F.when(F.col("connector") == "conn_2", 1).when(F.col("connector") == "conn_x", 2).when(F.col("connector") == "conn_0", 3).otherwise(4)
    listed = rows.select("country", F.explode("connector_ids").alias("connector")).distinct().withColumn("ordinal", order)
    return G.feedback_hints(rows.drop("connector"), listed)


# --- access ----------------------------------------------------------------------------------


def _policies(t):
    return t.v_policies().withColumns(
        {"user_name": F.regexp_replace("user_name", "^user:1", " 1"), "policy_conditions": F.when(F.col("ordinal") % 3 != 0, F.array(F.col("policy_condition"), F.lit("all")))}
    )


@query(
    "agg_10_access_summary",
    """SELECT user_name, arg_min(relation, ordinal) AS relation, coalesce(array_to_string(list_sort(list(DISTINCT nullif(regexp_extract(object_id, '_([A-Z]{2})$', 1), ''))), ','), '') AS countries,
  count(*) AS policies FROM v_policies GROUP BY user_name""",
    ("v_policies",),
)
def access_summary(t):
    return G.access_summary(_policies(t))[0]


@query(
    "agg_10_access_items",
    """SELECT DISTINCT user_name, 'object' AS kind, object_id AS item FROM v_policies UNION ALL
SELECT DISTINCT user_name, 'condition', c FROM (SELECT user_name, unnest([policy_condition, 'all']) AS c FROM v_policies WHERE ordinal % 3 <> 0)""",
    ("v_policies",),
)
def access_items(t):
    return G.access_summary(_policies(t))[1]


@query("srt_4_sort_policies", "SELECT user_name, object_id, ordinal FROM v_policies ORDER BY object_id DESC, ordinal", ("v_policies",))
def sort_policies(t):
    return G.sort_policies(t.v_policies(), "object", "desc").select("user_name", "object_id", "ordinal")


# --- runs ------------------------------------------------------------------------------------

_RUNS = """s AS (SELECT run_id, min(ordinal) AS st FROM v_runs WHERE type = 'RUN_STARTED' GROUP BY run_id),
live AS (SELECT v.* FROM v_runs v JOIN s ON v.run_id = s.run_id WHERE ordinal >= st AND type <> 'BAD_FRAME'),
state AS (SELECT run_id, CASE WHEN arg_max(type, ordinal) FILTER (type IN ('RUN_STARTED', 'RUN_FINISHED')) = 'RUN_FINISHED' THEN 'done' ELSE 'running' END AS status,
  count(*) FILTER (type = 'STEP_FINISHED') AS stage_count, count(*) FILTER (type = 'TOOL_CALL_START') AS tool_call_count, min(ts) AS created_at, max(ts) AS updated_at, max(ordinal) AS last_ordinal
  FROM live GROUP BY run_id)"""


@query("str_1_run_state", f"WITH {_RUNS} SELECT run_id, status, stage_count, tool_call_count, last_ordinal FROM state", ("v_runs",))
def run_state(t):
    return G.run_state(t.v_runs()).select("run_id", "status", "stage_count", "tool_call_count", "last_ordinal")


@query(
    "str_1_run_entries",
    f"WITH {_RUNS} SELECT run_id, ordinal, CASE WHEN type = 'STEP_FINISHED' THEN 'stage' ELSE 'tool_call' END AS entry FROM live WHERE type IN ('STEP_FINISHED', 'TOOL_CALL_START')",
    ("v_runs",),
)
def run_entries(t):
    return G.run_entries(t.v_runs()).drop("ts")


@query(
    "str_1_run_state_of_known_runs",
    """SELECT run_id, CASE WHEN arg_max(type, ordinal) FILTER (type IN ('RUN_STARTED', 'RUN_FINISHED')) = 'RUN_FINISHED' THEN 'done'
    WHEN bool_or(type IN ('RUN_STARTED', 'RUN_FINISHED')) THEN 'running' ELSE 'pending' END AS status,
  count(*) FILTER (type = 'STEP_FINISHED') AS stage_count, count(*) FILTER (type = 'TOOL_CALL_START') AS tool_call_count FROM v_runs
WHERE type <> 'BAD_FRAME' AND run_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY run_id""",
    ("v_runs",),
)
def known_runs(t):
    runs = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("run_id"))
    return X.run_state(t.v_runs(), runs).drop("updated_at")


_CREATED = """r AS (SELECT user_id AS run_id, event_id AS ordinal, ts, CASE event_type WHEN 'signup' THEN 'RUN_CREATED' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'RUN_FINISHED' ELSE 'RUN_STARTED' END
    WHEN 'click' THEN 'TOOL_CALL_START' WHEN 'view' THEN 'STEP_FINISHED' ELSE 'BAD_FRAME' END AS type FROM events),
c AS (SELECT run_id, min(ordinal) AS st, arg_min(ts, ordinal) AS created FROM r WHERE type = 'RUN_CREATED' GROUP BY 1),
l AS (SELECT c.run_id, c.created, r.ordinal, r.ts, r.type FROM c LEFT JOIN r ON r.run_id = c.run_id AND r.ordinal >= c.st AND r.ts < c.created + INTERVAL 25 DAY AND r.type NOT IN ('RUN_CREATED', 'BAD_FRAME')),
g AS (SELECT run_id, created, arg_max(type, ordinal) FILTER (type IN ('RUN_STARTED', 'RUN_FINISHED')) AS last, count(*) FILTER (type = 'STEP_FINISHED') AS stage_count, count(*) FILTER (type = 'TOOL_CALL_START') AS tool_call_count,
    greatest(created, coalesce(max(ts), created)) AS updated_at FROM l GROUP BY run_id, created)"""


@query(
    "str_1_run_state_with_expiry",
    f"""WITH {_CREATED} SELECT run_id, CASE WHEN (SELECT max(ts) FROM events) >= created + INTERVAL 25 DAY THEN 'expired' WHEN last IS NULL THEN 'pending' WHEN last = 'RUN_FINISHED' THEN 'done' ELSE 'running' END AS status,
  stage_count, tool_call_count, updated_at, created + INTERVAL 25 DAY AS expires_at FROM g""",
)
def runs_with_expiry(t):
    """The batch twin of the stream with timers; 25 days, as the events span a month."""
    kind = F.col("event_type")
    kinds = (
        F.when(kind == "signup", "RUN_CREATED").when((kind == "purchase") & (F.col("event_id") % 2 == 0), "RUN_FINISHED").when(kind == "purchase", "RUN_STARTED")
        .when(kind == "click", "TOOL_CALL_START").when(kind == "view", "STEP_FINISHED").otherwise("BAD_FRAME")
    )
    return S.expiring_runs(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), "ts", kinds.alias("type")), "25 days")


@query(
    "agg_18_run_summary",
    f"WITH {_RUNS} SELECT run_id, stage_count, tool_call_count FROM state ORDER BY updated_at DESC, last_ordinal DESC LIMIT 500",
    ("v_runs",),
)
def run_summary(t):
    return G.run_summary(t.v_runs(), 500).select("run_id", "stage_count", "tool_call_count")


@query(
    "str_2_session_expiry",
    "SELECT user_id AS session_id, min(ts) AS created_at, min(ts) + INTERVAL 1 HOUR AS expires_at FROM events WHERE event_type = 'signup' GROUP BY user_id",
)
def session_expiry(t):
    sessions = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("session_id"), "ts")
    return X.session_expiry(sessions)


@query(
    "str_3_rolling_feedback",
    """SELECT date_trunc('day', ts) AS window_start, country, connector, count(*) AS samples, count(*) FILTER (rating = 'not_helpful') AS negative,
  count(*) >= 8 AND count(*) FILTER (rating = 'not_helpful') / count(*) >= 0.4 AS hint FROM v_feedback GROUP BY ALL""",
    ("v_feedback",),
)
def rolling_feedback(t):
    return X.rolling_feedback(t.v_feedback())


@query(
    "str_3_last_feedback_hints",
    """WITH latest AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY ts DESC, ordinal DESC) AS age FROM v_feedback),
rated AS (SELECT country, connector AS subject, rating FROM latest WHERE age <= 500 UNION ALL SELECT country, 'conn_x', rating FROM latest WHERE age <= 500),
c AS (SELECT country, subject, count(*) AS n, count(*) FILTER (rating = 'not_helpful') AS bad, CASE subject WHEN 'conn_2' THEN 1 WHEN 'conn_x' THEN 2 ELSE 3 END AS o FROM rated WHERE subject IN ('conn_2', 'conn_x', 'conn_0') GROUP BY country, subject
  UNION ALL SELECT country, 'country', count(*), count(*) FILTER (rating = 'not_helpful'), 9 FROM latest WHERE age <= 8 GROUP BY country),
h AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY o) AS hint_no FROM c WHERE n >= 8 AND bad / n >= 0.4)
SELECT e.country, CAST(e.k AS INT) AS hint_no, h.subject, CAST(bad * 100 // n AS BIGINT) AS percent FROM (SELECT DISTINCT country, unnest([1, 2, 3]) AS k FROM v_feedback) e
LEFT JOIN h ON h.country IS NOT DISTINCT FROM e.country AND h.hint_no = e.k""",
    ("v_feedback",),
)
def last_feedback_hints(t):
    """The batch twin of the stream that keeps the last 500 ratings of a country."""
    rows = t.v_feedback().withColumn("connector_ids", F.array(F.col("connector"), F.lit("conn_x"))).drop("connector")
    return S.last_feedback_hints(rows, ["conn_2", "conn_x", "conn_0"])


@query(
    "str_4_usage_by_day",
    f"""SELECT date_trunc('day', ts) AS day, {_FEATURE} AS feature, count(*) AS generations, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
  CAST(sum({_COST}) AS DOUBLE) AS cost_usd FROM v_generations WHERE NOT {_TEST} GROUP BY ALL""",
    _GEN,
)
def usage_by_day(t):
    return X.usage_by_day(t.v_generations())


@query("str_5_dedup_uploads", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_uploads(t):
    return X.dedup_uploads(t.documents.select("doc_id", "text"), F.col("text"), order="doc_id").select("content_hash", "doc_id")


@query(
    "str_5_first_uploads",
    """SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS content_hash, CAST(min(doc_id) OVER (PARTITION BY text) AS VARCHAR) AS first_id, min(doc_id) OVER (PARTITION BY text) <> doc_id AS is_duplicate FROM documents""",
)
def first_uploads(t):
    """The batch twin of the stream in which each copy leaves with the id it repeats; documents arrive in the order of their ids."""
    docs = t.documents.select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    return S.first_uploads(docs, F.col("text")).select("id", "content_hash", "first_id", "is_duplicate")


@query(
    "str_6_enrichment_progress",
    """SELECT session_id, stage, finished, CAST(row_number() OVER (PARTITION BY session_id ORDER BY fo) AS INT) AS place
FROM (SELECT user_id AS session_id, event_type AS stage, count(*) AS finished, min(event_id) AS fo FROM events GROUP BY ALL)""",
)
def enrichment_progress(t):
    return G.enrichment_progress(t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("ordinal")))


@query(
    "agg_19_change_summary",
    """WITH l AS (SELECT l_orderkey, line_key, CASE WHEN l_tax > 0 THEN concat('part.', l_partkey) ELSE ' ' END AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY line_key) AS rn FROM v_lines)
SELECT l_orderkey AS record_id, count(*) AS change_count, coalesce(string_agg(path, ',' ORDER BY rn) FILTER (rn <= 5 AND trim(path) <> ''), '') AS risk_paths FROM l GROUP BY l_orderkey""",
    ("v_lines",),
)
def change_summary(t):
    changes = t.v_lines().select(
        F.col("l_orderkey").alias("record_id"), F.when(F.col("l_tax") > 0, F.concat(F.lit("part."), F.col("l_partkey").cast("string"))).otherwise(" ").alias("path"),
        F.col("line_key").alias("ordinal"),
    )
    return G.change_summary(changes)
