"""Usage, feedback, access and run reports over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import text as T
from entityops.functions.ordering import top_rows

MONEY = "decimal(28,12)"


# --- generations -----------------------------------------------------------------------------


def feature_of(name: Column) -> Column:
    """Feature of a trace name by the ordered prefix catalog."""
    text = T.strip(F.coalesce(name, F.lit("")))
    out = F
    for feature, prefixes in C.FEATURE_CATALOG:
        for prefix in prefixes:
            out = out.when(text.startswith(prefix), F.lit(feature))
    return out.otherwise(F.lit("other"))


def is_test_trace(name: Column) -> Column:
    lowered = F.lower(name)
    return reduce(lambda a, b: a | b, [lowered.startswith(p) for p in C.TEST_NAME_PREFIXES])


def exclude_test_traces(generations: DataFrame) -> DataFrame:
    return generations.where(~F.coalesce(is_test_trace(F.col("name")), F.lit(False)))


def estimated_cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Tokens x rate as an exact decimal; negative counts are zero."""

    def part(tokens: Column, usd_per_million: float) -> Column:
        return F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("decimal(20,0)") * F.lit(usd_per_million / 1_000_000).cast("decimal(10,8)")

    return (part(input_tokens, C.INPUT_USD_PER_MTOK) + part(output_tokens, C.OUTPUT_USD_PER_MTOK)).cast(MONEY)


def estimate_cost(df: DataFrame, cost: str = "cost", input_tokens: str = "input_tokens", output_tokens: str = "output_tokens") -> DataFrame:
    """Add cost_usd and estimated: the recorded cost if positive, else tokens x rate."""
    recorded = F.col(cost) > 0
    used = (F.coalesce(input_tokens, F.lit(0)) != 0) | (F.coalesce(output_tokens, F.lit(0)) != 0)
    guess = estimated_cost(F.col(input_tokens), F.col(output_tokens))
    value = F.when(recorded, F.col(cost).cast(MONEY)).when(used, guess).otherwise(F.lit(0).cast(MONEY))
    return df.withColumns({"cost_usd": value, "estimated": F.coalesce(~recorded, F.lit(True)) & used})


def usage_summary(generations: DataFrame, as_of: Column, days: int = 7, include_tests: bool = False) -> DataFrame:
    """Totals, features and models of the last ``days`` (1..90) as rows (level, key, ...).

    Costs are settled per trace name (and per model), as a metrics query returns them, from one pass
    with grouping sets; without tests, the totals are the sum over the features.
    """
    period = max(days, 1)
    rows = generations.where((F.col("ts") > as_of - F.expr(f"interval {period} days")) & (F.col("ts") <= as_of))
    facts = rows.select(
        F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce("cost", F.lit(0.0)).cast(MONEY).alias("cost"),
    )
    sums = facts.groupingSets([["name"], ["model"], []], "name", "model").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("generations"), F.sum("cost").cast(MONEY).alias("cost"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    settled = estimate_cost(sums).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    by_name, by_model = settled.where("_set = 1"), settled.where("_set = 2")
    if not include_tests:
        by_name = exclude_test_traces(by_name)
    measures = [F.sum("generations").alias("generations"), F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"), F.bool_or("estimated").alias("estimated")]
    features = by_name.groupBy(feature_of(F.col("name")).alias("key")).agg(*measures).withColumn("level", F.lit("feature"))
    models = by_model.where("model <> 'unknown' AND lower(model) <> 'none'").groupBy(F.col("model").alias("key")).agg(*measures).withColumn("level", F.lit("model"))
    totals = (settled.where("_set = 3") if include_tests else by_name).agg(*measures).withColumns({"key": F.lit("all"), "level": F.lit("total")})
    columns = ["level", "key", "generations", "cost_usd", "tokens", "estimated"]
    out = reduce(DataFrame.unionByName, [x.select(*columns) for x in (totals, features, models)])
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def feature_trace_names(generations: DataFrame) -> DataFrame:
    """Which trace names make up a feature, one row each."""
    return generations.select(feature_of(F.col("name")).alias("feature"), "name").distinct()


def recent_generations(generations: DataFrame, limit: int = 25, include_tests: bool = False) -> DataFrame:
    """The newest generations; tests are filtered before the limit, so no over-fetch is needed."""
    rows = generations if include_tests else exclude_test_traces(generations)
    newest = rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(max(limit, 1))
    return estimate_cost(newest.withColumn("feature", feature_of(F.col("name"))))


# --- feedback --------------------------------------------------------------------------------


def tail_n(df: DataFrame, order: list[Column], n: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows of the table or of each group; ``order`` is ascending."""
    latest = [o.desc() for o in order]
    if not keys:
        return df.orderBy(*latest).limit(n)
    return top_rows(df, keys, latest, n, "_tail").drop("_tail")


def recent_feedback(feedback: DataFrame, country: str | None = None, limit: int = 500) -> DataFrame:
    """Last ``limit`` rows, optionally of one country without regard to case."""
    rows = feedback if country is None else feedback.where(F.upper("country") == country.upper())
    return tail_n(rows, [F.col("ts"), F.col("ordinal")], limit)


def feedback_hints(feedback: DataFrame, connectors: DataFrame, recent: int = 500, top: int = 3) -> DataFrame:
    """Hints per country from its recent ratings, at most ``top``, connectors in their order.

    feedback: country, rating, connector_ids (array), ts, ordinal; connectors: country, connector, ordinal.
    A connector needs eight ratings and 40 percent "not helpful"; the last eight ratings of the
    country give one more hint.
    """
    latest = top_rows(feedback, ["country"], [F.col("ts").desc(), F.col("ordinal").desc()], recent, "_age")
    bad = F.col("rating") == "not_helpful"
    by_connector = (
        latest.where(T.present(F.col("rating"))).select("country", "rating", F.explode("connector_ids").alias("connector"))
        .groupBy("country", "connector").agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("negative"))
    )
    enough = (F.col("samples") >= C.FEEDBACK_MIN_SAMPLES) & (F.col("negative") / F.col("samples") >= C.FEEDBACK_NEGATIVE_RATE)
    first = by_connector.where(enough).join(connectors, ["country", "connector"]).select(
        "country", F.col("connector").alias("subject"), F.floor(F.col("negative") / F.col("samples") * 100).alias("percent"), F.col("ordinal").cast("long").alias("ordinal")
    )
    country = (
        latest.where(F.col("_age") <= C.FEEDBACK_MIN_SAMPLES)
        .groupBy("country").agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("negative"))
        .where(enough)
        .select("country", F.lit("country").alias("subject"), F.floor(F.col("negative") / F.col("samples") * 100).alias("percent"), F.lit(1 << 40).alias("ordinal"))
    )
    return top_rows(first.unionByName(country), ["country"], [F.col("ordinal"), F.col("subject")], top, "hint_no").drop("ordinal")


# --- access ----------------------------------------------------------------------------------


def format_user(col: Column) -> Column:
    text = T.strip(col)
    return F.when((text == "") | text.startswith("user:"), text).otherwise(F.concat(F.lit("user:"), text))


def policy_country(object_id: Column) -> Column:
    """Two capital letters after a final underscore; needs at least three characters."""
    return F.nullif(F.regexp_extract(object_id, "_([A-Z]{2})$", 1), F.lit(""))


def access_summary(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, items): first relation and countries per user; objects and conditions one row each.

    policies: user_name, relation, object_id, policy_conditions (array), ordinal.  Country codes are two
    letters, so their set is small; objects are not, so they stay rows.
    """
    country = policy_country(F.col("object_id"))
    users = policies.groupBy(format_user(F.col("user_name")).alias("user_name")).agg(
        F.min_by(F.struct(F.coalesce("relation", F.lit("")).alias("relation")), F.col("ordinal")).alias("_r"),
        F.array_join(F.array_sort(F.collect_set(country)), ",").alias("countries"), F.count(F.lit(1)).alias("policies"),
    )
    user = format_user(F.col("user_name")).alias("user_name")
    objects = policies.where(T.present(F.col("object_id"))).select(user, F.lit("object").alias("kind"), F.col("object_id").alias("item")).distinct()
    conditions = policies.select(user, F.lit("condition").alias("kind"), F.explode("policy_conditions").alias("item")).distinct()
    return users.select("user_name", "_r.relation", "countries", "policies"), objects.unionByName(conditions)


def sort_policies(policies: DataFrame, by: str = "subject", order: str = "asc") -> DataFrame:
    """Policies sorted by subject, relation or object; the input order settles ties."""
    column = {"subject": "user_name", "relation": "relation", "object": "object_id"}[by]
    key = F.col(column).desc() if order == "desc" else F.col(column).asc()
    return policies.orderBy(key, "ordinal")


# --- runs and changes ------------------------------------------------------------------------


def run_state(events: DataFrame) -> DataFrame:
    """State of each run after its events (the batch twin of the streaming operator).

    events: run_id, ordinal, ts, type.  A run exists from its first RUN_STARTED; earlier events and
    unknown frames are ignored.
    """
    started = events.where("type = 'RUN_STARTED'").groupBy("run_id").agg(F.min("ordinal").alias("_start"))
    live = events.join(started, "run_id").where("ordinal >= _start")
    known = live.where(F.col("type").isin("RUN_STARTED", "STEP_FINISHED", "TOOL_CALL_START", "RUN_FINISHED"))
    lifecycle = F.col("type").isin("RUN_STARTED", "RUN_FINISHED")
    last = F.max_by("type", F.when(lifecycle, F.col("ordinal")))
    return known.groupBy("run_id").agg(
        F.when(last == "RUN_FINISHED", "done").otherwise("running").alias("status"),
        F.count_if(F.col("type") == "STEP_FINISHED").alias("stage_count"), F.count_if(F.col("type") == "TOOL_CALL_START").alias("tool_call_count"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max("ordinal").alias("last_ordinal"),
    )


def run_entries(events: DataFrame) -> DataFrame:
    """Appended stage results and tool calls of the runs, one row each in order."""
    started = events.where("type = 'RUN_STARTED'").groupBy("run_id").agg(F.min("ordinal").alias("_start"))
    live = events.join(started, "run_id").where("ordinal >= _start")
    return live.where(F.col("type").isin("STEP_FINISHED", "TOOL_CALL_START")).select(
        "run_id", "ordinal", "ts", F.when(F.col("type") == "STEP_FINISHED", "stage").otherwise("tool_call").alias("entry")
    )


def run_summary(events: DataFrame, limit: int = 50) -> DataFrame:
    """Counts of the most recently updated runs."""
    return run_state(events).orderBy(F.col("updated_at").desc(), F.col("last_ordinal").desc()).limit(max(limit, 1))


def change_summary(changes: DataFrame, paths: int = 5) -> DataFrame:
    """Number of changes per record and the first few paths: record_id, path, ordinal."""
    counts = changes.groupBy("record_id").agg(F.count(F.lit(1)).alias("change_count"))
    first = top_rows(changes.select("record_id", "path", "ordinal"), ["record_id"], [F.col("ordinal")], paths)
    listed = first.where(T.present(F.col("path"))).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("_p"))
    return counts.join(listed, "record_id", "left").select(
        "record_id", "change_count", F.coalesce(F.array_join(F.transform("_p", lambda x: x["path"]), ","), F.lit("")).alias("risk_paths")
    )


def enrichment_progress(events: DataFrame) -> DataFrame:
    """Per session and stage: how often it finished, when first, and in which place.

    events: session_id, stage, ordinal.  Stages are few, so ranking them per session is cheap.
    """
    per = events.groupBy("session_id", "stage").agg(F.count(F.lit(1)).alias("finished"), F.min("ordinal").alias("first_ordinal"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("first_ordinal"))
    return per.select("session_id", "stage", "finished", place.alias("place"))
