"""Streams with keyed state and timers: runs that expire, copies that name their first upload, ratings of the last N.

They need the state store that keeps its data outside the heap (``use_state_store``). Times are event times: a state goes
when the watermark passes its timer, so a replay gives the same rows. Each operator has a batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from entityops import constants as C
from entityops.functions.ordering import top_rows

RUN_TTL = "90 days"
RUN_SCHEMA = "run_id string, status string, stage_count long, tool_call_count long, updated_at timestamp, expires_at timestamp"
_KNOWN = ("RUN_STARTED", "STEP_FINISHED", "TOOL_CALL_START", "RUN_FINISHED")


def use_state_store(spark: SparkSession) -> None:
    """Set the state store for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(times: pd.Series) -> pd.Series:
    return (times - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)


def _time(millis: int) -> pd.Timestamp:
    return pd.Timestamp(int(millis), unit="ms")


# --- runs ------------------------------------------------------------------------------------


class _Runs(StatefulProcessor):
    """One value and one timer a run: creation, last lifecycle event, two counters, last update."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "created long, created_ordinal long, last_ordinal long, done boolean, stages long, calls long, updated long")

    def _row(self, run_id: str, state: tuple, status: str | None = None) -> pd.DataFrame:
        created, _, last, done, stages, calls, updated = state
        status = status or ("pending" if last is None else "done" if done else "running")
        return pd.DataFrame(
            {"run_id": [run_id], "status": [status], "stage_count": [stages], "tool_call_count": [calls], "updated_at": [_time(updated)], "expires_at": [_time(created + self.ttl_ms)]}
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.run.get()
        state = None if state is None else tuple(state)
        held = []  # rows before a creation that a later part of the batch may bring; their number is that of one run's events in a batch
        for part in rows:
            part = part.assign(ms=_millis(part["ts"]))
            if state is None:
                made = part[part["type"] == "RUN_CREATED"]
                held.append(part)
                if made.empty:
                    continue
                part, held = pd.concat(held), []
                made = part[part["type"] == "RUN_CREATED"].sort_values("ordinal").iloc[0]
                state = (int(made["ms"]), int(made["ordinal"]), None, False, 0, 0, int(made["ms"]))
                self.handle.registerTimer(state[0] + self.ttl_ms)
            created, first, last, done, stages, calls, updated = state
            live = part[(part["ordinal"] >= first) & (part["ms"] < created + self.ttl_ms) & part["type"].isin(_KNOWN)]
            cycle = live[live["type"].isin(("RUN_STARTED", "RUN_FINISHED"))]
            if len(cycle):
                newest = cycle.assign(end=cycle["type"] == "RUN_FINISHED").sort_values(["ordinal", "end"]).iloc[-1]
                if last is None or (int(newest["ordinal"]), bool(newest["end"])) > (last, done):
                    last, done = int(newest["ordinal"]), bool(newest["end"])
            stages += int((live["type"] == "STEP_FINISHED").sum())
            calls += int((live["type"] == "TOOL_CALL_START").sum())
            if len(live):
                updated = max(updated, int(live["ms"].max()))
            state = (created, first, last, done, stages, calls, updated)
        if state is not None:
            self.run.update(state)
            yield self._row(key[0], state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.run.get()
        if state is not None:
            self.run.clear()
            yield self._row(key[0], tuple(state), "expired")

    def close(self) -> None:
        pass


def expiring_runs(events: DataFrame, ttl: str = RUN_TTL, watermark: str = "1 day") -> DataFrame:
    """Status and counts of created runs; a run goes ``ttl`` after its creation, with a last row of status ``expired``.

    events: run_id (string), ordinal, ts, type. A run exists from its RUN_CREATED; events of other runs, of a smaller ordinal
    than the creation's and from the expiry on are ignored, as are unknown types. A stream drops events older than its watermark,
    needs update mode, and gives a row for each run that a batch touches. A batch gives the last row of each run, as
    of the newest event. Run ids are not used again.
    """
    if events.isStreaming:
        rows = events.select(F.col("run_id").cast("string").alias("run_id"), "ordinal", F.col("ts").cast("timestamp").alias("ts"), "type")
        ttl_ms = int(pd.Timedelta(ttl) / pd.Timedelta(milliseconds=1))
        return rows.withWatermark("ts", watermark).groupBy("run_id").transformWithStateInPandas(_Runs(ttl_ms), RUN_SCHEMA, "Update", "EventTime")
    created = events.where("type = 'RUN_CREATED'").groupBy("run_id").agg(F.min_by("ts", "ordinal").alias("_created"), F.min("ordinal").alias("_first"))
    expires = F.col("_created") + F.expr(f"interval {ttl}")
    now = events.agg(F.max("ts").alias("_now"))  # one row
    joined = created.join(events.where(F.col("type").isin(*_KNOWN)).withColumnRenamed("run_id", "_r"), F.col("run_id") == F.col("_r"), "left")
    live = (F.col("ordinal") >= F.col("_first")) & (F.col("ts") < expires)
    done = F.col("type") == "RUN_FINISHED"
    last = F.max(F.when(live & F.col("type").isin("RUN_STARTED", "RUN_FINISHED"), F.struct("ordinal", done.alias("done"))))
    state = joined.groupBy("run_id", "_created").agg(
        last.alias("_last"), F.count_if(live & (F.col("type") == "STEP_FINISHED")).alias("stage_count"), F.count_if(live & (F.col("type") == "TOOL_CALL_START")).alias("tool_call_count"),
        F.greatest(F.col("_created"), F.max(F.when(live, F.col("ts")))).alias("updated_at"),
    )
    status = F.when(F.col("_last").isNull(), "pending").when(F.col("_last.done"), "done").otherwise("running")
    return state.join(F.broadcast(now)).select(
        "run_id", F.when(F.col("_now") >= expires, "expired").otherwise(status).alias("status"), "stage_count", "tool_call_count", "updated_at", expires.alias("expires_at")
    )


# --- copies ----------------------------------------------------------------------------------


class _Firsts(StatefulProcessor):
    """The id of the first upload of a content, until its time is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "id string, until long")

    def _meets(self, key, part: pd.DataFrame) -> pd.DataFrame:
        """The ids that rows in order of time repeat; a row past the time of the first begins a new one."""
        state = self.first.get()
        id_, until = (None, None) if state is None else tuple(state)
        ms = _millis(part["ts"])
        firsts, done = [], 0
        while done < len(part):
            end = done if until is None else int((ms < until).sum())
            if end <= done:
                if until is not None:
                    self.handle.deleteTimer(until)
                id_, until = str(part["id"].iloc[done]), int(ms.iloc[done]) + self.ttl_ms
                self.first.update((id_, until))
                self.handle.registerTimer(until)
                end = int((ms < until).sum())
            firsts += [id_] * (end - done)
            done = end
        return pd.DataFrame({"id": part["id"], "ts": part["ts"], "content_hash": key[0], "first_id": firsts, "is_duplicate": part["id"].to_numpy() != firsts})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["ts", "place"])  # ids and times of one content in one batch
        yield self._meets(key, whole)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_uploads(uploads: DataFrame, content: Column, key: str = "doc_id", ttl: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(id, ts, content_hash, first_id, is_duplicate): every upload with the id of the first one of its content.

    uploads: the key, ts and content. Only ids, times and hashes reach the state. In a stream the first is the earliest of the
    batch that brought the content; it is forgotten ``ttl`` after its time, and a copy from then on is a first again. In a batch it is
    the earliest of all (equal times: the smallest key), as in ``sources.keyed.exact_duplicates``.
    """
    rows = uploads.select(F.col(key).cast("string").alias("id"), F.col(key).alias("place"), F.col("ts").cast("timestamp").alias("ts"), F.sha2(content, 256).alias("content_hash"))
    if uploads.isStreaming:
        ttl_ms = int(pd.Timedelta(ttl) / pd.Timedelta(milliseconds=1))
        schema = "id string, ts timestamp, content_hash string, first_id string, is_duplicate boolean"
        return rows.withWatermark("ts", watermark).groupBy("content_hash").transformWithStateInPandas(_Firsts(ttl_ms), schema, "Append", "EventTime")
    firsts = rows.groupBy("content_hash").agg(F.min_by("id", F.struct("ts", "place")).alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = rows.join(firsts, "content_hash", "left")
    first = F.coalesce("first_id", "id")
    return met.select("id", "ts", "content_hash", first.alias("first_id"), (first != F.col("id")).alias("is_duplicate"))


# --- ratings ---------------------------------------------------------------------------------


class _LastRatings(StatefulProcessor):
    """The last ``recent`` ratings of a country, as a list, and what they hint at."""

    def __init__(self, connectors: list[str], recent: int, top: int):
        self.connectors, self.recent, self.top = connectors, recent, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getListState("ratings", "ms long, ordinal long, rating string, connectors string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.ratings.get()]
        for part in rows:
            lists = [json.dumps([None if c is None else str(c) for c in (() if x is None else x)]) for x in part["connector_ids"]]
            ratings = [None if pd.isna(r) else r for r in part["rating"]]
            new = zip(_millis(part["ts"]).astype(int).tolist(), part["ordinal"].astype(int).tolist(), ratings, lists)
            kept = sorted([*kept, *new], key=lambda r: r[:2], reverse=True)[: self.recent]
        self.ratings.put(kept)
        counts: dict[str, list[int]] = {}
        for _, _, rating, listed in kept:
            if rating is not None and rating.strip():
                for name in json.loads(listed):
                    n = counts.setdefault(name, [0, 0])
                    n[0] += 1
                    n[1] += rating == "not_helpful"
        last = [r[2] for r in kept[: C.FEEDBACK_MIN_SAMPLES]]
        asked = [(c, *counts.get(c, (0, 0))) for c in self.connectors] + [("country", len(last), sum(r == "not_helpful" for r in last))]
        hints = [(c, 100 * bad // n) for c, n, bad in asked if n >= C.FEEDBACK_MIN_SAMPLES and bad / n >= C.FEEDBACK_NEGATIVE_RATE][: self.top]
        hints += [(None, None)] * (self.top - len(hints))
        yield pd.DataFrame({"country": key[0], "hint_no": range(1, self.top + 1), "subject": [c for c, _ in hints], "percent": pd.array([p for _, p in hints], dtype="Int64")})

    def close(self) -> None:
        pass


def last_feedback_hints(feedback: DataFrame, connectors: list[str], recent: int = 500, top: int = 3) -> DataFrame:
    """(country, hint_no, subject, percent): the hints of each country's exact last ``recent`` ratings; null where there is none.

    feedback: country, rating, connector_ids (array), ts, ordinal; ``connectors`` in the order of their hints. A stream needs
    update mode and gives all ``top`` rows of each country that a batch touches, so that they replace the earlier ones; a task
    holds ``recent`` ratings of a country and one part of the batch. A batch gives the same rows for every country.
    """
    if feedback.isStreaming:
        rows = feedback.select("country", "rating", "connector_ids", F.col("ts").cast("timestamp").alias("ts"), F.col("ordinal").cast("long").alias("ordinal"))
        return rows.groupBy("country").transformWithStateInPandas(_LastRatings(connectors, recent, top), "country string, hint_no int, subject string, percent long", "Update", "None")
    latest = top_rows(feedback, ["country"], [F.col("ts").desc(), F.col("ordinal").desc()], recent, "_age")
    bad = F.col("rating") == "not_helpful"
    places = {c: k for k, c in enumerate(connectors)}
    rated = latest.where(F.trim("rating") != "").select("country", "rating", F.explode("connector_ids").alias("subject")).where(F.col("subject").isin(*connectors))
    last = latest.where(F.col("_age") <= C.FEEDBACK_MIN_SAMPLES).select("country", "rating", F.lit("country").alias("subject"))
    counts = rated.unionByName(last).groupBy("country", "subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in places.items() for x in c]), F.col("subject")), F.lit(len(places))) if places else F.lit(0)
    good = counts.where((F.col("n") >= C.FEEDBACK_MIN_SAMPLES) & (F.col("bad") / F.col("n") >= C.FEEDBACK_NEGATIVE_RATE))
    hints = top_rows(good.withColumn("_o", order), ["country"], [F.col("_o")], top, "hint_no").select("country", "hint_no", "subject", F.floor(F.col("bad") * 100 / F.col("n")).alias("percent"))
    every = feedback.select("country").distinct().select("country", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("hint_no"))
    hints = hints.withColumnsRenamed({"country": "_c", "hint_no": "_n"})
    return every.join(hints, F.col("country").eqNullSafe(F.col("_c")) & (F.col("hint_no") == F.col("_n")), "left").drop("_c", "_n")
