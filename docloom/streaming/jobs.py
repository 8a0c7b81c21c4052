"""Structured Streaming jobs over request logs, feedback and sessions.

Late rows within ten minutes count; later ones are left out of windows, and stay in the log.
Windows and sessions are given once, when the watermark has passed them, and forgotten;
state by key is dropped when nothing has come for ``TTL_MS``, so no state grows for ever.
Without ``ttl`` it stays: a run over what is there now (``availableNow``) ends only then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import alert_columns, chat_alerts
from ..sources.tables import REQUESTS, as_requests, requests, shared_dir

LATE = "10 minutes"
#: State of a key that nothing has come for in so long is dropped: seven days.
TTL_MS = 7 * 24 * 3600 * 1000


def _kept(state: GroupState, value: tuple, ttl: bool) -> None:
    state.update(value)
    if ttl:
        state.setTimeoutDuration(TTL_MS)


def _timeout(ttl: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout


def _forgotten(state: GroupState) -> bool:
    """Whether this call is only to drop the state of a silent key."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Events as a stream of files, with event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event*.parquet")
    return raw.withColumn("at", F.to_timestamp(F.col("ts").cast("timestamp")))


def minute_counts(events: DataFrame) -> DataFrame:
    """Requests and errors of each minute, in tumbling windows."""
    return (
        events.withWatermark("at", LATE)
        .groupBy(F.window("at", "1 minute"))
        .agg(F.count("*").alias("requests"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
        .select(F.unix_millis("window.start").alias("minute"), "requests", "errors")
    )


def sliding_alerts(events: DataFrame, size: str = "5 minutes", step: str = "1 minute", least: int = 5, error_rate: float = 20.0, p95: float = 60_000.0, model_failure: float = 10.0, no_evidence: float = 40.0) -> DataFrame:
    """Windows of requests but those of test clients, with what ``chat_alert_windows`` watches, and which thresholds raise alerts."""
    log = as_requests(events, "at").filter(F.col("client_type") != "qa")
    got = log.withWatermark("at", LATE).groupBy(F.window("at", size, step)).agg(*alert_columns(F.percentile_approx("duration_ms", 0.95, 10_000)))
    limits = {"error_rate": error_rate, "p95": p95, "model_failure": model_failure, "no_evidence": no_evidence}
    alerts = chat_alerts(F.col("n"), F.col("chats"), limits, least)
    return got.select(F.unix_millis("window.start").alias("start"), "n", "chats", "error_rate", "p95", "model_failure", "no_evidence", alerts.alias("alerts"), (alerts != "").alias("alert"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Summary of each session: a user's events without a longer gap."""
    return (
        events.withWatermark("at", LATE)
        .groupBy(F.session_window("at", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.unix_millis("session_window.start").alias("start"), "events")
    )


def alert_cooldown(alerts: DataFrame, wait_ms: int = 600_000, ttl: bool = True) -> DataFrame:
    """Alerts (alert_key, at_ms) that fire: none within ``wait_ms`` of the last that fired for its key. State: when that was."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        last, fired = (state.get[0] if state.exists else None), []
        for at in sorted(t for batch in batches for t in batch["at_ms"]):
            if last is None or at - last >= wait_ms:
                last = int(at)
                fired.append(last)
        if last is not None:
            _kept(state, (last,), ttl)
        yield pd.DataFrame({"alert_key": [key[0]] * len(fired), "fired_at": fired})

    return alerts.groupBy("alert_key").applyInPandasWithState(fold, "alert_key string, fired_at bigint", "last bigint", "append", _timeout(ttl))


def session_memory(turns: DataFrame, keep: int = 6, ttl: bool = True) -> DataFrame:
    """The last turns of each session (session_id, turn, text), bounded whatever a session's length."""

    def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        held = list(zip(*state.get)) if state.exists else []
        held += [(int(t), str(x)) for batch in batches for t, x in zip(batch["turn"], batch["text"])]
        held = sorted(held)[-keep:]
        _kept(state, ([t for t, _ in held], [x for _, x in held]), ttl)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [len(held)], "last": [held[-1][1]]})

    return turns.groupBy("session_id").applyInPandasWithState(remember, "session_id bigint, turns int, last string", "turn array<bigint>, text array<string>", "update", _timeout(ttl))


def failure_streaks(probes: DataFrame, least: int = 2, ttl: bool = True) -> DataFrame:
    """Services (service, at_ms, ok) that have failed ``least`` times in a row, once a streak."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        run, out = (state.get[0] if state.exists else 0), []
        for at, ok in sorted((int(a), bool(o)) for batch in batches for a, o in zip(batch["at_ms"], batch["ok"])):
            run = 0 if ok else run + 1
            if run == least:
                out.append(at)
        _kept(state, (run,), ttl)
        yield pd.DataFrame({"service": [key[0]] * len(out), "critical_at": out})

    return probes.groupBy("service").applyInPandasWithState(follow, "service string, critical_at bigint", "run int", "append", _timeout(ttl))


def upsert_sink(path: str, key: str, order: str):
    """For ``foreachBatch``: versions of a table of the latest row of each key; each batch writes the next version, so a retried batch writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark, old = batch.sparkSession, f"{path}/v{number - 1}"
        rows = batch if number == 0 else spark.read.parquet(old).unionByName(batch)
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def enriched(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Feedback (a stream) with the product and category of its request, from the log as it is when a batch begins; null where there is none."""
    return feedback.join(log, "request_id", "left")


def first_feedback(feedback: DataFrame) -> DataFrame:
    """The first of equal feedback (request_id, action) within the watermark."""
    return feedback.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["request_id", "action"])


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its rows as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


#: Up to where windows are closed when all events are in, in milliseconds.
MARK = "mark AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS mark FROM events)"

QUERIES = {
    "stream_minutes": (
        lambda s, d: collected(minute_counts(event_stream(s, d)), "stream_minutes"),
        f"WITH {REQUESTS}, {MARK} SELECT completed_at - completed_at % 60000 AS minute, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM requests, mark GROUP BY 1, mark HAVING minute + 60000 <= mark",
    ),
    "stream_sessions": (
        lambda s, d: collected(sessions(event_stream(s, d)), "stream_sessions"),
        f"""WITH {MARK}, e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) // 1000 AS start, count(*) AS events FROM g, mark GROUP BY user_id, k, mark HAVING epoch_us(max(ts)) + 1800000000 <= mark * 1000""",
    ),
    "stream_alerts": (lambda s, d: collected(sliding_alerts(event_stream(s, d)), "stream_alerts"), None),
    "feedback_enriched": (
        lambda s, d: collected(enriched(event_stream(s, d).filter("event_type = 'purchase'").select(F.concat(F.lit("r"), F.col("event_id") - 1).alias("request_id"), F.lit("solved").alias("action")), requests(s, d).select("request_id", "product", "category")), "feedback_enriched"),
        f"WITH {REQUESTS}, f AS (SELECT 'r' || (event_id - 1) AS request_id, 'solved' AS action FROM requests WHERE event_type = 'purchase') SELECT f.request_id, action, product, category FROM f LEFT JOIN requests r ON r.request_id = f.request_id",
    ),
}
