"""Keyed state with two rules, and a bounded set of hot sessions.

Of feedback on a request the last verdict, solved or unsolved, stands, and of each other action the first.
The firsts are state with a time to live, so requests that nothing more comes for are forgotten; of verdicts each batch gives its
last one, which no later batch needs. Of sessions,
the last turns of the most recent ``MOST`` are kept by a sink whose versions a retried batch writes again.

Nulls and ties: feedback without a request or an action is left out. Within a batch rows are taken by time,
then by id; a later batch is later whatever its times. Sessions of equal time go by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import FEEDBACK, REQUESTS, feedback, requests, shared_dir
from .jobs import TTL_MS

#: Actions of which the last one stands.
VERDICTS = ("solved", "unsolved")
#: Sessions that stay, and turns of each.
MOST, TURNS = 500, 6
#: The state store that keyed state with several values needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

STANDING = "request_id string, slot string, action string, created_at bigint"


#: Groups that requests are dealt to by their hash; a group's rows of a batch meet at once, as a call for each request takes longer than its work.
GROUPS = 256


class Standing(StatefulProcessor):
    """What stands for the requests of a group: the last verdict of a batch, and the first of each other action."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getMapState("firsts", "request_id string, action string", "created_at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["created_at", "id", "action"])
        said = came["action"].isin(VERDICTS)
        verdicts = came[said].drop_duplicates("request_id", keep="last")
        others = came[~said].drop_duplicates(["request_id", "action"])
        new = [not self.firsts.containsKey(k) for k in zip(others["request_id"], others["action"], strict=True)]
        others = others[pd.Series(new, others.index, dtype=bool)]
        for request, action, at in zip(others["request_id"], others["action"], others["created_at"], strict=True):
            self.firsts.updateValue((request, action), (int(at),))
        out = pd.concat([others.assign(slot=others["action"]), verdicts.assign(slot="verdict")])
        yield out[["request_id", "slot", "action", "created_at"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def standing_feedback(rows: DataFrame, ttl: bool = True) -> DataFrame:
    """Changes of what stands, as a stream: ``slot`` is ``verdict`` or the action, and the last row of a slot stands.

    With ``ttl`` the stream goes on for ever, as time alone may end state; a run over what is there now is without.
    ``rows`` is a stream of feedback (id, request_id, action, created_at).
    """
    rows.sparkSession.conf.set(*STORE)
    known = rows.filter("request_id IS NOT NULL AND action IS NOT NULL").select("id", "request_id", "action", "created_at")
    return known.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(GROUPS))).groupBy("part").transformWithStateInPandas(Standing(TTL_MS if ttl else None), STANDING, "Update", "ProcessingTime" if ttl else "None")


def slot_sink(path: str):
    """For ``foreachBatch``: changes by batch, so that the last batch of a slot is known."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return write


def standing(spark, path: str) -> DataFrame:
    """What stands: the last change of each slot."""
    rows = spark.read.parquet(f"{path}/batch-*")
    return rows.groupBy("request_id", "slot").agg(F.max_by(F.struct("action", "created_at"), "batch").alias("r")).select("request_id", "slot", "r.*")


def hot_sessions_sink(path: str, most: int = MOST, keep: int = TURNS):
    """For ``foreachBatch``: the last ``keep`` turns (session_id, at, turn, text) of the ``most`` sessions that spoke last.

    Each batch writes the next version from the one before, which has at most ``most`` times ``keep`` rows; what a batch
    has is brought down to as much before the two meet.
    """

    def bounded(rows: DataFrame) -> DataFrame:
        last = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("turn"), "text")
        own = rows.filter("session_id IS NOT NULL").withColumn("k", F.row_number().over(last)).filter(F.col("k") <= keep).drop("k")
        hot = own.groupBy("session_id").agg(F.max("at").alias("updated")).orderBy(F.desc("updated"), "session_id").limit(most)
        return own.join(F.broadcast(hot.select("session_id")), "session_id", "left_semi")  # at most ``most`` rows

    def write(batch: DataFrame, number: int) -> None:
        rows = bounded(batch.select("session_id", "at", "turn", "text"))
        if number:
            rows = bounded(batch.sparkSession.read.parquet(f"{path}/v{number - 1}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def hot_sessions(spark, path: str) -> DataFrame:
    """The sessions of the last version that was written as a whole."""
    number, found = 0, None
    while True:
        try:
            found = spark.read.parquet(f"{path}/v{number}")
        except AnalysisException:
            return found
        number += 1


def _streamed(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table as a stream of files, and the folder that it is in."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in"), path


def _run(stream: DataFrame, sink, path: str, mode: str) -> None:
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _standing(s, d) -> DataFrame:
    stream, path = _streamed(feedback(s, d), "stream-standing")
    before = s.conf.get(STORE[0], None)
    try:
        _run(standing_feedback(stream, ttl=False), slot_sink(f"{path}/out"), path, "update")
    finally:
        s.conf.set(STORE[0], before) if before else s.conf.unset(STORE[0])
    return standing(s, f"{path}/out")


def _hot(s, d) -> DataFrame:
    turns = requests(s, d).select(F.col("session_id"), F.col("completed_at").alias("at"), F.col("event_id").alias("turn"), F.col("event_type").alias("text"))
    stream, path = _streamed(turns, "stream-hot")
    _run(stream, hot_sessions_sink(f"{path}/out", 100), path, "append")
    return hot_sessions(s, f"{path}/out").groupBy("session_id").agg(F.count("*").alias("turns"), F.max("at").alias("updated"), F.max_by("text", F.struct("at", "turn")).alias("last"))


QUERIES = {
    "stream_standing": (
        _standing,
        f"""WITH {FEEDBACK}, k AS (SELECT request_id, CASE WHEN action IN ('solved', 'unsolved') THEN 'verdict' ELSE action END AS slot, action, created_at, id FROM feedback)
        SELECT request_id, slot, CASE WHEN slot = 'verdict' THEN max_by(action, {{'t': created_at, 'i': id}}) ELSE slot END AS action, CASE WHEN slot = 'verdict' THEN max(created_at) ELSE min(created_at) END AS created_at FROM k GROUP BY request_id, slot""",
    ),
    "stream_hot_sessions": (
        _hot,
        f"""WITH {REQUESTS}, h AS (SELECT session_id FROM requests WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY max(completed_at) DESC, session_id LIMIT 100)
        SELECT session_id, least(count(*), {TURNS}) AS turns, max(completed_at) AS updated, max_by(event_type, {{'t': completed_at, 'i': event_id}}) AS last FROM requests WHERE session_id IN (SELECT session_id FROM h) GROUP BY session_id""",
    ),
}
