"""A table of the latest row of each key that a stream keeps, by deltas.

A batch writes only its own latest rows, under its number, over what an earlier attempt at it left. ``compact`` merges
the deltas so far into a new base and then notes up to which batch it goes; until that row stands, the old base counts. Readers take the
base and the deltas behind it. So a batch costs what it brings, not what the table has, and a base is never changed.

Nulls and ties: rows without a key are left out. Of rows of equal order the later batch wins, and within a batch the one
whose columns sort last. A null order is before all others.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import REQUESTS, requests, shared_dir
from .state import _run, _streamed

NOTES = "base bigint, upto bigint"


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last by order, then by batch; ``rows`` has ``_batch``."""
    others = [c for c in rows.columns if c != "_batch"]
    last = F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), "_batch", F.struct(*others).alias("row")))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(last.alias("r")).select("r.row.*", "r._batch")


def delta_sink(path: str, key: str, order: str):
    """For ``foreachBatch``: the batch's latest row of each key, as its number's delta."""

    def write(batch: DataFrame, number: int) -> None:
        _latest(batch.withColumn("_batch", F.lit(number).cast("long")), key, order).write.mode("overwrite").parquet(f"{path}/delta-{number}")

    return write


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    try:
        r = spark.read.schema(NOTES).parquet(f"{path}/notes").agg(F.max(F.struct("upto", "base")).alias("r")).first().r
    except AnalysisException:
        r = None
    return (r.base, r.upto) if r else (-1, -1)


def _rows(spark: SparkSession, path: str, key: str, order: str) -> DataFrame | None:
    base, upto = _state(spark, path)
    try:
        new = spark.read.parquet(f"{path}/delta-*").filter(F.col("_batch") > upto)
    except AnalysisException:
        return None
    return _latest(new if base < 0 else spark.read.parquet(f"{path}/base-{base}").unionByName(new), key, order)


def upserted(spark: SparkSession, path: str, key: str, order: str) -> DataFrame | None:
    """The latest row of each key of all batches so far; None before the first."""
    rows = _rows(spark, path, key, order)
    return rows if rows is None else rows.drop("_batch")


def compact(spark: SparkSession, path: str, key: str, order: str) -> int:
    """Merge the deltas so far into a new base; gives the last batch in it."""
    base, upto = _state(spark, path)
    rows = _rows(spark, path, key, order)
    last = None if rows is None else spark.read.parquet(f"{path}/delta-*").agg(F.max("_batch")).first()[0]
    if last is None or last <= upto:
        return upto
    rows.write.mode("overwrite").parquet(f"{path}/base-{base + 1}")
    spark.createDataFrame([(base + 1, last)], NOTES).coalesce(1).write.mode("append").parquet(f"{path}/notes")
    return last


def _sessions(s, d) -> DataFrame:
    """The last request of each session, by a stream of files in several batches with a merge between."""
    rows = requests(s, d).select("session_id", "request_id", "status_code", F.struct("completed_at", "event_id").alias("at"))
    path = f"{shared_dir(s)}/stream-upserts-{uuid.uuid4().hex}"
    for part in (0, 1):
        stream, _ = _streamed(rows.filter(F.pmod(F.col("at.event_id"), F.lit(2)) == part), "stream-upsert-rows")
        sink = delta_sink(path, "session_id", "at")
        _run(stream, lambda batch, number, part=part: sink(batch, 1000 * part + number), f"{path}/run-{part}", "append")
        if not part:
            compact(s, path, "session_id", "at")
    return upserted(s, path, "session_id", "at").select("session_id", "request_id", "status_code")


QUERIES = {
    "stream_upserts": (
        _sessions,
        f"WITH {REQUESTS} SELECT session_id, request_id, status_code FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY completed_at DESC, event_id DESC) AS k FROM requests) WHERE k = 1",
    ),
}
