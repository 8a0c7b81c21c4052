"""The tables of a data folder, and the roles that they take in the library's queries."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a timestamp as written, whatever the session's time zone."""
    written = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz").cast("string")
    return F.unix_millis(F.to_timestamp(F.concat(written, F.lit("Z"))))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: one row per request."""
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(events: DataFrame, *keep: str) -> DataFrame:
    """The request log's columns of events (a table or a stream), and the columns to ``keep``."""
    return events.select(
        F.concat(F.lit("r"), F.col("event_id")).alias("request_id"),
        epoch_ms("ts").alias("completed_at"),
        F.col("user_id").alias("session_id"),
        F.when(F.col("event_type").isin("view", "click"), "chat").otherwise(F.col("event_type")).alias("category"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("user_id") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit("p"), F.col("user_id") % 10)).alias("product"),
        F.when(F.col("event_id") % 11 == 0, 1).otherwise(0).alias("model_failed"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("no_evidence"),
        F.when(F.col("user_id") % 13 == 0, "qa").otherwise("web").alias("client_type"),
        "event_type",
        "event_id",
        *keep,
    )


REQUESTS = """requests AS (
  SELECT 'r' || event_id AS request_id, epoch_us(ts) // 1000 AS completed_at, user_id AS session_id, CASE WHEN event_type IN ('view', 'click') THEN 'chat' ELSE event_type END AS category,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms, CASE WHEN user_id % 10 = 0 THEN '  ' ELSE 'p' || (user_id % 10) END AS product,
    CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS model_failed, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS no_evidence,
    CASE WHEN user_id % 13 = 0 THEN 'qa' ELSE 'web' END AS client_type, event_type, event_id FROM events
)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events of a session as feedback on its latest chat before them (an as-of match by a window)."""
    r = requests(spark, sf_dir)
    last = "last_value(CASE WHEN event_type = 'click' THEN request_id END) IGNORE NULLS OVER (PARTITION BY session_id ORDER BY completed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    action = F.when(F.col("event_type") == "purchase", "solved").when(F.col("event_type") == "signup", "unsolved").when(F.col("event_type") == "error", "transfer")
    return (
        r.withColumn("about", F.expr(last))
        .withColumn("action", F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "ticket_submit").otherwise(action))
        .filter("action IS NOT NULL AND about IS NOT NULL")
        .select(F.col("event_id").alias("id"), F.col("about").alias("request_id"), "action", F.col("completed_at").alias("created_at"))
    )


FEEDBACK = (
    REQUESTS
    + """, feedback AS (
  SELECT event_id AS id, about AS request_id, action, completed_at AS created_at FROM (
    SELECT *, last_value(CASE WHEN event_type = 'click' THEN request_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY completed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS about,
      CASE event_type WHEN 'purchase' THEN 'solved' WHEN 'signup' THEN 'unsolved' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'ticket_submit' ELSE 'transfer' END END AS action FROM requests
  ) WHERE action IS NOT NULL AND about IS NOT NULL
)"""
)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents as sections, numbered from 0 in each document, without a shuffle.

    The heading is the line up to its first full stop, at most 60 characters.
    """
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    s = d.select("doc_id", F.col("source").alias("product"), "lang", F.posexplode(lines).alias("section_id", "text"))
    return s.withColumn("heading", F.substring(F.substring_index("text", ".", 1), 1, 60)).withColumn("char_len", F.length("text"))


SECTIONS = """sections AS (
  SELECT doc_id, product, lang, CAST(i - 1 AS INT) AS section_id, ls[i] AS text, substr(split_part(ls[i], '.', 1), 1, 60) AS heading, CAST(length(ls[i]) AS INT) AS char_len FROM (
    SELECT doc_id, source AS product, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) t
)"""
