"""Conversations: memory, context packets, follow-up questions, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import REQUESTS, requests, table

#: What a follow-up question begins with or hangs on.
FOLLOW_UP = r"(?i)^(?:it|that|this|and|or|then|why|also)\b|\b(?:above|previous|again)\b|它|这个|那个|上面|刚才"
CONSTRAINT = r"只|仅|不要|不得|必须|务必|(?i:\bonly\b|\bmust\b|\bdo not\b|\bwithout\b)"
MODEL = r"\b([A-Z]{2,6}-?\d{2,6}[A-Z]{0,3})\b"


def conversation_list(messages: DataFrame, owner: str, newest: int = 100) -> DataFrame:
    """Messages of each conversation and the newest conversations of each owner (owner, conv_id, at)."""
    per = messages.groupBy(owner, "conv_id").agg(F.count("*").alias("messages"), F.max("at").alias("updated"))
    w = Window.partitionBy(owner).orderBy(F.desc("updated"), "conv_id")
    return per.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= newest)


def last_turns(turns: DataFrame, n: int = 6, key: str = "conv_id") -> DataFrame:
    """The last n turns of each session."""
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def carried(turns: DataFrame, value: str, key: str = "session_id", *order: str) -> DataFrame:
    """Each turn with the last ``value`` before it in its session, nulls passed over."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def follow_up(turns: DataFrame, limit: int = 220) -> DataFrame:
    """User turns with the retrieval query: a follow-up gets the latest full question before it in front."""
    asked = turns.filter("role = 'user'").withColumn("is_follow_up", F.col("text").rlike(FOLLOW_UP) | (F.length("text") < 40))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    full = F.last(F.when(~F.col("is_follow_up"), F.col("text")), ignorenulls=True).over(w)
    rows = asked.withColumn("before", F.when(F.col("is_follow_up"), full))
    return rows.select("conv_id", "turn", "is_follow_up", F.concat_ws(" ", F.substring("before", 1, limit), "text").alias("query"))


def turn_summary(turns: DataFrame, n: int = 6, most: int = 1200) -> DataFrame:
    """One text per session of its last turns, each clipped."""
    clip = F.concat_ws(": ", "role", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 160))
    rows = last_turns(turns, n).select("conv_id", F.struct("turn", clip.alias("line")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"])
    return rows.groupBy("conv_id").agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("summary"))


def inferred(turns: DataFrame, value: str, back: int = 4) -> DataFrame:
    """Each turn with the latest ``value`` of up to ``back`` earlier turns."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    return turns.withColumn("inferred", F.last(value, ignorenulls=True).over(w))


def context_packet(turns: DataFrame, recent: int = 8, most: int = 8) -> DataFrame:
    """One bounded packet per conversation as JSON: model named last, constraints of the user, recent turns, and a hint."""
    user = F.col("role") == "user"
    kept = turns.filter(F.col("role").isin("user", "assistant"))
    rows = kept.withColumn("model", F.when(user, F.nullif(F.regexp_extract("text", MODEL, 1), F.lit(""))))
    clauses = F.filter(F.split("text", r"[。；;.!?！？\n]+"), lambda c: c.rlike(CONSTRAINT))
    rows = rows.withColumn("constraints", F.when(user, F.transform(clauses, lambda c: F.trim(c))).otherwise(F.expr("CAST(array() AS array<string>)")))
    per = rows.groupBy("conv_id").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("turn"))).alias("model"),
        F.array_sort(F.collect_list(F.struct("turn", "constraints"))).alias("said"),
        F.array_sort(F.collect_list(F.struct("turn", "role", F.substring("text", 1, 260).alias("text")))).alias("turns"),
    )
    limits = F.slice(F.array_distinct(F.flatten(F.transform("said", lambda s: s["constraints"]))), 1, most)
    last = F.when(F.size("turns") > recent, F.slice("turns", -recent, recent)).otherwise(F.col("turns"))
    hint = F.when(F.exists(limits, lambda c: c.rlike("不要重新检索|只根据上一轮|(?i:\\bdo not search\\b)")), "history_only").otherwise("auto")
    return per.select("conv_id", F.to_json(F.struct(F.lit(1).alias("version"), "model", limits.alias("user_constraints"), last.alias("recent_turns"), hint.alias("retrieval_hint"))).alias("packet"))


def stale_guests(users: DataFrame, conversations: DataFrame, cutoff) -> DataFrame:
    """Users (user_id, created_at) without activity since the cutoff: the latest of their conversations, or their creation."""
    last = conversations.groupBy("user_id").agg(F.max("updated_at").alias("updated_at"))
    return users.join(last, "user_id", "left").filter(F.coalesce("updated_at", "created_at") < cutoff)


def merged_traces(old: DataFrame, new: DataFrame) -> DataFrame:
    """Audit traces (request_id, path, item_key, value): later values win unless they are empty."""
    n = new.select("request_id", "path", "item_key", F.col("value").alias("later"))
    return old.join(n, ["request_id", "path", "item_key"], "full_outer").select("request_id", "path", "item_key", F.coalesce(F.nullif("later", F.lit("")), "value").alias("value"))


def _turns(s, d):
    return table(s, d, "conversations")


def _follow_sql(text: str) -> str:
    return rf"(regexp_matches({text}, '(?i)^(?:it|that|this|and|or|then|why|also)\b|\b(?:above|previous|again)\b|它|这个|那个|上面|刚才') OR length({text}) < 40)"


QUERIES = {
    "conversation_list": (
        lambda s, d: conversation_list(_turns(s, d).select((F.col("conv_id") % 7).alias("user_id"), "conv_id", F.col("turn").alias("at")), "user_id", 5),
        "WITH g AS (SELECT conv_id % 7 AS user_id, conv_id, count(*) AS messages, max(turn) AS updated FROM conversations GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, conv_id) AS place FROM g) SELECT * FROM k WHERE place <= 5",
    ),
    "last_turns": (lambda s, d: last_turns(_turns(s, d)).select("conv_id", "turn", "back"), "SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6"),
    "carry_product": (
        lambda s, d: carried(requests(s, d).withColumn("value", F.when(F.col("category") == "chat", F.concat("product", F.col("event_id") % 3))), "value", "session_id", "completed_at", "event_id").select("request_id", "carried"),
        f"WITH {REQUESTS}, v AS (SELECT *, CASE WHEN category = 'chat' THEN product || (event_id % 3) END AS value FROM requests) SELECT request_id, last_value(value IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY completed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM v",
    ),
    "followup_rewrite": (
        lambda s, d: follow_up(_turns(s, d)),
        f"""WITH u AS (SELECT *, {_follow_sql("text")} AS f FROM conversations WHERE role = 'user'), l AS (SELECT *, last_value(CASE WHEN NOT f THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u)
        SELECT conv_id, turn, f AS is_follow_up, CASE WHEN f AND b IS NOT NULL THEN substr(b, 1, 220) || ' ' || text ELSE text END AS query FROM l""",
    ),
    "turn_summary": (
        lambda s, d: turn_summary(_turns(s, d)),
        r"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, substr(string_agg(role || ': ' || substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 160), chr(10) ORDER BY turn), 1, 1200) AS summary FROM k WHERE back <= 6 GROUP BY conv_id""",
    ),
    "inferred_context": (
        lambda s, d: inferred(_turns(s, d).withColumn("value", F.nullif(F.regexp_extract("text", r"(?:^|\s)([A-Z][a-z]{6,})\s", 1), F.lit(""))), "value").select("conv_id", "turn", "inferred"),
        r"WITH v AS (SELECT *, nullif(regexp_extract(text, '(?:^|\s)([A-Z][a-z]{6,})\s', 1), '') AS value FROM conversations WHERE true) SELECT conv_id, turn, last_value(value IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS inferred FROM v",
    ),
    "context_packet": (lambda s, d: context_packet(_turns(s, d)), None),
    "guest_retention": (
        lambda s, d: stale_guests(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("1995-06-01").alias("created_at")), table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at")), "1998-01-01").select("user_id", F.coalesce("updated_at", "created_at").alias("last_seen")),
        "WITH l AS (SELECT o_custkey, max(strftime(o_orderdate, '%Y-%m-%d')) AS u FROM orders GROUP BY 1) SELECT c_custkey AS user_id, coalesce(u, '1995-06-01') AS last_seen FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE coalesce(u, '1995-06-01') < '1998-01-01'",
    ),
    "audit_merge": (
        lambda s, d: merged_traces(
            requests(s, d).filter("status_code = 200").select("request_id", F.lit("p").alias("path"), F.col("category").alias("item_key"), F.col("product").alias("value")),
            requests(s, d).filter("duration_ms > 20").select("request_id", F.lit("p").alias("path"), F.col("category").alias("item_key"), F.trim("product").alias("value")),
        ),
        f"WITH {REQUESTS} SELECT coalesce(o.request_id, n.request_id) AS request_id, 'p' AS path, coalesce(o.category, n.category) AS item_key, coalesce(nullif(trim(n.product), ''), o.product) AS value FROM (SELECT * FROM requests WHERE status_code = 200) o FULL JOIN (SELECT * FROM requests WHERE duration_ms > 20) n ON o.request_id = n.request_id",
    ),
}
