"""Dashboards, quality rates and alerts over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import FEEDBACK, REQUESTS, feedback, requests, table
from .ranks import nearest_ranks, staged

DAY = 86_400_000
MINUTE = 60_000
UNKNOWN = "unrecognised"


def rate(part: Column, whole: Column) -> Column:
    """Percent to two places, halves upwards, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 10000.0 / whole + 0.5) / 100).otherwise(F.lit(0.0))


def totals(log: DataFrame, since: int | None = None) -> DataFrame:
    """Requests, errors, chats, mean latency and error rate, in one row."""
    log = log if since is None else log.filter(F.col("completed_at") >= since)
    errors = F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0))
    return log.agg(
        F.count("*").alias("total"),
        F.coalesce(errors, F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("category") == "chat", 1).otherwise(0)), F.lit(0)).alias("chats"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
        rate(errors, F.count("*")).alias("error_rate"),
    )


def percentiles(log: DataFrame, by: list[str] = (), exact: bool = True) -> DataFrame:
    """p50, p95 and p99 of the latency by nearest rank, and ``n``.

    Exact ones come from running sums of counts of values, whatever a group's size; ``exact=False`` merges
    sketches of partitions instead.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        return nearest_ranks(log, list(by), "duration_ms", shares)
    return log.groupBy(*by).agg(*(F.percentile_approx("duration_ms", p, 10_000).alias(name) for name, p in shares.items()), F.count("*").alias("n"))


def timeline(log: DataFrame, minutes: int = 60) -> DataFrame:
    """Each of the last minutes before the latest request, also those without any."""
    floor = F.expr(f"completed_at - completed_at % {MINUTE}")
    end = log.agg(F.max(floor).alias("end"))
    late = log.join(F.broadcast(end)).filter(F.col("completed_at") > F.col("end") - minutes * MINUTE)  # only these are added up
    by = late.groupBy(floor.alias("minute")).agg(
        F.count("*").alias("requests"),
        F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("category") == "chat", 1).otherwise(0)).alias("chats"),
        F.avg("duration_ms").alias("avg"),
        F.max("duration_ms").alias("max"),
        *(F.expr(f"percentile_disc(0.{p}) WITHIN GROUP (ORDER BY duration_ms)").alias(f"p{p}") for p in (95, 99)),
    )
    spine = end.select(F.explode(F.sequence(F.col("end") - (minutes - 1) * MINUTE, F.col("end"), F.lit(MINUTE))).alias("minute"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return spine.join(by, "minute", "left").select(
        "minute", *(zero(F.col(c)).alias(c) for c in ("requests", "errors", "chats")), F.round(F.coalesce("avg", F.lit(0.0)), 6).alias("avg_ms"), F.coalesce("max", F.lit(0.0)).alias("max_ms"), *(F.coalesce(p, F.lit(0.0)).alias(f"{p}_ms") for p in ("p95", "p99"))
    )


def latest_resolution(votes: DataFrame) -> DataFrame:
    """The last of solved and unsolved for each request, ties by id."""
    return votes.filter(F.col("action").isin("solved", "unsolved")).groupBy("request_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("resolution"))


def enriched(log: DataFrame, votes: DataFrame) -> DataFrame:
    """Chats with their resolution, transfers and tickets; those of test clients are left out."""
    extra = votes.groupBy("request_id").agg(
        F.max(F.when(F.col("action") == "transfer", 1).otherwise(0)).alias("transferred"), F.max(F.when(F.col("action") == "ticket_submit", 1).otherwise(0)).alias("ticketed")
    )
    chats = log.filter((F.col("category") == "chat") & (F.col("client_type") != "qa"))
    chats = chats.withColumn("product", F.coalesce(F.nullif(F.trim("product"), F.lit("")), F.lit(UNKNOWN)))
    return chats.join(latest_resolution(votes), "request_id", "left").join(extra, "request_id", "left")


def quality(log: DataFrame, votes: DataFrame, rollup: bool = False) -> DataFrame:
    """Consultations, resolutions and failures by product; with ``rollup`` also over all of them."""
    rows = enriched(log, votes)
    grouped = rows.rollup("product") if rollup else rows.groupBy("product")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    solved, unsolved = one(F.col("resolution") == "solved"), one(F.col("resolution") == "unsolved")
    return grouped.agg(
        F.count("*").alias("consultations"),
        solved.alias("solved"),
        unsolved.alias("unsolved"),
        one(F.col("transferred") == 1).alias("transfers"),
        one(F.col("ticketed") == 1).alias("tickets"),
        F.sum("model_failed").alias("model_failures"),
        F.sum("no_evidence").alias("no_evidence"),
        rate(solved, solved + unsolved).alias("solved_rate"),
        rate(F.sum("no_evidence"), F.count("*")).alias("no_evidence_rate"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    ).withColumn("product", F.coalesce("product", F.lit("*")))


#: Path prefixes and categories, in the order of their precedence.
CATEGORIES = [("/api/chat", "chat"), ("/api/chunks", "knowledge_admin"), ("/api/manuals", "knowledge_admin"), ("/api/monitor", "monitor"), ("/api/auth", "auth"), ("/api/", "api"), ("/livez", "health"), ("/page", "page")]


def path_category(path: Column, rules: list[tuple[str, str]] = CATEGORIES) -> Column:
    """The category of the first prefix that a path has, else ``other``."""
    out = None
    for prefix, name in rules:
        hit = F.startswith(path, F.lit(prefix))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def valid_request_id(request_id: Column) -> Column:
    """The id if it is well formed, else a new one."""
    return F.when(request_id.rlike(r"^[A-Za-z0-9._:-]{8,128}$"), request_id).otherwise(F.uuid())


#: What each alert watches, in percent but for the latency.
THRESHOLDS = {"error_rate": 20.0, "p95": 60_000.0, "model_failure": 10.0, "no_evidence": 40.0}
LEAST_SAMPLES = 5


def chat_alerts(n: Column, chats: Column, thresholds: dict, least: int = LEAST_SAMPLES) -> Column:
    """The thresholds that are exceeded: model failures and missing evidence where there are enough chats, the others where there are enough requests."""
    enough = lambda k: (chats if k in ("model_failure", "no_evidence") else n) >= least
    return F.array_join(F.array_compact(F.array(*(F.when(enough(k) & (F.col(k) >= v), F.lit(k)) for k, v in thresholds.items()))), ",")


def chat_alert_windows(log: DataFrame, minutes: int = 5, step: int = 1, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Windows that slide by ``step`` minutes, and which thresholds each exceeds; windows of few samples have none.

    Rates of model failures and missing evidence are over chats alone, and errors are those from status 400 on.
    """
    size, hop = minutes * MINUTE, step * MINUTE
    start = F.explode(F.expr(f"sequence(completed_at - completed_at % {hop} - {size - hop}, completed_at - completed_at % {hop}, {hop})"))
    rows = log.filter(F.col("client_type") != "qa").select(start.alias("start"), "category", "status_code", "duration_ms", "model_failed", "no_evidence")
    got = rows.groupBy("start").agg(*alert_columns(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)")))
    return got.withColumn("alerts", chat_alerts(F.col("n"), F.col("chats"), thresholds))


def alert_columns(p95: Column) -> list[Column]:
    """What a window of requests is watched by."""
    n, chat = F.count("*"), F.col("category") == "chat"
    chats = F.sum(F.when(chat, 1).otherwise(0))
    of_chats = lambda c: rate(F.sum(F.when(chat, F.col(c)).otherwise(0)), chats)
    return [
        n.alias("n"),
        chats.alias("chats"),
        rate(F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)), n).alias("error_rate"),
        p95.alias("p95"),
        of_chats("model_failed").alias("model_failure"),
        of_chats("no_evidence").alias("no_evidence"),
    ]


def cooldown(candidates: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """Alerts (alert_key, at) that fire: not within ``wait_ms`` of the last that fired for the key.

    Each alert points to the first one of its key that may fire after it. The first alert fires, and what
    fires after it is found by doubling pointers: each round adds where the known ones point, and makes pointers reach
    twice as far. So the rounds are the logarithm of how often a key fires. An alert
    finds its next one among those of one stretch of ``wait_ms``, else it is the first of the next stretch that has any:
    of a key only one row for each stretch meets in a task. Nulls are no alerts.
    """
    rows = candidates.select("alert_key", F.col("at").cast("long").alias("at")).filter("alert_key IS NOT NULL AND at IS NOT NULL").distinct()
    stretch = lambda c: F.expr(f"{c} div {wait_ms}")
    alerts = rows.withColumn("stretch", stretch("at"))
    firsts = alerts.groupBy("alert_key", "stretch").agg(F.min("at").alias("first"))
    asked = rows.withColumn("from", F.col("at")).withColumn("at", F.col("at") + wait_ms).withColumn("stretch", stretch("at"))
    both = alerts.select("alert_key", "stretch", "at", F.lit(None).cast("long").alias("from")).unionByName(asked)
    here = Window.partitionBy("alert_key", "stretch").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next", F.min(F.when(F.col("from").isNull(), F.col("at"))).over(here)).filter("from IS NOT NULL")
    steps = firsts.select("alert_key", F.col("stretch").alias("at_stretch"), "first").withColumn("mark", F.lit(0)).unionByName(
        found.filter("next IS NULL").select("alert_key", F.col("stretch").alias("at_stretch"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("mark")).distinct()
    )
    ahead = Window.partitionBy("alert_key").orderBy("at_stretch").rangeBetween(1, Window.unboundedFollowing)
    beyond = steps.withColumn("beyond", F.min("first").over(ahead)).filter("mark = 1").select("alert_key", F.col("at_stretch").alias("stretch"), "beyond")
    jump = found.join(beyond, ["alert_key", "stretch"], "left").select("alert_key", F.col("from").alias("at"), F.coalesce("next", "beyond").alias("to")).filter("to IS NOT NULL")
    jump, fired = staged(jump, "alert-jumps"), staged(rows.groupBy("alert_key").agg(F.min("at").alias("at")), "alert-fired")
    while jump.limit(1).count():
        fired = staged(fired.unionByName(fired.join(jump, ["alert_key", "at"]).select("alert_key", F.col("to").alias("at"))).distinct(), "alert-fired")
        far = jump.select("alert_key", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(far, ["alert_key", "to"]).select("alert_key", "at", F.col("further").alias("to")), "alert-jumps")
    return fired.select("alert_key", F.col("at").alias("fired_at"))


def recent(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The newest k rows; only k of each partition are sorted together."""
    return rows.orderBy(*order).limit(k)


def call_totals(log: DataFrame) -> DataFrame:
    """Calls by channel (the category): successes, failures by kind and mean latency."""
    return log.groupBy("category").agg(
        F.count("*").alias("calls"),
        F.sum(F.when((F.col("status_code") < 400) & (F.col("model_failed") == 0), 1).otherwise(0)).alias("successes"),
        F.sum(F.when(F.col("status_code") >= 500, 1).otherwise(0)).alias("server_errors"),
        F.sum("model_failed").alias("model_failures"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )


def retained(log: DataFrame, days: int) -> DataFrame:
    """Rows of the last days, counted from the newest."""
    newest = log.agg(F.max("completed_at").alias("newest"))
    return log.join(F.broadcast(newest)).filter(F.col("completed_at") >= F.col("newest") - days * DAY).drop("newest")


def upsert(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


RATE = lambda a, b: f"CASE WHEN {b} > 0 THEN floor({a} * 10000.0 / {b} + 0.5) / 100 ELSE 0.0 END"

ENRICHED = (
    FEEDBACK
    + f""", resolution AS (
  SELECT request_id, action AS resolution FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS k FROM feedback WHERE action IN ('solved', 'unsolved')) WHERE k = 1
), extra AS (
  SELECT request_id, max(CAST(action = 'transfer' AS INT)) AS transferred, max(CAST(action = 'ticket_submit' AS INT)) AS ticketed FROM feedback GROUP BY request_id
), enriched AS (
  SELECT r.* EXCLUDE (product), coalesce(nullif(trim(product), ''), '{UNKNOWN}') AS product, resolution, transferred, ticketed FROM requests r LEFT JOIN resolution USING (request_id) LEFT JOIN extra USING (request_id)
  WHERE category = 'chat' AND client_type <> 'qa'
)"""
)
S, U = "count(*) FILTER (resolution = 'solved')", "count(*) FILTER (resolution = 'unsolved')"
QUALITY = f"""count(*) AS consultations, {S} AS solved, {U} AS unsolved, count(*) FILTER (transferred = 1) AS transfers, count(*) FILTER (ticketed = 1) AS tickets,
  CAST(sum(model_failed) AS BIGINT) AS model_failures, CAST(sum(no_evidence) AS BIGINT) AS no_evidence, {RATE(S, f"({S} + {U})")} AS solved_rate, {RATE("sum(no_evidence)", "count(*)")} AS no_evidence_rate, round(avg(duration_ms), 6) AS avg_ms"""

_ALERTS = lambda s, d: chat_alert_windows(requests(s, d), minutes=60, step=10, thresholds={"error_rate": 20.0, "p95": 150.0, "model_failure": 10.0, "no_evidence": 20.0})
ALERTS = f"""w AS (SELECT unnest(range(completed_at - completed_at % 600000 - 3000000, completed_at - completed_at % 600000 + 1, 600000)) AS start, * FROM requests WHERE client_type <> 'qa'
), g AS (SELECT start, count(*) AS n, count(*) FILTER (category = 'chat') AS chats, {RATE("count(*) FILTER (status_code >= 400)", "count(*)")} AS error_rate, quantile_disc(duration_ms, 0.95) AS p95,
  {RATE("count(*) FILTER (category = 'chat' AND model_failed = 1)", "count(*) FILTER (category = 'chat')")} AS model_failure, {RATE("count(*) FILTER (category = 'chat' AND no_evidence = 1)", "count(*) FILTER (category = 'chat')")} AS no_evidence FROM w GROUP BY start
), alerts AS (SELECT *, concat_ws(',', CASE WHEN n >= 5 AND error_rate >= 20 THEN 'error_rate' END, CASE WHEN n >= 5 AND p95 >= 150 THEN 'p95' END, CASE WHEN chats >= 5 AND model_failure >= 10 THEN 'model_failure' END, CASE WHEN chats >= 5 AND no_evidence >= 20 THEN 'no_evidence' END) AS alerts FROM g)"""


def _cooldown(spark, sf_dir):
    rows = _ALERTS(spark, sf_dir).filter("alerts <> ''").select(F.explode(F.split("alerts", ",")).alias("alert_key"), F.col("start").alias("at"))
    return cooldown(rows, 3 * 3_600_000)


QUERIES = {
    "request_totals": (lambda s, d: totals(requests(s, d)), f"""WITH {REQUESTS} SELECT count(*) AS total, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (category = 'chat') AS chats,
      round(avg(duration_ms), 6) AS avg_ms, {RATE("count(*) FILTER (status_code >= 400)", "count(*)")} AS error_rate FROM requests"""),
    "latency_percentiles": (lambda s, d: percentiles(requests(s, d), ["category"]), f"""WITH {REQUESTS} SELECT category, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95,
      quantile_disc(duration_ms, 0.99) AS p99, count(*) AS n FROM requests GROUP BY category"""),
    "minute_timeline": (lambda s, d: timeline(requests(s, d)), f"""WITH {REQUESTS}, m AS (SELECT *, completed_at - completed_at % 60000 AS minute FROM requests), g AS (
      SELECT minute, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (category = 'chat') AS chats, avg(duration_ms) AS a, max(duration_ms) AS x, quantile_disc(duration_ms, 0.95) AS p, quantile_disc(duration_ms, 0.99) AS q FROM m GROUP BY minute
      ), spine AS (SELECT unnest(range(e - 59 * 60000, e + 1, 60000)) AS minute FROM (SELECT max(minute) AS e FROM m))
      SELECT minute, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(chats, 0) AS chats, round(coalesce(a, 0), 6) AS avg_ms, coalesce(x, 0) AS max_ms, coalesce(p, 0) AS p95_ms, coalesce(q, 0) AS p99_ms FROM spine LEFT JOIN g USING (minute)"""),
    "latest_resolution": (lambda s, d: latest_resolution(feedback(s, d)), f"WITH {ENRICHED} SELECT request_id, resolution FROM resolution"),
    "product_quality": (lambda s, d: quality(requests(s, d), feedback(s, d)), f"WITH {ENRICHED} SELECT product, {QUALITY} FROM enriched GROUP BY product"),
    "quality_rollup": (lambda s, d: quality(requests(s, d), feedback(s, d), rollup=True), f"WITH {ENRICHED} SELECT coalesce(product, '*') AS product, {QUALITY} FROM enriched GROUP BY ROLLUP (product)"),
    "request_category": (
        lambda s, d: table(s, d, "pages").select("page_id", path_category(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1), [("/en/1", "a"), ("/en", "b"), ("/fr", "c"), ("/d", "d")]).alias("category")),
        "SELECT page_id, CASE WHEN p LIKE '/en/1%' THEN 'a' WHEN p LIKE '/en%' THEN 'b' WHEN p LIKE '/fr%' THEN 'c' WHEN p LIKE '/d%' THEN 'd' ELSE 'other' END AS category FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)",
    ),
    "chat_alert_windows": (_ALERTS, f"WITH {REQUESTS}, {ALERTS} SELECT * FROM alerts"),
    "alert_cooldown": (_cooldown, f"""WITH RECURSIVE {REQUESTS}, {ALERTS}, c AS (SELECT DISTINCT unnest(string_split(alerts, ',')) AS alert_key, start AS t FROM alerts WHERE alerts <> ''), f(alert_key, fired_at) AS (
      SELECT alert_key, min(t) FROM c GROUP BY alert_key
      UNION ALL
      SELECT alert_key, nxt FROM (SELECT f.alert_key, min(c.t) AS nxt FROM f JOIN c ON c.alert_key = f.alert_key AND c.t >= f.fired_at + 10800000 GROUP BY f.alert_key, f.fired_at))
      SELECT alert_key, fired_at FROM f"""),
    "recent_traces": (lambda s, d: recent(requests(s, d), 80, F.desc("completed_at"), F.desc("event_id")).select("request_id", "completed_at", "category"), f"WITH {REQUESTS} SELECT request_id, completed_at, category FROM requests ORDER BY completed_at DESC, event_id DESC LIMIT 80"),
    "route_calls": (lambda s, d: call_totals(requests(s, d)), f"""WITH {REQUESTS} SELECT category, count(*) AS calls, count(*) FILTER (status_code < 400 AND model_failed = 0) AS successes, count(*) FILTER (status_code >= 500) AS server_errors,
      CAST(sum(model_failed) AS BIGINT) AS model_failures, round(avg(duration_ms), 6) AS avg_ms FROM requests GROUP BY category"""),
    "log_retention": (lambda s, d: retained(requests(s, d), 7).groupBy("category").agg(F.count("*").alias("n")), f"WITH {REQUESTS} SELECT category, count(*) AS n FROM requests WHERE completed_at >= (SELECT max(completed_at) FROM requests) - 7 * 86400000 GROUP BY category"),
    "request_upsert": (
        lambda s, d: upsert(requests(s, d), "session_id", F.desc("completed_at"), F.desc("event_id")).select("session_id", "request_id", "status_code"),
        f"WITH {REQUESTS} SELECT session_id, request_id, status_code FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY completed_at DESC, event_id DESC) AS k FROM requests) WHERE k = 1",
    ),
}
