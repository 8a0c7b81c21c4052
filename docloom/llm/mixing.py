"""Mixing sources to target weights by temperature, with DataFrame functions only.

Shares p of the sources' tokens are raised to an exponent a in [0, 1] and normalised:
1 keeps the natural mix, 0 makes it even. The exponent is bisected: to the largest one
whose entropy reaches a target, or to the smallest one under which no source is repeated
more often than a limit. Weights times the budget give each source whole tokens: so many
full passes over the source, then a part of one more, which takes documents in the order
of a permutation of blocks, and of the documents in each block, until the next document
would exceed the source's budget.

A source's documents fall into blocks by a hash of their ids: ``BLOCKS``, and with more
than ``BLOCK_ROWS`` rows for each so many more that this holds. Running sums go over a
source's blocks, then over the rows of one block, so a source of any size is never in one
task.

Nulls, ties and odd tables: a null source counts as the empty string, a null text has no
tokens, and a source without tokens gets one pass. Repeated ids are ordered by tokens, then
by a hash of the text; of rows equal in both any may be the last that is taken. Texts of
any length are counted by the JVM; one longer than its source's rest ends the pass. An empty
table gives no rows. Columns of ``docs`` may have any names: ``mix`` adds its own in place of
those of the same names, ``realised`` gives all back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, staged

BLOCKS, BLOCK_ROWS = 4096, 1 << 16
ROUNDS, WAYS = 8, 16  # each round keeps one of 16 parts: as good as 32 halvings


def tokens(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def block_of(seed: int, doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.conv(F.substring(_hash(F.lit(seed), doc_id), 1, 6), 16, 10).cast("long"), F.lit(blocks))


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent for ``sources`` (source, n_tokens), by one small aggregation a round.

    ``entropy`` is a target in nats. ``repeats`` limits the passes over any source, given
    the budget in tokens or, without one, the least that takes every document once.
    """
    n = sources.agg(F.sum("n_tokens")).first()[0] or 0
    if not n:
        return 1.0
    p = F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.lit(float(n)))

    def fits(a: float) -> list[Column]:
        z = F.sum(F.pow(p, F.lit(a)))
        if entropy is not None:
            return [F.log(z) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z >= entropy]
        if budget is not None:
            return [F.max(F.pow(p, F.lit(a - 1))) / z * F.lit(budget / n) <= repeats]
        return [F.max(F.pow(p, F.lit(a - 1))) / F.min(F.pow(p, F.lit(a - 1))) <= repeats]

    lo, hi = 0.0, 1.0  # entropy: fits from 0 up to some exponent; repeats: from some exponent up to 1
    for _ in range(ROUNDS):
        step = (hi - lo) / WAYS
        got = sources.agg(*(fits(lo + step * i)[0].alias(f"f{i}") for i in range(1, WAYS))).first()
        good = sum(bool(x) for x in got)
        part = good if entropy is not None else WAYS - 1 - good
        lo, hi = lo + step * part, lo + step * (part + 1)
    return lo if entropy is not None else hi


def _mixed(docs: DataFrame, columns: list[str], entropy: float | None = None, repeats: float | None = None, budget: int | None = None, natural_budget: bool = False, seed: int = 7) -> DataFrame:
    """``carried`` (the columns, by place), ``mix_tokens``, ``mix_block``, ``mix_weight``, ``mix_copies`` and ``mix_last`` of each row."""
    many = max(BLOCKS, 1 << max(0, -(-docs.count() // BLOCK_ROWS) - 1).bit_length())
    rows = docs.select(
        F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("carried"),
        F.col("doc_id").alias("mix_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("mix_source"),
        tokens(F.col("text")).alias("mix_tokens"),
        block_of(seed, F.col("doc_id"), many).alias("mix_block"),
        F.xxhash64("text").alias("mix_tie"),
    )
    blocks = staged(rows.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")), "mix-blocks")
    sources = staged(blocks.groupBy(F.col("mix_source").alias("source")).agg(F.sum("block_tokens").alias("n_tokens")), "mix-sources")
    n = sources.agg(F.sum("n_tokens")).first()[0] or 0
    total = n if natural_budget else budget
    a = exponent(sources, entropy, repeats, total)
    share = F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.lit(float(n or 1)))
    powers = sources.agg(F.sum(F.pow(share, F.lit(a))).alias("z"), F.min(F.pow(share, F.lit(a - 1))).alias("least")).first()
    z, least = powers["z"] or 1.0, powers["least"] or 1.0
    if total is None:  # passes of the source that gets fewest: one
        total = n * z / least
    weight = F.pow(share, F.lit(a)) / F.lit(z)
    plan = sources.select(
        F.col("source").alias("mix_source"), "n_tokens", F.coalesce(weight, F.lit(0.0)).alias("mix_weight"), F.round(F.coalesce(weight, F.lit(0.0)) * F.lit(float(total))).cast("long").alias("own")
    ).withColumn("passes", F.when(F.col("n_tokens") > 0, F.expr("own div n_tokens")).otherwise(F.lit(1).cast("long")))
    plan = plan.withColumn("rest", F.when(F.col("n_tokens") > 0, F.expr("own % n_tokens")).otherwise(F.lit(0).cast("long")))

    order = Window.partitionBy("mix_source").orderBy(_hash(F.lit(seed), F.col("passes"), F.col("mix_source"), F.col("mix_block")), "mix_block")
    placed = blocks.join(plan, "mix_source").withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
    placed = placed.select("mix_source", "mix_block", "mix_weight", "passes", "rest", "before")
    inside = Window.partitionBy("mix_source", "mix_block").orderBy(_hash(F.lit(seed), F.col("passes"), F.col("mix_id")), "mix_tokens", "mix_tie")
    upto = F.col("before") + F.sum("mix_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(placed, ["mix_source", "mix_block"]).withColumn("mix_last", (F.col("rest") > 0) & (upto <= F.col("rest")))
    return out.withColumn("mix_copies", F.col("passes") + F.col("mix_last").cast("long")).select("carried", *ADDED)


ADDED = ["mix_tokens", "mix_block", "mix_weight", "mix_copies", "mix_last"]


def _back(columns: list[str], kept: list[str]) -> list[Column]:
    return [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns) if c in kept]


def mix(docs: DataFrame, keep: tuple[str, ...] | None = None, **how) -> DataFrame:
    """The rows of ``docs`` with what the mix takes of them.

    Adds ``mix_tokens``, ``mix_block``, ``mix_weight`` (of the source), ``mix_copies`` and
    ``mix_last`` (whether the part of a pass takes it). ``keep``: the columns to carry,
    without which all are. ``how``: ``entropy`` or ``repeats``, the aim of the exponent;
    ``budget`` in tokens, or ``natural_budget``, as many as there are; ``seed``.
    """
    columns = list(keep or docs.columns)
    return _mixed(docs, columns, **how).select(*_back(columns, [c for c in columns if c not in ADDED]), *ADDED)


def realised(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with the columns of ``docs``."""
    mixed = _mixed(docs, docs.columns, **how).filter("mix_copies > 0")
    return mixed.select("carried", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_pass")).select(*_back(docs.columns, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs, keep=("doc_id", "source"), repeats=2.0, natural_budget=True)
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_copies").alias("copies"), F.col("mix_last").alias("in_last"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS t,
    CAST('0x' || md5('7|' || doc_id)[1:6] AS BIGINT) % {BLOCKS} AS b FROM documents
), s AS (
  SELECT src, CAST(sum(t) AS BIGINT) AS st, st / CAST(sum(sum(t)) OVER () AS DOUBLE) AS p FROM d GROUP BY src
), ps AS (SELECT list(p) AS ps, CAST(sum(st) AS BIGINT) AS n FROM s), bis(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) <= 2.0 AS ok
    FROM bis, ps WHERE i < 32)
), a AS (SELECT hi AS a FROM bis WHERE i = 32), w AS (
  SELECT src, st, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM s, a
), plan AS (
  SELECT src, weight, CAST(round(weight * n) AS BIGINT) // st AS passes, CAST(round(weight * n) AS BIGINT) % st AS rest FROM w, ps
), bt AS (SELECT src, b, CAST(sum(t) AS BIGINT) AS bt FROM d GROUP BY src, b), placed AS (
  SELECT src, b, weight, passes, rest, sum(bt) OVER (PARTITION BY src ORDER BY md5('7|' || passes || '|' || src || '|' || b), b) - bt AS before FROM bt JOIN plan USING (src)
)
SELECT doc_id, source, t AS n_tokens, round(weight, 9) AS weight, passes + CAST(in_last AS BIGINT) AS copies, in_last FROM (
  SELECT d.*, weight, passes, rest > 0 AND before + sum(t) OVER (PARTITION BY src, b ORDER BY md5('7|' || passes || '|' || doc_id), t ROWS UNBOUNDED PRECEDING) <= rest AS in_last
  FROM d JOIN placed USING (src, b))
"""
