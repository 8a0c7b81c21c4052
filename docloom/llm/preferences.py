"""Chat formatting: preference pairs.

Chosen and rejected conversations share a beginning: the longest common prefix of turns is
found and rendered once, as the prompt; what follows of either is its completion. A mask
says which characters of a completion are trained on: those of assistant turns.

Turns are compared by role and text, null as the empty string. Equal conversations have
empty completions and ``identical`` set. All work is on one pair's two arrays, so no row
is compared with others and nothing depends on how many conversations are alike.

Nulls, ties and odd tables: null roles and texts are empty, turns without a number come
first, and repeated turns stay, ordered by role, then text. Conversations without an id are one. An empty table gives no
rows. All turns of a conversation meet in one row, which is what a pair is; a long text stays
in the JVM. Other columns of the turns are left aside, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before and after a turn's text.
HEAD, MID, TAIL = "<|", "|>\n", "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per conv_id with its ``turns``, an array of (role, text) in the order of turns.

    Repeated turns stay, ordered by role, then text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return conversations.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def self_negatives(conversations: DataFrame) -> DataFrame:
    """Pairs made from single conversations: in the rejected one the first half of the last
    assistant turn's characters stands for the whole turn, so the answer breaks off.

    Conversations without an assistant turn are left as they are.
    """
    rows = turns_of(conversations)
    last = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0), lambda acc, i: F.when(F.element_at("turns", i)["role"] == "assistant", i).otherwise(acc))
    rows = rows.withColumn("last", last)
    cut = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))).otherwise(t["text"]).alias("text")),
    )
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), cut.alias("rejected"))


def _render(turns: Column) -> Column:
    each = F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MID), t["text"], F.lit(TAIL)))
    return F.array_join(each, "")


def _mask(turns: Column) -> Column:
    """Runs of characters, trained or not: ``0:17,1:250,...``."""
    head = len(HEAD + MID)
    runs = F.transform(
        turns,
        lambda t: F.when(t["role"] == "assistant", F.concat(F.lit("0:"), F.length(t["role"]) + head, F.lit(",1:"), F.length(t["text"]) + len(TAIL))).otherwise(
            F.concat(F.lit("0:"), F.length(t["role"]) + F.length(t["text"]) + head + len(TAIL))
        ),
    )
    return F.array_join(runs, ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected, each an array of (role, text)) as prompt and masked completions."""
    size = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    rows = pairs.withColumn("n_shared", F.when(first > 0, first - 1).otherwise(size).cast("int"))
    rest = lambda name: F.slice(F.col(name), F.col("n_shared") + 1, F.greatest(F.size(name), F.lit(1)))
    return rows.select(
        "pair_id",
        "n_shared",
        _render(F.slice(F.col("chosen"), F.lit(1), F.col("n_shared"))).alias("prompt"),
        _render(rest("chosen")).alias("chosen"),
        _mask(rest("chosen")).alias("chosen_mask"),
        _render(rest("rejected")).alias("rejected"),
        _mask(rest("rejected")).alias("rejected_mask"),
        ((F.col("n_shared") == F.size("chosen")) & (F.col("n_shared") == F.size("rejected"))).alias("identical"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return format_pairs(self_negatives(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql(turns: str) -> tuple[str, str]:
    text = f"coalesce(list_aggregate(list_transform({turns}, lambda t: '{HEAD}' || t.role || '{MID[:-1]}' || chr(10) || t.text || '{TAIL[:-1]}' || chr(10)), 'string_agg', ''), '')"
    mask = (
        f"coalesce(list_aggregate(list_transform({turns}, lambda t: CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8) "
        "ELSE '0:' || (length(t.role) + length(t.text) + 13) END), 'string_agg', ','), '')"
    )
    return text, mask


ORACLE = f"""
WITH t AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS chosen FROM conversations GROUP BY conv_id
), l AS (
  SELECT *, coalesce(list_max(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role = 'assistant')), 0) AS last FROM t
), r AS (
  SELECT conv_id, chosen, list_transform(chosen, lambda t, i: CASE WHEN i = last THEN struct_pack(role := t.role, text := substr(t.text, 1, CAST(length(t.text) // 2 AS BIGINT))) ELSE t END) AS rejected FROM l
), p AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS INT) AS n_shared FROM r
)
SELECT conv_id AS pair_id, n_shared, {_sql("chosen[1:n_shared]")[0]} AS prompt, {_sql("chosen[n_shared + 1:]")[0]} AS chosen, {_sql("chosen[n_shared + 1:]")[1]} AS chosen_mask,
  {_sql("rejected[n_shared + 1:]")[0]} AS rejected, {_sql("rejected[n_shared + 1:]")[1]} AS rejected_mask, n_shared = len(chosen) AS identical FROM p
"""
