"""Rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one
failure bit per rule; a policy is a mask over the bits, so policies of any version, and
what each rule alone costs a policy, follow from the stored bits without the texts.

Nulls, ties and odd tables: null and empty texts have no words, so the rule on too few
words fails. Repeated rows are judged one by one, equal lines and windows count from the
second, or all of them, as the measure says; a text of any length is measured as a whole, at some
forty bytes for each of its own. An empty table gives no rows. Other columns pass through
by place and may have any names; those of the ledger's own names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import SPACE, beside, binary_array, lookup, packed, per_row, slices, text_bytes, words

SYMBOLS = lookup(b"#*$%&|<>")
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _rules() -> list[tuple[str, Column]]:
    """Name and failure of each rule; a rule's place is its bit, so new rules go to the end."""
    words_, chars, symbols, lines, dups, repeats = map(F.col, MEASURES)
    return [
        ("few_words", words_ < 20),
        ("repeated_words", 100 * repeats > 30 * words_),
        ("many_symbols", 100 * symbols > 40 * words_),
        ("repeated_lines", (lines > 2) & (100 * dups > 60 * lines)),
        ("short_words", chars < 2 * words_),
        ("long_words", chars > 25 * words_),
    ]


RULES = ["few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words"]

#: Policies by version: the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols", "repeated_lines"],
    "v2": RULES,
}


def mask(rules: list[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _groups(ids: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values."""
    return np.unique(ids, return_inverse=True)[1]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of a column."""
    data, off = text_bytes(texts)
    n = len(off) - 1
    is_word = ~SPACE[data]
    starts, _, row = words(data, off, is_word)
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_row(is_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_row(SYMBOLS[data], off),
    }

    newline = data == 10
    line_starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(newline) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    gone = np.zeros(len(data) + 1, np.int64)
    np.cumsum(newline, out=gone[1:])
    lines = binary_array(data[~newline], np.append(line_starts - gone[line_starts], len(data) - gone[-1]))
    has_word = per_row(is_word, np.append(line_starts, len(data))) > 0
    line_row = (np.searchsorted(off, line_starts, "right") - 1)[has_word]
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[has_word]
    seen = np.unique(line_row * (len(lines) + 1) + ids) // (len(lines) + 1)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(seen, minlength=n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    end = np.cumsum(out["n_words"])[row] if len(row) else row
    whole = np.flatnonzero(np.arange(len(row)) + WINDOW <= end)
    if len(whole):
        rank = packed(data, is_word, starts).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        step = 1
        while step < WINDOW:  # equal numbers, equal runs of 2, 4, 8 words
            rank = _groups(rank[:-step] * (len(row) + 1) + rank[step:])
            step *= 2
        key = row[whole] * (len(row) + 1) + rank[whole]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = whole[count[back] > 1]
        change = np.zeros(len(row) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=n)
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the measurements and ``bits``, where bit i is set if rule i fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part in slices(batches, "judged"):
            found = measure(part.column("judged"))
            yield part, [pa.array(found[m], pa.int64()) for m in MEASURES]

    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(_rules()):
        bits = bits + F.when(failed, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return beside(docs.drop("bits"), text, {m: LongType() for m in MEASURES}, run).withColumn("bits", bits)


def passes(policy: str, bits: str = "bits") -> Column:
    """Whether a document passes a policy, from its stored bits alone."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents kept with it, without the rule, and failed by this rule alone.

    The ledger is first counted by bits, at most 2 ** rules rows however many documents there are.
    """
    counts = rows.groupBy("bits").count()
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("all"), F.lit(mask([r])).cast("long").alias("one"))
        for p, rules in POLICIES.items()
        for r in rules
    ]
    each = counts.select("bits", "count", F.explode(F.array(*cases)).alias("c")).select("bits", "count", "c.*")
    hit = F.col("bits").bitwiseAND(F.col("all"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit == 0, F.col("count")).otherwise(0)).alias("kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not("one")) == 0, F.col("count")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(hit == F.col("one"), F.col("count")).otherwise(0)).alias("failed_alone"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.col("bits").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes("v2")).alias("kept"), "n_lines", "bits"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) t
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again WHERE m > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines > 2 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits FROM b
"""
