"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All
but the last return the columns of ``documents``; what a stage decides is gone from its
result: rejected documents, copies, repeated passages, and what the mix leaves out.

Nulls, ties and odd tables: a null or empty text fails the quality rules. Repeated ids are
documents of their own in every stage. Other columns go by place through all stages, so they
may have any names and come out as they went in; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bag_minhash, mixing, phrase_dedup, quality_rules, sentencepiece
from docloom.llm.common import discard, named, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def packed(docs: DataFrame) -> DataFrame:
    """The documents with all columns but doc_id and text in one, by place, so that no name can clash with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(others))).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    at = {c: f"rest.c{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    return rows.select(*(F.col(at.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy of quality rules."""
    return unpacked(quality_rules.ledger(packed(docs)).filter(quality_rules.passes("v2")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates (a null id is the largest)."""
    first = bag_minhash.near_duplicates(packed(docs), carry=("text", "rest")).filter("is_first")
    return unpacked(first, docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; bytes of characters that were cut go, and ``n_chars`` is counted anew.

    Documents of which nothing is left are gone.
    """
    kept = phrase_dedup.dedup(packed(docs), keep="text", carry=("rest",)).filter("n_bytes = 0 OR n_bytes > n_removed")
    return unpacked(kept, docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature that repeats none more than twice; the budget takes every document at least once."""
    return mixing.realised(docs, repeats=2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return sentencepiece.encode(docs).select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenize),
]

#: The second, third and fifth stage can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{i + 1}")
        if i:  # nothing reads the stage before again
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
