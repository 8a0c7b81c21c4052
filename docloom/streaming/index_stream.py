"""New manuals to an index: postings that a file stream keeps.

Each batch writes the postings of its documents under its number, over what an earlier attempt
at the same batch may have left, and so becomes pending. ``build`` merges pending batches into a new
base and then notes up to which batch it goes; only with that row does the base count. Readers take
the base and, of the batches behind it, what is pending: a document's newest batch wins, by a join on
documents, which are few beside postings. A base and its note are never changed, so a stream or a merge
that dies is done again, and any number of restarts give the postings of one pass over all files.

Nulls and ties: null texts are documents without words. A document that comes again replaces its
former self; twice in one batch, the text that sorts last stays. Documents without an id are left out.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.tables import shared_dir

POSTINGS = "batch bigint, doc_id bigint, token string, tf bigint"
DOCS = "batch bigint, doc_id bigint, dl int"
BASES = "base bigint, upto bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def delta_sink(root: str):
    """For ``foreachBatch``: the postings of a batch of documents (doc_id, text), as its number's delta."""

    def write(batch: DataFrame, number: int) -> None:
        one = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"))
        docs = batch.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")
        words = F.size(R.T.words(F.coalesce("text", F.lit("")))).alias("dl")
        at = F.lit(number).cast("long").alias("batch")
        R.postings(docs).select(at, "doc_id", "token", "tf").write.mode("overwrite").parquet(f"{root}/postings/delta-{number}")
        docs.select(at, "doc_id", words).write.mode("overwrite").parquet(f"{root}/docs/delta-{number}")  # last: a delta counts once its documents stand

    return write


def follow(docs: DataFrame, root: str):
    """Start the stream of ``docs`` over what is there now; it goes on where it stopped."""
    return docs.writeStream.foreachBatch(delta_sink(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def _base(spark: SparkSession, root: str) -> tuple[int, int]:
    """The base that counts and the last batch in it; -1 and -1 without one."""
    r = _read(spark, f"{root}/bases", BASES).agg(F.max(F.struct("upto", "base")).alias("r")).first().r
    return (r.base, r.upto) if r else (-1, -1)


def _delta(spark: SparkSession, root: str, kind: str, schema: str, after: int) -> DataFrame:
    return _read(spark, f"{root}/{kind}/delta-*", schema).filter(F.col("batch") > after)


def state(spark: SparkSession, root: str) -> DataFrame:
    """``batch``, ``docs`` and whether it is ``built`` or ``pending``, of all batches that had documents."""
    _, upto = _base(spark, root)
    counts = _read(spark, f"{root}/docs/delta-*", DOCS).groupBy("batch").agg(F.count("*").alias("docs"))
    return counts.select("batch", "docs", F.when(F.col("batch") <= upto, "built").otherwise("pending").alias("state"))


def _merged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, documents, and the last batch as one row, of base and pending batches together."""
    base, upto = _base(spark, root)
    old_docs, old_postings = (_read(spark, f"{root}/base-{base}/{kind}", schema) for kind, schema in (("docs", DOCS), ("postings", POSTINGS)))
    new_docs, new_postings = (_delta(spark, root, kind, schema, upto) for kind, schema in (("docs", DOCS), ("postings", POSTINGS)))
    newest = new_docs.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("dl", "batch").alias("dl"))
    live = newest.select("doc_id", "batch")
    kept = old_postings.join(live.select("doc_id"), "doc_id", "left_anti").select("batch", "doc_id", "token", "tf")
    postings = kept.unionByName(new_postings.join(live, ["doc_id", "batch"], "left_semi"))
    docs = old_docs.join(live.select("doc_id"), "doc_id", "left_anti").unionByName(newest)
    return postings, docs, new_docs.agg(F.max("batch").alias("last"))


def build(spark: SparkSession, root: str) -> int:
    """Merge what is pending into a new base; gives the last batch in it. Without anything pending nothing is done."""
    base, upto = _base(spark, root)
    postings, docs, last = _merged(spark, root)
    last = last.first()["last"]
    if last is None:
        return upto
    postings.repartitionByRange("token").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{root}/base-{base + 1}/postings")
    docs.write.mode("overwrite").parquet(f"{root}/base-{base + 1}/docs")
    spark.createDataFrame([(base + 1, last)], BASES).coalesce(1).write.mode("append").parquet(f"{root}/bases")
    return last


def postings(spark: SparkSession, root: str) -> DataFrame:
    """token, doc_id and tf of all documents that the stream has had, merged or not."""
    return _merged(spark, root)[0].select("token", "doc_id", "tf")


def lengths(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and dl, the words of each document."""
    return _merged(spark, root)[1].select("doc_id", "dl")


def _indexed(s, d) -> DataFrame:
    """Postings of the stream of documents: in batches of a file, half merged, half pending."""
    root = f"{shared_dir(s)}/stream-index-{uuid.uuid4().hex}"
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    for part in (0, 1):
        docs.filter(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(f"{root}/in")
        stream = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
        follow(stream, root).awaitTermination()
        if part == 0:
            build(s, root)
    return postings(s, root)


_W = R._W.format("text")
QUERIES = {
    "stream_index": (
        lambda s, d: _indexed(s, d).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")),
        f"WITH t AS (SELECT doc_id, unnest({_W}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY token",
    ),
}
