"""The registered queries of the library."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["operators.monitor", "operators.texts", "operators.retrieval", "operators.answers", "operators.routing", "operators.vector_index", "operators.pictures", "operators.blocks", "operators.gates", "operators.reviewed", "operators.citations", "operators.structure", "operators.conversation", "operators.ingest", "streaming.jobs", "sources.publication", "streaming.index_stream", "streaming.state", "streaming.upserts", "operators.evidence", "operators.catalogue", "operators.results"]


def _all() -> dict:
    return {name: pair for m in MODULES for name, pair in import_module(f"docloom.{m}").QUERIES.items()}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["bm25_topk"](spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
