"""Manuals as a catalogue: listings, status, names, captions, and answers continued over a heading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import answers as A
from . import retrieval as R


def listing(catalog: DataFrame, pending: DataFrame) -> DataFrame:
    """Manuals (product, and counts) with their index status, by name in any case."""
    waits = pending.select("product").distinct().withColumn("_p", F.lit(True))
    return catalog.join(waits, "product", "left").withColumn("index_status", F.when(F.col("_p"), "pending").otherwise("ready")).drop("_p").orderBy(F.lower("product"), "product")


def repository_status(catalog: DataFrame, pending: DataFrame) -> DataFrame:
    """Counts over all manuals, and whether data is newer than the index (columns data_time, index_time)."""
    n = pending.agg(F.count_distinct("product").alias("pending"))
    got = catalog.agg(F.count("*").alias("manuals"), F.sum("section_count").alias("sections"), F.coalesce(F.max("data_time") > F.max("index_time"), F.lit(False)).alias("stale"))
    return got.join(F.broadcast(n))


def counts_or_own(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Catalogue counts, where they are missing or 0 those of the chunks."""
    own = chunks.groupBy("product").agg(F.count("*").alias("own"))
    return catalog.join(own, "product", "left").withColumn("chunk_count", F.coalesce(F.nullif("chunk_count", F.lit(0)), "own", F.lit(0))).drop("own")


def preview(rows: DataFrame, most: int = 600) -> DataFrame:
    return rows.withColumn("text", F.substring("text", 1, most))


def rerank_text(rows: DataFrame, most: int = 900) -> DataFrame:
    """Caption before summary, and so many characters."""
    parts = F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in ("product", "heading", "caption_aux", "summary", "text"))), lambda x: x != "")
    return rows.withColumn("rerank_text", F.substring(F.array_join(parts, "\n"), 1, most))


def name_key(name: Column) -> Column:
    """What names are compared by: letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def resolve_names(names: DataFrame, products: DataFrame) -> DataFrame:
    """The product of each free name: the exact one, else the only one of the same key."""
    exact = products.select(F.col("product").alias("name"), F.col("product").alias("_exact"))
    keyed = products.groupBy(name_key(F.col("product")).alias("key")).agg(F.count_distinct("product").alias("n"), F.min("product").alias("_keyed")).filter("n = 1 AND key <> ''").drop("n")
    rows = names.withColumn("key", name_key(F.col("name"))).join(exact, "name", "left").join(keyed, "key", "left")
    return rows.withColumn("product", F.coalesce("_exact", "_keyed")).drop("key", "_exact", "_keyed")


def caption_evidence(captions: DataFrame, most: int = 8, chars: int = 260) -> DataFrame:
    """Captions (qid, rank, caption, category, section_fit) without noise and misfits, but for tables of facts; clipped, the first of each query."""
    fit = (F.coalesce("section_fit", F.lit("")) != "mismatch") | (F.col("category") == "info_table")
    good = captions.filter((F.coalesce("category", F.lit("")) != "noise") & fit)
    w = Window.partitionBy("qid").orderBy("rank")
    return good.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).withColumn("caption", F.substring("caption", 1, chars))


def support_relation(question: Column, primary: Column, other: Column) -> Column:
    """What a block beside the main one is to it."""
    return (
        F.when(other.rlike(r"(?i)\bcompatib|\bonly with\b|适用|兼容"), "compatibility")
        .when(other.rlike(r"(?i)\bbefore\b|\bmake sure\b|\bensure\b|之前|确保"), "prerequisite")
        .when(F.size(F.array_intersect(R.heading_terms(F.concat_ws(" ", question, primary)), R.heading_terms(other))) >= 2, "operational_note")
        .when(other.rlike(r"(?i)\bwarning\b|\bcaution\b|\bdanger\b|警告|注意|危险"), "generic_warning")
        .otherwise("sibling_topic")
    )


def family(rows: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """All sections under the same heading path but its leaf as a seed's, where they are 2 to ``most``; the seed is primary."""
    stem = lambda df: df.withColumn("stem", F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), "/")).filter("stem <> ''")
    r = stem(rows).select("product", "section_id", "stem")
    sizes = r.groupBy("product", "stem").agg(F.count("*").alias("m")).filter(F.col("m").between(2, most))
    s = stem(seeds).select("qid", "product", "stem", F.col("section_id").alias("seed"))
    return s.join(sizes, ["product", "stem"]).join(r, ["product", "stem"]).select("qid", "product", "seed", "section_id", F.when(F.col("section_id") == F.col("seed"), "primary").otherwise("related").alias("role"))


def continued(scores: DataFrame, grams: DataFrame, most: int = 4, share: float = 0.02) -> DataFrame:
    """Passages that an answer's block goes on in: the best one, then greedily those of its heading that add enough trigrams.

    ``scores`` has block, passage, score; ``grams`` has block, passage, heading and shared, the trigrams that both have.
    Blocks have few candidates, so each is folded on its own.
    """
    rows = scores.join(grams, ["block", "passage"])

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "passage"], ascending=[False, True])
        first, out, have = part.iloc[0], [], set()
        least = max(5, share * len(set().union(*part["shared"])))
        for r in part[part["heading"] == first["heading"]].itertuples():
            new = set(r.shared) - have
            if not out or len(new) >= least and len(out) <= most:
                out.append((r.block, r.passage, len(out), len(new)))
                have |= new
        return pd.DataFrame(out, columns=["block", "passage", "place", "added"])

    return rows.select("block", "passage", "score", "heading", "shared").groupBy("block").applyInPandas(fold, "block bigint, passage string, place int, added int")


def _catalog(s, d):
    return sections(s, d).groupBy("product").agg(F.count("*").alias("section_count"), F.max("doc_id").alias("data_time"), F.max(F.col("doc_id") - 1).alias("index_time"))


def _pending(s, d):
    return table(s, d, "documents").filter("source IN ('src3', 'src7')").select(F.col("source").alias("product"))


def _own_paths(s, d):
    """Paths inside each document: its sections by the first word of their heading. What other documents there are changes no family."""
    own = F.array(F.concat(F.lit("d"), F.col("doc_id")), F.substring_index("heading", " ", 1), F.col("heading"))
    return sections(s, d).select(F.col("doc_id").alias("product"), F.concat_ws("-", "doc_id", "section_id").alias("section_id"), own.alias("path"))


def _continued(s, d):
    pairs = A._pairs(s, d)
    heads = sections(s, d).select(F.concat_ws("/", "doc_id", "section_id").alias("passage"), F.col("product").alias("heading"))
    grams = pairs.select("block", "passage", F.array_intersect(T.trigrams(F.col("block_text")), T.trigrams(F.col("passage_text"))).alias("shared")).join(heads, "passage")
    return continued(A.overlap_scores(pairs).filter("strong").select("block", "passage", "score"), grams)


_C = f"WITH {SECTIONS}, cat AS (SELECT product, count(*) AS section_count, max(doc_id) AS data_time, max(doc_id - 1) AS index_time FROM sections GROUP BY product), pend AS (SELECT DISTINCT source AS product FROM documents WHERE source IN ('src3', 'src7'))"

QUERIES = {
    "manual_listing": (lambda s, d: listing(_catalog(s, d), _pending(s, d)).select("product", "section_count", "index_status"), f"{_C} SELECT product, section_count, CASE WHEN product IN (SELECT product FROM pend) THEN 'pending' ELSE 'ready' END AS index_status FROM cat"),
    "repository_status": (lambda s, d: repository_status(_catalog(s, d), _pending(s, d)), f"{_C} SELECT count(*) AS manuals, CAST(sum(section_count) AS BIGINT) AS sections, max(data_time) > max(index_time) AS stale, (SELECT count(*) FROM pend) AS pending FROM cat"),
    "catalog_counts": (
        lambda s, d: counts_or_own(_catalog(s, d).select("product", F.when(F.col("product").endswith("1"), 0).when(F.col("product").endswith("2"), None).otherwise(5).cast("bigint").alias("chunk_count")), sections(s, d)),
        f"{_C} SELECT product, CASE WHEN ends_with(product, '1') OR ends_with(product, '2') THEN section_count ELSE 5 END AS chunk_count FROM cat",
    ),
    "resolve_names": (
        lambda s, d: resolve_names(
            table(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower(F.regexp_replace("c_name", "#", " - "))).otherwise(F.col("c_name")).alias("name")), table(s, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("product"))
        ),
        "WITH p AS (SELECT c_name AS product, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS key FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', ' - ')) ELSE c_name END AS name FROM customer) SELECT name, p.product FROM n LEFT JOIN p ON regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = key",
    ),
    "caption_evidence": (
        lambda s, d: caption_evidence(sections(s, d).select(F.col("doc_id").alias("qid"), F.col("section_id").alias("rank"), F.col("text").alias("caption"), F.when(F.col("section_id") % 4 == 0, "noise").when(F.col("section_id") % 4 == 1, "info_table").otherwise("figure").alias("category"), F.when(F.col("section_id") % 3 == 0, "mismatch").alias("section_fit"))).select("qid", "rank", "k", F.md5("caption").alias("digest")),
        f"WITH {SECTIONS}, g AS (SELECT doc_id AS qid, section_id AS rank, text, row_number() OVER (PARTITION BY doc_id ORDER BY section_id) AS k FROM sections WHERE section_id % 4 <> 0 AND (section_id % 3 <> 0 OR section_id % 4 = 1)) SELECT qid, rank, k, md5(substr(text, 1, 260)) AS digest FROM g WHERE k <= 8",
    ),
    "section_family_own": (
        lambda s, d: family(_own_paths(s, d), _own_paths(s, d).filter("length(path[2]) < 25").withColumn("qid", F.lit(1))),
        f"WITH {SECTIONS}, p AS (SELECT doc_id AS product, doc_id || '-' || section_id AS section_id, heading, split_part(heading, ' ', 1) AS stem FROM sections), z AS (SELECT product, stem FROM p GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8) SELECT 1 AS qid, s.product, s.section_id AS seed, r.section_id, CASE WHEN r.section_id = s.section_id THEN 'primary' ELSE 'related' END AS role FROM p s JOIN z USING (product, stem) JOIN p r USING (product, stem) WHERE length(s.heading) < 25",
    ),
    "section_preview": (lambda s, d: preview(sections(s, d), 60).select("doc_id", "section_id", "text"), f"WITH {SECTIONS} SELECT doc_id, section_id, substr(text, 1, 60) AS text FROM sections"),
    "align_continuation": (_continued, None),
}
