"""Batched retrieval: a whole table of queries at once, each channel one pass over postings."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .ranks import staged

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K = 60


def words_of(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each word of each text."""
    return rows.select(key, F.explode(T.words(F.coalesce(F.col(text), F.lit("")))).alias("token"))


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, tf of ``docs`` (doc_id, text); counts are added up before the shuffle."""
    return words_of(docs, "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """Document frequency and idf of every term; negative ones become a quarter of the mean."""
    words = F.array_distinct(T.words(F.coalesce(F.col("text"), F.lit(""))))  # of one row: no pair of text and word is moved
    df = docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Postings(NamedTuple):
    """What a corpus is searched by: ``terms`` (doc_id, token, tf, dl), ``stats`` (token, df, idf), ``mean`` (one row, avgdl), and ``docs``."""

    terms: DataFrame
    stats: DataFrame
    mean: DataFrame
    docs: DataFrame


def indexed(docs: DataFrame) -> Postings:
    """Postings of ``docs`` (doc_id, text), staged: texts are tokenised once, and all statistics come from the postings."""
    words = T.words(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("token"))
    terms = staged(rows.groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf")), "postings")
    n = docs.agg(F.count("*").alias("n"))
    df = staged(terms.groupBy("token").agg(F.count("*").alias("df")), "document-frequencies")
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = raw.agg((FLOOR * F.avg("raw")).alias("low"))
    stats = raw.join(F.broadcast(low)).select("token", "df", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))
    mean = terms.agg(F.sum("tf").alias("tokens")).join(F.broadcast(n)).select((F.col("tokens") / F.col("n")).alias("avgdl"))
    return Postings(terms, stats, mean, docs)


#: Words of queries that go to every task; beyond, postings and queries are joined by words.
MOST_ASKED = 1 << 20


def bm25(docs: DataFrame | Postings, queries: DataFrame, scope: DataFrame | None = None, most: int = MOST_ASKED) -> DataFrame:
    """qid, doc_id, score over ``queries`` (qid, text); repeated words of a query count again.

    ``docs`` is a corpus or its postings: of a corpus only words that some query has are kept before anything is
    shuffled, so nothing is staged for one search; postings serve many. ``scope`` (qid, product) limits a query to products of the documents
    (doc_id, text, product); queries without a row in it have all. Statistics are the whole corpus' either way.

    Postings are shuffled once, by document. Words of queries, with their weights, come to them by broadcast (up to ``most``, by joins beyond),
    so pairs of query and document are made and added up where the document is, and never shuffled.
    """
    words = T.words(F.coalesce("text", F.lit("")))
    times = words_of(queries, "qid").groupBy("qid", "token").agg(F.count("*").alias("times"))
    limits = None if scope is None else scope.select("qid", "product").distinct().withColumn("bound", F.lit(True))
    sizes = queries.select("qid", F.size(words).alias("n"))
    if limits is not None:
        sizes = sizes.join(limits.groupBy("qid").agg(F.count("*").alias("m")), "qid", "left").select((F.col("n") * F.coalesce("m", F.lit(1))).alias("n"))
    few = (sizes.agg(F.sum("n")).first()[0] or 0) <= most
    everywhere = F.broadcast if few else (lambda rows: rows)
    some = everywhere(times.select("token").distinct())
    if isinstance(docs, Postings):
        found = docs
        terms = found.terms.join(some, "token", "left_semi").repartition("doc_id")
    else:
        rows = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("token"))
        terms = rows.join(some, "token", "left_semi").repartition("doc_id").groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))
        found = Postings(terms, term_stats(docs).join(some, "token", "left_semi"), docs.agg(F.avg(F.size(words)).alias("avgdl")), docs)
    asked = times.join(found.stats.select("token", "idf"), "token")
    rows = terms.join(F.broadcast(found.mean))
    if limits is None:
        rows = rows.join(everywhere(asked), "token")
    else:
        said = asked.join(limits.withColumnRenamed("product", "only"), "qid", "left").withColumnRenamed("token", "said")
        rows = rows.join(found.docs.select("doc_id", "product"), "doc_id")
        rows = rows.join(everywhere(said), (F.col("token") == F.col("said")) & (F.col("bound").isNull() | (F.col("only") == F.col("product"))))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("qid", "doc_id").agg(F.round(F.sum(part * F.col("times")), 6).alias("score")).filter("score > 0")


def original_channel(docs: DataFrame | Postings, queries: DataFrame, n: int = 20, scope: DataFrame | None = None) -> DataFrame:
    """The channel of questions as they were said (qid, text, said), of those only that are searched by another text."""
    other = queries.filter(~T.question_key(F.coalesce("said", F.lit(""))).eqNullSafe(T.question_key(F.coalesce("text", F.lit("")))) & (F.trim(F.coalesce("said", F.lit(""))) != ""))
    return top(bm25(docs, other.select("qid", F.col("said").alias("text")), scope), n)


def top(rows: DataFrame, n: int, by: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best n of each query with their ranks from 1, ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Words that headings and questions are not matched by.
HEADING_STOP = ["a", "an", "and", "are", "be", "can", "do", "does", "for", "how", "i", "if", "in", "is", "it", "of", "on", "or", "the", "this", "to", "use", "using", "what", "when", "with", "you", "your"]


def heading_terms(text: Column) -> Column:
    """Distinct Latin terms of three letters at least, lightly stemmed, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]*)"), 1)
    kept = F.filter(found, lambda t: ~t.isin(HEADING_STOP) & (F.length(t) >= 3))
    cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    stem = lambda t: F.when(t.endswith("ing") & (F.length(t) > 5), cut(t, 3)).when(t.endswith("es") & (F.length(t) > 4), cut(t, 2)).when(t.endswith("s") & (F.length(t) > 3), cut(t, 1)).otherwise(t)
    return F.array_distinct(F.transform(kept, stem))


def heading_recall(headings: DataFrame, queries: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """Headings (doc_id, heading) by shared terms: coverage, precision, hits in the leaf, and whole parts in the question.

    Headings are shuffled once, by document; queries of up to ``most`` terms come to them by broadcast, so pairs aren't shuffled.
    """
    q = queries.select("qid", heading_terms(F.col("text")).alias("q_terms"), T.question_key(F.col("text")).alias("q_text"))
    leaf = F.element_at(F.concat(F.array(F.lit("")), T.heading_parts(F.col("heading"))), -1)
    h = headings.select("doc_id", heading_terms(F.col("heading")).alias("h_terms"), heading_terms(leaf).alias("leaf"), F.transform(T.heading_parts(F.lower("heading")), lambda p: F.regexp_replace(p, r"\s+", " ")).alias("parts"))
    few = (q.agg(F.sum(F.size("q_terms"))).first()[0] or 0) <= most
    everywhere = F.broadcast if few else (lambda rows: rows)
    h = h.repartition("doc_id")  # pairs are made where the heading is
    pairs = h.select("doc_id", F.explode("h_terms").alias("term")).join(everywhere(q.select("qid", F.explode("q_terms").alias("term"))), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("hits"))
    rows = pairs.join(h, "doc_id").join(everywhere(q), "qid")
    coverage, precision = F.col("hits") / F.greatest(F.size("q_terms"), F.lit(1)), F.col("hits") / F.greatest(F.size("h_terms"), F.lit(1))
    exact = F.exists("parts", lambda p: (F.length(p) >= 3) & F.contains(F.col("q_text"), p))
    score = 0.56 * coverage + 0.28 * precision + 0.08 * F.least(F.size(F.array_intersect("q_terms", "leaf")), F.lit(2)) + F.when(exact, 0.45).otherwise(0.0)
    return rows.filter((F.col("hits") >= 2) | exact | (coverage >= 0.25)).select("qid", "doc_id", F.round(score, 6).alias("score"), F.round(coverage, 6).alias("coverage"))


def rrf(channels: list[DataFrame], n: int = 32, k: int = RRF_K) -> DataFrame:
    """Fused ranks of channels (qid, doc_id, rank): sums of 1 / (k + rank), ties by the earliest list, then its rank."""
    both = None
    for i, c in enumerate(channels):
        part = c.select("qid", "doc_id", F.lit(i).alias("list"), "rank")
        both = part if both is None else both.unionByName(part)
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(channels))]
    fused = both.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"), *ranks)
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), "first")
    return fused.withColumn("rrf_rank", F.row_number().over(w)).filter(F.col("rrf_rank") <= n).drop("first")


def distinct_channels(channels: list[DataFrame]) -> list[DataFrame]:
    """Channels without, for each query, lists equal to an earlier channel's."""
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    every = None
    for i, c in enumerate(channels):
        part = c.groupBy("qid").agg(ordered(c).alias("ids")).withColumn("list", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("qid", "ids").agg(F.min("list").alias("list"))
    return [c.join(first.filter(F.col("list") == i).select("qid"), "qid", "left_semi") for i, c in enumerate(channels)]


def language_first(ranked: DataFrame, q_lang: str = "q_lang", d_lang: str = "lang") -> DataFrame:
    """Documents of the query's language before others, each in their order."""
    w = Window.partitionBy("qid").orderBy((F.col(q_lang) != F.col(d_lang)).cast("int"), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w))


def relevance(rows: DataFrame) -> DataFrame:
    """Relevance and tiers of candidates (qid, doc_id, rank, bm25, cosine, heading_coverage).

    Rows far from the best in every way go, never the first; the best one left is the core.
    """
    q = Window.partitionBy("qid")
    best, near = F.max("bm25").over(q), F.max("cosine").over(q)
    rel = F.when(best > 0, F.col("bm25") / best).otherwise(0.0)
    gap = near - F.col("cosine")
    dense = F.greatest(F.lit(0.0), 1 - gap / 0.22)
    combined = F.least(F.lit(1.0), 0.44 * F.least(F.lit(1.0), rel) + 0.46 * dense + 0.10 * F.least(F.lit(1.0), 2 * F.col("heading_coverage")))
    out = rows.select("*", F.round(rel, 6).alias("bm25_relative"), F.round(gap, 6).alias("dense_gap"), F.round(combined, 6).alias("combined"))
    out = out.filter(~((F.col("rank") > 1) & (F.col("heading_coverage") == 0) & (F.col("bm25_relative") < 0.025) & (F.col("dense_gap") >= 0.20)))
    order = q.orderBy(F.desc("combined"), "rank")
    tier = F.when(F.row_number().over(order) == 1, "core").when(F.col("combined") >= 0.25, "related").otherwise("extremely_low")
    return out.withColumn("tier", tier)


def confidence(combined: Column, dense: Column, heading: Column, n_products: Column, visual: Column, n_candidates: Column) -> tuple[Column, Column]:
    """Score of 0 to 100 and level; several route candidates are never high."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    scope = F.when(n_products == 1, 1.0).when(n_products > 1, 0.45).otherwise(0.0)
    score = F.least(F.lit(100.0), F.round(100 * (0.58 * combined + 0.17 * clamp(dense) + 0.12 * clamp(heading) + 0.09 * scope + 0.04 * visual)))
    score = F.when(n_candidates > 1, F.least(score, F.lit(71.0))).otherwise(score)
    return score, F.when(n_candidates > 1, "medium").when(score >= 72, "high").when(score >= 50, "medium").otherwise("low")


def budget(items: DataFrame, chars: int = 1200, most: int = 4) -> DataFrame:
    """Items (qid, doc_id, rank, rrf, chars, core) without the least useful ones that aren't core, until both limits hold.

    What goes is a prefix in the order of utility, so a running sum decides.
    """
    q = Window.partitionBy("qid")
    utility = 0.55 * F.col("rrf") / F.max("rrf").over(q) + 0.45 / F.col("rank")
    rows = items.withColumn("utility", F.round(utility, 6)).withColumn("total", F.sum("chars").over(q)).withColumn("n", F.count("*").over(q))
    before = q.orderBy("core", "utility", F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("chars").over(before), F.lit(0))
    kept = F.col("core") | ((F.col("total") - gone <= chars) & (F.col("n") - F.count("*").over(before) <= most))
    return rows.withColumn("kept", kept).drop("total", "n")


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


#: Rows of one product of matrices.
QUERY_SLICE, VECTOR_BLOCK, QUERY_CHUNK = 2048, 20_000, 64


def dense_top(vectors: DataFrame, queries: DataFrame, n: int, scope: str | None = None) -> DataFrame:
    """The n nearest ``vectors`` (vec_id, embedding) of each of ``queries`` (qid, embedding) by cosine, in a common ``scope`` if one is named.

    Slices of queries meet blocks of vectors; each pair is one product of matrices in a task
    of its own, and only n rows a query and block are ranked further.
    """
    columns = [scope] * bool(scope)
    n_slices, n_blocks = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERY_SLICE), (vectors, VECTOR_BLOCK)))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    v = vectors.select("vec_id", "embedding", *columns, F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), each(n_slices).alias("slice"))
    q = queries.select("qid", "embedding", *columns, F.pmod(F.xxhash64("qid"), F.lit(n_slices)).cast("int").alias("slice")).withColumn("block", each(n_blocks))

    def matrix(table: pa.Table) -> np.ndarray:
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def codes(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        both = pa.concat_arrays([t.column(scope).combine_chunks() for t in (left, right)]).dictionary_encode().indices
        return both[: left.num_rows].fill_null(-1).to_numpy(), both[left.num_rows :].fill_null(-2).to_numpy()

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vec = right.column("qid").to_numpy(), left.column("vec_id").to_numpy()
        qids, hits, best = [ids[:0]], [vec[:0]], [np.empty(0)]
        if len(ids) and len(vec):
            x, (of, only) = matrix(left), codes(left, right) if scope else (None, None)
            least = min(n, len(vec))
            for at in range(0, len(ids), QUERY_CHUNK):  # a few queries at a time: their scores are all that a task holds beside its vectors
                scores = np.round(matrix(right.slice(at, QUERY_CHUNK)) @ x.T, 6)
                if scope:
                    scores[only[at : at + QUERY_CHUNK, None] != of[None, :]] = -2
                row, hit = np.nonzero((scores >= np.partition(scores, -least, axis=1)[:, -least, None]) & (scores > -2))
                score = scores[row, hit]
                order = np.lexsort((vec[hit], -score, row))  # with those that tie with the n-th
                row, hit, score = row[order], hit[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < n
                qids.append(ids[at + row[keep]])
                hits.append(vec[hit[keep]])
                best.append(score[keep])
        return pa.table({"qid": pa.array(np.concatenate(qids), pa.int64()), "doc_id": pa.array(np.concatenate(hits), pa.int64()), "score": pa.array(np.concatenate(best), pa.float64())})

    found = v.groupBy("slice", "block").cogroup(q.groupBy("slice", "block")).applyInArrow(product, "qid bigint, doc_id bigint, score double")
    return top(found, n)


def mean_pool(segments: DataFrame) -> DataFrame:
    """Mean vector of each document's segments (doc_id, embedding)."""
    each = segments.select("doc_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: F.round(s["x"], 6)).alias("embedding"))


def rerank(candidates: DataFrame, n: int, scorer=None) -> DataFrame:
    """Fused candidates (qid, doc_id, rank, query, text) by a pair scorer, padded with the others in their order.

    ``scorer(query, text)`` makes a column; without one, the share of the query's words that the text has.
    """
    def default(q: Column, t: Column) -> Column:
        asked = F.array_distinct(T.words(q))
        return F.size(F.array_intersect(asked, T.words(t))) / F.greatest(F.size(asked), F.lit(1))

    scored = candidates.withColumn("pair_score", F.round((scorer or default)(F.col("query"), F.col("text")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("pair_score"), "rank")
    return scored.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= n)


def fuse_with_missing(channels: list[DataFrame], sizes: list[Column | int], n: int = 12, k: int = RRF_K) -> DataFrame:
    """As ``rrf``, but an id that a channel lacks has there the rank of its size plus one."""
    out = None
    for i, c in enumerate(channels):
        part = c.select("qid", "doc_id", F.col("rank").alias(f"r{i}"))
        out = part if out is None else out.join(part, ["qid", "doc_id"], "full_outer")
    score = sum((1.0 / (k + F.coalesce(f"r{i}", F.lit(s) + 1)) for i, s in enumerate(sizes)), F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("score", F.round(score, 8)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# Queries over the test tables: documents as chunks, benchmark passages as questions.


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


def _ask(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _headings(s, d):
    return _docs(s, d).select("doc_id", F.substring_index("text", ".", 1).alias("heading"))


def bm25_top(s, d, n=20):
    return top(bm25(_docs(s, d).select("doc_id", "text"), _ask(s, d)), n)


def _channels(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    return [top(bm25(docs, _ask(s, d)), 20), _dense_channel(s, d), top(heading_recall(_headings(s, d), _ask(s, d)), 20)]


def _dense_channel(s, d):
    """Vectors of documents nearest to a question's; both are kept by their ids in one table."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    asked = table(s, d, "embeddings").select("vec_id", "embedding").join(_ask(s, d).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
    return dense_top(vectors, asked, 20)


def _candidates(s, d):
    """Ranked candidates with a lexical stand-in for the cosine: the share of the question's words."""
    asked = words_of(_ask(s, d), "qid").distinct()
    size = asked.groupBy("qid").agg(F.count("*").alias("size"))
    best = staged(bm25_top(s, d), "candidates")
    some = best.select("doc_id").distinct()
    docs = _docs(s, d).join(some, "doc_id", "left_semi").select("doc_id", "text")
    shared = words_of(docs, "doc_id").distinct().join(asked, "token").groupBy("qid", "doc_id").agg(F.count("*").alias("shared"))
    heads = heading_recall(_headings(s, d).join(some, "doc_id", "left_semi"), _ask(s, d)).select("qid", "doc_id", "coverage")
    rows = best.join(shared, ["qid", "doc_id"]).join(size, "qid").join(heads, ["qid", "doc_id"], "left")
    return rows.select("qid", "doc_id", "rank", F.col("score").alias("bm25"), F.round(F.col("shared") / F.col("size"), 6).alias("cosine"), F.coalesce("coverage", F.lit(0.0)).alias("heading_coverage"))


def _confidence(s, d):
    r = relevance(_candidates(s, d))
    core = r.filter("tier = 'core'")
    n = r.groupBy("qid").agg(F.sum(F.when(F.col("tier") != "extremely_low", 1).otherwise(0)).alias("n"))
    score, level = confidence(F.col("combined"), F.col("cosine"), F.col("heading_coverage"), F.lit(1), F.lit(0.0), F.when(F.col("n") > 12, 2).otherwise(1))
    return core.join(n, "qid").select("qid", "doc_id", score.alias("score"), level.alias("level"))


def _budget(s, d):
    size = _docs(s, d).select("doc_id", F.length("text").cast("bigint").alias("chars"))
    fused = rrf(_channels(s, d), 8)
    items = fused.select("qid", "doc_id", F.col("rrf_rank").alias("rank"), "rrf", (F.col("rrf_rank") == 1).alias("core")).join(size, "doc_id")
    return budget(items, 20_000, 4).select("qid", "doc_id", "utility", "kept")


def _lang(s, d):
    rows = bm25_top(s, d).join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    return language_first(rows.withColumn("q_lang", F.when(F.col("qid") % 2 == 0, "en").otherwise("fr"))).select("qid", "doc_id", "rank", "new_rank")


def _dense(s, d, scoped=False):
    """Every hundredth vector as a query."""
    vectors = table(s, d, "embeddings")
    return dense_top(vectors, vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), 10, "label" if scoped else None)


def _keyed(s, d):
    """Questions that are searched by some of their words: every second one by its first eight."""
    words = F.array_join(F.slice(T.words(F.coalesce("text", F.lit(""))), 1, 8), " ")
    return _ask(s, d).select("qid", F.col("text").alias("said"), F.when(F.col("qid") % 2 == 0, words).otherwise(F.col("text")).alias("text"))


def _scoped(s, d):
    docs = _docs(s, d).select("doc_id", "text", F.col("source").alias("product"))
    products = F.explode(F.array(F.concat(F.lit("src"), F.col("qid") % 20), F.concat(F.lit("src"), (F.col("qid") + 1) % 20))).alias("product")
    return top(bm25(docs, _ask(s, d), _ask(s, d).filter("qid % 3 > 0").select("qid", products)), 20)


def _four(s, d):
    found, asked = indexed(_docs(s, d).select("doc_id", "text")), _keyed(s, d)
    keyed = top(bm25(found, asked.select("qid", "text")), 20)
    return rrf([keyed, _dense_channel(s, d), top(heading_recall(_headings(s, d), _ask(s, d)), 20), original_channel(found, asked)])


def _rerank(s, d):
    docs, ask = _docs(s, d).select("doc_id", "text"), _ask(s, d).select("qid", F.col("text").alias("query"))
    rows = bm25_top(s, d).join(docs, "doc_id").join(ask, "qid").withColumn("text", F.substring("text", 1, 900))
    return rerank(rows, 6).select("qid", "doc_id", "rank", "pair_score", "rerank")


def _caption_fusion(s, d):
    a, b, c = _channels(s, d)
    n = table(s, d, "documents").count()
    return fuse_with_missing([a, b, c], [n, n, n]).select("qid", "doc_id", "score", "rank")


_W = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_TERMS = "(" + "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9-]*'), lambda t: NOT list_contains([" + ", ".join(f"'{x}'" for x in HEADING_STOP) + "], t) AND length(t) >= 3), lambda t: CASE WHEN ends_with(t, 'ing') AND length(t) > 5 THEN substr(t, 1, length(t) - 3) WHEN ends_with(t, 'es') AND length(t) > 4 THEN substr(t, 1, length(t) - 2) WHEN ends_with(t, 's') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END)))"

STATS = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({_W.format("text")}) AS token FROM documents), post AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
  dl AS (SELECT doc_id, len({_W.format("text")}) AS dl FROM documents), raw AS MATERIALIZED (
  SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM post GROUP BY token) t, (SELECT count(*) AS n FROM documents) d
), mean_raw AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM raw), stats AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM raw, mean_raw)"""


def _bm25_sql(name: str, text: str) -> str:
    return f"""{name}_q AS (SELECT item_id AS qid, unnest({_W.format(text)}) AS token FROM benchmark), {name}_s AS (
  SELECT qid, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score FROM {name}_q JOIN post USING (token) JOIN stats USING (token) JOIN dl USING (doc_id) GROUP BY qid, doc_id
), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= 20)"""


A = _bm25_sql("a", "text")
NEAR = """ev AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), en AS MATERIALIZED (SELECT vec_id, e, greatest(sqrt(list_inner_product(e, e)), 1e-12) AS norm FROM ev), b AS (
  SELECT qid, doc_id, rank FROM (SELECT q.vec_id AS qid, x.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, x.e) / q.norm / x.norm, 6) DESC, x.vec_id) AS rank
  FROM en q, en x WHERE q.vec_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 20)"""
_PARTS = r"list_filter(list_transform(string_split_regex({}, '\s*[>/|]\s*'), lambda p: trim(p)), lambda p: p <> '')"
HEAD = rf"""hd AS (SELECT doc_id, split_part(text, '.', 1) AS heading FROM documents), h AS (
  SELECT doc_id, {_TERMS.format("heading")} AS h_terms, {_TERMS.format("coalesce(" + _PARTS.format("heading") + "[-1], '')")} AS leaf, list_transform({_PARTS.format("lower(heading)")}, lambda p: regexp_replace(p, '\s+', ' ', 'g')) AS parts FROM hd
), hq AS (SELECT item_id AS qid, {_TERMS.format("text")} AS q_terms, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q_text FROM benchmark), hp AS (
  SELECT *, len(list_intersect(q_terms, h_terms)) AS hits, coalesce(list_bool_or(list_transform(parts, lambda p: length(p) >= 3 AND contains(q_text, p))), false) AS exact FROM hq, h
), heads AS (
  SELECT qid, doc_id, round(0.56 * (hits / greatest(len(q_terms), 1)) + 0.28 * (hits / greatest(len(h_terms), 1)) + 0.08 * least(len(list_intersect(q_terms, leaf)), 2) + CASE WHEN exact THEN 0.45 ELSE 0 END, 6) AS score,
    round(hits / greatest(len(q_terms), 1), 6) AS coverage FROM hp WHERE hits > 0 AND (hits >= 2 OR exact OR hits / greatest(len(q_terms), 1) >= 0.25)
), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM heads) WHERE rank <= 20)"""
FUSED = f"""{STATS}, {A}, {NEAR}, {HEAD}, u AS (SELECT qid, doc_id, 0 AS l, rank FROM a UNION ALL SELECT qid, doc_id, 1, rank FROM b UNION ALL SELECT qid, doc_id, 2, rank FROM c), f AS (
  SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, min(l * 1000 + rank) AS first, max(rank) FILTER (l = 0) AS rank_0, max(rank) FILTER (l = 1) AS rank_1, max(rank) FILTER (l = 2) AS rank_2 FROM u GROUP BY qid, doc_id
), fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS rrf_rank FROM f) WHERE rrf_rank <= 32)"""
RELEVANCE = f"""{STATS}, {A}, {HEAD}, sh AS (
  SELECT qid, doc_id, count(*) AS shared FROM (SELECT DISTINCT qid, token FROM a_q) q JOIN post USING (token) GROUP BY qid, doc_id
), sz AS (SELECT qid, count(DISTINCT token) AS size FROM a_q GROUP BY qid), cand AS (
  SELECT a.qid, a.doc_id, a.rank, a.score AS bm25, round(shared / size, 6) AS cosine, coalesce(coverage, 0) AS heading_coverage FROM a JOIN sh USING (qid, doc_id) JOIN sz USING (qid) LEFT JOIN heads h USING (qid, doc_id)
), rel AS (
  SELECT *, bm25 / max(bm25) OVER (PARTITION BY qid) AS r, max(cosine) OVER (PARTITION BY qid) - cosine AS g FROM cand
), comb AS (
  SELECT qid, doc_id, rank, bm25, cosine, heading_coverage, round(r, 6) AS bm25_relative, round(g, 6) AS dense_gap, round(least(1, 0.44 * least(1, r) + 0.46 * greatest(0, 1 - g / 0.22) + 0.1 * least(1, 2 * heading_coverage)), 6) AS combined FROM rel
), tiers AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY combined DESC, rank) = 1 THEN 'core' WHEN combined >= 0.25 THEN 'related' ELSE 'extremely_low' END AS tier
  FROM comb WHERE NOT (rank > 1 AND heading_coverage = 0 AND bm25_relative < 0.025 AND dense_gap >= 0.2)
)"""
DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, label, e, greatest(sqrt(list_inner_product(e, e)), 1e-12) AS norm FROM v), sc AS (
  SELECT q.vec_id AS qid, x.vec_id AS doc_id, q.label AS ql, x.label AS xl, round(list_inner_product(q.e, x.e) / q.norm / x.norm, 6) AS score FROM n q, n x WHERE q.vec_id % 100 = 0)"""


def _dense_sql(where: str) -> str:
    return f"WITH {DENSE} SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE {where}) WHERE rank <= 10"


_KEYED = f"CASE WHEN item_id % 2 = 0 THEN array_to_string({_W.format('text')}[1:8], ' ') ELSE text END"
_FOUR = f"""{STATS}, {A}, {_bm25_sql("k", _KEYED)}, {NEAR}, {HEAD}, o AS (SELECT a.* FROM a JOIN benchmark ON item_id = a.qid WHERE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace({_KEYED}, '\\s+', ' ', 'g')))),
  u AS (SELECT qid, doc_id, 0 AS l, rank FROM k UNION ALL SELECT qid, doc_id, 1, rank FROM b UNION ALL SELECT qid, doc_id, 2, rank FROM c UNION ALL SELECT qid, doc_id, 3, rank FROM o), f AS (
  SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, min(l * 1000 + rank) AS first, max(rank) FILTER (l = 0) AS rank_0, max(rank) FILTER (l = 1) AS rank_1, max(rank) FILTER (l = 2) AS rank_2, max(rank) FILTER (l = 3) AS rank_3 FROM u GROUP BY qid, doc_id)"""

QUERIES = {
    "bm25_scoped": (
        _scoped,
        f"""WITH {STATS}, {A} SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM a_s JOIN documents USING (doc_id) WHERE score > 0 AND (qid % 3 = 0 OR source IN ('src' || (qid % 20), 'src' || ((qid + 1) % 20)))
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 20""",
    ),
    "hybrid_original": (_four, f"WITH {_FOUR} SELECT qid, doc_id, rrf, rank_0, rank_1, rank_2, rank_3, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS rrf_rank FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) <= 32"),
    "bm25_topk": (bm25_top, f"WITH {STATS}, {A} SELECT qid, doc_id, score, rank FROM a"),
    "term_stats": (lambda s, d: term_stats(_docs(s, d)).withColumn("idf", F.round("idf", 6)), f"WITH {STATS} SELECT token, df, round(idf, 6) AS idf FROM stats"),
    "heading_recall": (lambda s, d: top(heading_recall(_headings(s, d), _ask(s, d)), 20), f"WITH {HEAD} SELECT qid, doc_id, score, coverage, rank FROM c"),
    "rrf_fuse": (lambda s, d: rrf(_channels(s, d)).select("qid", "doc_id", "rrf", "rrf_rank"), f"WITH {FUSED} SELECT qid, doc_id, rrf, rrf_rank FROM fused"),
    "hybrid_trace": (lambda s, d: rrf(_channels(s, d)), f"WITH {FUSED} SELECT qid, doc_id, rrf, rank_0, rank_1, rank_2, rrf_rank FROM fused"),
    "lang_reorder": (_lang, f"""WITH {STATS}, {A} SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY CAST((CASE WHEN qid % 2 = 0 THEN 'en' ELSE 'fr' END) <> lang AS INT), rank) AS new_rank FROM a JOIN documents USING (doc_id)"""),
    "relevance_tiers": (lambda s, d: relevance(_candidates(s, d)), f"WITH {RELEVANCE} SELECT * FROM tiers"),
    "confidence": (_confidence, f"""WITH {RELEVANCE}, n AS (SELECT qid, count(*) FILTER (tier <> 'extremely_low') AS n FROM tiers GROUP BY qid), k AS (
      SELECT qid, doc_id, n > 12 AS many, least(100.0, round(100 * (0.58 * combined + 0.17 * greatest(0, least(1, cosine)) + 0.12 * greatest(0, least(1, heading_coverage)) + 0.09))) AS s FROM tiers JOIN n USING (qid) WHERE tier = 'core')
      SELECT qid, doc_id, CAST(CASE WHEN many THEN least(s, 71) ELSE s END AS DOUBLE) AS score, CASE WHEN many THEN 'medium' WHEN s >= 72 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS level FROM k"""),
    "evidence_budget": (_budget, f"""WITH {FUSED}, it AS (SELECT qid, doc_id, rrf_rank AS rank, rrf, rrf_rank = 1 AS core, CAST(length(text) AS BIGINT) AS chars FROM fused JOIN documents USING (doc_id) WHERE rrf_rank <= 8), u2 AS (
      SELECT *, round(0.55 * rrf / max(rrf) OVER (PARTITION BY qid) + 0.45 / rank, 6) AS utility, sum(chars) OVER (PARTITION BY qid) AS total, count(*) OVER (PARTITION BY qid) AS n FROM it
      ), g AS (SELECT *, coalesce(sum(chars) OVER w, 0) AS gone, count(*) OVER w AS k FROM u2 WINDOW w AS (PARTITION BY qid ORDER BY core, utility, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT qid, doc_id, utility, core OR (total - gone <= 20000 AND n - k <= 4) AS kept FROM g"""),
    "dense_topk": (_dense, _dense_sql("true")),
    "dense_topk_scoped": (lambda s, d: _dense(s, d, True), _dense_sql("ql = xl")),
    "l2_normalize": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")),
        "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, CAST(i - 1 AS INT) AS i, round(e[i] / greatest(sqrt(list_inner_product(e, e)), 1e-12), 6) AS x FROM v, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i) t",
    ),
    "mean_pool": (
        lambda s, d: mean_pool(table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), "embedding")).select("doc_id", F.posexplode("embedding").alias("i", "x")),
        "SELECT doc_id, CAST(i - 1 AS INT) AS i, round(avg(CAST(e[i] AS DOUBLE)), 6) AS x FROM (SELECT vec_id % 50 AS doc_id, embedding AS e FROM embeddings), LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i) t GROUP BY doc_id, i",
    ),
    "rerank": (_rerank, f"""WITH {STATS}, {A}, p AS (SELECT qid, doc_id, rank, list_distinct({_W.format("b.text")}) AS q, {_W.format("substr(d.text, 1, 900)")} AS t FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qid), r AS (
      SELECT qid, doc_id, rank, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS pair_score FROM p)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, rank) AS rerank FROM r) WHERE rerank <= 6"""),
    "caption_fusion": (_caption_fusion, f"""WITH {FUSED}, m AS (SELECT count(*) + 1 AS m FROM documents), s AS (SELECT qid, doc_id, round(1.0 / (60 + coalesce(rank_0, m)) + 1.0 / (60 + coalesce(rank_1, m)) + 1.0 / (60 + coalesce(rank_2, m)), 8) AS score FROM f, m)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 12"""),
}
