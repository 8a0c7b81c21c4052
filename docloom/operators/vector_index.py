"""A stored vector index: an inverted file over centroids, with half-precision vectors.

``build`` fits centroids on a sample of at most ``SAMPLE`` vectors (those of the smallest hashes of
their ids) and stores every vector in the cell of its nearest centroid, normalised, as 16-bit
floats. ``search`` renormalises what it reads and looks into each query's best cells first. What is
found there is a bound: a cell can only hold something better if its radius, the widest angle
between its centroid and a vector of it, reaches so far. All cells that it can't rule out
are looked into next, so the second round ends the search. Half precision blurs a score by ``BLUR`` at
most; all vectors within it of the last place are scored again from ``exact`` vectors, where
they are given. So the result is that of comparing all with all, and with ``rounds=1`` that of the first probes.

Cells of any size are dealt out in parts of ``PART`` vectors, and the queries of a part in slices of ``SLICE``,
so no task holds a whole cell, even one of equal vectors. Ids are integers.

Nulls and ties: null vectors, and those with null elements, are neither stored nor searched for; zero vectors have score 0 with all.
Equal scores go by id, so of equal vectors each part compares the first ``n`` only. Vectors and queries have one dimension. Rows of equal id are vectors of their own in the index and one in the result.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table
from . import retrieval as R

#: Vectors that centroids are fitted on at most, most centroids, and rounds of fitting.
SAMPLE, MOST_CELLS, FITS = 8192, 4096, 8
#: Rows of one product of matrices.
PART, SLICE = 16_384, 2048
#: How far a score of two unit vectors may be off, as one has elements of 11 significant bits, and is renormalised.
BLUR = 2.0**-10


class Index(NamedTuple):
    """``vectors`` (cell, part, vec_id, twin, a hash of the vector as it was, half) and ``cells`` (cell, centroid, cosine of the radius, parts)."""

    vectors: DataFrame
    cells: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def halves(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Stored vectors, renormalised."""
    return unit(np.stack([np.frombuffer(b, "<f2") for b in column.to_pylist()]).astype(np.float64)) if len(column) else np.zeros((0, 0))


def whole(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<float>").alias("embedding"))


def fitted(vectors: DataFrame, n_cells: int | None = None) -> np.ndarray:
    """Centroids of a sample, by a few rounds of spherical k-means; as many as the root of the number of vectors without ``n_cells``."""
    n_cells = n_cells or int(min(MOST_CELLS, max(1, vectors.count() ** 0.5)))
    sample = vectors.select("vec_id", "embedding", F.xxhash64("vec_id").alias("at")).orderBy("at", "vec_id").limit(SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    x = unit(matrix(sample.column("embedding")))
    centroids = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)]
    for _ in range(FITS):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), centroids)
    return centroids


def build(vectors: DataFrame, path: str, n_cells: int | None = None) -> Index:
    """Store an index of ``vectors`` (vec_id, embedding) in the folder ``path``, and open it."""
    spark, rows = vectors.sparkSession, whole(vectors, "vec_id").withColumn("twin", F.xxhash64("embedding"))
    centroids = fitted(rows, n_cells)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("embedding")))
            stored = x.astype("<f2")
            near = unit(stored.astype(np.float64)) @ centroids.T
            cell = np.argmax(near, axis=1)
            close = near[np.arange(len(x)), cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), batch.column("twin"), pa.array([s.tobytes() for s in stored], pa.binary()), pa.array(close)], names=["cell", "vec_id", "twin", "half", "close"])

    placed = rows.mapInArrow(assign, "cell int, vec_id bigint, twin bigint, half binary, close double")
    staged = f"{path}/placed"
    placed.write.mode("overwrite").parquet(staged)
    placed = spark.read.parquet(staged)
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("close").alias("radius"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    counts.join(known, "cell").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).write.mode("overwrite").parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int")
    sized = placed.join(F.broadcast(cells.select("cell", "parts")), "cell")  # at most MOST_CELLS rows
    sized.select("cell", part.alias("part"), "vec_id", "twin", "half").repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/vectors")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def search(index: Index, queries: DataFrame, n: int = 10, probes: int = 4, rounds: int = 2, exact: DataFrame | None = None) -> DataFrame:
    """The ``n`` nearest vectors (doc_id) of each of ``queries`` (qid, embedding), with score and rank.

    ``rounds=1`` looks into ``probes`` cells only. ``exact`` (vec_id, embedding) are the vectors before
    they were stored, for scores without blur.
    """
    asked, cells = whole(queries, "qid"), index.cells
    blur = BLUR if exact is not None else 0.0
    found = _candidates(index, _probed(asked, cells, probes), n, blur)
    if rounds > 1:
        last = R.top(found.select("qid", "doc_id", "score"), n).groupBy("qid").agg(F.when(F.count("*") == n, F.min("score")).otherwise(-2.0).alias("least"))
        floor = asked.join(last, "qid", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)) - 2 * blur)
        found = found.unionByName(_candidates(index, _probed(floor, cells, probes, further=True), n, blur))
    found = found.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    if exact is None:
        return R.top(found.withColumn("score", F.round("score", 6)), n)
    place = R.top(found, n).filter(F.col("rank") == n).select("qid", F.col("score").alias("least"))
    near = found.join(place, "qid", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least") - 2 * blur)).select("qid", F.col("doc_id").alias("vec_id"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    rows = near.join(whole(exact, "vec_id").withColumnRenamed("embedding", "a"), "vec_id").join(asked.withColumnRenamed("embedding", "b"), "qid")
    scored = rows.select("qid", F.col("vec_id").alias("doc_id"), F.round(product / norm("a") / norm("b"), 6).alias("score"))
    return R.top(scored.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), n)


#: Queries that the number of probes is fitted on, and the share of their neighbours that these must find.
CALIBRATION, TARGET = 128, 0.96


def _bounds(x: np.ndarray, known: pa.Table) -> np.ndarray:
    """The best score that each cell may hold for each of the vectors ``x``."""
    angle = np.arccos(np.clip(known.column("radius").to_numpy(), -1, 1))
    near = np.arccos(np.clip(unit(x) @ matrix(known.column("centroid")).T, -1, 1))
    return np.cos(np.maximum(near - angle - 1e-9, 0))


def calibrated(index: Index, vectors: DataFrame, n: int = 10, target: float = TARGET) -> int:
    """The fewest probes with which ``target`` of the neighbours of a sample are found: ``CALIBRATION`` of the ``vectors``, those of the smallest hashes of their ids.

    Their neighbours come from an exact search. Vectors without clusters need nearly all cells.
    """
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).withColumnRenamed("vec_id", "qid")
    asked = whole(sample, "qid").dropDuplicates(["qid"]).toArrow()
    known = index.cells.orderBy("cell").select("cell", "centroid", "radius").toArrow()
    if not asked.num_rows or not known.num_rows:
        return 1
    spark = vectors.sparkSession
    found = search(index, spark.createDataFrame(asked), n).select("qid", F.col("doc_id").alias("vec_id"))
    hits = found.join(index.vectors.select("vec_id", "cell"), "vec_id").select("qid", "cell").toArrow()
    place = np.argsort(np.argsort(-_bounds(matrix(asked.column("embedding")), known), axis=1, kind="stable"), axis=1)
    row = {q: i for i, q in enumerate(asked.column("qid").to_pylist())}
    column = {c: i for i, c in enumerate(known.column("cell").to_pylist())}
    ranks = sorted(place[row[q], column[c]] for q, c in zip(hits.column("qid").to_pylist(), hits.column("cell").to_pylist(), strict=True))
    return int(ranks[max(0, -(-int(len(ranks) * target * 1000) // 1000) - 1)]) + 1 if ranks else 1


def _probed(asked: DataFrame, cells: DataFrame, probes: int, further: bool = False) -> DataFrame:
    """The cells (cell) that each query looks into: the best ``probes`` by bound or, ``further``, all others whose bound reaches ``least``."""
    known = cells.orderBy("cell").select("cell", "centroid", "radius").toArrow()  # at most MOST_CELLS rows
    number = known.column("cell").to_numpy()

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not known.num_rows:
                continue
            bound = _bounds(matrix(batch.column("embedding")), known)
            order = np.argsort(-bound, axis=1, kind="stable")
            take = np.zeros(bound.shape, bool)
            np.put_along_axis(take, order[:, :probes], True, axis=1)
            if further:
                take = ~take & (bound >= batch.column("least").to_numpy(zero_copy_only=False)[:, None])
            row, cell = np.nonzero(take)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("embedding").take(at), pa.array(number[cell].astype(np.int32))], names=["qid", "embedding", "cell"])

    columns = ["qid", "embedding", *(["least"] if further else [])]
    return asked.select(*columns).mapInArrow(run, "qid bigint, embedding array<float>, cell int")


def _candidates(index: Index, probed: DataFrame, n: int, blur: float) -> DataFrame:
    """The best ``n`` vectors (qid, doc_id, score) of each query in each part of the cells that it looks into, and those within twice the blur of them."""
    slices = probed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).join(F.broadcast(index.cells.select("cell", "parts")), "cell")
    sizes = F.broadcast(slices)  # at most MOST_CELLS rows
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    q = probed.join(sizes, "cell").withColumn("slice", F.pmod(F.xxhash64("qid"), F.col("slices").cast("long")).cast("int")).select("cell", each("parts").alias("part"), "slice", "qid", "embedding")
    v = index.vectors.join(sizes, "cell").select("cell", "part", each("slices").alias("slice"), "vec_id", "twin", "half")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, twin = left.column("vec_id").to_numpy(), left.column("twin").to_numpy()
        order = np.lexsort((ids, twin))
        new = np.append(True, twin[order][1:] != twin[order][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - first < n]  # of equal vectors no query takes more than n
        left, ids = left.take(pa.array(order)), ids[order]
        scores = unit(matrix(right.column("embedding"))) @ halves(left.column("half")).T
        k = min(n, len(ids))
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, hit = np.nonzero(scores >= least - 2 * blur - 1e-9)
        return pa.table({"qid": pa.array(right.column("qid").to_numpy()[row]), "doc_id": pa.array(ids[hit]), "score": pa.array(scores[row, hit])})

    return v.groupBy("cell", "part", "slice").cogroup(q.groupBy("cell", "part", "slice")).applyInArrow(product, "qid bigint, doc_id bigint, score double")


def _query(s, d, rounds: int, exact: bool) -> DataFrame:
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    index = build(vectors, f"{shared_dir(s)}/vector-index-{uuid.uuid4().hex}")
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    probes = 4 if rounds > 1 else calibrated(index, vectors)
    return search(index, asked, 10, probes, rounds, exact=vectors if exact else None).select("qid", "doc_id", "score", "rank")


QUERIES = {
    "vector_index_topk": (lambda s, d: _query(s, d, 2, True), R._dense_sql("true")),
    "vector_index_probed": (lambda s, d: _query(s, d, 1, False), None),
}
