"""The stored vector index against comparing all with all."""

import numpy as np
import pytest

from docloom.operators import retrieval as R
from docloom.operators import vector_index as V

KIND = "vec_id long, embedding array<float>"


def clustered(n, dims=24, seed=1, groups=12):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, dims))
    x = centres[g.integers(0, groups, n)] + 0.35 * g.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 6] = x[n // 2]  # one vector many times
    x[3] = 0
    return x.astype(np.float32)


def plain(x, ids, n):
    unit = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-12)
    out = set()
    for q in ids:
        scores = np.round(unit @ unit[q], 6)
        out |= {(q, int(i), k + 1) for k, i in enumerate(np.lexsort((np.arange(len(x)), -scores))[:n])}
    return out


def tables(spark, x, step):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    return rows, rows.filter(f"vec_id % {step} = 0").withColumnRenamed("vec_id", "qid")


@pytest.mark.parametrize("cells, part, piece", [(None, 1 << 14, 2048), (9, 50, 7), (1, 100, 16)])
def test_same_as_all_with_all(spark, tmp_path, monkeypatch, cells, part, piece):
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "SLICE", piece)
    x = clustered(900)
    rows, asked = tables(spark, x, 23)
    index = V.build(rows, str(tmp_path / "index"), cells)
    found = V.search(index, asked, 10, probes=2, exact=rows)
    assert {(r.qid, r.doc_id, r["rank"]) for r in found.collect()} == plain(x, range(0, 900, 23), 10)


def test_recall_of_the_first_probes(spark, tmp_path):
    x = clustered(3000, seed=2)
    rows, asked = tables(spark, x, 30)
    index = V.build(rows, str(tmp_path / "index"))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got, hits = V.search(index, asked, 10, probes=8, rounds=1).collect(), 0
    for q in range(0, 3000, 30):
        least = np.sort(unit @ unit[q])[-10]
        hits += sum(float(unit[r.doc_id] @ unit[q]) >= least - 1e-3 for r in got if r.qid == q)
    assert hits / (10 * 100) >= 0.9


def test_every_row_is_stored_and_read_again(spark, tmp_path):
    x = clustered(400)
    rows, _ = tables(spark, x, 10)
    odd = spark.createDataFrame([(1000, None), (1001, [1.0] * 23 + [None]), (1002, []), (7, x[7].tolist())], KIND)
    V.build(rows.unionByName(odd), str(tmp_path / "index"), 5)
    index = V.load(spark, str(tmp_path / "index"))
    assert sorted(r.vec_id for r in index.vectors.select("vec_id").collect()) == sorted([*range(400), 7])
    stored = V.halves(index.vectors.filter("vec_id = 20").select("half").toArrow().column("half"))[0]
    assert abs(float(np.linalg.norm(stored)) - 1) < 1e-9 and np.abs(stored - x[20] / np.linalg.norm(x[20])).max() < 1e-3
    asked = spark.createDataFrame([(1, None), (2, x[20].tolist())], "qid long, embedding array<float>")
    assert {r.qid for r in V.search(index, asked, 3).collect()} == {2}


def test_scores_stay_within_the_blur(spark, tmp_path):
    x = clustered(300, dims=64)
    rows, asked = tables(spark, x, 7)
    index = V.build(rows, str(tmp_path / "index"), 1)
    exact = {(r.qid, r.doc_id): r.score for r in R.dense_top(rows, asked, 300).collect()}
    got = V.search(index, asked, 10, rounds=1).collect()
    assert got and max(abs(exact[r.qid, r.doc_id] - r.score) for r in got) <= V.BLUR


def test_an_empty_index(spark, tmp_path):
    rows, asked = tables(spark, clustered(40), 5)
    index = V.build(rows.limit(0), str(tmp_path / "index"))
    assert V.search(index, asked, 3).count() == 0 and V.search(index, asked, 3, exact=rows.limit(0)).count() == 0


@pytest.mark.parametrize("groups, least", [(12, 0.9), (3000, 0.9)])
def test_recall_of_as_many_probes_as_a_sample_needs(spark, tmp_path, groups, least):
    x = clustered(3000, seed=5, groups=groups)
    rows, asked = tables(spark, x, 30)
    index = V.build(rows, str(tmp_path / "index"))
    probes = V.calibrated(index, rows)
    found = {(r.qid, r.doc_id) for r in V.search(index, asked, 10, probes, 1, exact=rows).collect()}
    want = {(q, i) for q, i, _ in plain(x, range(0, 3000, 30), 10)}
    assert len(found & want) / len(want) >= least and (probes < 30 or groups > 12)
