"""The Merkle manifest against a plain one."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle_manifest
from docloom.llm.common import numbered, staged
from docloom.llm.merkle_manifest import folded, manifest, proof

from .cases import SCHEMA, documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(digests):
    """The levels of a tree, from the leaves."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return out


def plain(rows):
    """(doc_id, leaf) to (subroot, root, proof, path) of rows of SCHEMA."""
    leaves = sorted(((r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(r[0], r[3], r[2], r[4], r[1])) for r in rows))
    groups = [list(g) for _, g in groupby(leaves, lambda x: x[:2])]
    trees = [levels([x[4] for x in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (rows_, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, x in enumerate(rows_):
            path = siblings(tree, i) + siblings(top, g)
            out.append((x[3] if x[2] else None, x[4], tree[-1][0], top[-1][0], h(*("".join(a + b) for a, b in path))))
    return sorted(map(repr, out))


def found(df):
    rows = df.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof")).collect()
    return sorted(repr(tuple(r)) for r in rows)


def many(n, sources=("a", None, "é", "z", "", "ab")):
    return [(i * 7 % n, f"text {i}\nmore", "en", "hot" if i % 3 == 0 else sources[i % len(sources)] if i % 11 else f"s{i}", i) for i in range(n)]


@pytest.mark.parametrize("rows", [documents(), many(700), many(28), many(1), [(5, "x", "en", f"s{i}", 1) for i in range(30)]])
def test_same_as_plain(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = manifest(docs)
    assert found(out) == plain(rows)
    assert out.filter(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert out.filter(folded(F.lit("0"), F.col("path")) == F.col("root")).count() == 0


def test_changed_texts_are_told(spark, tmp_path):
    import zlib

    rows = [r for r in documents() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = merkle_manifest.query(spark, str(tmp_path)).collect()
    breaks = {r[0]: "\n" in (r[1] or "") for r in rows}
    assert len(out) == len(rows) and {r.root for r in out} == {out[0].root}
    for r in out:
        assert r.verified == (r.folded_root == r.root) == (not (breaks[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 2 == 0))
    assert {r.verified for r in out} == {True, False}


def test_own_fields_and_odd_names(spark):
    docs = spark.createDataFrame([(i, f"g{i % 2}", "x", i) for i in range(20)], "`a.b` long, path string, leaf string, digest long")
    out = manifest(docs, fields=["a.b", "leaf"], group="path", order="a.b", carry=("a.b", "leaf", "digest"))
    assert out.columns == ["a.b", "digest", "leaf", "subroot", "root", "path"]
    assert {r["a.b"]: r.leaf for r in out.collect()} == {i: plain_leaf(i, "x") for i in range(20)}


def test_an_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_of_groups_that_go_over_tasks(spark):
    rows = staged(spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 40 AS string)) AS g", "(id * 37) % 5000 AS v", "id % 2 AS w").repartition(7), "rows")
    out = numbered(rows, "g", ["w", "v"], "order").collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [(r.w, r.v) for r in own] == sorted((r.w, r.v) for r in own)
