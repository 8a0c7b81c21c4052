"""Publishing, restoring and indexing, with jobs that die between their steps."""

import os

import pytest

from docloom.sources import publication as P
from docloom.streaming import index_stream as I


def products(df):
    return {r.product for r in df.collect()}


def sections(spark, names):
    return {"sections": spark.createDataFrame([(n, i) for n in names for i in range(50)], "product string, section long").repartition(3), "catalog": spark.createDataFrame([(n,) for n in names], "product string")}


def test_versions_come_and_go(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert P.pending(spark, root).count() == 0
    with pytest.raises(P.Refused):
        P.current(spark, root, "sections")
    assert P.publish(sections(spark, ["a", "b"]), root, ["a", "b"]) == 1
    assert products(P.pending(spark, root)) == {"a", "b"}
    P.mark_built(spark, root)
    assert P.pending(spark, root).count() == 0
    assert P.publish(sections(spark, ["a", "b", "c"]), root, ["c"]) == 2
    assert products(P.current(spark, root, "catalog")) == {"a", "b", "c"} and products(P.pending(spark, root)) == {"c"}
    P.restore(spark, root, 1)
    assert products(P.current(spark, root, "sections")) == {"a", "b"} and products(P.pending(spark, root)) == {"c"}
    assert P.publish(sections(spark, ["d"]), root, ["d"]) == 3
    P.restore(spark, root, 2)
    assert products(P.current(spark, root, "catalog")) == {"a", "b", "c"}
    with pytest.raises(P.Refused):
        P.restore(spark, root, 9)
    assert {r.name for r in P.digests(spark, root, 1).collect()} == {"sections", "catalog"}


def test_a_job_that_dies_between_staging_and_the_swap(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pub")
    P.publish(sections(spark, ["a"]), root, ["a"])

    def die(*_):
        raise KeyboardInterrupt

    for step in ("_files", "faults", "_note"):  # before the manifest, before the check, before the swap
        with monkeypatch.context() as m:
            m.setattr(P, step, die)
            with pytest.raises(KeyboardInterrupt):
                P.publish(sections(spark, ["a", "half"]), root, ["half"])
        assert products(P.current(spark, root, "catalog")) == {"a"} and products(P.pending(spark, root)) == {"a"}
    assert P.publish(sections(spark, ["a", "whole"]), root, ["whole"]) == 2
    assert products(P.current(spark, root, "catalog")) == {"a", "whole"}


def test_files_that_changed_are_refused(spark, tmp_path):
    root = str(tmp_path / "pub")
    P.publish(sections(spark, ["a"]), root, ["a"])
    P.publish(sections(spark, ["b"]), root, ["b"])
    folder = tmp_path / "pub/v1/tables/sections"
    files = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    whole = (folder / files[0]).read_bytes()
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    (folder / files[0]).write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    (folder / "extra.parquet").write_bytes(whole)
    (folder / files[1]).unlink()
    assert sorted(r.fault for r in P.faults(spark, root, 1).collect()) == ["added", "changed", "missing"]
    with pytest.raises(P.Refused, match="changed"):
        P.restore(spark, root, 1)
    assert products(P.current(spark, root, "catalog")) == {"b"}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(rows):
    from collections import Counter

    return {(t, i, n) for i, text in rows.items() for t, n in Counter((text or "").split()).items()}


def test_a_stream_that_is_started_again_gives_the_index_of_all(spark, tmp_path):
    root, into = str(tmp_path / "index"), str(tmp_path / "in")
    got = lambda: {(r.token, r.doc_id, r.tf) for r in I.postings(spark, root).collect()}
    assert got() == set() and I.build(spark, root) == -1
    want = {}
    for step in range(4):
        rows = [(i, f"w{i} common step{step} common") for i in range(step * 5, step * 5 + 8)] + [(100 + step, None)]
        want |= dict(rows)
        docs(spark, rows).coalesce(1).write.mode("append").parquet(into)
        stream = spark.readStream.schema("doc_id long, text string").parquet(into)
        I.follow(stream, root).awaitTermination()
        assert got() == plain(want)
        if step in (1, 2):
            I.build(spark, root)
            assert got() == plain(want)
    assert {r.doc_id: r.dl for r in I.lengths(spark, root).collect()} == {i: len((t or "").split()) for i, t in want.items()}
    states = {r.batch: r.state for r in I.state(spark, root).collect()}
    assert states == {0: "built", 1: "built", 2: "built", 3: "pending"}
    assert I.build(spark, root) == 3 and I.build(spark, root) == 3 and got() == plain(want)


def test_batches_and_merges_that_are_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    sink = I.delta_sink(root)
    sink(docs(spark, [(1, "a b"), (2, "b")]), 0)
    sink(docs(spark, [(1, "a b"), (2, "b")]), 0)
    sink(docs(spark, [(2, "c"), (2, "b c"), (None, "z")]), 1)
    want = {("a", 1, 1), ("b", 1, 1), ("c", 2, 1)}
    got = lambda: {(r.token, r.doc_id, r.tf) for r in I.postings(spark, root).collect()}
    assert got() == want
    make = type(spark).createDataFrame
    with monkeypatch.context() as m:  # dies between the base and its note
        m.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: make(self, data, schema, **k) if schema != I.BASES or not data else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            I.build(spark, root)
    assert got() == want and {r.state for r in I.state(spark, root).collect()} == {"pending"}
    assert I.build(spark, root) == 1 and got() == want


def test_a_manifest_is_not_hashed_in_one_task(spark, tmp_path):
    root = str(tmp_path / "pub")
    P.publish(sections(spark, ["a", "b"]), root, ["a", "b"])
    plan = P._manifest(spark, root, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" in plan and "Coalesce 1" not in plan
    assert len(spark.read.parquet(f"{root}/v1/manifest").inputFiles()) == 1
