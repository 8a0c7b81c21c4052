"""Upserts by deltas: batches in any number, merges between, attempts that are done again."""

import random

import pytest

from docloom.streaming import upserts as U

KIND = "k string, at long, v string"


def test_the_latest_row_of_each_key(spark, tmp_path):
    r, want, path = random.Random(8), {}, str(tmp_path)
    sink = U.delta_sink(path, "k", "at")
    assert U.upserted(spark, path, "k", "at") is None and U.compact(spark, path, "k", "at") == -1
    for number in range(6):
        rows = [(f"k{r.randint(0, 9)}", r.choice([None, *range(20)]), f"v{number}-{i}") for i in range(25)] + [(None, 99, "x")]
        for k, at, v in rows:
            rank = (at is not None, at or 0, number, v)
            if k and rank > want.get(k, ((False, 0, -1, ""),))[0]:
                want[k] = (rank, at, v)
        batch = spark.createDataFrame(rows, KIND).repartition(3)
        sink(batch, number)
        sink(batch, number)
        if number in (1, 3):
            assert U.compact(spark, path, "k", "at") == number == U.compact(spark, path, "k", "at")
        got = {x.k: (x.at, x.v) for x in U.upserted(spark, path, "k", "at").collect()}
        assert got == {k: w[1:] for k, w in want.items()}


def test_a_merge_that_dies_before_its_note(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sink = U.delta_sink(path, "k", "at")
    sink(spark.createDataFrame([("a", 1, "x")], KIND), 0)
    make = type(spark).createDataFrame

    def die(self, data, schema=None, **k):
        if schema == U.NOTES:
            raise KeyboardInterrupt
        return make(self, data, schema, **k)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", die)
        with pytest.raises(KeyboardInterrupt):
            U.compact(spark, path, "k", "at")
    sink(spark.createDataFrame([("a", 2, "y")], KIND), 1)
    assert [(x.at, x.v) for x in U.upserted(spark, path, "k", "at").collect()] == [(2, "y")] and U.compact(spark, path, "k", "at") == 1
    assert [(x.at, x.v) for x in U.upserted(spark, path, "k", "at").collect()] == [(2, "y")]
