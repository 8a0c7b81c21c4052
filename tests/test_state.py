"""Keyed state over several batches, and hot sessions."""

import random

import pytest

from docloom.streaming import state as S

KIND = "id long, request_id string, action string, created_at long"


@pytest.fixture
def store(spark):
    yield
    spark.conf.unset(S.STORE[0])


def test_the_last_verdict_and_the_first_of_others(spark, tmp_path, store):
    r = random.Random(4)
    rows = [(i, f"r{r.randint(0, 9)}", r.choice(["solved", "unsolved", "transfer", "ticket_open"]), i * 10) for i in range(160)] + [(900, None, "solved", 1), (901, "r1", None, 1)]
    want = {}
    for part in range(4):
        own = rows[part * 40 : part * 40 + 40] + (rows[160:] if part == 1 else [])
        spark.createDataFrame(own, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _, q, action, at in own:
            if q and action in S.VERDICTS:
                want[q, "verdict"] = (action, at)
            elif q and action:
                want.setdefault((q, action), (action, at))
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        S._run(S.standing_feedback(stream, ttl=False), S.slot_sink(str(tmp_path / "out")), str(tmp_path), "update")
        got = {(x.request_id, x.slot): (x.action, x.created_at) for x in S.standing(spark, str(tmp_path / "out")).collect()}
        assert got == want


def test_requests_of_a_group_meet_in_one_call(spark, tmp_path, store, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 1)
    rows = [(i, f"r{i % 50}", ["solved", "transfer", "unsolved", "ticket_open"][i // 50 % 4], i) for i in range(400)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    S._run(S.standing_feedback(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), ttl=False), S.slot_sink(str(tmp_path / "out")), str(tmp_path), "update")
    got = {(x.request_id, x.slot): (x.action, x.created_at) for x in S.standing(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 150 and got["r3", "verdict"] == ("unsolved", 303) and got["r3", "transfer"] == ("transfer", 53) and got["r3", "ticket_open"] == ("ticket_open", 153)


def test_the_hottest_sessions_stay(spark, tmp_path):
    r = random.Random(6)
    sink, kept = S.hot_sessions_sink(str(tmp_path), most=5, keep=3), {}
    for number in range(4):
        rows = [(f"s{r.randint(0, 11)}", number * 100 + i, i, f"t{i}") for i in range(30)] + [(None, 10_000, 0, "x")]
        for q, at, turn, text in rows:
            if q:
                kept.setdefault(q, []).append((at, turn, text))
        kept = {q: sorted(v)[-3:] for q, v in kept.items()}
        kept = dict(sorted(kept.items(), key=lambda x: (-x[1][-1][0], x[0]))[:5])
        batch = spark.createDataFrame(rows, "session_id string, at long, turn long, text string")
        sink(batch, number)
        sink(batch, number)  # a batch that is done again
        got = {}
        for x in S.hot_sessions(spark, str(tmp_path)).collect():
            got.setdefault(x.session_id, []).append((x.at, x.turn, x.text))
        assert {q: sorted(v) for q, v in got.items()} == kept
