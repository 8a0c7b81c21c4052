"""Running sums, percentiles, cooldown and numbers where one key has all rows."""

import random

import pytest

from docloom.operators import monitor, ranks, structure


def test_running_sums_of_any_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(30)]), i, r.randint(0, 5)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v long, i long, w long").repartition(7)
    for groups in (["g"], [], ["g", "v"]):
        want, sums = {}, {}
        order = sorted(rows, key=lambda x: tuple((x["gvi".index(c)] is not None, x["gvi".index(c)] or 0) if c != "g" else (x[0] is not None, x[0] or "") for c in [*groups, "v", "i"]))
        for x in order:
            key = tuple(x["gvi".index(c)] for c in groups)
            want[x[2]] = sums.get(key, 0)
            sums[key] = sums.get(key, 0) + x[3]
        got = ranks.running_sums(df, groups, ["v", "i"], "w").collect()
        assert {x.i: x.sum_before for x in got} == want and len(got) == len(rows)
        assert all(x.sum_all == sums[tuple(getattr(x, c) for c in groups)] for x in got)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 400])
def test_percentiles_by_nearest_rank(spark, n):
    r = random.Random(n)
    rows = [("hot" if i % 5 else None, float(r.randint(0, 9)) if r.random() < 0.9 else None) for i in range(n)] + [("none", None)]
    got = monitor.percentiles(spark.createDataFrame(rows, "category string, duration_ms double").repartition(4), ["category"]).collect()
    for x in got:
        own = sorted(v for g, v in rows if g == x.category and v is not None)
        rank = lambda p: own[max(1, -(-len(own) * p // 100)) - 1] if own else None  # noqa: B023, E731
        assert (x.p50, x.p95, x.p99, x.n) == (rank(50), rank(95), rank(99), sum(g == x.category for g, _ in rows))
    assert {x.category for x in got} == {g for g, _ in rows}


@pytest.mark.parametrize("wait, spread", [(10, 3), (10, 40), (1000, 7), (1, 1)])
def test_cooldown_is_a_fold_in_order(spark, wait, spread):
    r = random.Random(wait + spread)
    rows, at = [], -50
    for _ in range(300):
        at += r.randint(0, spread) if r.random() < 0.97 else 50 * wait
        rows.append(("hot" if r.random() < 0.9 else "rare", at))
    want = set()
    for key in ("hot", "rare"):
        last = None
        for k, t in sorted(rows):
            if k == key and (last is None or t - last >= wait):
                want.add((key, t))
                last = t
    df = spark.createDataFrame(rows + [(None, 1), ("hot", None)], "alert_key string, at long").repartition(3)
    assert {tuple(x) for x in monitor.cooldown(df, wait).collect()} == want
    assert monitor.cooldown(df.limit(0), wait).count() == 0


def test_numbers_over_all_groups(spark):
    rows = [("b" if i % 7 else "a", i // 3, i) for i in range(500)]
    got = structure.renumbered(spark.createDataFrame(rows, "product string, doc long, section long").repartition(6), "product", "doc", "section").collect()
    assert {(x.product, x.doc, x.section): x.chunk_id for x in got} == {k: n for n, k in enumerate(sorted(rows))}
