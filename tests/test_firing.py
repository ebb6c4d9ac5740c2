"""Greedy firing of hot roots, range by range, against the fold."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import firing, state


def fold(rows, window):
    out, last = [], {}
    for i, root, us, lasts in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        ready, at, n = last.get(root, (None, None, 0))
        fire = ready is None or us >= ready
        if fire:
            last[root] = (us + max(window, lasts or 0), us, n + 1)
        out.append((i, root, us, fire, last[root][2], last[root][1]))
    return sorted(out)


def run(spark, rows, window, **how):
    df = spark.createDataFrame(rows, "event_id long, root long, us long, lasts long")
    return sorted(map(tuple, firing.fired(df, window, "lasts", **how).collect()))


def log(seed, n, roots, span):
    rng = random.Random(seed)
    rows = [(i, rng.choice(roots), rng.randrange(span), rng.choice([0, 0, 3, 50, None, 400])) for i in range(n)]
    return rows + [(n, None, 5, 0), (n + 1, roots[0], None, 0)]


@pytest.mark.parametrize("walked", [0, 50_000])
@pytest.mark.parametrize("roots,span,window", [([1], 4000, 30), ([1], 300, 1), ([7, 7, 7, 8, 9], 2500, 200), ([3], 50_000, 10_000)])
def test_hot_roots_equal_the_fold(spark, roots, span, window, walked):
    """One root, several hot ones; sparse, dense and with windows longer than a range; hops walked and doubled."""
    rows = log(len(roots) + span, 900, roots, span)
    assert run(spark, rows, window, ranges=6, walked=walked) == fold(rows, window)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 60), st.sampled_from([2, 5, 9]))
def test_any_log(spark, monkeypatch, seed, window, ranges):
    monkeypatch.setattr(firing, "HOT", 10)
    rows = log(seed, 250, [1, 1, 1, 2, 3], 600)
    assert run(spark, rows, window, ranges=ranges, walked=0 if seed % 2 else 50_000) == fold(rows, window)


def test_no_task_has_all_rows_of_one_root(spark):
    """A single root, as when engines are looked for anew: its rows come from several tasks, none with more than its share."""
    df = spark.range(10_000, numPartitions=3).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("root"), ((F.col("id") * 7919) % 1_000_003).alias("us"))
    got = state.debounced(df, 5000).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) >= 8 and max(sizes) < 2500


def test_small_and_empty_logs(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(1, 5, 0, None), (2, 5, 9, 0), (3, 5, 10, 0), (4, 6, 0, 100), (5, 6, 99, 0), (6, 6, 100, 0)], 10) == [
        (1, 5, 0, True, 1, 0), (2, 5, 9, False, 1, 0), (3, 5, 10, True, 2, 10), (4, 6, 0, True, 1, 0), (5, 6, 99, False, 1, 0), (6, 6, 100, True, 2, 100),
    ]


def test_a_pass_in_flight(spark):
    rows = [(1, 5, 0, 40), (2, 5, 39, 0), (3, 5, 40, 0), (4, 5, 60, 5), (5, 5, 64, 0), (6, 5, 65, 0), (7, 6, 10, 0)]
    df = spark.createDataFrame(rows, "event_id long, root long, us long, lasts long")
    got = {r["event_id"]: r["reindexing"] for r in state.reindexing(df, 10, "lasts", width=16).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_sessions_and_lookups(spark):
    from tessera.operators import gateway

    rows = [(1, 5, 0, 10, False), (2, 5, 9, 1, True), (3, 5, 10, 1, True), (4, 5, 10 + 60_000_000 - 1, 1, True), (5, 5, 10 + 60_000_000, 7, True), (6, 5, 10 + 60_000_006, 1, False), (7, 5, 10 + 60_000_007, 1, False), (8, 6, 3, 2, True)]
    got = {r["event_id"]: (r["started"], r["state"]) for r in gateway.sessions(spark.createDataFrame(rows, "event_id long, root long, us long, took long, ok boolean")).collect()}
    assert got == {1: (True, "warming"), 2: (False, "warming"), 3: (False, "cooling"), 4: (False, "cooling"), 5: (True, "warming"), 6: (False, "warming"), 7: (False, "ready"), 8: (True, "warming")}
    asks = [(1, 5, 0, "unreachable"), (2, 5, 1, "missing"), (3, 5, 2, "ok"), (4, 5, 30_000_001, "ok"), (5, 5, 99_000_000, "missing"), (6, 6, 0, None), (7, 6, 5, "ok")]
    told = {r["event_id"]: (r["asked"], r["answer"]) for r in gateway.lookups(spark.createDataFrame(asks, "event_id long, root long, us long, outcome string")).collect()}
    assert told == {1: (True, "backend-unreachable"), 2: (True, "not-indexed"), 3: (False, "not-indexed"), 4: (True, "ok"), 5: (False, "ok"), 6: (True, "backend-unreachable"), 7: (True, "ok")}
