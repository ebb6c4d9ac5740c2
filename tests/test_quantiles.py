"""Exact quantiles by range refinement, against numpy."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import quantiles

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def check(spark, rows, bins):
    df = spark.createDataFrame(rows, "op string, v double")
    got = {r["op"]: [r[s] for s in SHARES] for r in quantiles.exact(df, "op", "v", SHARES, bins).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and np.isfinite(v):
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, list(SHARES.values())), rtol=1e-12)


@pytest.mark.parametrize("bins", [64, 1024])
def test_even_skewed_and_odd_values(spark, bins):
    rng = random.Random(bins)
    rows = [("even", rng.random()) for _ in range(400)] + [("skewed", 10 ** rng.uniform(-9, 9)) for _ in range(300)] + [("same", 4.0)] * 50 + [("two", 1.0), ("two", 2.0), ("one", -3.5)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(200)] + [(None, 1.0), (None, 5.0), ("", 7.0), ("none", None), ("wild", float("nan")), ("wild", float("inf")), ("wild", -0.0), ("wild", 1e300), ("wild", -1e300)]
    check(spark, rows, bins)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_any_values(spark, rows):
    check(spark, rows, 256)


def test_a_hot_group_is_counted_where_it_lies(spark):
    """Nine tenths in one group: what is shuffled is bins, and no task holds the group's values."""
    df = spark.range(60_000, numPartitions=6).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("op"), ((F.col("id") * 7919) % 59_999).cast("double").alias("v"))
    got = quantiles.exact(df, "op", "v", {"m": 0.5})
    want = df.groupBy("op").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    assert sorted(got.collect()) == sorted(want.collect())
    x = df.select(F.concat(F.lit("k"), "op").alias("key__"), F.col("v").alias("x"))
    state = x.groupBy("key__").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).select("key__", "n", F.array(F.struct("low", "high", F.lit(9).cast("long").alias("rank"))).alias("b"))
    met = quantiles.join_hot(x, state, "key__", "n", 60_000, "b").withColumn("task", F.spark_partition_id())
    assert met.where("key__ = 'khot'").groupBy("task").count().agg(F.max("count")).first()[0] <= 10_000


def test_empty(spark):
    assert quantiles.exact(spark.createDataFrame([], "op string, v double"), "op", "v", SHARES).collect() == []
