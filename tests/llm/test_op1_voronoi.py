import math

import numpy as np
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tessera.llm import op1_voronoi as op

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks, out = {}, []
    for i, v in sorted(ok):
        if i % every == 0:
            asks.setdefault(i, v)
    for q, a in asks.items():
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **how):
    return sorted(map(tuple, op.search(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND), **how).collect()))


def test_equals_sql(spark, small):
    compare(op.search(spark.read.parquet(f"{small}/embeddings.parquet")), op.ORACLE, small)


def test_clusters_noise_and_salts(spark, monkeypatch):
    monkeypatch.setattr(op, "DATA_BLOCK", 60)
    monkeypatch.setattr(op, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(3, 6))
    rows = [(i, (centre[i % 3] + 0.01 * rng.normal(size=6) if i % 2 else rng.normal(size=6)).astype(np.float32).tolist()) for i in range(400)]
    assert run(spark, rows, every=20) == brute(rows, every=20)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [0.5]), (100, [0.0, -1.0]), (100, [0.0, -1.0]), (-100, [2.0, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_and_lone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_large_numbers(spark):
    rows = [(0, [2.5e6, 1.0]), (1, [2.5e6, 2.0]), (2, [2.5e6, 1.0]), (3, [-2.5e6, 5.0])]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    compare(op.search(clash(e)), op.ORACLE, small)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=30))
def test_small_integer_vectors(spark, vectors):
    rows = [(i * 5, [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert run(spark, rows) == brute(rows)


def test_clusters_are_pruned(spark, monkeypatch):
    """Of clustered rows a block gets its own cluster; without structure it gets all rows, over several salts."""
    monkeypatch.setattr(op, "DATA_BLOCK", 500)
    rng = np.random.default_rng(2)
    centre = 10 * np.eye(16)[:8]
    rows = [(i, (centre[i % 8] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    noise = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(4000)]
    shares = []
    for some in (rows, noise):
        data = op.quantized(spark.createDataFrame([(i, v, 0) for i, v in some], KIND))
        asking, sent, _ = op.dealt(data.where("vec_id % 50 = 0"), data)
        blocks = asking.select("block").distinct().count()
        shares.append(sent.count() / (4000 * blocks))
        sizes = [r["count"] for r in sent.groupBy("block", "salt").count().collect()]
        assert max(sizes) <= 700
    assert shares[0] <= 0.2 and shares[1] >= 0.5
    assert run(spark, rows, every=50) == brute(rows, every=50)


def test_scores_beyond_doubles(spark):
    """More candidates than places, scores at 2**54 and beyond that differ by less than doubles tell apart."""
    rng = np.random.default_rng(4)
    near = [(0, [1.5e5, 1.5e5])] + [(i, [1.5e5, float(np.float32(1.5e5 + (i % 13) / 64))]) for i in range(1, 90)]
    assert run(spark, near) == brute(near)
    wild = [(i, (4.0e5 * rng.normal(size=3)).astype(np.float32).tolist()) for i in range(0, 400, 4)]
    assert run(spark, wild) == brute(wild)
    assert any(abs(s) > 1 << 53 for *_, s in brute(near))


def test_components_beyond_doubles(spark):
    big = 1 << 61
    data = spark.createDataFrame([(i, [big + i, 1]) for i in range(30)], "vec_id long, v array<long>")
    ask = spark.createDataFrame([(100, [1, 0])], "vec_id long, v array<long>")
    assert [(r["vec_id"], r["score"]) for r in op.nearest(ask, data).orderBy("rank").collect()] == [(i, big + i) for i in range(29, 19, -1)]
