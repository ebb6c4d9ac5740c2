"""The innermost interval around each point, against every pair."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, intervals

SPANS = "path string, start long, end long, name string"


def brute(points, spans):
    out = []
    for key, at, tag in points:
        around = [(s, -e, n or "", n) for k, s, e, n in spans if k == key and None not in (key, at, s, e) and s <= at < e]
        best = max(around, default=None)
        out.append((key, at, tag, *((best[0], -best[1], best[3]) if best else (None, None, None))))
    return sorted(out, key=str)


def run(spark, points, spans, width):
    p = spark.createDataFrame(points, "path string, i long, tag long")
    got = intervals.innermost(p, spark.createDataFrame(spans, SPANS), "path", "i", "tag", width=width)
    assert got.columns == ["path", "i", "tag", "start", "end", "name"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-40, 120)), st.integers(0, 99)), max_size=40),
    st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-60, 130), st.integers(-60, 130), st.sampled_from(["x", "y", "", None])), max_size=30),
    st.sampled_from([1, 3, 16, 4096]),
)
def test_any_intervals(spark, points, spans, width):
    assert run(spark, points, spans, width) == brute(points, spans)


@pytest.mark.parametrize("width", [1, 8, 64])
def test_nested_overlapping_and_long(spark, width):
    rng = random.Random(width)
    spans = [("f", a, a + rng.choice([1, 5, 40, 700, 3000]), f"n{k}") for k, a in enumerate(rng.sample(range(3000), 250))] + [("f", 0, 4000, "all"), ("g", 5, 6, "g")]
    points = [("f", at, at) for at in range(-5, 4005, 7)] + [("g", at, 0) for at in (4, 5, 6)] + [("h", 1, 1)]
    assert run(spark, points, spans, width) == brute(points, spans)


def test_empty_sides(spark):
    assert run(spark, [], [("a", 0, 9, "x")], 8) == []
    assert run(spark, [("a", 3, 1)], [], 8) == [("a", 3, 1, None, None, None)]


def _one_file(spark, n):
    """A file of ``n`` matching lines in ``n`` definitions: half of them small, half nested over everything that follows."""
    lines = spark.range(n, numPartitions=4)
    points = lines.select(F.lit("f").alias("path"), F.col("id").cast("int").alias("i"))
    spans = lines.select(F.lit("f").alias("path"), F.col("id").cast("int").alias("start"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(2 * n - F.col("id")).cast("int").alias("end"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"))
    return points, spans


def test_one_file_grows_linearly_over_several_tasks(spark):
    took = {}
    for n in (15_000, 60_000):
        points, spans = _one_file(spark, n)
        began = time.perf_counter()
        got = intervals.innermost(points, spans, "path", "i", width=1024)
        assert got.where("name = concat('d', i)").count() == n  # each line's own definition is its innermost
        took[n] = time.perf_counter() - began
    assert took[60_000] < 4 * took[15_000] + 6 and took[60_000] < 40
    points, spans = _one_file(spark, 20_000)
    by_run = intervals.innermost(points, spans, "path", "i", width=1024).groupBy(F.floor(F.col("i") / 1024)).count().count()
    assert by_run == 20


def test_pattern_answer(spark):
    files = spark.createDataFrame([("a.py", ["x = 1", "def f():", "    hit", "    def g():", "        hit", "hit"]), ("b.py", ["nothing"])], "path string, lines array<string>")
    spans = spark.createDataFrame([("a.py", "f", 1, 5), ("a.py", "g", 3, 5)], "path string, name string, start int, end int")
    got = [r["line"] for r in chunking.pattern_lines(files, spans, "hit").orderBy("place", "line").collect()]
    assert got == ['## Pattern matches for "hit" (3)', "- a.py  (lines 6)", "- f a.py:2  (lines 3)", "- g a.py:4  (lines 5)"]
    assert [r["line"] for r in chunking.pattern_lines(files, spans, "absent").collect()] == ['## Pattern matches for "absent"\n(no matches)']
