"""Stabbing joins: the innermost interval around each point, in O(n log n) and without a task that holds a whole key.

Positions are cut into runs of ``width``. An interval that covers runs as a whole is handed to them through the dyadic nodes
that make it up, of which each keeps the innermost one only: a run then looks up the nodes above it. What begins or
ends inside a run is swept there in sorted order together with the run's points. So a key (a file, a root) is as many tasks as it
has runs, and an interval costs a logarithmic number of rows however long it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a run, where the caller doesn't know better.
WIDTH = 4096
_FOUND = "key__ string, at__ long, tag__ long, start__ long, end__ long, name__ string"


def _swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points with the innermost open interval, of events sorted by run and position; a task holds the open ones and a batch."""
    run, open_ = None, []
    for f in frames:
        rows = []
        for key, bin_, pos, is_point, tag, start, end, name in zip(*(f[c].tolist() for c in ("key__", "run__", "at__", "point__", "tag__", "start__", "end__", "name__"))):
            if (key, bin_) != run:
                run, open_ = (key, bin_), []
            if not is_point:
                heapq.heappush(open_, _Innermost((-start, end), name))
                continue
            while open_ and open_[0].place[1] <= pos:
                heapq.heappop(open_)
            best = open_[0] if open_ else None
            rows.append((key, pos, tag, -best.place[0] if best else None, best.place[1] if best else None, best.name if best else None))
        out = pd.DataFrame(rows, columns=["key__", "at__", "tag__", "start__", "end__", "name__"])
        yield out.astype({"tag__": "Int64", "start__": "Int64", "end__": "Int64"})


class _Innermost:
    """Order of open intervals: the latest start, then the earliest end, then the greatest name, nulls last."""

    def __init__(self, place: tuple[int, int], name: str | None):
        self.place, self.name = place, name

    def __lt__(self, other: _Innermost) -> bool:
        return self.place < other.place or (self.place == other.place and self.name is not None and (other.name is None or self.name > other.name))


def _dyadic(first: Column, last: Column) -> Column:
    """``array<struct<level,node>>``: the runs ``first`` to ``last`` as the fewest blocks of 2**level runs each."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((last - first + 1).cast("double"))).cast("int") + 1)

    def of(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.floor((first + size - 1) / size), F.floor((last + 1) / size)
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), F.struct(k.alias("level"), low.alias("node")))
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), F.struct(k.alias("level"), (high - 1).alias("node")))
        return F.filter(F.array(left, right), lambda x: x.isNotNull())

    return F.flatten(F.transform(levels, of))


def innermost(points: DataFrame, intervals: DataFrame, key: str, at: str, tag: str | None = None, start: str = "start", end: str = "end", name: str = "name", width: int = WIDTH) -> DataFrame:
    """``key, at[, tag], start, end, name``: every point with the innermost interval ``[start, end)`` of its key around it.

    Innermost is the one that starts last, of those the one that ends first, then the greatest name; without one all three are null.
    ``tag`` (a long) tells points of one place apart. Points without key or place have no interval; intervals without a
    bound, or that end where they start or before, hold no point.
    """
    size = F.lit(width).cast("long")
    run = lambda c: F.floor(c / size)
    own_tag = F.lit(None).cast("long") if tag is None else F.col(tag).cast("long")
    asked = points.select(F.col(key).cast("string").alias("key__"), F.col(at).cast("long").alias("at__"), own_tag.alias("tag__"))
    spans = intervals.select(F.col(key).cast("string").alias("key__"), F.col(start).cast("long").alias("start__"), F.col(end).cast("long").alias("end__"), F.col(name).cast("string").alias("name__"))
    spans = spans.where("key__ is not null and start__ < end__").withColumn("first", F.ceil(F.col("start__") / size)).withColumn("last", run(F.col("end__")) - 1)

    whole = spans.where("first <= last").select("key__", F.explode(_dyadic(F.col("first"), F.col("last"))).alias("d"), F.struct("start__", (-F.col("end__")).alias("e"), "name__").alias("s"))
    nodes = whole.groupBy("key__", "d.level", "d.node").agg(F.max("s").alias("s"))
    top = nodes.agg(F.max("level")).first()[0]
    located = asked.where("key__ is not null and at__ is not null").withColumn("run__", run(F.col("at__")))
    kind = lambda point: F.lit(int(point)).alias("point__")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start__", "long"), ("end__", "long"), ("name__", "string"))]
    events = located.select("key__", "run__", "at__", kind(True), "tag__", *none)
    no_tag = F.lit(None).cast("long").alias("tag__")
    ends = F.array_distinct(F.array(run(F.col("start__")), run(F.col("end__") - 1)))
    partly = spans.withColumn("run__", F.explode(F.filter(ends, lambda r: ~r.between(F.col("first"), F.col("last")))))
    events = events.unionByName(partly.select("key__", "run__", F.greatest(F.col("start__"), F.col("run__") * size).alias("at__"), kind(False), no_tag, "start__", "end__", "name__"))
    if top is not None:
        above = located.select("key__", "run__").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        above = above.withColumn("node", F.floor(F.col("run__") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))))
        over = above.join(nodes, ["key__", "level", "node"]).groupBy("key__", "run__").agg(F.max("s").alias("s"))
        events = events.unionByName(over.select("key__", "run__", (F.col("run__") * size).alias("at__"), kind(False), no_tag, F.col("s.start__").alias("start__"), (-F.col("s.e")).alias("end__"), F.col("s.name__").alias("name__")))
    sorted_ = events.repartition("key__", "run__").sortWithinPartitions("key__", "run__", "at__", "point__")
    found = sorted_.mapInPandas(_swept, _FOUND)
    lost = asked.where("key__ is null or at__ is null").select("key__", "at__", "tag__", *none)
    out = found.unionByName(lost)
    kept = [F.col("key__").cast(points.schema[key].dataType).alias(key), F.col("at__").cast(points.schema[at].dataType).alias(at)]
    kept += [] if tag is None else [F.col("tag__").cast(points.schema[tag].dataType).alias(tag)]
    return out.select(*kept, *[F.col(f"{mine}__").alias(theirs) for mine, theirs in (("start", start), ("end", end), ("name", name))])
