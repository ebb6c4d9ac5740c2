"""Greedy firing: of the events of a root those that come when the one that fired before them is over.

Firing depends on what fired before, so it is a fold over each root in time order. Roots of an ordinary share are folded by
one task each, streaming over sorted runs. A hot root, of more than its share of rows, is dealt out by ranges of time, and
its fold is put together from its ranges:

1. every range says, for each of its events, when a chain that enters there leaves the range (the time from which the next
   event may fire); chains soon meet, so few times are left;
2. each such time is looked up in the range where it falls, which gives the time at which it leaves that one: a hop;
3. the hops that the root's first event leads to are followed by pointer doubling, in as many rounds as the logarithm
   of the ranges (few hops are counted and followed on the driver instead);
4. every range is folded on from the time, generation and last firing that were found for it.

The driver holds a few numbers for each range. A task holds a range in steps 1 and 2, else a batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import BROADCAST_ROWS, HOT, cut

_FIRED = "event_id long, root long, us long, fired boolean, generation long, last_fired long"
_HOP = "root long, t long, part int, t2 long, part2 int, fired long, last long"
#: No range: the chain is past the root's last event.
END = -1


def _fold(entered: dict[tuple[int, int], tuple[int, int, int]]):
    """Folds sorted rows; ``entered`` says from which time, generation and last firing on a root goes on in a range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ready, last, generation = None, None, None, 0
        for f in frames:
            fired, gens, lasts = [], [], []
            for part, root, us, over in zip(f["part"].tolist(), f["root"].tolist(), f["us"].tolist(), f["ready"].tolist()):
                if (part, root) != key:
                    key = (part, root)
                    ready, generation, last = entered.get(key, (None, 0, None))
                fire = ready is None or us >= ready
                if fire:
                    ready, last, generation = over, us, generation + 1
                fired.append(fire)
                gens.append(generation)
                lasts.append(last)
            out = f[["event_id", "root", "us"]].assign(fired=fired)
            yield out.assign(generation=pd.Series(gens, out.index, "int64"), last_fired=pd.Series(lasts, out.index, "int64"))

    return run


class Ranges:
    """Where the roots lie that go on over several ranges: for each its ranges and the last time in each."""

    def __init__(self, ends: list):
        seen: dict[int, list[tuple[int, int]]] = {}
        for e in sorted(ends, key=lambda e: e["part"]):
            seen.setdefault(e["low"]["root"], []).append((e["part"], -e["low"]["us"]))
            if e["high"]["root"] != e["low"]["root"]:
                seen.setdefault(e["high"]["root"], []).append((e["part"], e["high"]["us"]))
        self.parts = {r: [p for p, _ in s] for r, s in seen.items() if len(s) > 1}
        self.last = {r: [t for _, t in s] for r, s in seen.items() if len(s) > 1}

    def of(self, root: int, t: int) -> int:
        """The range of the root's first event at ``t`` or later."""
        k = bisect_left(self.last[root], t)
        return self.parts[root][k] if k < len(self.parts[root]) else END


def _chains(us: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each event, if it fires: when the chain leaves the range, how often it fires there, and when last."""
    following = np.searchsorted(us, ready)
    out, n, last = ready.copy(), np.ones(len(us), np.int64), us.copy()
    for i in range(len(us) - 1, -1, -1):
        if (j := following[i]) < len(us):
            out[i], n[i], last[i] = out[j], n[j] + 1, last[j]
    return out, n, last


def _exits(ranges: Ranges):
    """``root, t, part, start, fired, last``: where chains go that leave a range; ``start``: it is the root's own chain."""

    def told(part: int, root: int, us: list, ready: list) -> list[tuple]:
        out, n, last = _chains(np.concatenate(us), np.concatenate(ready))
        if ranges.parts[root][0] == part:
            return [(root, int(out[0]), ranges.of(root, int(out[0])), True, int(n[0]), int(last[0]))]
        return [(root, int(t), ranges.of(root, int(t)), False, 0, 0) for t in np.unique(out)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, us, ready = None, [], []
        columns = ["root", "t", "part", "start", "fired", "last"]
        for f in frames:
            for k, g in f.groupby(["part", "root"], sort=False):
                if k != key:
                    if key is not None:
                        yield pd.DataFrame(told(*key, us, ready), columns=columns)
                    key, us, ready = k, [], []
                us.append(g["us"].to_numpy())
                ready.append(g["ready"].to_numpy())
        if key is not None:
            yield pd.DataFrame(told(*key, us, ready), columns=columns)

    return run


def _hops(ranges: Ranges):
    def run(key: tuple, asked: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        rows, (part, root) = [], (int(key[0]), int(key[1]))
        if len(asked) and len(events):
            events = events.sort_values(["us", "event_id"])
            us = events["us"].to_numpy()
            out, n, last = _chains(us, events["ready"].to_numpy())
            for t, i in zip(asked["t"].tolist(), np.searchsorted(us, asked["t"].to_numpy())):
                rows.append((root, t, part, int(out[i]), ranges.of(root, int(out[i])), int(n[i]), int(last[i])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _HOP.split(", ")])

    return run


def _followed(starts: list, hops: DataFrame, longest: int, walked: int) -> list[tuple]:
    """``(root, t, part, generation, last)`` of every entry of a root's own chain, the end included."""
    here = [(r["root"], r["t"], r["part"], r["fired"], r["last"]) for r in starts]
    if hops.count() <= walked:
        to = {(h["root"], h["t"], h["part"]): h for h in hops.collect()}
        found = list(here)
        for root, t, part, n, last in here:
            while (h := to.get((root, t, part))) is not None:
                t, part, n, last = h["t2"], h["part2"], n + h["fired"], h["last"]
                found.append((root, t, part, n, last))
        return found
    spark = hops.sparkSession
    place = ["root", "t", "part"]
    reached = spark.createDataFrame(here, "root long, t long, part int, n long, last long")
    for _ in range(longest.bit_length() + 1):  # after k rounds all entries of up to 2**k hops
        step = reached.drop("last").join(hops, place).select("root", F.col("t2").alias("t"), F.col("part2").alias("part"), (F.col("n") + F.col("fired")).alias("n"), "last")
        reached = cut(reached.unionByName(step).distinct())
        onward = hops.select("root", F.col("t").alias("t2"), F.col("part").alias("part2"), F.col("t2").alias("t3"), F.col("part2").alias("part3"), F.col("fired").alias("more"), F.col("last").alias("later"))
        hops = cut(hops.join(onward, ["root", "t2", "part2"]).select(*place, F.col("t3").alias("t2"), F.col("part3").alias("part2"), (F.col("fired") + F.col("more")).alias("fired"), F.col("later").alias("last")))
    return [(r["root"], r["t"], r["part"], r["n"], r["last"]) for r in reached.collect()]  # an entry a range and root at most


def _hot(rows: DataFrame, ranges_: int, walked: int) -> DataFrame:
    order = ["root", "us", "event_id"]
    dealt = cut(rows.repartitionByRange(ranges_, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.min(F.struct("root", (-F.col("us")).alias("us"))).alias("low"), F.max(F.struct("root", "us")).alias("high")).collect()
    ranges, entered = Ranges(ends), {}
    if ranges.parts:
        wide = dealt.where(F.col("root").isin(*ranges.parts))
        exits = cut(wide.mapInPandas(_exits(ranges), "root long, t long, part int, start boolean, fired long, last long"))
        starts = exits.where("start").collect()  # one a root
        asked = exits.where(F.col("part") != END).select("root", "t", "part").distinct()
        hops = cut(asked.groupBy("part", "root").cogroup(wide.groupBy("part", "root")).applyInPandas(_hops(ranges), _HOP))
        entries: dict[int, list[tuple]] = {}
        for root, t, part, n, last in _followed(starts, hops, max(map(len, ranges.parts.values())), walked):
            entries.setdefault(root, []).append((n, t, part, last))
        for root, parts in ranges.parts.items():
            for p in parts[1:]:  # the next entry at this range or after it
                n, t, _, last = min(e for e in entries[root] if e[2] == END or e[2] >= p)
                entered[p, root] = (t, n, last)
    return dealt.mapInPandas(_fold(entered), _FIRED)


def fired(events: DataFrame, window_us: int, lasts: str | None = None, ranges: int | None = None, walked: int = BROADCAST_ROWS) -> DataFrame:
    """``event_id, root, us, fired, generation, last_fired`` of ``events(event_id, root, us)``.

    An event fires if ``window_us`` has passed since its root's last firing and that one is over: column ``lasts`` says how many
    microseconds it takes, where given. Events of one time count in order of id; those without root or time are left out. ``ranges``: into
    how many the hot roots are dealt, as many as there are shuffle partitions if not given.
    """
    over = F.lit(window_us) if lasts is None else F.greatest(F.lit(window_us), F.coalesce(F.col(lasts), F.lit(0)))
    rows = events.where("root is not null and us is not null").select("event_id", "root", "us", (F.col("us") + over.cast("long")).alias("ready"))
    ranges = ranges or max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.groupBy("root").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    least = max(HOT, (whole["n"] or 0) // ranges)
    hot = [r["root"] for r in counts.where(F.col("n") > least).collect()] if (whole["most"] or 0) > least else []  # fewer than ranges
    cold = rows.where(~F.col("root").isin(*hot)) if hot else rows
    folded = cold.repartition("root").sortWithinPartitions("root", "us", "event_id").withColumn("part", F.lit(0)).mapInPandas(_fold({}), _FIRED)
    return folded.unionByName(_hot(rows.where(F.col("root").isin(*hot)), ranges, walked)) if hot else folded
