"""Sharding by minimax contiguous partition: ordered atomic groups are cut so that the largest shard is as small as possible.

Groups are equal texts, in the order of the SHA-256 of the text, so that shards are mixtures of the corpus and don't
depend on the order of the input. A group is never split. The smallest capacity is found by binary search, each
candidate checked greedily: a shard takes groups as long as they fit, and a group that is larger than the capacity has a
shard of its own, so that one huge group doesn't raise the capacity of the others. The largest shard is then as small as
it can be. Cuts are made at that capacity; where it leaves room each goes to the group boundary that is nearest to an
equal share of what is left, so that no shard stays empty or small without need.

Neither groups nor rows meet on the driver: it knows the byte positions of at most ``LOOKUPS`` group boundaries a round,
with which it bounds the greedy check from both sides, and asks for more only where cuts are still undecided. Every
round narrows those gaps; measured on lists of three million sizes, 5 rounds suffice, 13 where a huge group leaves no slack.

Equal texts are summed in each task before they are shuffled; rows are dealt out by ranges of shard and id, so a group that holds a
third of all rows is many tasks' work. All that is read twice is written to the shared folder.

Defined results: a null text counts as empty; repeated rows are members of one group and have slots of their own;
null ids have the first slots of their shard; fewer groups than shards leave the last shards empty; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Group boundaries that one round asks for at most.
LOOKUPS = 8192
#: Capacities that one round tries to decide, and gaps that it follows for each before it waits for the next round.
TRIED, FOLLOWED = 6, 96


def group_key(text: Column) -> Column:
    """Equal texts have equal keys, and no others; 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _runs(batch: pa.RecordBatch, *keys: np.ndarray) -> Iterator[tuple]:
    """The parts of a batch in which all keys stay the same, each with its keys."""
    turns = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows > 1 else []
    starts = [0, *turns][: batch.num_rows]
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a), *(int(k[a]) for k in keys)


def grouped(rows: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """``key, bytes, rank, before``: the groups of ``rows`` in order of key, with their place and all bytes before them.

    Two narrow shuffles: partial sums by key, then ranges of keys. The driver gets two numbers a partition.
    """
    sums = rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("bytes"))
    dealt = cut(sums.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).orderBy("part").collect()
    first, n, b = {}, 0, 0
    for p in parts:
        first[p["part"]] = (n, b)
        n, b = n + p["n"], b + p["b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(first)
        for whole in batches:
            part = whole.column("part").to_numpy()
            for batch, p in _runs(whole, part):
                (n, b), sizes = at[p], batch.column("bytes").to_numpy()
                ends = b + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n + np.arange(len(sizes)), pa.int64()), pa.array(ends - sizes, pa.int64())], ["key", "bytes", "rank", "before"])
                at[p] = n + len(sizes), int(ends[-1])

    return cut(dealt.mapInArrow(run, "key binary, bytes long, rank long, before long"))


class Boundaries:
    """What is known of the group boundaries: their ranks and the bytes before them, both strictly rising.

    Between two known neighbours lies one group, or an open gap with more boundaries that aren't known yet.
    """

    def __init__(self, groups: int, total: int):
        self.ranks, self.at = [0, groups], [0, total]

    def add(self, found: dict[int, int]) -> None:
        known = dict(zip(self.ranks, self.at)) | found
        self.ranks = sorted(known)
        self.at = [known[r] for r in self.ranks]

    def open(self, k: int) -> bool:
        """More boundaries lie between the known ones ``k`` and ``k + 1``."""
        return k + 1 < len(self.ranks) and self.ranks[k + 1] - self.ranks[k] > 1

    def floor(self, x: int) -> int:
        return bisect_right(self.at, x) - 1

    def least_end(self, p: int, c: int) -> int:
        """Where a shard that begins at ``p`` surely reaches at capacity ``c``; ``p`` itself if that isn't known."""
        k = self.floor(p + c)
        if self.at[k] > p or k + 1 == len(self.at):
            return self.at[k]
        return p if self.open(k) else self.at[k + 1]

    def most_end(self, p: int, c: int) -> int:
        """Where it reaches at most. Groups larger than ``c`` are known, so none lies in an open gap."""
        k = self.floor(p + c)
        if k + 1 == len(self.at) or (not self.open(k) and self.at[k] > p):
            return self.at[k]
        return min(p + c, self.at[k + 1]) if self.open(k) else self.at[k + 1]

    def least_start(self, p: int, c: int) -> int:
        """Where a shard that ends at ``p`` begins at the earliest."""
        x = max(0, p - c)
        k = self.floor(x)
        if self.at[k] == x or self.open(k):
            return x
        return self.at[k + 1] if self.at[k + 1] < p else self.at[k]


def _fits(reach: Callable[[int, int], int], c: int, shards: int, total: int) -> bool:
    p = 0
    for _ in range(shards):
        if p >= total:
            break
        p = reach(p, c)
    return p >= total


def _least(fits: Callable[[int], bool], low: int, high: int) -> int:
    """The smallest capacity in [low, high] that fits; ``high`` does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def _capacity(known: Boundaries, shards: int, base: int) -> tuple[int, set[int]]:
    """The smallest feasible capacity, or the gaps that must be known better to decide."""
    total = known.at[-1]
    sure = _least(lambda c: _fits(known.least_end, c, shards, total), base, max(base, total))
    hoped = _least(lambda c: _fits(known.most_end, c, shards, total), base, sure)
    if hoped == sure:
        return sure, set()
    gaps: set[int] = set()
    for c in {hoped + (sure - 1 - hoped) * j // (TRIED - 1) for j in range(TRIED)}:
        gaps |= _undecided(known, shards, c)
    return sure, gaps


def _undecided(known: Boundaries, shards: int, c: int) -> set[int]:
    """The first open gaps in which the greedy check at ``c`` may cut; later cuts hang on them."""
    needed = [known.at[-1]]  # from needed[m] on m shards may suffice; a cut before it decides against ``c`` by itself
    for _ in range(shards):
        needed.append(known.least_start(needed[-1], c))
    gaps: set[int] = set()
    low = high = 0
    for left in range(shards - 1, -1, -1):
        low, high = max(known.least_end(low, c), needed[left]), known.most_end(high, c)
        gaps.update(k for k in range(known.floor(low), min(known.floor(high) + 1, len(known.at) - 1)) if known.open(k))
        if len(gaps) > FOLLOWED:
            break
    return gaps


def _levelled(known: Boundaries, shards: int, capacity: int) -> tuple[list[int], set[int]]:
    """The cuts at the capacity, one a shard, and the gaps that must be known better to be sure of them."""
    at, total, gaps = known.at, known.at[-1], set()

    def look(x: int) -> int:
        k = known.floor(x)
        if at[k] != x and known.open(k):
            gaps.add(k)
        return k

    last = [total]  # from last[m] on, m shards suffice
    while last[-1] > 0 and len(last) <= shards:
        x = max(0, last[-1] - capacity)
        k = look(x)
        b = at[k] if at[k] == x else at[k + 1]
        if b >= last[-1]:  # a group larger than the capacity
            b = at[bisect_left(at, last[-1]) - 1]
        last.append(b)
    last += [0] * (shards + 1 - len(last))
    cuts, p = [], 0
    for left in range(shards, 0, -1):
        if p < total:
            high = at[max(look(p + capacity), known.floor(p) + 1)]
            low = max(last[left - 1], at[known.floor(p) + 1])
            if known.open(known.floor(p)) and last[left - 1] <= p:
                gaps.add(known.floor(p))
            goal = p * left + total - p  # ``left`` times the fair end
            k = look(goal // left)
            near = min((at[j] for j in (k, k + 1) if j < len(at)), key=lambda b: (abs(b * left - goal), b))
            p = min(max(near, low), max(high, low))
        cuts.append(p)
    return cuts, gaps


def cuts_of(groups: DataFrame, shards: int = SHARDS, lookups: int = LOOKUPS) -> tuple[int, list[bytes]]:
    """The smallest capacity, and the first key of every shard but the first; fewer where shards stay empty.

    ``groups`` as ``grouped`` makes them.
    """
    whole = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    if not whole["n"]:
        return 0, []
    known = Boundaries(whole["n"], whole["b"])
    large = groups.orderBy(F.desc("bytes"), "rank").limit(shards + 1).collect()
    known.add({r["rank"]: r["before"] for r in large} | {r["rank"] + 1: r["before"] + r["bytes"] for r in large})
    base = large[shards]["bytes"] if len(large) > shards else 1

    def find(ranks: list[int], *columns: str) -> list:
        asked = groups.sparkSession.createDataFrame([(r,) for r in ranks], "rank long")
        return groups.join(F.broadcast(asked), "rank").select("rank", *columns).collect()  # at most ``lookups`` rows

    def refine(gaps: set[int]) -> None:
        wanted: set[int] = set()
        for k in gaps:
            a, n, parts = known.ranks[k], known.ranks[k + 1] - known.ranks[k], max(2, lookups // len(gaps))
            wanted.update(a + n * j // parts for j in range(1, parts))
        known.add({r["rank"]: r["before"] for r in find(sorted(wanted - set(known.ranks)), "before")})

    refine({k for k in range(len(known.at)) if known.open(k)} or {0})
    capacity, gaps = _capacity(known, shards, base)
    while gaps:
        refine(gaps)
        capacity, gaps = _capacity(known, shards, base)
    cuts, gaps = _levelled(known, shards, capacity)
    while gaps:
        refine(gaps)
        cuts, gaps = _levelled(known, shards, capacity)
    firsts = sorted({known.ranks[bisect_left(known.at, p)] for p in cuts if p < known.at[-1]})
    return capacity, [bytes(r["key"]) for r in sorted(find(firsts, "key"), key=lambda r: r["rank"])]


def shard_of(key: Column, firsts: list[bytes]) -> Column:
    """The shard of a key: how many shards begin at or before it, less one; needs neither join nor shuffle."""
    out = F.lit(0)
    for first in firsts:
        out = out + (key >= F.lit(first)).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, column: str = "shard") -> DataFrame:
    """``docs`` with all their columns and the shard in ``column``, a name that they must not have."""
    firsts = cuts_of(grouped(docs.select(group_key(F.col("text")).alias("key"), _size().alias("size"))), shards)[1]
    return docs.withColumn(column, shard_of(group_key(F.col("text")), firsts))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder ``shard__=k`` for each shard that isn't empty."""
    sharded(docs, shards, "shard__").write.partitionBy("shard__").parquet(path)


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD


def _slotted(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, size, text_crc32, shard, row)`` with ``slot``, gapless in each shard in order of id.

    Dealt out by ranges, so that a shard is several tasks; the driver gets one number for each shard of each partition, and ranges
    meet few shards.
    """
    order = ["shard", "doc_id", "size", "text_crc32", "row"]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    seen: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for r in dealt.groupBy("part", "shard").agg(F.count("*").alias("n")).orderBy("part", "shard").collect():
        first[r["part"], r["shard"]] = seen.get(r["shard"], 0)
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(first)
        for whole in batches:
            for batch, p, k in _runs(whole, whole.column("part").to_numpy(), whole.column("shard").to_numpy()):
                start = at[p, k]
                at[p, k] = start + batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(start + np.arange(batch.num_rows), pa.int64())], ["doc_id", "size", "text_crc32", "shard", "slot"])

    return dealt.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long")


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(text).alias("key"), F.monotonically_increasing_id().alias("row")))
    firsts = cuts_of(grouped(rows), shards)[1]
    placed = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("key"), firsts).alias("shard"), "row")
    return _slotted(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rule over one sorted list of sizes: a fold for each capacity, then the cuts from the right and from the left.
ORACLE = f"""
WITH RECURSIVE poly AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))),
t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size, sha256(coalesce(text, '')) AS key FROM documents),
r AS (SELECT doc_id, size, key, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, v: xor(tab[(xor(a, v) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM t, poly),
g AS (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY key),
e AS (SELECT key, bytes, CAST(sum(bytes) OVER (ORDER BY key) AS BIGINT) AS stop FROM g),
l AS (SELECT list({{'k': CAST(1 AS BIGINT), 'f': bytes}} ORDER BY key) AS sizes, list_prepend(CAST(0 AS BIGINT), list(stop ORDER BY key)) AS ends, max(stop) AS total FROM e),
search AS (SELECT CAST(1 AS BIGINT) AS low, total AS high FROM l UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (
    SELECT low, high, mid, list_reduce(sizes, lambda a, x: CASE WHEN a.f + x.f <= mid THEN {{'k': a.k, 'f': a.f + x.f}} ELSE {{'k': a.k + 1, 'f': x.f}} END).k <= {SHARDS} AS fits
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM search WHERE low < high), l)),
c AS (SELECT max(low) AS cap FROM search WHERE low = high),
r2l AS (SELECT 0 AS m, total AS b FROM l UNION ALL
  SELECT m + 1, CASE WHEN b = 0 THEN 0 ELSE least(list_min(list_filter(ends, lambda x: x >= b - cap)), list_max(list_filter(ends, lambda x: x < b))) END FROM r2l, l, c WHERE m < {SHARDS}),
l2r AS (SELECT {SHARDS} AS m, CAST(0 AS BIGINT) AS p UNION ALL
  SELECT m - 1, CASE WHEN p = total THEN p ELSE least(greatest(near, low), greatest(high, low)) END FROM (
    SELECT l2r.m, p, total, greatest(r2l.b, list_min(list_filter(ends, lambda x: x > p))) AS low,
      greatest(list_max(list_filter(ends, lambda x: x <= p + cap)), list_min(list_filter(ends, lambda x: x > p))) AS high,
      CASE WHEN below IS NULL OR abs(above * l2r.m - goal) < abs(below * l2r.m - goal) THEN above ELSE below END AS near
    FROM (SELECT *, list_max(list_filter(ends, lambda x: x <= goal // m)) AS below, coalesce(list_min(list_filter(ends, lambda x: x > goal // m)), total) AS above
      FROM (SELECT l2r.*, l.*, cap, p * m + total - p AS goal FROM l2r, l, c WHERE m > 0)) AS l2r JOIN r2l ON r2l.m = l2r.m - 1)),
s AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p FROM l2r, l WHERE p > 0 AND p < total)),
h AS (SELECT key, CAST((SELECT count(*) FROM s WHERE s.p <= e.stop - e.bytes) AS INTEGER) AS shard FROM e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r JOIN h ON h.key = r.key
"""
