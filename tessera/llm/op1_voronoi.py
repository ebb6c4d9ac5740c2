"""Exact top-k search as a Voronoi kNN join on integer inner products.

Pivots from a bounded sample cut the space into cells. One pass gives each row its cell and its distance to
the pivot; a summary of each cell (rows, largest distance, largest norm, and its ``K + 1`` rows nearest to the
pivot) is all that the driver holds. From the summary every query gets

- a threshold: its K-th best score among the summaries' rows, so a true lower bound of its K-th best, and
- for each cell an upper bound of any score in it, q.p + |q| * radius (and |q| * largest norm); cells whose
  bound stays under the threshold are left out.

Queries are grouped by cell into blocks of about ``QUERY_BLOCK``; queries that need most cells form blocks of
their own. A data row goes to a block only if its cell is needed there and the row's own bound (by its own
distance to its pivot) reaches the block's lowest threshold. Blocks are solved locally by matrix products and
the partial results are merged. All pruning is by bounds with slack for rounding, so the result is exact.

Scale: a cell or block may hold a third of all rows, so data is dealt out by block and a salt, at most about
``DATA_BLOCK`` rows together (a block gets salts by the rows of the cells it needs); partial results are at most K
rows for each query and salt. Clustered data is pruned to a
few cells; for rows without structure no bound prunes and the join is the blocked product of all queries with
all rows, which any exact method needs there.

Defined results: a vector that is null or holds null or non-finite components takes no part, nor does a row
without an id; an empty vector scores 0 with every row; shorter vectors count as filled up with zeros; of
repeated ids one row (the least vector) asks, every row but those of the query's id is a candidate; ties go to
the smaller vec_id; with fewer candidates all come; an empty table gives an empty result; extra columns are
ignored. Scores are exact in 64 bits: where doubles don't hold them, products are made of integers and
thresholds are rounded down, so that no row falls under the threshold that it set itself. Beyond 64 bits scores are clipped
to the largest 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_counted

K, SCALE, EVERY = 10, 1024, 100
SAMPLE, PIVOTS, ROUNDS = 4096, 64, 6
QUERY_BLOCK, DATA_BLOCK, TILE = 1024, 4096, 4096


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of every component, for rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return embeddings.where(e.isNotNull() & fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"))


class Coder:
    """Vectors as bytes of one width and length, and exact products of them."""

    def __init__(self, dim: int, largest: int):
        self.dim, self.type = max(1, dim), "<i4" if largest < 1 << 31 else "<i8"
        self.exact = largest * largest * max(1, dim) < 1 << 53  # doubles hold every partial sum
        self.float = np.float64 if largest < 1 << 53 else np.longdouble  # either way components stay as they are

    def pack(self, vectors) -> list[bytes]:
        out = np.zeros((len(vectors), self.dim), self.type)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return [row.tobytes() for row in out]

    def unpack(self, column) -> np.ndarray:
        x = np.frombuffer(b"".join(column), self.type).reshape(-1, self.dim)
        return x.astype(self.float)

    def below(self, score: np.ndarray) -> np.ndarray:
        """A double at or under each exact score of which ``score`` is the nearest double."""
        return score if self.exact else np.nextafter(score, -np.inf)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return a @ b.T
        big = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
        return big


def pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """A few rounds of k-means from far-apart starting rows of the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    found = [sample[rng.integers(len(sample))]]
    gap = ((sample - found[0]) ** 2).sum(axis=1)
    while len(found) < count and gap.max() > 0:
        found.append(sample[rng.choice(len(sample), p=(gap / gap.sum()).astype(np.float64))])
        gap = np.minimum(gap, ((sample - found[-1]) ** 2).sum(axis=1))
    p = np.array(found)
    for _ in range(rounds):
        cell = _nearest(sample, p)[0]
        p = np.array([sample[cell == j].mean(axis=0) if (cell == j).any() else p[j] for j in range(len(p))])
    return p


def _nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)[None, :]
    cell = d.argmin(axis=1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))


def _assigned(coder: Coder, p: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = coder.unpack(packed := coder.pack(f["v"].tolist()))
                cell, r = _nearest(x, p)
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": packed, "cell": cell.astype(np.int32), "r": r.astype(np.float64), "norm": np.sqrt((x * x).sum(axis=1)).astype(np.float64)})

    return run


def _near_pivot(k: int):
    """Of each run of rows the ``k`` nearest to each pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            f = f if best is None else pd.concat([best, f])
            best = f.sort_values(["cell", "r", "vec_id"]).groupby("cell").head(k)
        if best is not None:
            yield best

    return run


class Summary:
    """Of each cell its pivot, largest distance, largest norm and nearest rows."""

    def __init__(self, p: np.ndarray, cells: list, near: pd.DataFrame, coder: Coder):
        self.p, self.coder = p, coder
        self.radius, self.norm, self.used = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p), bool)
        for c in cells:
            self.radius[c["cell"]], self.norm[c["cell"]], self.used[c["cell"]] = c["r"], c["norm"], True
        self.ids, self.rows = near["vec_id"].to_numpy(np.int64), coder.unpack(near["v"].tolist())

    def bounds(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the threshold, q.p of each cell, and which cells it needs."""
        s = np.array(self.coder.products(q, self.rows), dtype=np.float64)
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        least = self.coder.below(np.sort(s, axis=1)[:, -k]) if s.shape[1] >= k else np.full(len(q), -np.inf)
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        dots = q @ self.p.T
        most = np.minimum(dots + size * self.radius, size * self.norm)
        slack = 1 + 1e-9 * size * (self.norm.max(initial=0) + np.sqrt((self.p**2).sum(axis=1)).max())
        return least, dots, (most + slack >= least[:, None]) & self.used


def _asking(summary: Summary, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = summary.coder.unpack(f["v"].tolist())
                least, dots, need = summary.bounds(f["vec_id"].to_numpy(), q, k)
                wide = need.sum(axis=1) > len(summary.p) / 2
                yield pd.DataFrame({
                    "query_id": f["vec_id"].to_numpy(), "v": f["v"].tolist(), "size": np.sqrt((q * q).sum(axis=1)).astype(np.float64), "least": least, "home": np.where(wide, -1, f["cell"]).astype(np.int32),
                    "needs": [[(int(j), float(d[j])) for j in np.flatnonzero(n)] for n, d in zip(need, dots)],
                })

    return run


def best(query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, rows: np.ndarray, coder: Coder, k: int) -> pd.DataFrame:
    """The k best candidates of each query among ``rows``, at or over its threshold."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    least, held = least.copy(), 0

    def settle() -> None:
        nonlocal held
        at, score, vec = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((vec, -score, at)) if coder.exact else np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], vec[i])), dtype=np.int64)
        at, score, vec = at[order], score[order], vec[order]
        start = np.searchsorted(at, np.arange(len(q)))
        keep = np.arange(len(at)) - start[at] < k
        kth = np.arange(len(at)) - start[at] == k - 1
        least[at[kth]] = np.maximum(least[at[kth]], coder.below(score[kth].astype(np.float64)))
        found[:] = [(at[keep], score[keep], vec[keep])]
        held = int(keep.sum())

    for i in range(0, len(rows), TILE):
        s = coder.products(q, rows[i : i + TILE])
        at, col = np.nonzero((s >= least[:, None]) & (ids[i : i + TILE][None, :] != query_ids[:, None]))
        found.append((at, s[at, col], ids[i : i + TILE][col]))
        held += len(at)
        if held > 16 * k * len(q) + 10_000:
            settle()
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    settle()
    at, score, vec = found[0]
    score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in score]
    return pd.DataFrame({"query_id": query_ids[at], "vec_id": vec, "score": np.array(score, np.int64)})


def dealt(queries: DataFrame, data: DataFrame, k: int = K, pivot_count: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, Coder] | None:
    """``asking(block, salt, query_id, v, least)`` and ``sent(block, salt, vec_id, v)``: what each block solves; None without queries."""
    shape = data.unionByName(queries).agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("top")).first()
    coder = Coder(shape["dim"] or 0, int(shape["top"] or 0))
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # at most ``sample`` rows
    p = pivots(coder.unpack(coder.pack(some["v"].tolist())), pivot_count)
    kind = "vec_id long, v binary, cell int, r double, norm double"
    rows = cut(data.mapInPandas(_assigned(coder, p), kind))
    cells = rows.groupBy("cell").agg(F.max("r").alias("r"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()  # at most PIVOTS rows
    near = rows.mapInPandas(_near_pivot(k + 1), kind).withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("r", "vec_id"))).where(F.col("at") <= k + 1)
    summary = Summary(p, cells, near.select("vec_id", "v").toPandas(), coder)  # at most PIVOTS * (k + 1) rows
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(_assigned(coder, p), kind)
    asked = cut(asked.mapInPandas(_asking(summary, k), "query_id long, v binary, size double, least double, home int, needs array<struct<cell:int,dot:double>>"))
    blocks, offset = {}, 0
    for r in sorted(asked.groupBy("home").count().collect(), key=lambda r: r["home"]):  # at most PIVOTS + 1 rows
        blocks[r["home"]] = (offset, n := -(-r["count"] // QUERY_BLOCK))
        offset += n
    if not blocks:
        return None
    place = F.create_map(*[x for h, (o, n) in blocks.items() for x in (F.lit(h), F.struct(F.lit(o).alias("o"), F.lit(n).alias("n")))])[F.col("home")]
    asked = asked.withColumn("block", place["o"] + F.pmod(F.xxhash64("query_id"), place["n"]).cast("int"))
    needed = asked.select("block", "size", "least", F.explode("needs").alias("c")).groupBy("block", "c.cell").agg(F.max("c.dot").alias("dot"), F.max("size").alias("size"), F.min("least").alias("least"))
    held = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], c["n"])])[F.col("cell")] if cells else F.lit(0)
    salts = cut(needed.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(held) / DATA_BLOCK)).cast("int").alias("salts")))
    needed = cut(needed.join(salts, "block"))
    reach = F.least(F.col("dot") + F.col("size") * F.col("r"), F.col("size") * F.col("norm"))
    slack = 1 + 1e-9 * F.col("size") * (F.col("norm") + F.lit(float(np.sqrt((p**2).sum(axis=1)).max())))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt")
    sent = join_counted(rows, needed, ["cell"], "vec_id").where(reach + slack >= F.col("least")).select("block", salt, "vec_id", "v")
    asking = asked.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "query_id", "v", "least")
    return asking, sent, coder


def nearest(queries: DataFrame, data: DataFrame, k: int = K, pivot_count: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of ``data(vec_id, v)`` for each of ``queries(vec_id, v)``."""
    got = dealt(queries, data, k, pivot_count, sample)
    if got is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asking, sent, coder = got

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("vec_id")
        return best(q["query_id"].to_numpy(), coder.unpack(q["v"].tolist()), q["least"].to_numpy(), d["vec_id"].to_numpy(), coder.unpack(d["v"].tolist()), coder, k)

    parts = asking.groupBy("block", "salt").cogroup(sent.groupBy("block", "salt")).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The contract's rows: rows whose vec_id is divisible by ``every`` ask, every other row is a candidate."""
    data = quantized(embeddings)
    return nearest(data.where(F.col("vec_id") % every == 0), data, k)


ORACLE = """
WITH e AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM p)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 10
"""
