"""What several operators share: salted joins, held-out folds, labelled samples, a logistic fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import BROADCAST_ROWS, clearing, cut, join_hot, remove, shared_folder  # noqa: F401

#: What ``labelled_sample`` takes at most; no query trains on it.
TRAIN_ROWS = 4000
#: Tasks that training rows are dealt out to.
TRAIN_PARTS = 24


#: Files for each core that ``packed`` leaves.
FILES = 4
#: Copies of the other side that a larger small side is joined through, so that a hot key is spread.
SALTS = 64
#: Bits of the bitmap of ``may_match``: 8 MB, in parts of 4 KB.
FILTER_BITS = 1 << 26


def packed(df: DataFrame) -> DataFrame:
    """``df`` in at most ``FILES`` partitions for each core of the cluster, without a shuffle; the same rows.

    Written out, each partition is a file, and on a local file system Hadoop starts processes to set the modes of each: over 211
    partitions 840 of them, forked from an executor, which counts twice for as long as a fork shares its memory.
    """
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` of ``df`` in few files."""
    return cut(packed(df))


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of ``big`` with ``small`` (distinct keys, already computed): broadcast if its counted rows allow
    that, else dealt out by the keys and a salt from ``spread``, so that no key lands in one task."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    salted = small.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt__", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt__"]).drop("salt__")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def labelled(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """``(doc_id, y)``: every labelled id outside the held-out fold. Ids labelled both ways equally often are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", parts) != held))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col(label)).alias("m"))
        .where("m <> 0.5")
        .select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))
    )


def labelled_sample(labels: DataFrame, label: str, parts: int, held: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` of the ids of ``labelled``, by a hash of the id, so that the choice depends neither on
    partitioning nor on row order.

    Half of the bound goes to each class, so a rare class is not starved.
    """
    one = labelled(labels, label, parts, held)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return one.where("y = 0").orderBy(*order).limit(rows // 2).unionByName(one.where("y = 1").orderBy(*order).limit(rows // 2))


def may_match(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with every row whose ``key`` (not null) is among ``keys``, and few others; for what shuffles ``rows`` next, by an exact join.

    The keys' hashes are set in a bitmap of ``FILTER_BITS``, of which each task asks its own rows. So nothing is shuffled but the bitmap's parts, and what is broadcast
    is of one size however many keys there are: more of them only let more of the other rows by (5 million: 7 %, by calculation).
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(place).alias("part__"), F.bitmap_bit_position(place).alias("at__")).groupBy("part__").agg(F.bitmap_construct_agg("at__").alias("bits__"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bits__", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(place) == F.col("part__")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``y, text``: of each id of ``ids(doc_id, y)``, already computed, one document, the one whose text has the smallest hash.

    Documents of one id are reduced to one in each task, so no more rows come out than ids go in, however often an id occurs.
    Texts are shuffled once, and those without a label hardly (``may_match``), at any number of ids.
    """
    mine = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    one = may_match(mine, ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("m"))
    return one.join(ids, "doc_id").select("y", F.col("m.text").alias("text"))


def training_rows(rows: DataFrame, labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """``(y, x)`` of every labelled id outside the held-out fold: of the ``rows(doc_id, hash, x)`` with one id that of the least text hash.

    Rows of one id are reduced to one in each task. They lie in an order of their own, so that sums over them don't hang on partitioning.
    """
    one = rows.where(F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held)).groupBy("doc_id").agg(F.min(F.struct("hash", "x")).alias("m"))
    mine = one.join(labelled(labels, label, parts, held), "doc_id").select("doc_id", "y", F.col("m.x").alias("x"))
    return cut_packed(mine.repartition(TRAIN_PARTS, "doc_id").sortWithinPartitions("doc_id").select("y", "x"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, prior: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic loss with a Gaussian prior (mean ``prior``) on every coefficient."""
    n, d = x.shape
    w0 = np.zeros(d) if prior is None else prior
    w, weight = w0.copy(), np.ones(n) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * (w - w0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def summed(train: DataFrame, tally: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays that ``tally(x, y)`` makes of batches of ``train(y, x)``, added up over all rows: each task adds its own, the driver those of the tasks,
    of which there are ``TRAIN_PARTS`` at most.

    Rows that lie in the same partitions in the same order give the same floating-point sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                got = tally(x, b.column("y").to_numpy(zero_copy_only=False))
                total = got if total is None else [t + g for t, g in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(t, np.float64).tobytes() for t in total]], pa.list_(pa.binary()))], ["t"])

    parts = [[np.frombuffer(t) for t in row] for row in train.select("y", "x").coalesce(TRAIN_PARTS).mapInArrow(run, "t array<binary>").toArrow().column("t").to_pylist()]
    return [np.sum(ts, axis=0) for ts in zip(*parts)]


def by_size(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` characters together (or one longer text)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def frames(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)
