"""The folder that all executors share: cutting lineage there, and clearing up afterwards."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side that is broadcast has at most so many (narrow) rows, counted or by construction.
BROADCAST_ROWS = 50_000
#: Rows from which on a key may count as hot.
HOT = 128

_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, from which it is read again after any executor is lost."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _made:
        _made[-1].append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` writes inside is deleted at the end; by then nothing may read it any more."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, *carry: str) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (a row a key) on ``key``, no task holding a hot key.

    ``side`` says in ``count`` how many of the ``total`` rows have its key. Keys with over ``total / BROADCAST_ROWS`` rows,
    of which there can be no more than ``BROADCAST_ROWS``, are broadcast; the others, each a 50,000th of the rows
    at most, meet in a plain join. ``carry`` names the columns of ``side`` that come along.
    """
    most = max(HOT, -(-total // BROADCAST_ROWS))
    hot = side.where(F.col(count) > most).select(key, F.struct(*carry).alias("hot__"))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = side.where(F.col(count) <= most).select(key, F.struct(*carry).alias("cold__"))
    own = [c for c in rows.columns if c != key]
    near = marked.where("hot__ is not null").select(key, *own, *[F.col(f"hot__.{c}").alias(c) for c in carry])
    far = marked.where("hot__ is null").drop("hot__").join(cold, key).select(key, *own, *[F.col(f"cold__.{c}").alias(c) for c in carry])
    return near.unionByName(far)
