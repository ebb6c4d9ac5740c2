"""The request log as streams: debounce with keyed state, and running metrics.

Both read the events folder incrementally and write Parquet below the shared checkpoint folder; each call
processes what is there and returns the result, so that batch and stream can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.storage import exists, is_folder, shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Debounce(StatefulProcessor):
    """Keeps the last fired time of each key; emits the events that fire."""

    def __init__(self, window_us: int):
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        f = pd.concat(list(rows)).sort_values(["us", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for i, us in zip(f["event_id"].tolist(), f["us"].tolist()):
            if last is None or us - last >= self.window:
                last = us
                out.append((i, key[0], us))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "root", "us"]).astype("int64")

    def close(self) -> None:
        pass


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, whether their table is one file or a folder of files."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    raw = source.parquet(path) if is_folder(spark, path) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return raw.select("event_id", us.alias("us"), F.col("user_id").alias("root"), F.col("event_type").alias("op"), F.col("value").alias("latency"))


def _result(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """What a stream wrote; of a table without rows no batch ran."""
    return spark.read.schema(schema).parquet(f"{place}/out") if exists(spark, f"{place}/out") else spark.createDataFrame([], schema)


def debounce_stream(spark: SparkSession, sf_dir: str, window_us: int) -> DataFrame:
    """``event_id, root, us`` of the events that fire, by ``transformWithState``.

    The state store that this needs is set in a session of its own; the caller's session is left alone.
    """
    place, own, kind = folder(spark), spark.newSession(), "event_id long, root long, us long"
    own.conf.set(PROVIDER, ROCKS)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    fired = events(own, sf_dir).where("root is not null and us is not null").groupBy("root").transformWithStateInPandas(Debounce(window_us), kind, "Append", "None")
    fired.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return _result(spark, place, kind)


def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op, n, seconds``: running counts and sums; each batch replaces the last result."""
    place = folder(spark)
    sums = events(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 2).alias("seconds"))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/out")
    sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return _result(spark, place, "op string, n long, seconds double")
