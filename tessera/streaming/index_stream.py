"""The index pass as a stream: file changes come in, and what becomes of each chunk goes out.

The chunks of every file are keyed state, so a change is compared with what the file had, however long ago; a file has at most as
many chunks as the chunker's cap allows, and its state is as small. A change says when it happened (``at``) and carries all
chunks of the file, or none if the file went.

Defined results: changes are applied in order of ``at``, equal ones in order of their contents. One that is not after the last
applied change of its file, late or repeated, is left out. So the catalogue that the output makes is the same however changes are split
into batches, and after a restart; where no change is late, so is the output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import chunking
from tessera.storage import exists
from tessera.streaming import replay

CHANGE = "project string, path string, at long, live boolean, ids array<string>, hashes array<string>"
OUT = "project string, path string, at long, version string, chunk_id string, content_hash string, status string"
_TOLD = Row("project", "path", "at", "version", "chunk_id", "content_hash", "status")


def _change(at: int, live: bool, ids: Column, hashes: Column) -> list[Column]:
    return [F.col("project"), F.col("path"), F.lit(at).cast("long").alias("at"), F.lit(live).alias("live"), ids.alias("ids"), hashes.alias("hashes")]


def changes_of(files: DataFrame, at: int, **how) -> DataFrame:
    """A change for each of ``files(project, path, lines, closed)``, with its chunks in order; a file without any has empty lists."""
    made = chunking.chunks(files, **how).groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("start", "chunk_id", "content_hash"))).alias("c"))
    none = F.array().cast("array<string>")
    rows = files.select("project", "path").join(made, ["project", "path"], "left")
    return rows.select(*_change(at, True, F.coalesce(F.col("c.chunk_id"), none), F.coalesce(F.col("c.content_hash"), none)))


def deletions_of(files: DataFrame, at: int) -> DataFrame:
    none = F.array().cast("array<string>")
    return files.select(*_change(at, False, none, none))


class Chunks(StatefulProcessor):
    """Keeps a file's chunks and its last change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "at long, version string, ids array<string>, hashes array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at, version, had = None, "", {}
        if (kept := self.file.get()) is not None:  # one call to the store, also for a file that it doesn't know
            at, version, ids, hashes = kept
            had = dict(zip(ids, hashes))
        changes = []
        for r in rows:
            now = dict(zip(r["ids"], r["hashes"]))
            changes.append((r["at"], hashlib.sha256(repr((r["live"], sorted(now.items()))).encode()).hexdigest(), r["live"], now))
        before = (at, version)
        for t, digest, live, now in sorted(changes, key=lambda c: c[:2]):
            if at is not None and (t, digest) <= (at, version):
                continue
            for i, h in now.items():
                yield _TOLD(*key, t, digest, i, h, "new" if i not in had else "unchanged" if had[i] == h else "changed")
            for i, h in had.items():
                if i not in now:
                    yield _TOLD(*key, t, digest, i, h, "orphan" if live else "deleted")
            at, version, had = t, digest, now
        if (at, version) != before:
            self.file.update((at, version, list(had), list(had.values())))

    def close(self) -> None:
        pass


def run(spark: SparkSession, source: str, place: str, files_at_once: int | None = None) -> DataFrame:
    """Applies the changes in the Parquet folder(s) ``source`` that weren't applied yet, and returns all that went out so far.

    ``place`` holds the output, the state and how far the stream got: called again, also after a crash, it goes on there.
    """
    own = spark.newSession()
    own.conf.set(replay.PROVIDER, replay.ROCKS)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    reader = own.readStream.schema(CHANGE)
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    changes = reader.parquet(source).where("path is not null and at is not null")
    told = changes.groupBy("project", "path").transformWithState(Chunks(), OUT, "Append", "None")
    told.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{place}/out") if exists(spark, f"{place}/out") else spark.createDataFrame([], OUT)


def catalogue(told: DataFrame) -> DataFrame:
    """``project, path, chunk_id, content_hash``: the chunks that are there after all changes of ``told``."""
    last = told.groupBy("project", "path", "chunk_id").agg(F.max_by(F.struct("content_hash", "status"), F.struct("at", "version")).alias("l"))
    return last.where(~F.col("l.status").isin("orphan", "deleted")).select("project", "path", "chunk_id", F.col("l.content_hash").alias("content_hash"))
