"""A chunk catalogue that is committed piece by piece: a pass rewrites the partitions that it touches, and no others.

Chunks lie in partitions by project and bucket of path. Every version is a manifest that names the folder of each
partition; folders are written under new names and never changed. A commit reads the touched partitions, writes them anew
with the chunks that came, changed and went, and publishes the next version by a rename that only one writer wins. Until
then, and after a pass that was interrupted, readers see the version before; a reader keeps the version that it began with.
A writer that lost tries again on the version that won: untouched partitions are taken over, touched ones are read anew.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import manifests
from tessera.storage import cut, exists, remove

#: Buckets of a project's paths; a large project is as many partitions, and a change rewrites that share of it.
BUCKETS = 16
#: Tasks that write one partition at most.
WRITERS = 8
#: Versions that stay, and seconds for which any version stays.
KEPT, GRACE = 3, 3600


def partition(project: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The partition of a chunk: its project's digest, and the bucket of its path."""
    return F.concat(F.substring(F.sha2(F.coalesce(project, F.lit("")), 256), 1, 24), F.lit("-"), F.pmod(F.xxhash64(path), F.lit(buckets)).cast("string"))


class Catalogue:
    """Chunks ``project, path, chunk_id, ...`` in the folder ``place``, a path that all executors share."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = BUCKETS, kept: int = KEPT, grace: float = GRACE):
        self.spark, self.place, self.buckets, self.kept, self.grace = spark, place.rstrip("/"), buckets, kept, grace

    def _named(self, version: int) -> str:
        return f"{self.place}/v{version:012d}.json"

    def current(self) -> dict:
        """The newest manifest: ``version``, ``schema`` and ``parts``, the folder of each partition."""
        for _, path in sorted(manifests.listed(self.spark, self.place), key=lambda x: x[1], reverse=True):
            if (found := manifests.read(self.spark, path)) is not None:
                return found
        return {"version": 0, "schema": None, "parts": {}}

    def _rows(self, manifest: dict, parts: set[str] | None = None) -> DataFrame | None:
        """The chunks of some partitions with ``part__``; folders that several partitions share are read once."""
        folders: dict[str, list[str]] = {}
        for p, f in manifest["parts"].items():
            if parts is None or p in parts:
                folders.setdefault(f, []).append(p)
        if not folders:
            return None
        held = [self.spark.read.option("basePath", f).parquet(*[f"{f}/part__={p}" for p in sorted(ps)]) for f, ps in sorted(folders.items())]
        return reduce(DataFrame.unionByName, held).withColumn("part__", F.col("part__").cast("string"))

    def read(self, project: str | None = None) -> DataFrame | None:
        """All chunks of the newest version, or those of one project, of which no other's files are read; None before the first commit."""
        manifest = self.current()
        if manifest["schema"] is None:
            return None
        parts = None
        if project is not None:
            parts = {r[0] for r in self.spark.range(self.buckets).select(F.concat(F.substring(F.sha2(F.lit(project), 256), 1, 24), F.lit("-"), F.col("id").cast("string"))).collect()}
        rows = self._rows(manifest, parts)
        return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"])) if rows is None else rows.drop("part__")

    def commit(self, chunks: DataFrame, gone: DataFrame | None = None) -> dict:
        """Publishes a version in which ``chunks`` stand in for those of the same ``chunk_id``, and those of ``gone(project, path, chunk_id)`` are missing.

        Chunks are unique by ``chunk_id``, which says project and path. Returns the manifest with ``touched``, the partitions that were written anew.
        """
        where = partition(F.col("project"), F.col("path"), self.buckets).alias("part__")
        new = cut(chunks.select("*", where))
        out = cut(gone.select("chunk_id", where)) if gone is not None else None
        ids = new.select("part__") if out is None else new.select("part__").unionByName(out.select("part__"))
        touched = {r["part__"] for r in ids.distinct().collect()}  # names of partitions, as a manifest holds them
        while True:
            base = self.current()
            folder = f"{self.place}/data-{uuid.uuid4().hex}"
            rows = new
            if (old := self._rows(base, touched)) is not None:
                kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
                kept = kept if out is None else kept.join(out.select("chunk_id"), "chunk_id", "left_anti")
                rows = kept.select(*new.columns).unionByName(new)
            try:
                dealt = rows.withColumn("writer__", F.pmod(F.xxhash64("path"), F.lit(WRITERS))).repartition("part__", "writer__").sortWithinPartitions("part__", "path", "chunk_id")
                dealt.drop("writer__").write.partitionBy("part__").parquet(folder)
                written = self._written(folder)
                parts = {p: f for p, f in base["parts"].items() if p not in touched} | {p: folder for p in written}
                manifest = {"version": base["version"] + 1, "schema": chunks.schema.jsonValue(), "parts": parts}
                if manifests.publish(self.spark, manifest, self._named(manifest["version"])):
                    self.clear()
                    return manifest | {"touched": sorted(touched)}
            except Exception:
                remove(self.spark, folder)
                raise
            remove(self.spark, folder)  # another writer was first

    def _written(self, folder: str) -> list[str]:
        found = manifests.system_of(self.spark, folder).listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder))
        return [n.removeprefix("part__=") for s in found if (n := s.getPath().getName()).startswith("part__=")]

    def forget(self, *projects: str) -> dict:
        """A version without these projects; no chunk is read or written."""
        heads = {r[0] for r in self.spark.createDataFrame([(p,) for p in projects], "p string").select(F.substring(F.sha2("p", 256), 1, 24)).collect()}
        while True:
            base = self.current()
            parts = {p: f for p, f in base["parts"].items() if p.split("-")[0] not in heads}
            manifest = base | {"version": base["version"] + 1, "parts": parts}
            if base["schema"] is None or manifests.publish(self.spark, manifest, self._named(manifest["version"])):
                return manifest

    def clear(self) -> None:
        """Removes versions beyond the newest ``kept`` that are older than ``grace`` seconds, and folders that no version names."""
        all_ = sorted(manifests.listed(self.spark, self.place), key=lambda x: x[1], reverse=True)
        old = [path for at, path in all_[self.kept :] if at <= time.time() - self.grace]
        named = lambda paths: {f for p in paths if (m := manifests.read(self.spark, p)) for f in m["parts"].values()}
        gone = named(old) - named([p for _, p in all_ if p not in old])
        for path in [*old, *gone]:
            if exists(self.spark, path):
                remove(self.spark, path)


def changes(stored: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pass writes and removes: of ``after``, a pass's catalogue with ``status``, the new and changed chunks, and what of ``stored`` it hasn't."""
    return after.where(F.col("status").isin("new", "changed")), stored.join(after.select("chunk_id"), "chunk_id", "left_anti")
