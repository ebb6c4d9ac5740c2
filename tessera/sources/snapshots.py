"""Versioned edge indexes: every state of a source table has a manifest of immutable folders, and a new state costs its changes.

A source is a file or a folder of part files. Its state is each part's path, size, time of change and checksum (of the file
system, or of the file's end, where Parquet keeps the statistics of its contents), so a part rewritten in place is seen
whatever its size. The index holds

- items: the narrow rows of each part from which edges are derived, in order of the group they belong to;
- edges: how often each edge is derived, as a base and signed deltas after it;
- degrees: of each node and type how many distinct edges come in and go out, likewise.

When parts change, only the groups that they touch are derived anew, once from the old items and once from the new ones; the
difference is the delta. Folders are written under new names and never changed. A manifest is published by a rename that
fails if another session was first, which then is the one that counts; the loser removes what it wrote. Readers go by
the manifest of the state that they found, so none reads a half-written index. Manifests beyond the newest ``KEPT`` go once
they are older than ``GRACE`` seconds, and with them folders that no manifest names.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import manifests
from tessera.storage import cut, remove, shared_folder

#: States that stay, and seconds for which any state stays, because a reader may still be at it.
KEPT, GRACE = 2, 3600
#: Deltas after which edges and degrees are summed into a new base.
FOLD = 8
#: Bytes at a part's end that its checksum covers where the file system has none.
TAIL = 64 << 10
EDGE = ["src", "dst", "type"]


class Index(NamedTuple):
    edges: DataFrame
    degrees: DataFrame


def parts_of(spark: SparkSession, path: str) -> dict[str, list]:
    """``part: [size, time, checksum]`` of the files of a table; hidden files don't count."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = system.listFiles(top, True), {}
    while files.hasNext():
        f = files.next()
        if f.getPath().getName()[0] not in "._":
            found[re.sub("^file:/+", "file:///", f.getPath().toUri().toString())] = [f.getLen(), f.getModificationTime(), _checksum(system, f)]
    return found


def _checksum(system, status) -> str:
    own = system.getFileChecksum(status.getPath())
    if own is not None:
        return bytes(own.getBytes()).hex()
    stream = system.open(status.getPath())
    try:
        stream.seek(max(0, status.getLen() - TAIL))
        return hashlib.sha256(bytes(stream.readNBytes(TAIL))).hexdigest()
    finally:
        stream.close()


def _part(path: Column) -> Column:
    """What items say of the part that they came from: a number, for paths would be most of a row's bytes."""
    return F.xxhash64(path)


def state_of(parts: dict[str, list]) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


class EdgeIndex:
    """The index ``name`` of the edges that ``derive`` makes of items, which are ``columns`` of a table's rows.

    ``derive`` maps items to edges ``src, dst, type`` (the same edge any number of times); an edge depends only on the items
    of one value of ``group``, a column of the items.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, columns: list[Column], derive: Callable[[DataFrame], DataFrame], group: str, fold: int = FOLD, kept: int = KEPT, grace: float = GRACE):
        self.spark, self.path, self.columns, self.derive, self.group = spark, path, columns, derive, group
        self.fold, self.kept, self.grace = fold, kept, grace
        source = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
        self.place = f"{shared_folder(spark)}/index/{name}-laid-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
        self.made: list[str] = []

    def manifests(self) -> list[tuple[float, str]]:
        """Times and paths of all states of this source, the newest first."""
        return manifests.listed(self.spark, self.place)

    def _folder(self, kind: str) -> str:
        self.made.append(f"{self.place}/{kind}-{uuid.uuid4().hex}")
        return self.made[-1]

    def _write(self, df: DataFrame, kind: str, *by: str) -> str:
        folder = self._folder(kind)
        (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.parquet(folder)
        return folder

    def _items(self, manifest: dict, parts: set[str]) -> DataFrame | None:
        """The items of some parts, read from the folders that hold them."""
        folders = {f for p, f in manifest["items"].items() if p in parts}
        if not folders:
            return None
        held = [self.spark.read.parquet(f).where(reduce(Column.__or__, [F.col("part__") == _part(F.lit(p)) for p, g in manifest["items"].items() if g == f and p in parts])) for f in sorted(folders)]
        return reduce(DataFrame.unionByName, held)

    def _laid(self, parts: set[str]) -> DataFrame:
        """The items of some parts of the source, dealt out by ranges of their group and in order of it, then of their columns."""
        part = _part(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///"))
        rows = self.spark.read.parquet(*sorted(parts)).select(*self.columns, part.alias("part__"))
        return rows.repartitionByRange(self.group).sortWithinPartitions(self.group, *[c for c in rows.columns if c not in (self.group, "part__")])

    def _extracted(self, parts: set[str]) -> str:
        return self._write(self._laid(parts), "items")

    @staticmethod
    def _counted(signed: list[tuple[DataFrame, int]]) -> DataFrame:
        rows = [e.select(*EDGE, F.lit(n).cast("long").alias("n")) for e, n in signed]
        return reduce(DataFrame.unionByName, rows).groupBy(*EDGE).agg(F.sum("n").alias("n")).where("n <> 0")

    @staticmethod
    def _degrees(flips: DataFrame) -> DataFrame:
        """``id, type, i, o`` of edges that come (n 1) and go (n -1)."""
        ends = flips.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), "type", F.col("n").alias("i"), F.lit(0).cast("long").alias("o")), F.struct(F.col("src").alias("id"), "type", F.lit(0).cast("long").alias("i"), F.col("n").alias("o")))).alias("e"))
        return ends.groupBy("e.id", "e.type").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o")).where("i <> 0 or o <> 0")

    def _summed(self, folders: list[str], keys: list[str], sums: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in folders])
        if len(folders) > 1:
            rows = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        return rows

    def _whole(self, parts: dict[str, list]) -> dict:
        # laid out once, for the items and for what is derived of them: the ranges keep a group whole and in order, so nothing is shuffled or sorted again
        laid = self._laid(set(parts)).persist(StorageLevel.DISK_ONLY)
        try:
            items = self._write(laid, "items")
            edges = self._write(self._counted([(self.derive(laid.drop("part__")), 1)]), "edges")
        finally:
            laid.unpersist()
        degrees = self._write(self._degrees(self.spark.read.parquet(edges).select(*EDGE, F.lit(1).cast("long").alias("n"))), "degrees")
        return {"source": self.path, "parts": parts, "items": dict.fromkeys(parts, items), "edges": [edges], "degrees": [degrees]}

    def _after(self, old: dict, parts: dict[str, list]) -> dict:
        """The manifest of ``parts`` from that of an older state."""
        gone = {p for p in old["parts"] if parts.get(p) != old["parts"][p]}
        come = {p for p in parts if old["parts"].get(p) != parts[p]}
        kept = set(parts) - come
        items = {p: old["items"][p] for p in kept} | (dict.fromkeys(come, self._extracted(come)) if come else {})
        new = {"source": self.path, "parts": parts, "items": items, "edges": list(old["edges"]), "degrees": list(old["degrees"])}
        before, after, same = self._items(old, gone), self._items(new, come), self._items(new, kept)
        changed = [x for x in (before, after) if x is not None]
        touched = cut(reduce(DataFrame.unionByName, changed).select(self.group).distinct())
        if same is not None:  # groups may go on in parts that stay; items are in order of group, so others aren't read
            low, high = touched.agg(F.min(self.group), F.max(self.group)).first()
            same = same.where(F.col(self.group).between(low, high)).join(touched, self.group, "left_semi")

        def derived(own: DataFrame | None) -> DataFrame | None:
            held = [x.drop("part__") for x in (own, same) if x is not None]
            return self.derive(reduce(DataFrame.unionByName, held)) if held else None

        signed = [(e, n) for e, n in ((derived(before), -1), (derived(after), 1)) if e is not None]
        delta = cut(self._counted(signed))
        was = reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in old["edges"]])
        there = was.join(delta.select(*EDGE), EDGE, "left_semi").groupBy(*EDGE).agg(F.sum("n").alias("had"))
        flips = delta.join(there, EDGE, "left").withColumn("had", F.coalesce("had", F.lit(0)))
        flips = flips.select(*EDGE, ((F.col("had") + F.col("n") > 0).cast("long") - (F.col("had") > 0).cast("long")).alias("n")).where("n <> 0")
        new["degrees"].append(self._write(self._degrees(flips), "degrees"))
        new["edges"].append(self._write(delta, "edges"))
        if len(new["edges"]) > self.fold:
            new["edges"] = [self._write(self._summed(new["edges"], EDGE, ["n"]).where("n > 0"), "edges")]
            new["degrees"] = [self._write(self._summed(new["degrees"], ["id", "type"], ["i", "o"]).where("i > 0 or o > 0"), "degrees")]
        return new

    def manifest(self) -> dict:
        """The manifest of the source as it is now; it is made if there is none."""
        parts = parts_of(self.spark, self.path)
        state = state_of(parts)
        final = f"{self.place}/{state}.json"
        if (found := manifests.read(self.spark, final)) is not None:
            return found
        self.made = []
        older = [m for _, path in self.manifests()[:1] if (m := manifests.read(self.spark, path)) is not None]
        try:
            made = self._after(older[0], parts) if older and set(older[0]["parts"]) & set(parts) else self._whole(parts)
            moved = parts_of(self.spark, self.path) != parts
            mine = not moved and manifests.publish(self.spark, made, final)
        except Exception:
            for folder in self.made:
                remove(self.spark, folder)
            raise
        if not mine:
            for folder in self.made:
                remove(self.spark, folder)
            return self.manifest() if moved else manifests.read(self.spark, final)  # changed while it was read: once more
        used = {*made["edges"], *made["degrees"], *made["items"].values()}
        for folder in self.made:  # sums that were folded away at once
            if folder not in used:
                remove(self.spark, folder)
        self.clear()
        return made

    def clear(self) -> None:
        """Removes states beyond the newest ``kept`` that are older than ``grace`` seconds, and what only they name."""
        all_ = self.manifests()
        old = [path for at, path in all_[self.kept :] if at <= time.time() - self.grace]
        named = lambda paths: {f for p in paths if (m := manifests.read(self.spark, p)) for f in (*m["edges"], *m["degrees"], *m["items"].values())}
        gone = named(old)
        for path in old:
            remove(self.spark, path)
        for folder in gone - named([path for _, path in all_ if path not in old]):
            remove(self.spark, folder)

    def open(self) -> Index:
        m = self.manifest()
        edges = self._summed(m["edges"], EDGE, ["n"]).where("n > 0").select(*EDGE)
        return Index(edges, self._summed(m["degrees"], ["id", "type"], ["i", "o"]).where("i > 0 or o > 0"))
