"""Small JSON files that name immutable folders: read whole, published by a rename that only one writer wins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tessera.storage import exists, remove


def system_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or None where there is none (any more)."""
    if not exists(spark, path):
        return None
    stream = system_of(spark, path).open(spark._jvm.org.apache.hadoop.fs.Path(path))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def listed(spark: SparkSession, place: str) -> list[tuple[float, str]]:
    """Times and paths of the manifests in a folder, the newest first."""
    if not exists(spark, place):
        return []
    found = system_of(spark, place).listStatus(spark._jvm.org.apache.hadoop.fs.Path(place))
    names = [(s.getModificationTime() / 1000, f"{place}/{s.getPath().getName()}") for s in found if s.getPath().getName().endswith(".json")]
    return sorted(names, reverse=True)


def publish(spark: SparkSession, manifest: dict, final: str) -> bool:
    """Whether this manifest got the name; where another writer was first, theirs stays."""
    hadoop, system = spark._jvm.org.apache.hadoop.fs, system_of(spark, final)
    draft = f"{final.rsplit('/', 1)[0]}/draft-{uuid.uuid4().hex}"
    out = system.create(hadoop.Path(draft), False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # no overwriting
    try:
        context.rename(context.makeQualified(hadoop.Path(draft)), context.makeQualified(hadoop.Path(final)), plain)
        return True
    except Exception:
        if not exists(spark, final):
            raise
        remove(spark, draft)
        return False
