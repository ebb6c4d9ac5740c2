"""Commits of a chunk catalogue: what they write, what readers see, and what is left of those that fail or lose."""

import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources.catalogue import Catalogue

KIND = "project string, path string, chunk_id string, content_hash string"


def chunks(spark, rows):
    return spark.createDataFrame([(p, f, f"{p}:{f}:{k}", h) for p, f, k, h in rows], KIND)


def seen(df):
    return sorted((r["chunk_id"], r["content_hash"]) for r in df.collect())


@pytest.fixture
def catalogue(spark, tmp_path):
    c = Catalogue(spark, f"{tmp_path}/cat", buckets=4)
    c.commit(chunks(spark, [(p, f"f{i}", k, "a") for p in ("one", "two", None) for i in range(20) for k in (0, 10)]))
    return c


def test_commits_and_projects(spark, catalogue):
    assert Catalogue(spark, catalogue.place + "-none").read() is None
    assert catalogue.read().count() == 120 and catalogue.read().columns == ["project", "path", "chunk_id", "content_hash"]
    assert {r["project"] for r in catalogue.read("one").collect()} == {"one"} and catalogue.read("one").count() == 40
    assert catalogue.read("nobody").count() == 0
    catalogue.commit(chunks(spark, [("one", "f3", 0, "b"), ("one", "f3", 20, "b")]), chunks(spark, [("one", "f3", 10, ""), ("two", "f5", 0, ""), ("two", "f99", 7, "")]))
    got = dict(seen(catalogue.read()))
    assert len(got) == 119 and got["one:f3:0"] == got["one:f3:20"] == "b" and "one:f3:10" not in got and "two:f5:0" not in got


def test_bytes_written_go_with_what_changed(spark, catalogue):
    size = lambda m: {f: sum(os.path.getsize(p) for p in glob.glob(f"{f}/**/*.parquet", recursive=True)) for f in set(m["parts"].values())}
    before = catalogue.current()
    after = catalogue.commit(chunks(spark, [("two", "f7", 0, "c")]))
    assert len(after["touched"]) == 1 and len(before["parts"]) > 8
    new = set(after["parts"].values()) - set(before["parts"].values())
    assert len(new) == 1 and sum(size(after)[f] for f in new) < sum(size(before).values()) / 4
    assert {p: f for p, f in after["parts"].items() if p not in after["touched"]} == {p: f for p, f in before["parts"].items() if p not in after["touched"]}


def test_an_interrupted_pass_changes_nothing(spark, catalogue):
    before, folders = seen(catalogue.read()), set(os.listdir(catalogue.place))
    broken = chunks(spark, [("one", "f1", 0, "z")]).withColumn("content_hash", F.when(F.col("path") == "f1", F.raise_error(F.lit("lost"))).otherwise("z"))
    with pytest.raises(Exception, match="lost"):
        catalogue.commit(broken)
    assert seen(catalogue.read()) == before and set(os.listdir(catalogue.place)) == folders
    # a writer that dies between writing and publishing leaves a folder that no version names
    chunks(spark, [("one", "f1", 0, "z")]).write.parquet(f"{catalogue.place}/data-dead")
    assert seen(catalogue.read()) == before
    catalogue.commit(chunks(spark, [("one", "f1", 0, "y")]))
    assert dict(seen(catalogue.read()))["one:f1:0"] == "y"


def test_a_reader_keeps_its_version(spark, catalogue):
    old = catalogue.read()
    catalogue.commit(chunks(spark, [("one", f"f{i}", 0, "new") for i in range(20)]))
    assert {h for _, h in seen(old)} == {"a"} and "new" in {h for _, h in seen(catalogue.read())}


def test_writers_at_once_lose_nothing(spark, catalogue):
    errors = []

    def write(k):
        try:
            Catalogue(spark, catalogue.place, buckets=4).commit(chunks(spark, [("one", "f1", 100 + k, f"w{k}"), (f"new{k}", "x", 0, f"w{k}")]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = dict(seen(catalogue.read()))
    assert not errors and len(got) == 126
    assert all(got[f"one:f1:{100 + k}"] == got[f"new{k}:x:0"] == f"w{k}" for k in range(3))
    assert catalogue.current()["version"] == 4


def test_forgetting_a_project_reads_and_writes_no_chunk(spark, catalogue):
    folders = {f for f in os.listdir(catalogue.place) if f.startswith("data-")}
    catalogue.forget("one", "unknown")
    assert {r["project"] for r in catalogue.read().collect()} == {"two", None}
    assert {f for f in os.listdir(catalogue.place) if f.startswith("data-")} == folders
    catalogue.forget("two", "")
    assert catalogue.read().count() == 0


def test_old_versions_go(spark, catalogue):
    c = Catalogue(spark, catalogue.place, buckets=4, kept=1, grace=0)
    for k in range(3):
        time.sleep(0.02)
        c.commit(chunks(spark, [(p, f"f{i}", j, f"v{k}") for p in ("one", "two", None) for i in range(20) for j in (0, 10)]))
    assert len([f for f in os.listdir(c.place) if f.endswith(".json")]) == 1
    assert {f"{c.place}/{f}" for f in os.listdir(c.place) if f.startswith("data-")} == set(c.current()["parts"].values())
    assert {h for _, h in seen(c.read())} == {"v2"}


def test_empty_commits(spark, tmp_path):
    c = Catalogue(spark, f"{tmp_path}/empty")
    c.commit(chunks(spark, []))
    assert c.read().count() == 0 and c.read().columns == ["project", "path", "chunk_id", "content_hash"]


def test_a_pass_reads_its_catalogues_once(spark):
    """What stands for cutting up and hashing texts is done once for each row of either catalogue."""
    from tessera.operators import chunking

    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    kind = "project string, path string, start int, chunk_id string, content_hash string"
    rows = lambda h: spark.range(300).selectExpr("'p' as project", "concat('f', id % 30) as path", "cast(id as int) as start", "concat('c', id) as chunk_id", h).mapInPandas(counted, kind)
    old, new = rows("'a' as content_hash").where("start % 7 <> 0"), rows("if(id % 5 = 0, 'b', 'a') as content_hash")
    got = chunking.index_pass(old, new, new.select("path").where("false"), 20).collect()
    assert made.value == 600 and len(got) == 300 - sum(i % 7 == 0 for i in range(300)) + sum(r["status"] == "new" for r in got)
