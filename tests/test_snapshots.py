"""The edge index after every kind of change of its source, against an index built anew."""

import os
import random
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import snapshots, views

ITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_comment string"


def rows(rng, orders):
    return [(o, rng.randint(1, 25), 1, n, float(rng.choice([10, 45])), rng.random(), rng.choice("RAN"), "x" * rng.randint(0, 9)) for o in orders for n in range(rng.randint(1, 5))]


def write_part(spark, folder, name, some):
    """One part file of that name, as another writer would put it there."""
    at = f"{folder}-{name}-{time.time_ns()}"
    spark.createDataFrame(some, ITEM).coalesce(1).write.parquet(at)
    part = next(f for f in os.listdir(at) if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    shutil.copyfile(f"{at}/{part}", f"{folder}/{name}.parquet")


def index(spark, d, **how):
    i = views.edge_index(spark, str(d))
    for k, v in how.items():
        setattr(i, k, v)
    return i


def check(spark, d, **how):
    got = index(spark, d, **how).open()
    want = views.built_edges(spark, str(d))
    assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, want.collect()))
    assert got.edges.count() == got.edges.distinct().count()
    nodes = spark.range(1, 26).select("id")
    assert sorted(graph.degrees(nodes, want).collect()) == sorted(graph.degrees(nodes, got.edges, got.degrees).collect())


def folders(d_index):
    return {f for f in os.listdir(d_index.place.removeprefix("file:")) if "-" in f and not f.startswith(".") and not f.endswith(".json")}


@pytest.fixture
def table(spark, tmp_path):
    rng = random.Random(1)
    for k in range(4):
        write_part(spark, f"{tmp_path}/lineitem.parquet", f"p{k}", rows(rng, range(30 * k, 30 * k + 33)))  # orders go on in the next part
    return tmp_path


def test_every_kind_of_change(spark, table):
    rng, place = random.Random(2), f"{table}/lineitem.parquet"
    check(spark, table)
    write_part(spark, place, "p1", rows(rng, range(30, 63)))  # rewritten
    check(spark, table)
    write_part(spark, place, "p9", rows(rng, range(100, 170)))  # added
    check(spark, table)
    os.remove(f"{place}/p0.parquet")  # removed
    check(spark, table)
    write_part(spark, place, "p2", [])  # emptied
    check(spark, table)
    for k in range(5):  # the deltas are folded on the way
        write_part(spark, place, f"q{k}", rows(rng, range(20 * k, 20 * k + 50)))
        check(spark, table, fold=3)
    assert len(index(spark, table).manifest()["edges"]) <= 3


def test_rewritten_in_place_with_the_same_size_and_time(spark, table):
    """The same number of bytes, the folder's and the file's time put back: the checksum tells."""
    place = f"{table}/lineitem.parquet"
    some = rows(random.Random(3), range(30, 63))
    write_part(spark, place, "p1", some)
    one = views.edges(spark, str(table)).collect()
    part = f"{place}/p1.parquet"
    size, stat, top = os.path.getsize(part), os.stat(part), os.stat(place)
    for shift in range(1, 25):  # other nodes, until the file has as many bytes
        write_part(spark, place, "p1", [(o, (p + shift) % 25 + 1, *rest) for o, p, *rest in some])
        if os.path.getsize(part) == size:
            break
    if os.path.getsize(part) != size:
        with open(part, "rb") as f:
            assert f.read(4) == b"PAR1"
        pytest.skip("no rewrite of the same size")
    os.utime(part, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.utime(place, ns=(top.st_atime_ns, top.st_mtime_ns))
    check(spark, table)
    assert sorted(views.edges(spark, str(table)).collect()) != sorted(one)


def test_cost_by_changed_files(spark, table):
    """After one of four parts changed, the new folders hold that part's items and the edges that differ, no more."""
    place = f"{table}/lineitem.parquet"
    i = index(spark, table)
    old = i.manifest()
    write_part(spark, place, "p3", rows(random.Random(4), range(90, 123)))
    new = index(spark, table).manifest()
    changed = {p for p in new["items"] if new["items"][p] != old["items"].get(p)}
    assert len(changed) == 1 and new["edges"][:-1] == old["edges"]
    items = spark.read.parquet(next(new["items"][p] for p in changed))
    assert items.count() == spark.read.parquet(f"{place}/p3.parquet").count()
    delta = spark.read.parquet(new["edges"][-1])
    touched = delta.count()
    assert touched < spark.read.parquet(*old["edges"]).count()
    same = index(spark, table)
    assert same.manifest() == new and same.made == []  # a second question builds nothing


def test_two_sessions_at_once(spark, table):
    """Both build the first state at the same time: one manifest counts, the other's folders go, both answers are right."""
    out, errors = [], []

    def ask():
        try:
            out.append(sorted(map(tuple, index(spark, table).open().edges.collect())))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=ask) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    want = sorted(map(tuple, views.built_edges(spark, str(table)).collect()))
    assert not errors and out == [want] * 3
    i = index(spark, table)
    m = i.manifest()
    assert folders(i) == {f.rsplit("/", 1)[1] for f in (*m["edges"], *m["degrees"], *m["items"].values())}


def test_old_states_go(spark, table):
    place = f"{table}/lineitem.parquet"
    for k in range(4):
        write_part(spark, place, "p1", rows(random.Random(k), range(30, 63)))
        check(spark, table, kept=1, grace=0, fold=1)
        time.sleep(0.02)
    i = index(spark, table, kept=1, grace=0)
    assert len(i.manifests()) == 1
    m = i.manifest()
    assert folders(i) == {f.rsplit("/", 1)[1] for f in (*m["edges"], *m["degrees"], *m["items"].values())}
    check(spark, table)


def test_a_build_that_fails_leaves_nothing(spark, table):
    i = index(spark, table)
    i.derive = lambda items: items.select(F.raise_error(F.lit("broken")).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), F.lit("CALLS").alias("type"))
    with pytest.raises(Exception, match="broken"):
        i.open()
    assert i.manifests() == [] and folders(i) == set()
    check(spark, table)


def test_checksum_of_a_part(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"x" * 200_000)
    (tmp_path / "t" / "_SUCCESS").write_text("")
    one = snapshots.parts_of(spark, str(tmp_path / "t"))
    assert len(one) == 2 and len({c for _, _, c in one.values()}) == 1
    (tmp_path / "t" / "b").write_bytes(b"x" * 199_999 + b"y")
    two = snapshots.parts_of(spark, str(tmp_path / "t"))
    assert len({c for _, _, c in two.values()}) == 2 and snapshots.state_of(one) != snapshots.state_of(two)


def test_a_first_build_shuffles_items_once(spark, table):
    """Edges are derived from items as they were laid out: no further exchange by order, and no further sort, of all items."""
    i, plans = index(spark, table), []

    def derive(items):
        out = views._neighbours(items)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    i.derive = derive
    i.manifest()
    own = plans[0].split("InMemoryTableScan")[0]
    assert len(plans) == 1 and "Window" in own and "Exchange" not in own and "Sort" not in own
    check(spark, table)
