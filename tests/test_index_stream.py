"""The index pass as a stream, against the batch difference, on any split into batches and after restarts."""

import random

import pytest

from tessera.operators import chunking
from tessera.sources.views import text_lines
from tessera.streaming import index_stream as s


def files(spark, rows):
    return text_lines(spark.createDataFrame(rows, "project string, path string, text string")).selectExpr("*", "endswith(text, '\\n') as closed")


def write(spark, rows, folder):
    spark.createDataFrame(rows, s.CHANGE).coalesce(1).write.mode("append").parquet(folder)


def replayed(changes):
    """Changes in order, applied one by one: the chunks of each file at the end."""
    import hashlib

    state = {}
    for p, f, at, live, ids, hashes in changes:
        now = dict(zip(ids, hashes))
        key = (at, hashlib.sha256(repr((live, sorted(now.items()))).encode()).hexdigest())
        if (p, f) not in state or key > state[p, f][0]:
            state[p, f] = (key, now)
    return sorted((p or "", f, i, h) for (p, f), (_, now) in state.items() for i, h in now.items())


def random_changes(seed, n=40):
    rng, out = random.Random(seed), []
    for _ in range(n):
        ids = [f"c{k}" for k in range(rng.randint(0, 4))]
        live = rng.random() > 0.2
        out.append((rng.choice(["p", "q", None]), rng.choice("abc"), rng.randint(1, 12), live, ids if live else [], [rng.choice("xyz") for _ in ids] if live else []))
    return out + out[:5]


def ended(spark, told):
    return sorted((r["project"] or "", r["path"], r["chunk_id"], r["content_hash"]) for r in s.catalogue(told).collect())


@pytest.mark.parametrize("cuts", [(), (13,), (5, 20, 33)])
def test_any_split_and_restarts_end_alike(spark, tmp_path, cuts):
    """Each part is a run of its own on the same place, as after a restart; late and repeated changes are among them."""
    changes, told = random_changes(7), None
    for a, b in zip([0, *cuts], [*cuts, len(changes)]):
        write(spark, changes[a:b], f"{tmp_path}/in")
        told = s.run(spark, f"{tmp_path}/in", str(tmp_path))
    assert ended(spark, told) == replayed(changes)
    assert ended(spark, s.run(spark, f"{tmp_path}/in", str(tmp_path))) == replayed(changes)  # nothing is applied twice


def test_equals_the_batch_pass(spark, tmp_path):
    one = files(spark, [("p", f"f{i}.txt", "".join(f"line {i} {k}\n" for k in range(45))) for i in range(8)] + [("p", "empty.txt", "")])
    two = files(spark, [("p", f"f{i}.txt", "".join(f"line {i} {k if i != 3 or k < 12 else 0}\n" for k in range(45 if i != 2 else 15))) for i in range(1, 9)] + [("p", "empty.txt", "now\n")])
    s.changes_of(one, 1).write.parquet(f"{tmp_path}/in")
    s.run(spark, f"{tmp_path}/in", str(tmp_path))
    gone = one.where("path = 'f0.txt'")
    s.changes_of(two, 2).unionByName(s.deletions_of(gone, 2)).write.mode("append").parquet(f"{tmp_path}/in")
    told = s.run(spark, f"{tmp_path}/in", str(tmp_path), files_at_once=1)
    old, new = chunking.chunks(one), chunking.chunks(two)
    want = chunking.difference(old, new, two.select("path"))
    got = told.where("at = 2").select("chunk_id", "path", "status")
    assert sorted(got.collect()) == sorted(want.collect()) and {r["status"] for r in want.collect()} == {"new", "changed", "unchanged", "orphan", "deleted"}
    assert sorted(r[0] for r in s.catalogue(told).select("chunk_id").collect()) == sorted(r["chunk_id"] for r in new.collect())


def test_without_changes(spark, tmp_path):
    write(spark, [], f"{tmp_path}/in")
    assert s.run(spark, f"{tmp_path}/in", str(tmp_path)).count() == 0


def test_one_look_at_the_state_for_each_file():
    """A file's state is asked for once a batch, and written only if a change was applied."""
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.held, self.calls = None, []

        def exists(self):
            self.calls.append("exists")
            return self.held is not None

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    c = s.Chunks()
    c.file = State()
    change = Row(project="p", path="f", at=1, live=True, ids=["a", "b"], hashes=["x", "y"])
    told = list(c.handleInputRows(("p", "f"), iter([change]), None))
    assert [(r["path"], r["chunk_id"], r["status"]) for r in told] == [("f", "a", "new"), ("f", "b", "new")]
    assert list(c.handleInputRows(("p", "f"), iter([change]), None)) == []
    assert c.file.calls == ["get", "update", "get"]
