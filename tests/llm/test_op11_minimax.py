import random
import zlib

import pytest
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from tessera.llm import op11_minimax as op


def least_capacity(sizes, shards):
    """Every candidate in turn, each checked by a plain loop."""
    fits = lambda c: greedy(sizes, c) <= shards
    candidates = {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
    return min(c for c in candidates | {1} if fits(c))


def greedy(sizes, c):
    n, room = 0, -1
    for s in sizes:
        if s > room:
            n, room = n + 1, c
        room -= s
    return n


def level(sizes, shards, c):
    """The last group of each shard, cut by cut, with every boundary at hand."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    total, last = ends[-1], [ends[-1]]
    for _ in range(shards):
        b = last[-1]
        last.append(0 if b == 0 else min(min(x for x in ends if x >= b - c), max(x for x in ends if x < b)))
    p, cuts = 0, []
    for left in range(shards, 0, -1):
        if p < total:
            after = min(x for x in ends if x > p)
            low, high = max(last[left - 1], after), max(max(x for x in ends if x <= p + c), after)
            near = min(ends, key=lambda b: (abs(b * left - (p * left + total - p)), b))
            p = min(max(near, low), max(high, low))
        cuts.append(p)
    return cuts


def search(sizes, shards, lookups):
    """The operator's search over a list, asking for boundaries as it would of the table."""
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    known = op.Boundaries(len(sizes), at[-1])
    large = sorted(range(len(sizes)), key=lambda r: (-sizes[r], r))[: shards + 1]
    known.add({r: at[r] for r in large} | {r + 1: at[r + 1] for r in large})
    base, asked = sizes[large[shards]] if len(large) > shards else 1, []

    def refine(gaps):
        wanted = set()
        for k in gaps:
            a, n, parts = known.ranks[k], known.ranks[k + 1] - known.ranks[k], max(2, lookups // len(gaps))
            wanted.update(a + n * j // parts for j in range(1, parts))
        asked.append(len(wanted - set(known.ranks)))
        known.add({r: at[r] for r in wanted})

    capacity, gaps = op._capacity(known, shards, base)
    while gaps:
        refine(gaps)
        capacity, gaps = op._capacity(known, shards, base)
    cuts, gaps = op._levelled(known, shards, capacity)
    while gaps:
        refine(gaps)
        cuts, gaps = op._levelled(known, shards, capacity)
    return capacity, cuts, asked


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 30), st.integers(1, 400)), min_size=1, max_size=40), st.integers(1, 9), st.sampled_from([2, 3, 64]))
def test_search_equals_brute_force(sizes, shards, lookups):
    capacity, cuts, _ = search(sizes, shards, lookups)
    assert capacity == least_capacity(sizes, shards)
    assert cuts == level(sizes, shards, capacity)


def test_many_groups_few_lookups():
    rng = random.Random(5)
    sizes = [rng.randint(17, 5000) for _ in range(60_000)] + [30_000_000] + [rng.randint(17, 5000) for _ in range(20_000)]
    capacity, cuts, asked = search(sizes, 40, 512)
    assert greedy(sizes, capacity) <= 40 < greedy(sizes, capacity - 1)
    assert sum(asked) < 20_000 and len(asked) < 24
    parts = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(parts) == sum(sizes) and parts.count(30_000_000) == 1  # the huge group has a shard of its own,
    near = [x for x in parts if x != 30_000_000]  # and the others are near equal all the same
    assert max(near) <= capacity and min(near) > 0.95 * max(near)


def test_equals_sql(spark, small):
    compare(op.assigned(spark.read.parquet(f"{small}/documents.parquet")), op.ORACLE, small)


def brute(rows, shards=op.SHARDS):
    """shard of each text by the rule over the whole list."""
    import hashlib

    sizes = {}
    for _, text in rows:
        key = hashlib.sha256((text or "").encode()).digest()
        sizes[key] = sizes.get(key, 0) + len((text or "").encode()) + 16
    order = sorted(sizes)
    values = [sizes[k] for k in order]
    low, high = 1, sum(values)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(values, mid) <= shards else (mid + 1, high)
    cuts, at, shard = level(values, shards, low), 0, {}
    for k, v in zip(order, values):
        shard[k] = sum(c <= at for c in cuts)
        at += v
    return {text: shard[hashlib.sha256((text or "").encode()).digest()] for _, text in rows}


def check(df, rows, shards=op.SHARDS):
    got, want = df.collect(), brute(rows, shards)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), want[t]) for i, t in rows), key=str)
    for s in {r["shard"] for r in got}:
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert [r["doc_id"] for r in mine if r["doc_id"] is not None] == sorted(r["doc_id"] for r in mine if r["doc_id"] is not None)
        assert all(r["doc_id"] is None for r in mine[: sum(r["doc_id"] is None for r in mine)])
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    assert all(0 <= r["shard"] < shards for r in got)


def test_hot_group_nulls_and_copies(spark, docs_of):
    texts = ["copy of many"] * 400 + [None, "", "é日本👩", "x" * 200_000] + [f"text {k} " * (k % 17) for k in range(700)]
    ids = [None if k % 50 == 0 else k // 2 for k in range(len(texts))]
    docs = docs_of(texts, ids=ids)
    check(op.assigned(clash(docs)), list(zip(ids, texts)))
    check(op.assigned(docs.repartition(7)), list(zip(ids, texts)))
    assert op.assigned(docs).coalesce(1).groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_refinement_on_a_table(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    texts = ["t" * rng.randint(0, 900) + str(k) for k in range(3000)]
    rows = docs_of(texts).select(op.group_key(F.col("text")).alias("key"), op._size().alias("size"))
    groups = op.grouped(rows)
    assert op.cuts_of(groups, 40, lookups=64) == op.cuts_of(groups, 40)


@pytest.mark.parametrize("texts", [[], ["one"], [None] * 5, ["a", "b", "c"], ["same"] * 100])
def test_few_groups(docs_of, texts):
    docs = docs_of(texts or ["x"]).limit(len(texts))
    check(op.assigned(docs), list(enumerate(texts)))


def test_documents_written_by_shard(spark, docs_of, tmp_path):
    docs = docs_of([f"text {k}" for k in range(200)])
    op.write(docs, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["text"] for r in back.collect()) == sorted(f"text {k}" for k in range(200))
    want = {(r["doc_id"], r["shard"]) for r in op.assigned(docs, 8).collect()}
    assert {(r["doc_id"], r["shard__"]) for r in back.collect()} == want
    assert "shard" in op.sharded(docs, 8).columns
