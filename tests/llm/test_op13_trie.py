import hashlib
import random
import re
import zlib

import pytest
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import types as T

from tessera.llm import op13_trie as op

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def sequences(rows):
    """Rebuilt conversations, by the rule's words."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def brute(rows):
    seqs = sequences(rows)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for prefix, own in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        has = lambda p: any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(prefix))))
        out.append((
            min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), sum(len(q) == len(prefix) + 1 for q in under), sum(not has(p) for p in under),
            sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows, local, piece=op.PIECE):
    df = spark.createDataFrame(rows, SCHEMA)
    got = op.trie(df, local, piece)
    assert got.columns == op.COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_equals_sql(spark, small):
    compare(op.trie(spark.read.parquet(f"{small}/conversations.parquet")), op.ORACLE, small)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 4 * n), n):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "a b", "", None, "x  y\tz", f"own {c}"])))
    rows += rng.sample(rows, min(4, len(rows)))  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [1, 20, 10**6])
def test_random_conversations(spark, local):
    check(spark, random_rows(local, 60), local)


def test_hot_prefixes_and_copies(spark):
    hot = [(c, t, "user", f"line {t}") for c in range(0, 400) for t in range(5)]
    common = [(1000 + c, 0, "user", "hello there") for c in range(120)] + [(1000 + c, 1, "bot", f"answer {c % 7}") for c in range(120)]
    long = [(5000 + 20 * c, t, "user", "w " * 3) for c in range(2) for t in range(300)]
    check(spark, hot + common + long, 50)


def test_odd_tables(spark):
    assert op.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    check(spark, [(7, None, None, None)], 10)
    check(spark, [(7, None, None, None), (None, 0, "a", "b"), (2**63 - 1, 0, "r", "t"), (-(2**63), 3, "r", "t"), (2**63 - 8, 1, "r", "t")], 1)
    rows = random_rows(9, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in op.trie(clash(df)).collect()), key=str) == brute(rows)


def test_many_ends_at_one_node(spark):
    """Pieces of a node's ids join to the digest of the whole list."""
    rows = [(20 * c, 0, "user", "same") for c in range(1, 300)] + [(20 * c, 1, "user", f"other {c}") for c in range(1, 100)]
    check(spark, rows, 30, 7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), min_size=1, max_size=12))
def test_multikey_quicksort(lists):
    words = [[x + 1 for x in s] for s in lists]
    got = op.subtree(list(range(len(lists))), lists, words, list(range(len(lists))), 0)
    prefixes = {tuple(s[:d]) for s in lists for d in range(len(s) + 1)}
    assert len(got) == len(prefixes)
    want = sorted((min(k for k, s in enumerate(lists) if tuple(s[: len(p)]) == p), len(p), sum(tuple(s[: len(p)]) == p for s in lists)) for p in prefixes)
    assert sorted((n[0], n[1], n[3]) for n in got) == want
