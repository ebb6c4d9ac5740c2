import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from conftest_llm import clash
from pyspark.sql import functions as F

from tessera.llm import op4_mixing as op


def share(children, budget):
    """Water-filling by repeated passes over (name, supply, weight), whole tokens."""
    out, open_ = {}, dict((n, (s, w)) for n, s, w in children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (s, w) in open_.items() if budget * w >= s * total]
        if not full:
            return out | {n: min(s, int(Fraction(budget * w, total))) for n, (s, w) in open_.items()}
        n = min(full, key=lambda n: (Fraction(open_[n][0], open_[n][1]), n))
        out[n] = open_[n][0]
        budget -= open_.pop(n)[0]
    return out


def brute(rows, weights, budget, epochs=op.EPOCHS, seed=op.SEED):
    """``rows``: (doc_id, domain, language, source, tokens) -> copies by row number."""
    weight = lambda *path: weights.get("/".join(path), 1)
    tree = defaultdict(int)
    for _, *path, n in rows:
        for k in range(4):
            tree[tuple(path[:k])] += n
    give = {(): min(budget, tree[()] * epochs)}
    for depth in range(3):
        for parent in [p for p in tree if len(p) == depth]:
            kids = [(p, tree[p] * epochs, weight(*p)) for p in tree if len(p) == depth + 1 and p[:depth] == parent]
            give |= share(kids, give[parent])
    out = {}
    for leaf in [p for p in tree if len(p) == 3]:
        passes, left = divmod(give[leaf], tree[leaf])
        own = sorted((hashlib.md5(f"{seed}:{passes}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[4], i) for i, r in enumerate(rows) if tuple(r[1:4]) == leaf)
        reach = 0
        for _, _, n, i in own:
            reach += n
            out[i] = passes + (reach <= left)
    return out


@pytest.mark.parametrize("budget", [0, 1, 300, 800, 2900, 10_000])
def test_equals_brute_force(docs_of, budget):
    n = 160
    langs, sources = ["en" if i % 3 else "de" for i in range(n)], [f"s{(i * i) % 7}" for i in range(n)]
    texts = [" ".join(["w"] * (1 + (i * 37) % 23)) for i in range(n)]
    docs = docs_of(texts, langs=langs, sources=sources)
    weights = {"web": 3, "web/en": 5, "web/en/s0": 2, "reference": 1}
    rows = [(i, "reference" if s[-1] in "13579" else "web", lg, s, len(t.split())) for i, (t, lg, s) in enumerate(zip(texts, langs, sources))]
    want = brute(rows, weights, sum(r[4] for r in rows) * budget // 1000)
    got = {r["doc_id"]: r["copies"] for r in op.planned(docs, weights=weights, budget=budget).collect()}
    assert got == want


def test_whole_documents(documents):
    rows = [(r["doc_id"], "reference" if r["source"][-1] in "13579" else "web", r["lang"], r["source"], len(r["text"].split())) for r in documents.collect()]
    want = brute(rows, op.WEIGHTS, sum(r[4] for r in rows) * op.BUDGET // 1000)
    got = {r["doc_id"]: (r["n_tokens"], r["copies"]) for r in op.mix(documents).collect()}
    assert got == {rows[i][0]: (rows[i][4], c) for i, c in want.items() if c}


def test_odd_rows(docs_of):
    docs = docs_of([None, "", "a b", "a b", "x " * 100_000], ids=[None, 1, 2, 2, 3], langs=[None, "en", "en", "en", "en"], sources=[None, "s1", "s1", "s1", "s2"])
    got = op.planned(clash(docs), budget=3000).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2, 100_000] and all(r["copies"] == 3 for r in got)
    out = op.mixed(clash(docs), budget=1000)
    assert out.columns == clash(docs).columns and out.count() >= 1
    assert op.mix(docs.where("false")).count() == 0 and op.mixed(docs.where("false")).count() == 0


def test_mixed_repeats_rows_as_planned(documents):
    want = {r["doc_id"]: r["copies"] for r in op.mix(documents).collect()}
    got = {r["doc_id"]: r["count"] for r in op.mixed(documents).groupBy("doc_id").count().collect()}
    assert got == want
    assert op.mixed(documents).select(F.sum("n_chars")).first()[0] > 0


def test_mixed_takes_rows_without_ids_as_planned(docs_of):
    n = 40
    docs = docs_of([" ".join(["w"] * (1 + i % 5)) for i in range(n)], ids=[None if i % 4 else 7 for i in range(n)], sources=[f"s{i % 2}" for i in range(n)])
    for budget in (300, 1400):
        want = op.mix(docs, budget=budget).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("n_tokens"))).first()
        assert tuple(op.mixed(clash(docs), budget=budget).agg(F.count("*"), F.sum(op.tokens_of(F.col("text")))).first()) == tuple(want)


@pytest.mark.parametrize("seed,small", [(0, 0), (1, 0), (0, 50_000), (1, 50_000)])
def test_budgets_of_many_siblings(spark, monkeypatch, seed, small):
    """Water levels over many siblings, also equal and nearly equal ones, against repeated passes; sought in steps and put in order."""
    import random

    from tessera import storage

    monkeypatch.setattr(storage, "HOT", 5)
    monkeypatch.setattr(op, "SMALL", small)
    rng = random.Random(seed)
    size = lambda: rng.choice([rng.randrange(1, 50), 1000, 1000 + rng.randrange(3), rng.randrange(1, 10**9), 10**9 + rng.randrange(5)])
    leaves = {(d, lg, f"s{k}"): size() for d in ("web", "reference") for lg in ("en", "de") for k in range(rng.randrange(1, 150))}
    weights = {"web": 3, **{f"web/en/s{k}": rng.randrange(1, 9) for k in range(0, 150, 7)}}
    rows = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, language string, source string, tokens long")
    tree = defaultdict(int)
    for p, n in leaves.items():
        for k in range(4):
            tree[p[:k]] += n
    for total in (1, sum(leaves.values()) // 7, sum(leaves.values()) * 2):
        give = {(): total}
        for depth in range(3):
            for parent in [p for p in tree if len(p) == depth]:
                give |= share([(p, tree[p] * 3, weights.get("/".join(p), 1)) for p in tree if len(p) == depth + 1 and p[:depth] == parent], give[parent])
        got = {(r["domain"], r["language"], r["source"]): r["budget"] for r in op.budgets(rows, weights, F.lit(total)).collect()}
        assert got == {p: give[p] for p in leaves}


def test_hot_ids_are_split(docs_of, monkeypatch):
    from tessera import storage

    monkeypatch.setattr(storage, "HOT", 3)
    monkeypatch.setattr(op, "SLICES", 4)
    n = 120
    docs = docs_of([" ".join(["w"] * (2 + (i % 3 == 0))) for i in range(n)], ids=[None if i % 2 else i for i in range(n)])
    rows = [(r["doc_id"], "web", "en", "s", len(r["text"].split())) for r in docs.collect()]
    for budget in (420, 1700):
        want = brute(rows, op.WEIGHTS, sum(r[4] for r in rows) * budget // 1000)
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["copies"]) for r in op.planned(docs, budget=budget).collect())
        assert got == sorted((rows[i][0] or -1, rows[i][4], c) for i, c in want.items())
