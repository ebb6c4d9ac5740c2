from zlib import crc32

import numpy as np
from conftest_llm import clash
from pyspark.sql import functions as F

from tessera.llm import op6_quality as op


def test_held_out_accuracy(documents, labels):
    got = {r["doc_id"]: r for r in op.quality(documents, labels).collect()}
    assert len(got) == documents.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, r in got.items():
        assert r["held_out"] == (crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    seen = [got[i]["predicted"] == y for i, y in truth.items()]
    assert np.mean(seen) >= 0.9


def test_fit_ranks_by_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(op.NAMES)))
    y = (x[:, 1] > -0.8).astype(int)
    model = op.fit(x, y, float(1 - y.mean()))
    s = op.scores(x, model)
    assert np.mean((s >= 0.7) == (y == 1)) > 0.95
    assert op.fit(x, np.ones(400), 0.0) is None and (op.scores(x, None) == 0.5).all()


def test_odd_rows(docs_of, labels):
    texts = [None, "", "x" * 300_000, "the end", "the end", "\x00é日"]
    got = op.quality(clash(docs_of(texts, ids=[None, 1, 2, 3, 3, 5])), labels.where("false")).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.5}
    assert all(np.isfinite(op.features(t)).all() and len(op.features(t)) == len(op.NAMES) for t in texts)
    assert op.features(None) == op.features("")
    assert op.quality(docs_of([]), labels).count() == 0


def test_accepted_keeps_columns_and_good_rows(documents, labels):
    wide = clash(documents)
    kept = op.accepted(wide, labels)
    assert kept.columns == wide.columns
    good = {r["doc_id"] for r in op.quality(documents, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_held_out_rows_alone(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    rows = [r for r in rows if r["quality"] in (0, 1)]
    assert len(rows) > 900 and all(crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    for y in (0, 1):
        assert np.mean([r["predicted"] == y for r in rows if r["quality"] == y]) >= 0.97


def test_held_out_labels_do_not_train(documents, labels):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert op.quality(documents, labels).exceptAll(op.quality(documents, other)).count() == 0


def test_weights_are_the_best_of_all_pairs():
    """The fit by Newton steps against plain gradient descent on the same pairs, and scores by a plain loop."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, len(op.NAMES)))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int)
    model = op.fit(x, y, float(1 - y.mean()), pairs=400)
    z = op.binned(x, model["edges"])
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    i, j = draw.choice(good, 400), draw.choice(bad, 400)
    loss = lambda w: sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in zip(i, j)) + op.L2 / 2 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        grad = op.L2 * w - sum((z[a] - z[b]) / (1 + np.exp((z[a] - z[b]) @ w)) for a, b in zip(i, j)) if _ % 400 == 0 else op.L2 * w - ((z[i] - z[j]) / (1 + np.exp((z[i] - z[j]) @ w))[:, None]).sum(axis=0)
        w -= 0.01 * grad
    assert loss(model["w"]) <= loss(w) + 1e-3 and np.abs(model["w"] - w).max() < 0.02
    for k, p in enumerate(op.scores(x, model)):
        s = sum(model["w"][f * model["edges"].shape[1] + e] for f in range(x.shape[1]) for e in range(model["edges"].shape[1]) if x[k, f] >= model["edges"][f, e])
        assert abs(p - 1 / (1 + np.exp(-(model["slope"] * (s - model["cut"]) + np.log(0.7 / 0.3))))) < 1e-9


def test_ties(docs_of, documents, labels):
    text = documents.where("length(text) > 500").first()["text"]
    got = op.quality(documents.unionByName(docs_of([text] * 3, ids=[None, 7, 7])), labels).where("doc_id is null or doc_id = 7").collect()
    assert len({(r["score"], r["predicted"]) for r in got if r["doc_id"] is None or r["score"] == got[-1]["score"]}) == 1


def test_one_id_on_very_many_documents(spark, docs_of):
    """The bound on training rows holds whatever the ids: one document of each sampled id trains."""
    from tessera.llm.shared import labelled_sample, labelled_texts

    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs_of(["good text", "bad text", None], ids=[1, 2, 3]).select("doc_id", "text").unionByName(many)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    ids = labelled_sample(labels, "quality", 1000, 1, 4)
    got = [tuple(r) for r in labelled_texts(docs, ids).collect()]
    assert len(got) == ids.count() and sum((t or "").startswith("text ") for _, t in got) == 1
    assert sorted(got, key=str) == sorted((tuple(r) for r in labelled_texts(docs.repartition(5), ids).collect()), key=str)
    assert op.learn(docs, labels) is not None


def _train(spark, x, y, parts=3):
    return spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, x array<double>").repartition(parts)


def test_every_labelled_row_trains(spark, docs_of):
    """Far more labelled rows than the sample held: each id outside the held-out fold is there once."""
    n = 9000
    docs = docs_of([f"text {i}" for i in range(n)], ids=list(range(n)))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    train = op.training_rows(op.measured(docs), labels)
    ids = [i for i in range(n) if crc32(str(i).encode()) % 4 != 2]
    assert train.count() == len(ids) > 6000
    assert sorted(map(tuple, train.collect())) == sorted((int(i % 3 != 0), op.features(f"text {i}")) for i in ids)


def test_weights_of_all_pairs(spark):
    """Newton steps by counts against the gradient of the loss over every pair, listed one by one."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(300, 4)))
    y = (x[:, 0] - x[:, 1] + 0.7 * rng.normal(size=300) > 0).astype(int)
    train = _train(spark, x, y)
    edges = op.edges_of(train)
    w = op.all_pairs(train, edges)
    z = op.binned(x, edges)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    grad = op.L2 * w - op.PAIRS / len(d) * (d / (1 + np.exp(d @ w))[:, None]).sum(axis=0)
    full = op.L2 * np.zeros_like(w) - op.PAIRS / len(d) * (d / 2).sum(axis=0)
    assert np.abs(grad).max() < 1e-3 * np.abs(full).max()
    for f in range(4):  # edges are quantiles of all rows to the coarseness of the counts
        share = np.array([np.mean(x[y == k, f][:, None] >= edges[f], axis=0) for k in (0, 1)]).mean(axis=0)
        assert (np.diff(edges[f]) >= 0).all() and 0 < share.min() and share[0] > 0.9


def test_few_sums_reach_the_driver(spark):
    """However many partitions the rows lie in, the driver adds up the sums of a bounded number of tasks."""
    from tessera.llm import shared

    train = spark.range(1000).selectExpr("cast(id % 2 as int) as y", "array(cast(id as double)) as x").repartition(211)
    rows, total = shared.summed(train, lambda x, y: [np.array([float(len(y))]), np.array([x.sum()])])
    assert (rows[0], total[0]) == (1000, 499500)
    seen = []
    whole, shared.np.sum = np.sum, lambda a, **k: (seen.append(len(a)), whole(a, **k))[1]
    try:
        shared.summed(train, lambda x, y: [np.array([float(len(y))])])
    finally:
        shared.np.sum = whole
    assert seen == [min(shared.TRAIN_PARTS, 211)]
