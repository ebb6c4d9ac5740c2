import base64

import public_tokenizers as public
import tiktoken
from conftest_llm import clash
from oracle import compare
from test_op4_mixing import brute as mixing
from test_op9_simhash import components, plain

import corpus_pipeline
from tessera.llm import op4_mixing, op6_quality, op7_secrets, op9_simhash, registry


def test_registered():
    import __spark_entry__ as e

    found = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found and set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_oracles(spark, small):
    for name, sql in registry.ORACLES.items():
        compare(registry.QUERIES[name](spark, small), sql, small)


def test_against_stages_by_hand(spark, small, documents, labels):
    rows = {r["doc_id"]: r for r in documents.collect()}
    good = sorted(r["doc_id"] for r in op6_quality.quality(documents, labels).where("predicted = 1").collect())
    prints = [plain(rows[i]["text"]) for i in good]
    kept = [good[k] for k, c in enumerate(components(prints)) if c == k]
    masked = {r["doc_id"]: r["text"] for r in op7_secrets.redacted(documents.where(documents.doc_id.isin(kept))).collect()}
    assert set(masked) == set(kept)
    table = [(i, "reference" if rows[i]["source"][-1] in "13579" else "web", rows[i]["lang"], rows[i]["source"], len(masked[i].split())) for i in kept]
    copies = {table[k][0]: c for k, c in mixing(table, op4_mixing.WEIGHTS, sum(r[4] for r in table) * op4_mixing.BUDGET // 1000).items() if c}
    got = corpus_pipeline.run(spark, small).collect()
    assert {i: sum(r["doc_id"] == i for r in got) for i in copies} == copies and len(got) == sum(copies.values())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        assert r["decoded"] == masked[r["doc_id"]] and r["ids"] == bpe.encode_ordinary(masked[r["doc_id"]])


def test_empty_tables(spark, small, documents, labels):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def odd(docs_of, documents, labels):
    """All documents and rows with nulls in each column, repeated rows and ids, empty and long texts, clashing columns."""
    kept = op6_quality.accepted(documents, labels).where("length(text) > 300 and length(text) < 3000").orderBy("doc_id").limit(6).collect()
    good = [r["text"] for r in kept]
    mine = [t[::-1] for t in good]  # texts that no document has
    texts = [*mine, mine[0], mine[0], mine[1] + " x", None, "", "", mine[2] * 40, f"{good[3]} secret: 9f8e7d6c5b4a39281706f5e4d3c2b1a0"]
    ids = [*range(10**9, 10**9 + 6), None, None, 1, None, 7, 7, 8, 9]
    langs, sources = [None if k % 4 == 3 else "en" for k in range(len(texts))], [None if k % 5 == 4 else f"src{k % 2}" for k in range(len(texts))]
    return clash(documents.unionByName(docs_of(texts, ids=ids, langs=langs, sources=sources))), mine


def test_stages_on_odd_rows(spark, small, docs_of, documents, labels):
    docs, mine = odd(docs_of, documents, labels)
    columns, same = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        after = docs.collect()
        assert after and (name == "mixing sources to target weights" or len(after) <= len(before))
        if name == "SimHash near-dedup":
            prints = {op9_simhash.fingerprint(r["text"]) for r in before}
            assert len({r["text"] for r in after}) == len(after) and all(op9_simhash.fingerprint(r["text"]) in prints for r in after)
            assert sum(r["text"] == mine[0] for r in after) <= 1
        elif name == "secret scans":
            assert len(after) == len(before) and not any("9f8e7d6c5b" in (r["text"] or "") for r in after)
        elif name == "quality classifier":
            fates = {}
            for r in before:
                same[r["text"]] = same.get(r["text"], 0) + 1
            for r in after:
                fates[r["text"]] = fates.get(r["text"], 0) + 1
            assert all(n == same[t] for t, n in fates.items())  # equal texts share one fate, whatever their ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted(r["decoded"] for r in last) == sorted(r["text"] or "" for r in docs.collect())


def test_run_leaves_only_its_result(spark, small, docs_of, documents, labels, tmp_path):
    from pathlib import Path

    docs, _ = odd(docs_of, documents, labels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(corpus_pipeline.shared_folder(spark).removeprefix("file:"))
    files = lambda: {p for p in folder.rglob("part-*")}
    before = files()
    got = corpus_pipeline.run(spark, str(tmp_path))
    new = files() - before
    assert new and all("/pipeline-" in str(p) and p.parent.name == "4" for p in new)
    assert got.count() == len(got.collect())


def test_quality_stage_trains_on_every_labelled_row(spark, docs_of, tmp_path, monkeypatch):
    from zlib import crc32

    import corpus_pipeline
    from tessera.llm import op6_quality

    n, seen = 9000, []
    spark.range(n).selectExpr("id as doc_id", "cast(id % 3 <> 0 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(op6_quality, "fit_all", lambda train, base: seen.append(train.count()))
    corpus_pipeline.quality(spark, docs_of([f"text {i}" for i in range(n)]), str(tmp_path))
    assert seen == [sum(crc32(str(i).encode()) % 4 != 2 for i in range(n))]


def test_checkpoints_and_results_are_few_files(spark, docs_of):
    """However many partitions the rows lie in, few files are written: each one forks processes on a local file system."""
    from tessera.llm import shared

    most = shared.FILES * spark.sparkContext.defaultParallelism
    many = docs_of([f"text {i}" for i in range(900)]).repartition(3 * most)
    kept = shared.cut_packed(many)
    assert kept.rdd.getNumPartitions() <= most and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert corpus_pipeline.encoding(spark, many, "").rdd.getNumPartitions() <= most
    assert op6_quality.measured(many).rdd.getNumPartitions() <= most
