"""Whole answers of a search: the quota over the wide set of hits, reasons, gaps, and texts that only survivors need."""

import math

import pytest

from tessera.operators import search

CATALOGUE = "project string, path string, start int, next int, vec_id long, embedding array<float>"
PROSE = "path like 'docs/%'"


def at(angle):
    return [math.cos(math.radians(angle)), math.sin(math.radians(angle))]


@pytest.fixture(scope="module")
def corpus(spark):
    """Twelve prose chunks nearest to the query, then 48 of code; ten more that are too far; another project."""
    rows = [("p", f"docs/d{i}.md", 0, None, i, at(i)) for i in range(12)] + [("p", f"src/s{i}.py", 2, None, i, at(13 + i)) for i in range(12, 60)]
    rows += [("p", f"src/far{i}.py", 0, None, 100 + i, at(89)) for i in range(10)] + [("q", "src/other.py", 0, None, 500, at(0))]
    files = [(p, f, f"\n\nline of {f}\nmore") for p, f, *_ in rows if f != "src/s13.py"]
    return spark.createDataFrame(rows, CATALOGUE), spark.createDataFrame(files, "project string, path string, text string")


def test_prose_ahead_of_code_leaves_room_for_code(corpus):
    got = search.answer(*corpus, at(0), "anything", "p", PROSE, rerank="off").collect()
    assert [r["corpus"] for r in got] == ["code"] * 6 + ["prose"] * 4
    assert [r["path"] for r in got] == [f"src/s{i}.py" for i in range(12, 18)] + [f"docs/d{i}.md" for i in range(4)]
    assert got[0]["shown"] == "src/s12.py:3 | line of src/s12.py" and got[0]["line"] == 3
    assert got[1]["shown"] == "src/s13.py:3 | " and got[1]["snippet"] == ""  # its file is gone


def test_fused_answer_keeps_all_sixty(corpus):
    got = search.hits(*corpus, at(0), "s40", "p", 60, rerank="on").orderBy("i").collect()
    assert len(got) == 60 and [r["i"] for r in got] == list(range(60))
    assert got[0]["path"] in ("src/s40.py", "docs/d0.md")
    assert {r["path"] for r in got} == {f"docs/d{i}.md" for i in range(12)} | {f"src/s{i}.py" for i in range(12, 60)}


def test_envelope_says_why(spark, corpus):
    ask = lambda project, prose=PROSE, floor=0.25, query=at(0): search.envelope(*corpus, query, "x", project, prose, floor=floor, rerank="off").first()
    whole = ask("p")
    assert whole["reason"] is None and whole["confidence"] == "complete" and len(whole["result"].split("\n")) == 10
    assert ask("nobody")["reason"] == "no-index" and ask("nobody")["result"] is None
    assert ask("p", floor=1.5)["reason"] == "below-floor"
    assert (ask("p", prose="true")["gap"], ask("p", prose="true")["confidence"]) == ("no-code-matches", "partial")
    assert ask("p", prose="vec_id % 5 <> 0")["gap"] == "prose-heavy"
    assert ask("q")["result"] == "src/other.py:1 | line of src/other.py"


def test_texts_are_read_after_the_top_k(spark, corpus, tmp_path):
    """The ranking's plan reads no text; of the files only the survivors' are cut into lines."""
    catalogue, files = corpus
    files.write.parquet(f"{tmp_path}/files")
    ranked = search.hits(catalogue, spark.read.parquet(f"{tmp_path}/files"), at(0), "x", "p", 10, rerank="off")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "split" in plan.split("FileScan")[0]  # ranking was done before; lines are cut above the join
    assert ranked.count() == 10


def test_stored_norms_give_the_same_scores(spark, corpus):
    from pyspark.sql import functions as F

    catalogue, files = corpus
    with_norm = catalogue.withColumn("norm", search.norm("embedding"))
    one, two = (search.hits(c, files, at(7), "x", "p", 20, rerank="off").select("vec_id", F.round("score", 12)).orderBy("vec_id").collect() for c in (catalogue, with_norm))
    assert one == two


def test_vectors_without_length_have_no_score(spark):
    c = spark.createDataFrame([("p", "a.py", 0, None, 1, [0.0, 0.0]), ("p", "b.py", 0, None, 2, [1.0, 0.0])], CATALOGUE)
    f = spark.createDataFrame([("p", "a.py", "a"), ("p", "b.py", "b")], "project string, path string, text string")
    assert [r["path"] for r in search.answer(c, f, [1.0, 0.0], "", "p", "false").collect()] == ["b.py"]
