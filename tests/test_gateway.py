from pyspark.sql import functions as F

from tessera.operators import chunking, gateway, graph, state

REQUESTS = "request int, op string, engine string, role string, root string"
ANSWERS = "request int, engine string, result string, reason string"


def policy(spark):
    roles = spark.createDataFrame([("admin", ["*"]), ("reader", ["overview"])], "role string, ops array<string>")
    tokens = spark.createDataFrame([("d", "ghost")], "digest string, role string")
    return state.rules_of(roles, tokens), spark.createDataFrame([("admin", "*"), ("reader", "/r")], "role string, allowed_root string")


def test_answers(spark):
    asked = [
        (1, "overview", "auto", "admin", "/x"), (2, "overview", "graph", "admin", "/x"), (3, "callers", "auto", "reader", "/r"), (4, "overview", "auto", "reader", "/rx"), (5, "overview", "weird", "admin", "/x"),
        (6, "context", "auto", "admin", "/x"), (7, "search", "auto", "admin", "/x"), (8, "overview", "auto", "ghost", "/r"), (9, "overview", "auto", "reader", "/r/sub"), (10, "callers", None, "admin", "/x"), (11, "context", "all", "admin", "/x"),
    ]
    said = [
        (1, "graph", None, "project-not-indexed"), (1, "lsp", "from lsp", None), (2, "graph", None, "project-not-indexed"), (2, "lsp", "from lsp", None), (6, "graph", "at /home/a/x", None), (6, "lsp", None, "timeout"), (6, "semantic", "never asked", None),
        (9, "graph", None, "not-in-graph"), (9, "lsp", "from lsp", None), (11, "graph", None, "timeout"),
    ]
    got = {r["request"]: r for r in gateway.answered(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(said, ANSWERS), *policy(spark), home="/home/a").collect()}
    assert len(got) == len(asked)
    assert (got[1]["engine"], got[1]["result"], got[1]["confidence"]) == ("lsp", "from lsp", "complete")  # routed by itself: the other engine helps
    assert (got[2]["engine"], got[2]["result"], got[2]["reason"]) == ("graph", None, "project-not-indexed")  # asked for by name: it doesn't
    assert got[3]["reason"] == "op-not-allowed-for-role" and got[4]["reason"] == "root-not-allowed-for-role" and got[8]["reason"] == "op-not-allowed-for-role"
    assert got[5]["reason"] == got[10]["reason"] == "unknown-engine"
    assert (got[6]["result"], got[6]["gaps"], got[6]["confidence"]) == ("## [graph]\nat ~/x", "lsp:timeout", "partial")
    assert (got[7]["engine"], got[7]["reason"]) == ("semantic", "engine-unavailable")
    assert (got[9]["engine"], got[9]["reason"]) == ("graph", "not-in-graph")  # asked, and nothing there
    assert (got[11]["result"], got[11]["reason"]) == (None, "engines-unavailable")


def test_cache_keys_follow_file_contents(spark):
    asked = spark.createDataFrame([(1, "overview", "a.py", "lsp", "/r"), (2, "overview", "/r/a.py", "lsp", "/r"), (3, "overview", "a.py", "lsp", "/q"), (4, "callers", "name", "graph", "/r")], "request int, op string, target string, engine string, root string")
    keys = lambda text: {r["request"]: r["key"] for r in gateway.cache_key(asked, spark.createDataFrame([("/r", "a.py", text)], "root string, path string, content string")).collect()}
    old, new = keys("one"), keys("two")
    assert len(old) == 4 and old[1] != new[1] and old[2] != new[2] and old[3] == new[3] and old[4] == new[4]


def test_cooldown(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 59_000_000), (3, 1, 60_000_000), (4, 2, 1)], "event_id long, root long, us long")
    assert {r["event_id"]: r["tried"] for r in gateway.cooled(rows).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_changes_read_as_clean_or_as_other_files(spark):
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    symbols = lambda *r: spark.createDataFrame(list(r), "label string, path string")
    lines = lambda f, s: [(r["section"], r["line"]) for r in graph.changed(f, s, "path like '%.py'", 2).orderBy("section", "place").collect()]
    assert lines(files(), symbols()) == [("head", "clean")]
    assert lines(files("a.md", "a.md"), symbols(("x", "b.md"))) == [("head", "no source changes: 2 of other files")]
    got = lines(files("a.py", "a.py", "b.py", "c.py", "d.md"), symbols(("f", "a.py"), ("f", "a.py"), ("a.py", "a.py"), ("g", None), ("h", "d.md"), (" ", "a.py")))
    assert got == [("files", "- a.py"), ("files", "- b.py"), ("files", "… (+1 more)"), ("head", "3 files, 2 symbols"), ("symbols", "- f  (a.py)"), ("symbols", "- g")]


def test_index_pass_keeps_what_a_ceiling_cut_off(spark):
    kind = "path string, start int, chunk_id string, content_hash string"
    old = spark.createDataFrame([("a", 0, "a0", "x"), ("a", 9, "a9", "x"), ("b", 0, "b0", "x"), ("b", 9, "b9", "x"), ("c", 0, "c0", "x")], kind)
    new = spark.createDataFrame([("a", 0, "a0", "y"), ("b", 0, "b0", "y"), ("b", 5, "b5", "x")], kind)
    live = spark.createDataFrame([("a",), ("b",)], "path string")
    run = lambda most: {(r["chunk_id"], r["content_hash"], r["status"]) for r in chunking.index_pass(old, new, live, most).collect()}
    assert run(10) == {("a0", "y", "changed"), ("b0", "y", "changed"), ("b5", "x", "new")}
    assert run(1) == {("a0", "y", "changed"), ("b0", "x", "stale"), ("b9", "x", "orphan")}


def test_labels(spark):
    rows = [("f", "a.py", "CALLS"), ("a.py", "a.py", None), ("", "a.py", " "), (None, None, "USAGE")]
    got = spark.createDataFrame(rows, "n string, f string, e string").select(graph.label_line(F.col("n"), F.col("f"), F.col("e")).alias("x")).collect()
    assert [r["x"] for r in got] == ["- f [CALLS] (a.py)", "- a.py", "- ? (a.py)", "- ? [USAGE]"]
