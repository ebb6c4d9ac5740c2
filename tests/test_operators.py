import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import chunking, graph, references, search, state
from tessera.sources import files, sinks

EDGES = "src long, dst long, type string"


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    ("path", "generated", "prose", "code"),
    [
        ("web/node_modules/a.ts", True, False, False),
        ("bazel-out/x.py", True, False, False),
        ("lib/app.min.js", True, False, False),
        ("proto/x_pb2.py", True, False, False),
        ("yarn.lock", True, False, False),
        ("packages/a/generated/b.py", False, False, True),
        ("src/pods.py", False, False, True),
        ("docs/a.py", False, True, False),
        ("README.MD", False, True, False),
        ("", False, False, False),
        ("Makefile", False, False, False),
        (".gitignore", False, False, False),
    ],
)
def test_path_classes(spark, path, generated, prose, code):
    x = F.col("x")
    got = spark.createDataFrame([(path,)], "x string").select(paths.generated_path(x), paths.prose(x), paths.code(x)).first()
    assert tuple(got) == (generated, prose, code)


def test_noise_names_and_labels(spark):
    x = F.col("x")
    assert values(spark, paths.synthetic(x), ["", None, "<builtins>", "a.py"]) == [True, True, True, False]
    assert values(spark, paths.test_like(x, F.lit("f")), ["tests/a.py", "a/test/b.py", "a_test.py", "contest/a.py", "conftest.py"]) == [True, True, True, False, True]
    assert values(spark, paths.family(x), ["a.PY", "b.tsx", "c.unknown", ""]) == ["python", "ts-js", "", ""]
    assert values(spark, paths.without_project(x), ["home-a-b.src.f", "src.f", "a-b.py", "a b-c.d"]) == ["src.f", "src.f", "a-b.py", "a b-c.d"]
    assert values(spark, paths.without_repeats(x), ["a.a.b", "1.1.b", "a.b.a"]) == ["a.b", "1.1.b", "a.b.a"]
    assert values(spark, paths.line_label(F.lit("p"), x), [0, 6, -1, None], "int") == ["p:1", "p:7", "p", "p"]
    assert values(spark, paths.redacted(x, "/home/al"), ["/private/home/al/x /home/al", "home-al.f"]) == ["~/x ~", "<home>.f"]
    assert values(spark, paths.contained(x, F.lit("/a/b/")), ["/a/b/c", "/a/bc", "/a/b/"]) == [True, False, True]
    assert values(spark, paths.glob(x, "gen/*.py"), ["gen/a.py", "x/gen/b.py", "gen/a.js"]) == [True, True, False]
    assert values(spark, paths.glob(x, "vendor"), ["vendor/a.py", "a/vendor", "vendors/a"]) == [True, True, False]


def test_generated_texts(spark):
    x = F.col("x")
    banner, late = "# Code generated by tool\nx\n", "\n" * 60 + "# autogenerated\n"
    assert values(spark, paths.generated_text(x), [banner, late, "a" * 2001 + "\n", "plain\n"]) == [True, False, True, False]
    assert values(spark, paths.generated_file(x), ["one line", "two\nlines"]) == [True, False]
    assert values(spark, paths.binary(F.encode("x", "UTF-8")), ["a\x00b", "ab", "\x10\x01"]) == [True, False, False]
    assert values(spark, paths.first_meaningful(F.split("x", "\n")), ["---\n a1 \nb", "--\n..", ""]) == ["a1", "--", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 60)), max_size=8), st.integers(0, 50))
def test_cover_is_gapless(spark, spans, n):
    def plain():
        out, at = [], 0
        win = lambda a, b: [(s, min(s + 4, b)) for s in range(a, b, 2)]
        for s, e in sorted(spans):
            s, e = max(s, at), min(e, n)
            if s < e:
                out += win(at, s) + ([(s, e)] if e - s <= 8 else win(s, e))
                at = e
        return sorted(out + win(at, n))

    f = spark.createDataFrame([("f", n)], "path string, n int")
    got = chunking.cover(f, spark.createDataFrame([("f", a, b) for a, b in spans], "path string, start int, end int"), 4, 2)
    assert sorted((r["start"], r["end"]) for r in got.collect()) == plain()


def test_text_lines(spark):
    from tessera.sources.views import text_lines

    t = spark.createDataFrame([("a\r\nb\rc\n",), ("",), ("x",), ("\n\n",)], "text string")
    assert [r["lines"] for r in text_lines(t).collect()] == [["a", "b", "c"], [], ["x"], ["", ""]]


def test_catalogue_difference(spark):
    kind = "project string, path string, chunk_id string, content_hash string"
    old = spark.createDataFrame([("p", "a", "1", "x"), ("p", "a", "2", "x"), ("p", "a", "3", "x"), ("p", "b", "4", "x")], kind)
    new = spark.createDataFrame([("p", "a", "1", "x"), ("p", "a", "2", "y"), ("p", "c", "5", "z")], kind)
    live = spark.createDataFrame([("a",), ("c",)], "path string")
    got = {r["chunk_id"]: r["status"] for r in chunking.difference(old, new, live).collect()}
    assert got == {"1": "unchanged", "2": "changed", "3": "orphan", "4": "deleted", "5": "new"}


def test_reach_over_cycles(spark):
    e = spark.createDataFrame([(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 1, "CALLS"), (3, 4, "USAGE"), (4, 5, "TESTS")], EDGES)
    got = {r["id"]: r["hop"] for r in graph.reach(e, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_coverage_of_few_rows_does_not_warn(spark):
    few = spark.createDataFrame([("py",)] * 4, "family string")
    assert graph.coverage(few, "family").first()["warns"] is False
    assert graph.coverage(few.union(few), "family").first()["warns"] is True
    assert graph.coverage(few.where("false"), "family").first()["warns"] is False


def test_rerank_order(spark):
    rows = [(0, math.cos(math.radians(20)), "near meaning", 0), (1, math.cos(math.radians(60)), "def needle here", 1)]
    c = spark.createDataFrame(rows, "vec_id long, score double, text string, i int")
    ranked = search.fused(c, search.lexical(F.col("text"), ["needle"]), search.symbol_boost(F.col("text"), "needle"))
    assert [r["vec_id"] for r in ranked.orderBy("place").collect()] == [1, 0]
    same = search.fused(c, search.lexical(F.col("text"), ["absent"]), search.symbol_boost(F.col("text"), "two words"))
    assert [r["vec_id"] for r in same.orderBy("place").collect()] == [0, 1]


def test_tokens_and_knn(spark):
    got = values(spark, search.tokens(F.col("x")), ["parseHTTPReply snake_case x1"])[0]
    assert set(got) == {"parsehttpreply", "parse", "http", "reply", "snake_case", "snake", "case", "x1", "x", "1"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in search.knn(v, [1.0, 0.0], 3).collect()] == [1, 3, 2]


def test_debounce_is_a_fold(spark):
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 20), (3, 1, 40), (4, 2, 5)], "event_id long, root long, us long")
    assert sorted(r["event_id"] for r in state.debounced(e, 30).where("fired").collect()) == [1, 3, 4]


def test_root_policy_fails_closed(spark):
    asked = spark.createDataFrame([(1, "a", "/r/x"), (2, "a", "/rx"), (3, "b", "/r"), (4, "all", "/q"), (5, "a", " "), (6, "a", "/r/")], "request int, role string, root string")
    roots = spark.createDataFrame([("a", "/r/"), ("all", "*")], "role string, allowed_root string")
    assert {r["request"]: r["allowed"] for r in state.root_allowed(asked, roots).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_registry_prefers_exact_then_longest(spark):
    reg = spark.createDataFrame([(0, "parent", "/p", 9), (1, "small", "/p/c", 3), (2, "big", "/p/c", 7), (3, "", "", 1)], "ordinal int, name string, root_path string, nodes int")
    t = spark.createDataFrame([("/p/c",), ("/p/c/d",), ("/p/x",), ("/z",)], "target string")
    assert {r["target"]: (r["name"], r["scope"]) for r in state.resolved(t, reg).collect()} == {"/p/c": ("big", "exact"), "/p/c/d": ("small", "ancestor"), "/p/x": ("parent", "ancestor")}


def test_merge_tells_failure_from_absence(spark):
    rows = [(1, "graph", "g", None), (1, "lsp", None, "timeout"), (2, "graph", None, "error"), (3, "graph", None, "no-result"), (3, "lsp", None, "error")]
    got = {r["request"]: r for r in state.merged(spark.createDataFrame(rows, "request int, engine string, result string, reason string")).collect()}
    assert (got[1]["confidence"], got[1]["gaps"]) == ("partial", "lsp:timeout")
    assert (got[2]["reason"], got[3]["reason"]) == ("engines-unavailable", "no-result")


def test_replies(spark):
    x = F.col("x")
    assert values(spark, references.reference_line(x), ["  >   7:from", "none", None]) == [7, None, None]
    assert values(spark, references.backend_error(x), ["  Exception: a", "[1]", "fine exception:"]) == [True, False, False]
    bad = spark.createDataFrame([(1, "{oops"), (2, "{}")], "reply int, json string")
    assert references.flattened(bad).count() == 0


def test_file_walk(spark, tmp_path):
    tree = {
        "src/a.py": "x = 1\ny = 2\n", "README.md": "# hi\nthere\n", "node_modules/x.js": "a\nb\n", "build/o.py": "a\nb\n", "dist/__init__.py": "a\nb\n", "pkg/dist/k.py": "a\nb\n",
        "bin.py": "a\x00b\n", "one.py": "no line end", "gen/g.py": "a\nb\n", "note.txt": "a\nb\n", "skip/s.py": "a\nb\n",
    }
    for name, text in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    ignored, globs = files.ignored_names("# c\n!x\n*.log\na/b\nskip/\n"), files.declared_globs("gen/* linguist-generated=true\n*.x text\n")
    assert (ignored, globs) == (["skip"], ["gen/*"])
    got = {r["path"] for r in files.source_files(files.list_tree(spark, str(tmp_path)), ignored, globs).collect()}
    assert got == {"src/a.py", "README.md", "dist/__init__.py", "pkg/dist/k.py"}


def test_settings():
    got = files.settings("window = 10\nextra = 1\ncosine_floor = 7.0\n", "= broken", "stride = -1\nrerank = 3\n")
    assert (got["window"], got["extra"], got["cosine_floor"], got["stride"], got["rerank"]) == (10, 1, 1.0, 10, "on")
    got = files.settings('max_chunks = "12"\nreindex = " NEVER "\nbackend = "other"\ncosine_floor = nan\nstride = inf\nmodel = ""\nchunk_strategy = "lines"\n')
    assert (got["max_chunks"], got["reindex"], got["backend"], got["cosine_floor"], got["stride"], got["model"], got["chunk_strategy"]) == (12, "never", "auto", 0.25, 10, files.DEFAULTS["model"], "lines")


def test_sinks(tmp_path):
    once, how = sinks.injected("Hello\n", "B")
    assert how == "appended" and sinks.injected(once, "B") == (once, "updated")
    assert sinks.injected(f"{sinks.END} x {sinks.START} y", "B")[1] == "repaired"
    p = tmp_path / "map.md"
    assert sinks.write_map(str(p), "real") and not sinks.write_map(str(p), sinks.STUB) and p.read_text() == "real"
    assert "</" not in sinks.graph_page({"a": "</script>"}, "__DATA__") and sinks.escaped("<&") == "&lt;&amp;"


def test_tokens_and_roles(spark):
    import hashlib

    digest = hashlib.sha256(b"key").hexdigest()
    tokens = state.token_digests(spark.createDataFrame([(f"SHA256: {digest.upper()}", "reader"), ("plain", "ghost"), ("all", "admin"), (None, "x")], "token string, role string"))
    asked = spark.createDataFrame([("key",), (f"sha256:{digest}",), (digest,), ("plain",), ("all",), ("",), (None,)], "token string")
    got = {r["token"]: r["role"] for r in state.role_of(asked, tokens).collect()}
    assert got == {"key": "reader", f"sha256:{digest}": None, digest: None, "plain": "ghost", "all": "admin", "": None, None: None}
    roles = spark.createDataFrame([("reader", ["view", None]), ("admin", ["*"]), ("broken", None)], "role string, ops array<string>")
    rules = state.rules_of(roles, tokens)
    assert {r["role"]: r["ops"] for r in rules.collect()} == {"reader": ["view", None], "broken": [], "ghost": []}
    rows = spark.createDataFrame([(r, op) for r in ("reader", "admin", "broken", "ghost", "", None) for op in ("view", "drop")], "role string, op string")
    allowed = {(r["role"], r["op"]) for r in state.op_allowed(rows, rules).collect() if r["allowed"]}
    assert allowed == {("reader", "view"), ("admin", "view"), ("admin", "drop"), ("", "view"), ("", "drop")}


def test_registry_roots_with_a_slash(spark):
    reg = spark.createDataFrame([(0, "parent", "/p", 9), (1, "child", "/p/c/", 3), (2, "top", "/", 1)], "ordinal int, name string, root_path string, nodes int")
    t = spark.createDataFrame([("/p/c",), ("/p/c/d",), ("/p/cx",), ("/q",)], "target string")
    assert {r["target"]: r["name"] for r in state.resolved(t, reg).collect()} == {"/p/c": "parent", "/p/c/d": "child", "/p/cx": "parent", "/q": "top"}


def test_refused_requests_take_no_slot(spark):
    rows = [(1, 1, 0, 10.0), (2, 1, 1_000_000, 100.0), (3, 1, 11_000_000, 1.0), (4, 2, 0, 1.0), (5, 2, 1_000_000, 1.0), (6, None, 5, 1.0)]
    got = {r["root"]: (r["most"], r["over"]) for r in state.load(spark.createDataFrame(rows, "event_id long, root long, us long, latency double"), 1.0, 1).collect()}
    assert got == {1: (1, 1), 2: (1, 0)}


def test_archived_paths(spark):
    x = F.col("x")
    assert values(spark, paths.archived(x), ["a/dist/x.js", "Vendor/x.go", "env/x.py", "src/distant/x.py", "dist.py", "a/.old/x.py"]) == [True, True, True, False, False, True]


def test_reach_has_a_bounded_plan(spark):
    e = spark.createDataFrame([(k, k + 1, "CALLS") for k in range(12)], EDGES)
    sizes = []
    for hops in (2, 10):
        found = graph.reach(e, spark.createDataFrame([(0,)], "id long"), hops)
        assert {r["id"]: r["hop"] for r in found.collect()} == {k: k for k in range(hops + 1)}
        sizes.append(found._jdf.queryExecution().analyzed().toString().count("Join"))
    assert sizes == [0, 0]


def test_ambiguous_names(spark):
    y = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 1), ("c", 7), ("c", 3)], "name string, id long")
    assert {(r["name"], r["candidates"], r["ids"]) for r in graph.ambiguous(y).collect()} == {("a", 500, "0,1,2,3,4"), ("c", 2, "3,7")}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 60)), max_size=8), st.integers(0, 50))
def test_cover_of_one_file(spans, n):
    got = sorted(chunking.covered(spans, n, 4, 2))
    assert (got == []) == (n == 0) and all(0 <= a < b <= n and b - a <= 8 for a, b in got)
    assert set(range(n)) == {k for a, b in got for k in range(a, b)} and len({a for a, _ in got}) == len(got)


def test_cover_of_one_file_and_of_a_table(spark):
    import random

    rng = random.Random(2)
    all_ = {f"f{i}": (rng.randint(0, 50), [(a, a + rng.randint(0, 25)) for a in rng.sample(range(50), rng.randint(0, 6))]) for i in range(40)}
    sizes = spark.createDataFrame([(p, n) for p, (n, _) in all_.items()], "path string, n int")
    spans = spark.createDataFrame([(p, a, b) for p, (_, d) in all_.items() for a, b in d], "path string, start int, end int")
    table = {}
    for r in chunking.cover(sizes, spans, 4, 2).collect():
        table.setdefault(r["path"], []).append((r["start"], r["end"]))
    assert {p: chunking.covered(d, n, 4, 2) for p, (n, d) in all_.items() if n} == {p: sorted(x) for p, x in table.items()}


def test_python_definitions():
    text = "import os\n\n@a\n@b(\n  1)\nclass C(D):\n    x = 1\n    @p\n    def f(self): pass\n    class E:\n        def g(self):\n            pass\nasync def h():\n    pass\ndef one(): pass\nclass Lone: y = 2\n"
    assert chunking.python_definitions(text, text.count("\n")) == [(2, 7), (7, 9), (9, 12), (12, 14), (14, 15), (15, 16)]
    assert chunking.definitions_of("def (", 1) == [] == chunking.definitions_of("x\0", 1)


def test_chunks_by_strategy(spark):
    body = "def a():\n    return 1\n\n\ndef b():\n    return 2\n"
    rows = [("p", f"{name}", body.split("\n")[:-1], True) for name in ("a.py", "b.txt", "C.PY")] + [("p", "broken.py", ["def (", "x", "y"], True), ("p", "empty.py", [], True)]
    files_ = spark.createDataFrame(rows, "project string, path string, lines array<string>, closed boolean")
    starts = lambda **how: {(r["path"], r["start"]) for r in chunking.chunks(files_, 4, 4, **how).collect()}
    assert starts() == {("a.py", 0), ("a.py", 4), ("C.PY", 0), ("C.PY", 4), ("b.txt", 0), ("b.txt", 4), ("broken.py", 0)}
    assert starts(cap=1) == {("a.py", 0), ("C.PY", 0), ("b.txt", 0), ("broken.py", 0)} and starts(strategy="lines") == starts()


@pytest.mark.parametrize("shape", ["file", "folder", "empty"])
def test_streams_of_files_folders_and_empty_tables(spark, small, tmp_path, shape):
    import shutil

    from tessera.plans.state_queries import DAY
    from tessera.sources.views import requests
    from tessera.streaming import replay

    rows = spark.read.parquet(f"{small}/events.parquet")
    if shape == "file":
        shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
        shutil.copy(f"{small}/orders.parquet", tmp_path / "orders.parquet")
    else:
        rows.where("false" if shape == "empty" else "true").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(replay.PROVIDER, None)
    got = {tuple(r) for r in replay.debounce_stream(spark, str(tmp_path), DAY).collect()}
    assert spark.conf.get(replay.PROVIDER, None) == before
    log = requests(spark, str(tmp_path))
    assert got == {tuple(r) for r in state.debounced(log, DAY).where("fired").select("event_id", "root", "us").collect()}
    want = {tuple(r) for r in log.groupBy("op").agg(F.count("*"), F.round(F.sum("latency"), 2)).collect()}
    assert {tuple(r) for r in replay.metrics_stream(spark, str(tmp_path)).collect()} == want and (shape == "empty") == (not want)


def test_index_follows_its_source(spark, small, tmp_path):
    from tessera.sources import views

    item = spark.read.parquet(f"{small}/lineitem.parquet")
    item.limit(2000).write.parquet(f"{tmp_path}/lineitem.parquet")
    one = views.edges(spark, str(tmp_path))
    assert one.exceptAll(views.built_edges(spark, str(tmp_path))).count() == 0
    item.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    two = views.edges(spark, str(tmp_path))
    assert two.count() == views.built_edges(spark, str(tmp_path)).count() > 0


def test_walk_of_links_and_odd_names(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    for p in ("a b/ü%20.py", "a b/_c/d.py", "top.py", "node_modules/x.py", "deep/1/2/3/e.py"):
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_text(f"# {p}\nx\n")
    out.mkdir()
    (out / "secret.py").write_text("y\n")
    (tree / "leak").symlink_to(out)
    (tree / "deep" / "leak").symlink_to(out)
    (tree / "deep" / "leak.py").symlink_to(out / "secret.py")
    (tree / "leak.py").symlink_to(out / "secret.py")
    (tree / "deep" / "loop").symlink_to(tree / "deep")
    listed = files.list_tree(spark, str(tree))
    want = {"a b/ü%20.py", "a b/_c/d.py", "top.py", "deep/1/2/3/e.py"}
    got = {r["path"]: bytes(r["content"]).decode() for r in files.contents(listed).collect()}
    assert set(got) == want and all(got[p] == f"# {p}\nx\n" for p in want)
    empty = tmp_path / "empty"
    empty.mkdir()
    assert files.list_tree(spark, str(empty)).count() == 0


def test_one_top_folder_is_many_tasks(spark, tmp_path):
    """All files below one folder: what a task leaves over is dealt out again, until every folder was listed."""
    want = set()
    for i in range(12):
        for j in range(4):
            p = f"src/d{i}/e{j}/deep/er/f{i}_{j}.py"
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text("x\ny\n")
            want.add(p)
    listed = files.list_tree(spark, str(tmp_path), folders=5)
    assert {r["path"] for r in listed.collect()} == want
    tasks = listed.withColumn("task", F.spark_partition_id()).groupBy("task").count().where("count > 0").count()
    assert tasks >= 4
    assert {r["path"] for r in files.list_tree(spark, str(tmp_path)).collect()} == want


def test_files_in_other_encodings_and_unreadable_ones(spark, tmp_path):
    odd = {"latin.py": "# größe\nx = 1\n".encode("latin-1"), "cut.py": "a = '日本'\n".encode()[:-4] + b"\n\n", "bom.py": b"\xef\xbb\xbfx = 1\n", "mixed.py": b"ok \xff\xfe \xe2\x82 \xc0\x80 \xed\xa0\x80 \xf4\x90\x80\x80 end\n"}
    for name, content in odd.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "gone.py").write_text("x\n")
    (tmp_path / "dir.py").mkdir()
    listed = files.list_tree(spark, str(tmp_path))
    rows = listed.unionByName(listed.where("path = 'latin.py'").selectExpr("replace(full, 'latin.py', 'dir.py') as full", "'dir.py' as path"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    (tmp_path / "gone.py").unlink()
    got = {r["path"]: r["text"] for r in files.source_files(rows).collect()}
    assert got == {name: content.decode("utf-8", "replace") for name, content in odd.items()}


@pytest.mark.parametrize("path,pattern,found", [
    ("gen/a.py", "/gen/*.py", True), ("/gen/a.py", "gen/*.py", True), ("x\\gen\\a.py", "gen/*.py", True), ("gen/b/a.py", "/gen/", True), ("gen", "gen/", False), ("gen", "gen", True),
    ("generated/a.py", "gen*", True), ("gen/a.py", "gen*", True), ("a/gen/b.py", "gen", False), ("docs/api/x.md", "docs/api", True), ("docs/apix/x.md", "docs/api", False),
])
def test_globs(spark, path, pattern, found):
    assert spark.createDataFrame([(path,)], "p string").select(paths.glob(F.col("p"), pattern)).first()[0] is found
