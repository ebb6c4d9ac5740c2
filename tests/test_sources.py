"""Rules on trees and written text at their edges: second names of files, missing values, agreement of both block forms."""

import os

from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import graph
from tessera.sources import files, sinks


def test_files_with_a_second_name_are_left_out(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside.py"
    (root / "sub").mkdir(parents=True)
    outside.write_text("secret = 1\n")
    for place in (root / "a.py", root / "sub" / "b.py"):
        place.write_text("x = 1\n")
    os.link(outside, root / "c.py")
    os.link(outside, root / "sub" / "d.py")
    assert {r["path"] for r in files.list_tree(spark, str(root)).collect()} == {"a.py", "sub/b.py"}


def test_block_forms_agree(spark):
    s, e = sinks.START, sinks.END
    contents = ["", "\n", "a", "a\n", "a\n\n", f"{s}{e}", f"x{s}y{e}z", f"{s}y", f"{e}{s}y", f"{s}{s}a{e}{e}", f"é😀{s}a{e}b{s}c{e}", f"{s}a{e}$1\\"]
    text, how = sinks.spliced(F.col("c"), "B")
    got = spark.createDataFrame([(c,) for c in contents], "c string").select("c", text.alias("text"), how.alias("how")).collect()
    assert [(r["text"], r["how"]) for r in got] == [sinks.injected(c, "B") for c in contents]
    assert spark.createDataFrame([(None,)], "c string").select(text.alias("t")).first()["t"] == sinks.injected("", "B")[0]


def test_redaction_of_nested_nulls(spark):
    rows = spark.createDataFrame([(None, ["/home/alice/x", None], {"k": None}), ({"a": "/home/alice", "n": 1}, None, None)], "s struct<a:string,n:int>, l array<string>, m map<string,string>")
    out = rows.select(*[paths.redacted_within(F.col(f.name), f.dataType, "/home/alice").alias(f.name) for f in rows.schema]).collect()
    assert (out[0]["s"], out[0]["l"], out[0]["m"]) == (None, ["~/x", None], {"k": None})
    assert (tuple(out[1]["s"]), out[1]["l"], out[1]["m"]) == (("~", 1), None, None)


def test_ambiguous_names(spark):
    rows = [("a", i) for i in range(1000)] + [("b", 1), ("c", 3), ("c", 2), (None, 1), (None, 2)]
    got = graph.ambiguous(spark.createDataFrame(rows, "name string, id long").repartition(7)).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", 1000, "0,1,2,3,4"), ("c", 2, "2,3")]
    assert graph.ambiguous(spark.createDataFrame([], "name string, id long")).count() == 0


def test_missing_projects_are_forgotten(spark):
    rows = spark.createDataFrame([("p", 1), ("q", 2), (None, 3), ("p", 4)], "project string, chunk int")
    roots = spark.createDataFrame([("p",), ("p",), (None,)], "project string")
    assert sorted(r["chunk"] for r in sinks.of_present(rows, roots).collect()) == [1, 4]
