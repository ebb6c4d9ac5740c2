"""Queries of the rules on source trees, contents and written text, with their SQL equivalents.

Documents give the rows: their ids choose folders, endings and contents that exercise every rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import chunking
from tessera.sources import files as trees
from tessera.sources import sinks
from tessera.sources.views import table

from .chunk_queries import HOME, _sql_chunks, _sql_files, files

TOPS = ("src", "build", "dist", "gen", "node_modules", "vendor", "old", "pkg.egg-info", ".git", "Lib")
MIDS = ("", "a/", "skip/", "tests/", "__pycache__/")
ENDS = (".py", ".md", ".min.js", ".json", ".ts", ".lock", "_pb2.py")
GITIGNORE = "# tools\n!keep\n*.log\na/b\nskip/\n"
GITATTRIBUTES = "gen/*.ts linguist-generated=true\n*.x text\nold/a/* linguist-vendored\n*.md linguist-generated=false\n"
GLOBS = {"ending": "*.py", "below": "gen/*", "folder": "vendor", "set": "[bd]*/a/*", "one": "src/?ests/*", "rooted": "/gen/*.py", "closed": "/old/a/", "star": "dist*"}
BLOCK = " map "


def _pick(of: tuple[str, ...], at) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in of]), at.cast("int") + 1)


def _tree(spark, d):
    """A path for each document; every 500th is a package's marker in ``build`` instead."""
    i = F.col("doc_id")
    path = F.concat(_pick(TOPS, i % 10), F.lit("/"), _pick(MIDS, F.floor(i / 10) % 5), F.lit("f"), i.cast("string"), _pick(ENDS, i % 7))
    return table(spark, d, "documents").select("doc_id", F.when(i % 500 == 1, F.lit("build/__init__.py")).otherwise(path).alias("path"))


def _odd_path() -> Column:
    """Some paths of the tree begin with slashes, some have backslashes."""
    p, i = F.col("path"), F.col("doc_id")
    return F.when(i % 3 == 0, F.concat(F.lit("//"), p)).when(i % 4 == 0, F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(p)


def _walk(spark, d):
    return trees.worth_reading(_tree(spark, d), trees.ignored_names(GITIGNORE), trees.declared_globs(GITATTRIBUTES))


def _binary(spark, d):
    i = F.col("doc_id")
    content = F.concat(F.repeat(F.lit("x"), (i * 37 % 10_000).cast("int")), F.when(i % 3 == 0, F.lit("\0")).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", paths.binary(F.encode(content, "UTF-8")).alias("binary"))


def _contained(spark, d):
    i = F.col("doc_id")
    base = F.concat(F.lit("/r/"), (i % 7).cast("string"))
    root = F.concat(base, F.when(i % 2 == 0, "/").otherwise(""))
    path = F.when(i % 5 == 0, base).when(i % 5 == 1, F.concat(base, F.lit("/x/f"))).when(i % 5 == 2, F.concat(base, F.lit("-secret/f"))).when(i % 5 == 3, F.concat(base, F.lit("/"))).otherwise("/q/f")
    return table(spark, d, "documents").select("doc_id", paths.contained(path, root).alias("inside"))


def _injected(spark, d):
    i, t = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    s, e = F.lit(sinks.START), F.lit(sinks.END)
    content = F.when(i == 0, t).when(i == 1, F.concat(t, F.lit("\n"))).when(i == 2, F.concat(F.lit("a\n"), s, F.lit("old"), e, t)).when(i == 3, F.concat(s, t))
    text, how = sinks.spliced(content.when(i == 4, F.concat(e, F.lit(" x "), s, t)).otherwise(F.concat(s, F.lit("a"), e, s, F.lit("b"), e, t)), BLOCK)
    return table(spark, d, "documents").select("doc_id", how.alias("how"), F.sha2(text, 256).alias("text_sha256"))


def _nested(spark, d):
    raw = F.concat(F.lit("/private/home/alice/"), F.col("source"), F.lit(" home-alice.pkg /home/alice"))
    body = F.struct(F.col("doc_id").alias("id"), F.array(raw, F.lit("x"), F.lit(None).cast("string")).alias("list"), F.create_map(F.lit("/home/alice"), F.array(F.struct(raw.alias("deep")))).alias("map"))
    rows = table(spark, d, "documents").select(body.alias("body"))
    out = rows.select(paths.redacted_within(F.col("body"), rows.schema["body"].dataType, HOME).alias("b"))
    return out.select(F.col("b.id").alias("doc_id"), F.concat_ws("|", "b.list").alias("list"), F.map_keys("b.map")[0].alias("key"), F.map_values("b.map")[0][0]["deep"].alias("deep"))


def _spans(spark, d):
    path = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, " ").otherwise(F.concat(F.lit(" doc"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", paths.span_label(path, F.col("n_chars") % 7 - 2, F.col("n_chars") % 5 - 1).alias("span"))


def _forgotten(spark, d):
    f = files(spark, d)
    left = sinks.of_present(chunking.chunks(f, 20, 10), f.where("project rlike '[02468]$'"))
    return left.groupBy("project").agg(F.count("*").alias("chunks"))


QUERIES = {
    "walk_paths": _walk,
    "glob_matches": lambda s, d: _tree(s, d).select("doc_id", *[paths.glob(_odd_path(), g).alias(k) for k, g in GLOBS.items()]),
    "binary_flags": _binary,
    "contained_paths": _contained,
    "block_injection": _injected,
    "redact_nested": _nested,
    "span_labels": _spans,
    "escaped_labels": lambda s, d: table(s, d, "documents").select("doc_id", paths.escaped(F.concat(F.lit("&lt; <"), "lang", F.lit("> & "), "source")).alias("label")),
    "project_forgotten": _forgotten,
}

_T = """t AS (SELECT doc_id, CASE WHEN doc_id % 500 = 1 THEN 'build/__init__.py' ELSE ['src', 'build', 'dist', 'gen', 'node_modules', 'vendor', 'old', 'pkg.egg-info', '.git', 'Lib'][doc_id % 10 + 1] || '/'
  || ['', 'a/', 'skip/', 'tests/', '__pycache__/'][(doc_id // 10) % 5 + 1] || 'f' || doc_id || ['.py', '.md', '.min.js', '.json', '.ts', '.lock', '_pb2.py'][doc_id % 7 + 1] END AS path FROM documents)"""
_START, _END = "'<!-- code-map:start -->'", "'<!-- code-map:end -->'"
_FULL = f"{_START} || ' map ' || {_END}"
ORACLES = {
    "walk_paths": f"""WITH {_T} SELECT doc_id, path FROM t WHERE regexp_matches(path, '\\.(py|md|ts)$') AND NOT regexp_matches(path, '_pb2\\.py$') AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|__pycache__|skip|[^/]*\\.egg-info)/')
      AND NOT path GLOB 'gen/*.ts' AND NOT path GLOB 'old/a/*' AND (NOT regexp_matches(path, '^(build|dist|vendor)/') OR split_part(path, '/', 1) IN (SELECT split_part(path, '/', 1) FROM t WHERE path GLOB '*/__init__.py'))""",
    "glob_matches": f"WITH {_T} SELECT doc_id, " + ", ".join(
        f"path GLOB '{g}' OR path GLOB '*/{g}'" + ("" if g.endswith("*") else f" OR path = '{g}' OR starts_with(path, '{g.rstrip('/')}/')") + f' AS "{k}"'
        for k, g in {"ending": "*.py", "below": "gen/*", "folder": "vendor", "set": "[bd]*/a/*", "one": "src/?ests/*", "rooted": "gen/*.py", "closed": "old/a/", "star": "dist*"}.items()
    ) + " FROM t",
    "binary_flags": "SELECT doc_id, contains(left(repeat('x', doc_id * 37 % 10000) || CASE WHEN doc_id % 3 = 0 THEN chr(0) ELSE '' END || coalesce(text, ''), 8192), chr(0)) AS \"binary\" FROM documents",
    "contained_paths": """WITH x AS (SELECT doc_id, '/r/' || doc_id % 7 AS base FROM documents), p AS (SELECT doc_id, base AS root, CASE doc_id % 5 WHEN 0 THEN base WHEN 1 THEN base || '/x/f' WHEN 2 THEN base || '-secret/f' WHEN 3 THEN base || '/' ELSE '/q/f' END AS path FROM x)
      SELECT doc_id, starts_with(rtrim(path, '/') || '/', root || '/') AS inside FROM p""",
    "block_injection": f"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN t WHEN 1 THEN t || chr(10) WHEN 2 THEN 'a' || chr(10) || {_START} || 'old' || {_END} || t WHEN 3 THEN {_START} || t WHEN 4 THEN {_END} || ' x ' || {_START} || t
        ELSE {_START} || 'a' || {_END} || {_START} || 'b' || {_END} || t END AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
      s AS (SELECT doc_id, c, strpos(c, {_START}) AS a, strpos(c, {_END}) AS e FROM c), x AS (SELECT doc_id, CASE WHEN a = 0 OR e = 0 THEN 'appended' WHEN e > a THEN 'updated' ELSE 'repaired' END AS how, c, a, e FROM s)
      SELECT doc_id, how, sha256(CASE how WHEN 'appended' THEN CASE WHEN ends_with(c, chr(10)) THEN left(c, length(c) - 1) ELSE c END || chr(10) || chr(10) || {_FULL} WHEN 'repaired' THEN left(c, a - 1) || {_FULL}
        ELSE left(c, a - 1) || {_FULL} || substr(c, e + length({_END})) END) AS text_sha256 FROM x""",
    "redact_nested": "SELECT doc_id, '~/' || source || ' <home>.pkg ~|x' AS list, '/home/alice' AS key, '~/' || source || ' <home>.pkg ~' AS deep FROM documents",
    "span_labels": """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN '?' ELSE 'doc' || doc_id END || CASE WHEN n_chars % 7 < 2 THEN '' ELSE ':' || (n_chars % 7 - 1) || CASE WHEN n_chars % 5 < 1 THEN '' ELSE '-' || (n_chars % 5) END END AS span
      FROM documents""",
    "escaped_labels": "SELECT doc_id, '&amp;lt; &lt;' || lang || '> &amp; ' || source AS label FROM documents",
    "project_forgotten": f"WITH {_sql_files()}, {_sql_chunks()} SELECT project, count(*) AS chunks FROM c WHERE regexp_matches(project, '[02468]$') GROUP BY project",
}
