"""Chunk, catalogue, path and text queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import chunking
from tessera.sources.views import table, text_lines

THE = r"(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])"
HOME = "/home/alice"


def files(spark: SparkSession, d: str, text: str = "text", where: str = "true") -> DataFrame:
    """Documents as files: project, path, text, lines, closed, n."""
    docs = table(spark, d, "documents").where(where).select(F.col("source").alias("project"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.expr(text).alias("text"), "doc_id")
    return text_lines(docs).withColumn("closed", F.col("text").endswith("\n")).withColumn("n", F.size("lines"))


def _cover(spark, d):
    f = files(spark, d).select("path", "n")
    k = F.explode(F.sequence(F.lit(0), F.lit(12)))
    spans = f.select("path", k.alias("k")).select("path", (3 + 9 * F.col("k")).alias("start"), (5 + 9 * F.col("k") + (F.col("k") * 5) % 13).alias("end"))
    return chunking.cover(f, spans, window=4, stride=2)


def _chunks(spark, d, text="text", where="true", window=20, stride=10, cap=chunking.CAP):
    return chunking.chunks(files(spark, d, text, where), window, stride, cap)


STORED, PRODUCED, LIVE, NEW_TEXT = "doc_id % 13 <> 0", "doc_id % 17 <> 0", "doc_id % 17 <> 0", "if(doc_id % 10 = 0, substring(text, 1, cast(length(text) div 2 as int)), text)"


def _catalogues(spark, d):
    old, new = _chunks(spark, d, where=STORED), _chunks(spark, d, NEW_TEXT, PRODUCED)
    return old, new, files(spark, d, where=LIVE).select("path")


def page_paths(spark, d):
    """Paths of pages with endings that exercise the rules."""
    ends = F.array(*[F.lit(x) for x in ENDS])
    base = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.concat(base, F.element_at(ends, (F.col("page_id") % len(ENDS)).cast("int") + 1)).alias("path"))


ENDS = ("/core.py", "/README.md", "/docs/guide.py", "/app.min.js", "/node_modules/x.ts", "/tests/test_a.py", "/.old/x.go", "/data.JSON", "/bazel-out/gen.cc", "/Main.java", "/x_pb2.py", "", "/vendor/lib.py", "/Dist/app.js", "/old/x.py", "/env/a.rb")


def _flags(spark, d):
    p, none = F.col("path"), F.lit("")
    return page_paths(spark, d).select(
        "page_id", paths.generated_path(p).alias("generated"), paths.prose(p).alias("prose"), paths.code(p).alias("code"), paths.archived(p).alias("archived"), paths.test_like(p, none).alias("test"),
        paths.noise(p, none).alias("noise"), paths.family(p).alias("family"), paths.non_code(p).alias("non_code"), paths.extension(p).alias("ext"),
    )


def _generated(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (~F.contains(F.substring(t, 1, paths.SAMPLE), F.lit("\n"))).alias("one_line"), paths.generated_text(t).alias("generated_text"), paths.generated_file(t).alias("generated_file"))


def _snippets(spark, d):
    head = F.rtrim(F.array_join(F.slice("lines", 1, 5), "\n"))
    return files(spark, d).select("path", head.alias("snippet"), paths.first_meaningful(F.slice("lines", 1, 5)).alias("shown"))


def _redact(spark, d):
    raw = F.concat(F.lit("/private/home/alice"), F.col("path"), F.lit(" home-alice.pkg.fn /home/alice/x"))
    return page_paths(spark, d).select("page_id", paths.redacted(raw, HOME).alias("redacted"), paths.leaks(raw).alias("leaked"), paths.leaks(paths.redacted(raw, HOME)).alias("leaks"))


def _loc(spark, d):
    line = (F.col("n_chars") % 7 - 2).cast("int")
    return table(spark, d, "documents").select("doc_id", paths.line_label(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), line).alias("loc"))


def _names(spark, d):
    slug = F.when(F.col("page_id") % 3 == 0, "home-alice-repo.").when(F.col("page_id") % 3 == 1, "src.src.").otherwise("a-b.")
    raw = F.concat(slug, F.lit("pkg.pkg.v."), F.col("page_id").cast("string"), F.lit("."), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".py").otherwise(".run"))
    return table(spark, d, "pages").select("page_id", paths.without_project(raw).alias("name"), paths.without_repeats(raw).alias("collapsed"))


def _python_files(spark, d):
    """Suppliers as Python files: an import, some functions of various lengths and a class with a member; every tenth doesn't parse."""
    k, body = F.col("s_suppkey"), lambda j: F.repeat(F.lit("    y = 1\n"), ((F.col("s_suppkey") + j) % 30 + 1).cast("int"))
    functions = F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda j: F.concat(F.lit("def f"), j.cast("string"), F.lit("():\n"), body(j), F.lit("\n"))), "")
    text = F.concat(F.when(k % 10 == 0, "def (\n").otherwise("import os\n"), F.lit("\n"), functions, F.lit("@wrap\nclass C:\n    z = 1\n\n    def g(self):\n        return 2\n"))
    docs = table(spark, d, "supplier").select(F.lit("p").alias("project"), F.concat(F.lit("s"), k.cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".py")).alias("path"), text.alias("text"))
    return text_lines(docs).withColumn("closed", F.lit(True)).withColumn("n", F.size("lines"))


def _python_spans(spark, d):
    return chunking.python_spans(_python_files(spark, d))


def _syntax_chunks(spark, d):
    return chunking.chunks(_python_files(spark, d), 4, 2, 40).select("path", "start", F.length("content").alias("chars"), "content_hash")


def _brace_files(spark, d):
    """Suppliers as files of five languages: an import, some functions with quoted braces, a class with a member; every tenth has a brace too many."""
    k = F.col("s_suppkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("function f", "func f", "fn f", "void f", "int f")]), (k % 5 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".go", ".rs", ".java", ".cpp")]), (k % 5 + 1).cast("int"))
    body = lambda j: F.repeat(F.lit('    y("}{"); // }\n'), ((k + j) % 6 + 1).cast("int"))
    functions = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda j: F.concat(word, j.cast("string"), F.lit("(a) {\n"), body(j), F.lit("}\n"))), "")
    text = F.concat(F.lit("import x;\n"), functions, F.when(k % 5 == 0, "class C {\n  m() {\n    return '}';\n  }\n}\n").otherwise(""), F.when(k % 10 == 3, "{\n").otherwise(""))
    docs = table(spark, d, "supplier").select(F.lit("p").alias("project"), F.concat(F.lit("s"), k.cast("string"), end).alias("path"), text.alias("text"))
    return text_lines(docs).withColumn("closed", F.lit(True)).withColumn("n", F.size("lines"))


QUERIES = {
    "brace_spans": lambda s, d: chunking.definition_spans(_brace_files(s, d)),
    "line_windows": lambda s, d: chunking.windows(files(s, d).select("path", "lines"), 10, 10).select("path", "start", "end"),
    "cover_running_max": _cover,
    "chunk_substance_cap": lambda s, d: _chunks(s, d, window=4, stride=2, cap=5).select("path", "start", F.length("content").alias("chars")),
    "chunk_hash": lambda s, d: _chunks(s, d).select("chunk_id", "content_hash"),
    "chunk_ceiling": lambda s, d: chunking.ceiling(_chunks(s, d), 500),
    "index_diff_status": lambda s, d: chunking.difference(*_catalogues(s, d)),
    "orphan_chunks": lambda s, d: chunking.orphans(*_catalogues(s, d)).select("chunk_id", "path"),
    "deleted_files": lambda s, d: chunking.deleted_files(_catalogues(s, d)[0], _catalogues(s, d)[2]),
    "catalogue_upsert": lambda s, d: chunking.upsert(*[c.select("chunk_id", "path", "content_hash") for c in _catalogues(s, d)[:2]]),
    "project_reset_semi": lambda s, d: table(s, d, "embeddings").join(table(s, d, "documents").where("source = 'src3'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label"),
    "next_chunk_start": lambda s, d: chunking.next_start(_chunks(s, d)).select("path", "start", "next"),
    "pattern_lines": lambda s, d: chunking.matching_lines(files(s, d), THE),
    "generated_text_flags": _generated,
    "path_flags": _flags,
    "prose_partition": lambda s, d: page_paths(s, d).groupBy(F.when(paths.prose(F.col("path")), "prose").otherwise("code").alias("corpus")).agg(F.count("*").alias("n")),
    "snippet_lines": _snippets,
    "redact_text": _redact,
    "loc_render": _loc,
    "qualified_names": _names,
    "python_spans": _python_spans,
    "syntax_chunks": _syntax_chunks,
}

_LINES = "CASE WHEN {t} = '' THEN [] WHEN {t} LIKE '%' || chr(10) THEN string_split({t}, chr(10))[:-2] ELSE string_split({t}, chr(10)) END"


def _sql_files(text: str = "text", where: str = "true", name: str = "f") -> str:
    lines = _LINES.format(t="t")
    return f"""{name} AS (SELECT project, path, t, lines, len(lines) AS n, t LIKE '%' || chr(10) AS closed, doc_id FROM (SELECT *, {lines} AS lines FROM (
      SELECT source AS project, 'doc' || doc_id AS path, doc_id, regexp_replace({text}, '\\r\\n|\\r', chr(10), 'g') AS t FROM documents WHERE {where})))"""


def _sql_chunks(files: str = "f", name: str = "c", window: int = 20, stride: int = 10, cap: int = chunking.CAP) -> str:
    return f"""{name} AS (SELECT project, path, start, content, substr(sha256(project), 1, 12) || ':' || path || ':' || start AS chunk_id, substr(sha256(content), 1, 16) AS content_hash FROM (
      SELECT project, path, CAST(s AS INTEGER) AS start, substr(array_to_string(lines[s + 1:least(s + {window}, n)], chr(10)) || CASE WHEN least(s + {window}, n) < n OR closed THEN chr(10) ELSE '' END, 1, {chunking.CHARS}) AS content
      FROM (SELECT *, unnest(range(0, n, {stride})) AS s FROM {files}) WHERE s < {cap * stride}) WHERE regexp_matches(content, '\\p{{L}}'))"""


_CATALOGUES = (
    f"WITH {_sql_files(where=STORED, name='fo')}, {_sql_files('CASE WHEN doc_id % 10 = 0 THEN substr(text, 1, CAST(length(text) // 2 AS BIGINT)) ELSE text END', PRODUCED, 'fn')}, {_sql_chunks('fo', 'old')}, {_sql_chunks('fn', 'new')}, "
    f"live AS (SELECT 'doc' || doc_id AS path FROM documents WHERE {LIVE})"
)
# Fixed values, written here anew so that a wrong one in the engine shows: a generator's banner, and names of generated files.
_BANNER = (
    r"(?i)(@generated\b|\bcode generated by\b|\bgenerated by\b.{0,40}\bdo not edit\b|\bautogenerated\b|\bauto-generated\b|\bdo not edit\b.{0,40}\bgenerated\b"
    r"|\bthis file (was|is) automatically generated\b)"
)
_GENERATED_NAME = (
    r"^(.*\.min\.(js|css|mjs|cjs)|.*[.\-_]bundle\.(js|css|mjs|cjs)|.*\.pb\.(go|cc|h|py)|.*_pb2(_grpc)?\.pyi?|.*_pb\.(js|ts)|.*\.generated\.[a-z0-9]+|.*\.g\.(dart|cs|kt)"
    r"|.*\.designer\.cs|.*\.d\.ts|.*\.(map|lock)|(package-lock|yarn|pnpm-lock|composer|poetry|cargo|gemfile)\.(json|lock|yaml))$"
)
_TOP = "array_to_string(string_split(substr(text, 1, 8192), chr(10))[1:40], chr(10))"
_GENERATED_TEXT = (
    f"(regexp_matches({_TOP}, '{_BANNER}') OR list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 "
    f"OR (length(text) > 50000 AND length(text) / len(string_split(text, chr(10))) > 200))"
)
_PATHS = f"p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') || ({list(ENDS)!r})[page_id % {len(ENDS)} + 1] AS path FROM pages)"
# Fixed values, written here a second time, so that a slip in the operators' lists shows.
_GENERATED_DIRS = """('node_modules', 'bower_components', 'jspm_packages', 'site-packages', 'pods', 'venv', '.venv', '__pycache__', '.next', '.nuxt', '.svelte-kit', '.turbo', '.parcel-cache', '.gradle', '.terraform', '.angular',
  '.docusaurus', '.vercel', '.serverless', '.webpack', '.output', '_build', 'deriveddata', 'htmlcov', '.nyc_output', '_generated', '__generated__', '.archive', '.archived', '_archive', '_archived', '.backup', '.backups', '.bak',
  '.old', '.deprecated', '.trash')"""
_ARCHIVE_DIRS = """('.archive', '.archived', '.backup', '.backups', '.bak', '.old', '.deprecated', '.trash', '.next', '.nuxt', '.svelte-kit', '.turbo', '.parcel-cache', '.gradle', '.terraform',
  'node_modules', '__pycache__', 'dist', 'build', 'out', 'target', 'vendor', 'vendored', 'third_party', 'thirdparty', 'venv', 'env', 'site-packages', 'coverage', 'generated')"""
_CODE_EXTS = "('.py', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.go', '.rs', '.java', '.c', '.h', '.cpp', '.cc', '.cxx', '.hpp', '.hh')"
_NON_CODE_EXTS = """('.json', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf', '.properties', '.md', '.mdx', '.rst', '.txt', '.csv', '.tsv', '.lock', '.log', '.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico', '.pdf', '.html', '.htm',
  '.css', '.scss', '.sass', '.less')"""
_PROSE_EXTS = "('.md', '.mdx', '.markdown', '.rst', '.txt', '.adoc', '.org')"
_PROSE_PARTS = "['/docs/', '/doc/', '/snapshots/', '/__snapshots__/', '/.archive/', '/adr/', '/rfc/', '/changelog/']"
_FAMILY = """CASE WHEN ext IN ('.py', '.pyi', '.pyx') THEN 'python' WHEN ext IN ('.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs') THEN 'ts-js' WHEN ext = '.go' THEN 'go' WHEN ext = '.rs' THEN 'rust' WHEN ext = '.rb' THEN 'ruby'
  WHEN ext = '.php' THEN 'php' WHEN ext IN ('.java', '.kt', '.scala') THEN 'jvm' WHEN ext IN ('.c', '.h', '.cc', '.cpp', '.hpp') THEN 'c-cpp' WHEN ext = '.cs' THEN 'dotnet' WHEN ext = '.swift' THEN 'swift' WHEN ext IN ('.sh', '.bash') THEN 'shell' ELSE '' END"""
_PARTED = f"""{_PATHS}, s AS (SELECT page_id, path, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS seg FROM p),
  b AS (SELECT *, coalesce(seg[-1], '') AS base, seg[:-2] AS dirs FROM s), x AS (SELECT *, regexp_extract(base, '[^.].*?(\\.[^.]*)$', 1) AS ext FROM b),
  g AS (SELECT *, len(list_filter(dirs, lambda q: q IN {_GENERATED_DIRS} OR starts_with(q, 'bazel-') OR starts_with(q, 'cmake-build-'))) > 0 OR regexp_matches(base, '{_GENERATED_NAME}') AS generated,
    ext IN {_PROSE_EXTS} OR len(list_filter({_PROSE_PARTS}, lambda q: contains('/' || ltrim(lower(path), '/'), q))) > 0 AS prose FROM x)"""
_RAW = "'/private/home/alice' || path || ' home-alice.pkg.fn /home/alice/x'"
_RED = f"replace(replace(replace({_RAW}, '/private/home/alice', '~'), '/home/alice', '~'), 'home-alice', '<home>')"
_QN = "CASE page_id % 3 WHEN 0 THEN 'home-alice-repo.' WHEN 1 THEN 'src.src.' ELSE 'a-b.' END || 'pkg.pkg.v.' || page_id || '.' || page_id || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '.run' END"

_PY = """y AS (SELECT s_suppkey AS k, 's' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '.txt' ELSE '.py' END AS path, CASE WHEN s_suppkey % 10 = 0 THEN 'def (' ELSE 'import os' END AS head FROM supplier),
  j AS (SELECT k, path, unnest(range(0, k % 5 + 1)) AS j FROM y), l AS (SELECT k, path, j, (k + j) % 30 + 2 AS own, 2 + coalesce(sum((k + j) % 30 + 3) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM j),
  c AS (SELECT k, path, max(s + own + 1) AS s FROM l GROUP BY k, path), sp AS (SELECT k, path, s, s + own AS e FROM l UNION ALL SELECT k, path, s, s + 4 FROM c UNION ALL SELECT k, path, s + 4, s + 6 FROM c)"""

ORACLES = {
    "brace_spans": """WITH f AS (SELECT s_suppkey AS k, 's' || s_suppkey || ['.ts', '.go', '.rs', '.java', '.cpp'][s_suppkey % 5 + 1] AS path FROM supplier WHERE s_suppkey % 10 <> 3),
      j AS (SELECT k, path, unnest(range(0, k % 4 + 1)) AS j FROM f), l AS (SELECT *, (k + j) % 6 + 3 AS n FROM j), s AS (SELECT *, 1 + sum(n) OVER (PARTITION BY k ORDER BY j) - n AS start FROM l),
      t AS (SELECT k, path, max(start + n) AS start FROM s WHERE k % 5 = 0 GROUP BY k, path), a AS (SELECT path, start, start + n AS stop FROM s UNION ALL SELECT path, start, start + 1 FROM t UNION ALL SELECT path, start + 1, start + 4 FROM t)
      SELECT path, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM a""",
    "python_spans": f"""WITH {_PY} SELECT path, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM sp WHERE k % 10 <> 0""",
    "syntax_chunks": f"""WITH {_PY}, t AS (SELECT y.path, y.k, head || chr(10) || chr(10) || string_agg('def f' || j || '():' || chr(10) || repeat('    y = 1' || chr(10), CAST(own - 1 AS BIGINT)) || chr(10), '' ORDER BY j)
        || '@wrap' || chr(10) || 'class C:' || chr(10) || '    z = 1' || chr(10) || chr(10) || '    def g(self):' || chr(10) || '        return 2' || chr(10) AS t FROM y JOIN l ON l.k = y.k GROUP BY y.path, y.k, head),
      f AS (SELECT path, k, string_split(t, chr(10))[:-2] AS lines, len(string_split(t, chr(10))) - 1 AS n FROM t),
      a AS (SELECT f.path, n, s, e FROM f JOIN sp ON sp.k = f.k WHERE f.k % 10 <> 0 AND f.path LIKE '%.py' UNION ALL SELECT path, n, n, n FROM f),
      m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a),
      o AS (SELECT path, unnest(range(CAST(cur AS BIGINT), CAST(s AS BIGINT), 2)) AS st, s AS lim, 4 AS w FROM m UNION ALL SELECT path, s, e, e - s FROM m WHERE s < e AND e - s <= 8
        UNION ALL SELECT path, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT), 2)), e, 4 FROM m WHERE s < e AND e - s > 8),
      r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY st) AS i FROM o),
      x AS (SELECT r.path, st, array_to_string(lines[CAST(st AS BIGINT) + 1:CAST(least(st + w, lim) AS BIGINT)], chr(10)) || chr(10) AS content FROM r JOIN f ON f.path = r.path WHERE i <= 40)
      SELECT path, CAST(st AS INTEGER) AS start, CAST(length(content) AS INTEGER) AS chars, substr(sha256(content), 1, 16) AS content_hash FROM x WHERE regexp_matches(content, '\\p{{L}}')""",
    "line_windows": f"WITH {_sql_files()} SELECT path, CAST(s AS INTEGER) AS start, CAST(least(s + 10, n) AS INTEGER) AS \"end\" FROM (SELECT path, n, unnest(range(0, n, 10)) AS s FROM f)",
    "cover_running_max": f"""WITH {_sql_files()}, sp AS (SELECT path, n, 3 + 9 * k AS s, least(5 + 9 * k + (k * 5) % 13, n) AS e FROM (SELECT path, n, unnest(range(0, 13)) AS k FROM f)),
      a AS (SELECT * FROM sp WHERE s < e UNION ALL SELECT path, n, n, n FROM f),
      c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a),
      m AS (SELECT *, greatest(s, cur) AS fr FROM c),
      o AS (SELECT path, unnest(range(cur, least(fr, n), 2)) AS st, least(fr, n) AS lim, 4 AS w FROM m WHERE fr < e OR s = n
        UNION ALL SELECT path, fr, e, e - fr FROM m WHERE fr < e AND e - fr <= 8
        UNION ALL SELECT path, unnest(range(fr, e, 2)), e, 4 FROM m WHERE fr < e AND e - fr > 8)
      SELECT path, CAST(st AS INTEGER) AS start, CAST(least(st + w, lim) AS INTEGER) AS "end" FROM o""",
    "chunk_substance_cap": f"WITH {_sql_files()}, {_sql_chunks(window=4, stride=2, cap=5)} SELECT path, start, CAST(length(content) AS INTEGER) AS chars FROM c",
    "chunk_hash": f"WITH {_sql_files()}, {_sql_chunks()} SELECT chunk_id, content_hash FROM c",
    "chunk_ceiling": f"""WITH {_sql_files()}, {_sql_chunks()}, k AS (SELECT path, start FROM c ORDER BY path, start LIMIT 500)
      SELECT path, start, count(*) OVER (PARTITION BY path) = (SELECT count(*) FROM c WHERE c.path = k.path) AS complete FROM k""",
    "index_diff_status": f"""{_CATALOGUES} SELECT coalesce(new.chunk_id, old.chunk_id) AS chunk_id, coalesce(new.path, old.path) AS path, CASE WHEN old.chunk_id IS NULL THEN 'new' WHEN new.chunk_id IS NOT NULL
      THEN CASE WHEN old.content_hash = new.content_hash THEN 'unchanged' ELSE 'changed' END WHEN old.path IN (SELECT path FROM live) THEN 'orphan' ELSE 'deleted' END AS status FROM old FULL JOIN new ON old.chunk_id = new.chunk_id""",
    "orphan_chunks": f"{_CATALOGUES} SELECT chunk_id, path FROM old WHERE path IN (SELECT path FROM live) AND NOT EXISTS (SELECT 1 FROM new WHERE new.chunk_id = old.chunk_id)",
    "deleted_files": f"{_CATALOGUES} SELECT DISTINCT path FROM old WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.path = old.path)",
    "catalogue_upsert": f"{_CATALOGUES} SELECT chunk_id, path, content_hash FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT chunk_id, path, content_hash FROM new",
    "project_reset_semi": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3')",
    "next_chunk_start": f"WITH {_sql_files()}, {_sql_chunks()} SELECT path, start, lead(start) OVER (PARTITION BY path ORDER BY start) AS next FROM c",
    "pattern_lines": f"""WITH {_sql_files()}, l AS (SELECT path, unnest(lines) AS line, unnest(range(1, n + 1)) AS i FROM f)
      SELECT path, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines FROM l WHERE regexp_matches(line, '{THE}') GROUP BY path""",
    "generated_text_flags": f"SELECT doc_id, NOT contains(substr(text, 1, 8192), chr(10)) AS one_line, {_GENERATED_TEXT} AS generated_text, NOT contains(substr(text, 1, 8192), chr(10)) OR {_GENERATED_TEXT} AS generated_file FROM documents",
    "path_flags": f"""WITH {_PARTED}, h AS (SELECT *, ext IN {_CODE_EXTS} AND NOT prose AND NOT generated AS code, generated OR len(list_filter(dirs, lambda q: q IN {_ARCHIVE_DIRS})) > 0 AS archived,
      regexp_matches(path, '(^|/)tests?/') OR regexp_matches(base, '^test_|_test\\.py$|^conftest\\.py$') AS test FROM g)
      SELECT page_id, generated, path <> '' AND prose AS prose, code, archived, test, path = '' OR starts_with(path, '<') OR test OR archived AS noise, {_FAMILY} AS family, ext IN {_NON_CODE_EXTS} AS non_code, ext FROM h""",
    "prose_partition": f"WITH {_PARTED} SELECT CASE WHEN path <> '' AND prose THEN 'prose' ELSE 'code' END AS corpus, count(*) AS n FROM g GROUP BY 1",
    "snippet_lines": f"""WITH {_sql_files()}, k AS (SELECT path, lines[1:5] AS head FROM f)
      SELECT path, rtrim(array_to_string(head, chr(10)), ' ') AS snippet, coalesce(list_filter(list_transform(head, lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[1], head[1], '') AS shown FROM k""",
    "redact_text": f"WITH {_PATHS} SELECT page_id, {_RED} AS redacted, regexp_matches({_RAW}, '/(Users|home)/[^/\\s]+/') AS leaked, regexp_matches({_RED}, '/(Users|home)/[^/\\s]+/') AS leaks FROM p",
    "loc_render": "SELECT doc_id, 'doc' || doc_id || CASE WHEN n_chars % 7 - 2 >= 0 THEN ':' || (n_chars % 7 - 1) ELSE '' END AS loc FROM documents",
    "qualified_names": f"""WITH q AS (SELECT page_id, {_QN} AS raw FROM pages), h AS (SELECT *, string_split(raw, '.') AS seg FROM q)
      SELECT page_id, CASE WHEN contains(seg[1], '-') AND seg[-1] <> 'py' THEN array_to_string(seg[2:], '.') ELSE raw END AS name,
      CASE page_id % 3 WHEN 0 THEN 'home-alice-repo.' WHEN 1 THEN 'src.' ELSE 'a-b.' END || 'pkg.v.' || page_id || '.' || page_id || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '.run' END AS collapsed FROM h""",
}
