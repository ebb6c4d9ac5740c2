"""Whole operations put together from the operators, each with its SQL equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import chunking, gateway, graph, search, state
from tessera.sources import catalogue
from tessera.sources.views import edges, requests, symbols, table, vectors
from tessera.storage import cut, shared_folder
from tessera.streaming import index_stream, replay

from .chunk_queries import _CATALOGUES, LIVE, NEW_TEXT, PRODUCED, STORED, THE, _catalogues, _sql_files, files
from .chunk_queries import ORACLES as _CHUNKS
from .graph_queries import ALL, NOISE, D
from .state_queries import _Q

TEXT = "die erst Wort"


def _requests(spark, d):
    """Events as requests, with engines, roles and roots that policy treats differently."""
    k, u = F.col("event_id"), F.col("root")
    op = F.element_at(F.array(*[F.lit(x) for x in ("callers", "overview", "search", "context")]), (k % 4 + 1).cast("int"))
    engine = F.element_at(F.array(*[F.lit(x) for x in ("auto", "auto", "auto", "graph", "all", "none", "semantic")]), (k % 7 + 1).cast("int"))
    root = F.when(u % 11 == 0, " ").otherwise(F.concat(F.lit("/r"), (u % 5).cast("string"), F.when(k % 2 == 0, "/sub").otherwise("")))
    role = F.when(u % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("role"), (u % 4).cast("string")))
    return requests(spark, d).select(k.alias("request"), op.alias("op"), engine.alias("engine"), role.alias("role"), root.alias("root"))


def _answers(spark, d):
    """What each engine says to each request; some are silent, some have no row."""
    k, e = F.col("request"), F.col("engine")
    rows = requests(spark, d).select(F.col("event_id").alias("request"), F.explode(F.array(*[F.lit(x) for x in state.ENGINES])).alias("engine"))
    place = F.when(e == "graph", 3).when(e == "lsp", 4).otherwise(5)
    rows = rows.where((k + place) % 6 != 0).withColumn("said", (k % place != 0))
    reason = F.element_at(F.array(F.lit("project-not-indexed"), F.lit("no-result"), F.lit("timeout")), (k % 3 + 1).cast("int"))
    return rows.select("request", "engine", F.when(F.col("said"), F.concat(e, F.lit(" /home/alice/x"), k.cast("string"))).alias("result"), F.when(~F.col("said"), reason).alias("reason"))


def _policy(spark):
    tokens = spark.createDataFrame([("x", "role3")], "digest string, role string")
    roles = spark.createDataFrame([("role0", ["*"]), ("role1", ["callers", None, "context"]), ("role2", ["overview", "search", "context"])], "role string, ops array<string>")
    roots = spark.createDataFrame([("role0", "*"), ("role1", "/r1/"), ("role1", "/r0"), ("role2", "/r2"), ("role2", "")], "role string, allowed_root string")
    return state.rules_of(roles, tokens), roots


def _gateway(spark, d):
    return gateway.answered(_requests(spark, d), _answers(spark, d), *_policy(spark), home="/home/alice")


def _definitions(spark, d):
    """Six-line definitions every ten lines, with one of three lines inside each."""
    f = files(spark, d).select("path", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k"))
    outer = f.select("path", F.concat(F.lit("f"), F.col("k").cast("string")).alias("name"), (10 * F.col("k")).alias("start"), (10 * F.col("k") + 6).alias("end"))
    return outer.unionByName(f.select("path", F.concat(F.lit("g"), F.col("k").cast("string")).alias("name"), (10 * F.col("k") + 2).alias("start"), (10 * F.col("k") + 5).alias("end")))


def _changed(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    reached = graph.reach(e, y.where("id % 200 = 0").select("id"), 2, back=True)
    path = F.concat("file", F.when(F.col("id") % 3 == 0, ".md").otherwise(".py"))
    impacted = y.join(reached, "id").select(F.when(F.col("id") % 7 == 0, path).otherwise(F.concat_ws(".", "file", "name")).alias("label"), F.when(F.col("id") % 5 != 0, path).alias("path"))
    changed = y.where("id % 200 = 0").select(path.alias("path"))
    return graph.changed(changed, impacted, "path like '%.py'", 10)


def _deadcode(spark, d, verified):
    y = symbols(spark, d).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 50).cast("string")))
    words = table(spark, d, "events").select(F.concat(F.lit("n"), (F.col("event_id") % 40).cast("string")).alias("name")).where("length(name) = 3").groupBy("name").agg(F.count("*").alias("used"))
    return graph.deadcode(y, edges(spark, d), NOISE, "id % 10 = 0", words if verified else None)


def _search(spark, d, rerank, how=search.answer, floor=0.05):
    """One vector a document, at one of its first lines; in a tenth of the even documents English stands for code, all others are prose."""
    project = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("project")
    start = (F.col("vec_id") % 3).cast("int")
    path = F.concat(F.lit("doc"), F.col("vec_id").cast("string")).alias("path")
    stored = vectors(spark, d).select(project, path, start.alias("start"), F.when(F.col("vec_id") % 5 != 0, start + 4).alias("next"), "vec_id", "embedding", "norm")
    texts = table(spark, d, "documents").withColumnRenamed("doc_id", "vec_id").select(project, path, "text")
    query = list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])
    return how(stored, texts, query, TEXT, "even", "vec_id % 10 <> 0", floor=floor, rerank=rerank)


def _nodes(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    return graph.payload_nodes(y.where("id % 9 <> 0"), e, graph.payload(y, e, 50, "false"))


def _labels(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    rows = graph.callers(y, e, "red widget").select(graph.label_line(F.when(F.col("src") % 3 == 0, F.col("from_file")).otherwise(F.col("from_name")), F.col("from_file"), F.col("type")).alias("line"), "src", "dst")
    return graph.capped(rows, ["line", "src", "dst"], 12)


def _keys(spark, d):
    """Pages as files; requests name them by relative, absolute and unknown targets."""
    p = table(spark, d, "pages").select((F.col("page_id") % 4).alias("r"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))
    stored = p.select(F.concat(F.lit("/r"), F.col("r").cast("string")).alias("root"), "path", "content")
    k = F.col("event_id")
    root = F.concat(F.lit("/r"), (k % 4).cast("string"))
    name = F.concat(F.lit("p"), (k % 300).cast("string"))
    target = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(root, F.lit("/"), name)).otherwise(F.concat(F.lit("./"), name))
    asked = table(spark, d, "events").select(k.alias("request"), F.lit("overview").alias("op"), target.alias("target"), F.lit("lsp").alias("engine"), root.alias("root"))
    return gateway.cache_key(asked, stored)


def _index_pass(spark, d):
    old, new, live = _catalogues(spark, d)
    return chunking.index_pass(old, new, live, 60)


def _committed(spark, d):
    """The catalogue as readers find it after two commits: what was stored, and what a pass over the live files changed."""
    old, new, live = _catalogues(spark, d)
    columns = ["project", "path", "chunk_id", "content_hash"]
    old, new = cut(old.select(*columns)), cut(new.select(*columns, "start"))  # texts are cut up and hashed once
    store = catalogue.Catalogue(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}")
    store.commit(old.select(*columns))
    came, gone = catalogue.changes(old, cut(chunking.index_pass(old, new, live, 60)))
    store.commit(came.join(new.select("chunk_id", "project"), "chunk_id").select(*columns), gone)
    return store.read().select("chunk_id", "path", "content_hash")


def _index_stream(spark, d):
    """Documents as they were stored, then as they are now, as a stream of file changes; what the second pass says of each chunk."""
    old, new = files(spark, d, where=STORED), files(spark, d, NEW_TEXT, PRODUCED)
    dead = files(spark, d, where=f"{STORED} and not ({LIVE})")
    first = index_stream.changes_of(old, 1)
    second = index_stream.changes_of(new, 2).unionByName(index_stream.deletions_of(dead, 2))
    place = replay.folder(spark)
    first.write.parquet(f"{place}/in/1")
    second.write.parquet(f"{place}/in/2")
    return index_stream.run(spark, f"{place}/in/*", place).where("at = 2").select("chunk_id", "path", "status")


QUERIES = {
    "index_pass": _index_pass,
    "catalogue_committed": _committed,
    "index_stream": _index_stream,
    "code_map_budget": lambda s, d: graph.code_map(symbols(s, d), edges(s, d), NOISE, 1000),
    "code_map_whole": lambda s, d: graph.code_map(symbols(s, d), edges(s, d), NOISE, 32_768),
    "gateway_answers": _gateway,
    "pattern_by_symbol": lambda s, d: chunking.matches_by_symbol(files(s, d), _definitions(s, d), THE),
    "changed_report": _changed,
    "deadcode_report": lambda s, d: _deadcode(s, d, True),
    "deadcode_raw": lambda s, d: _deadcode(s, d, False),
    "search_answer": lambda s, d: _search(s, d, "on"),
    "search_answer_plain": lambda s, d: _search(s, d, " OFF "),
    "search_envelope": lambda s, d: _search(s, d, "on", search.envelope),
    "search_below_floor": lambda s, d: _search(s, d, "on", search.envelope, floor=1.5),
    "symbol_listing": lambda s, d: graph.listing(symbols(s, d), edges(s, d), "Method", 2, 6),
    "payload_nodes": _nodes,
    "label_lines": _labels,
    "session_cooldown": lambda s, d: gateway.cooled(requests(s, d).where("op = 'error'").select("event_id", "root", "us"), 86_400),
    "engine_reprobe": lambda s, d: gateway.cooled(requests(s, d).select("event_id", F.lit(0).cast("long").alias("root"), "us"), 3_600),
    "no_engine": lambda s, d: gateway.no_engine(_requests(s, d).where("engine = 'none'")),
    "cache_keys": _keys,
}


def _fires(seconds: int, where: str, root: str) -> str:
    return f"""WITH RECURSIVE {_Q}, n AS (SELECT event_id, us, {root} AS root, row_number() OVER (PARTITION BY {root} ORDER BY us, event_id) AS k FROM q WHERE {where}),
      f AS (SELECT event_id, root, k, us AS last, true AS tried FROM n WHERE k = 1 UNION ALL SELECT n.event_id, n.root, n.k, CASE WHEN n.us - last >= {seconds * 1_000_000} THEN n.us ELSE last END, n.us - last >= {seconds * 1_000_000} FROM f JOIN n ON n.root = f.root AND n.k = f.k + 1)
      SELECT event_id, tried FROM f"""


_ASKED = f"""{_Q}, rq AS (SELECT event_id AS request, ['callers', 'overview', 'search', 'context'][event_id % 4 + 1] AS op, ['auto', 'auto', 'auto', 'graph', 'all', 'none', 'semantic'][event_id % 7 + 1] AS engine,
  CASE WHEN root % 13 <> 0 THEN 'role' || (root % 4) END AS role, CASE WHEN root % 11 = 0 THEN ' ' ELSE '/r' || (root % 5) || CASE WHEN event_id % 2 = 0 THEN '/sub' ELSE '' END END AS root FROM q)"""
_DEAD = f"""{ALL}, {D}, z AS (SELECT y.* REPLACE ('n' || (y.id % 50) AS name), in_degree, out_degree FROM y JOIN d ON d.id = y.id WHERE label = 'Function' AND in_degree = 0 AND y.id % 10 <> 0 ORDER BY y.id LIMIT 200),
  w AS (SELECT name, count(*) AS used FROM (SELECT 'n' || (event_id % 40) AS name FROM events) WHERE length(name) = 3 GROUP BY name), k AS (SELECT * FROM z WHERE file <> 'Brand#1')"""
_WORDS = r"""list_distinct(list_transform(list_concat(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), regexp_extract_all(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')), lambda x: lower(x)))"""


def _found(fuse: bool, floor: float = 0.05) -> str:
    """Sixty hits over the floor, in cosine order or fused; then six places for code and four for prose if both have hits."""
    tokens = _WORDS.format(t=f"'{TEXT}'")
    rank = "SELECT *, i AS p FROM o" if not fuse else f"""SELECT *, row_number() OVER (ORDER BY 1.0::DOUBLE / (60 + i) + 1.0::DOUBLE / (60 + lr) DESC, i) - 1 AS p FROM (
      SELECT *, row_number() OVER (ORDER BY lex DESC, i) - 1 AS lr FROM (SELECT *, len(list_intersect({tokens}, {_WORDS.format(t='own')})) / len({tokens}) AS lex FROM o))"""
    return f"""WITH {_sql_files()}, c AS (SELECT e.vec_id, 'doc' || e.vec_id AS path, coalesce(f.lines, []) AS lines, CAST(e.vec_id % 3 AS INTEGER) AS start, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS score
        FROM embeddings e LEFT JOIN f ON f.doc_id = e.vec_id WHERE e.vec_id % 2 = 0),
      n AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS i FROM c WHERE score >= {floor}), o AS (SELECT *, array_to_string(lines[start + 1:start + CASE WHEN vec_id % 5 <> 0 THEN 4 ELSE 40 END], chr(10)) AS own FROM n WHERE i < 60),
      r AS ({rank}), t AS (SELECT *, CASE WHEN vec_id % 10 <> 0 THEN 'prose' ELSE 'code' END AS corpus, lines[start + 1:start + 5] AS head FROM r),
      h AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY p) AS k, count(*) FILTER (WHERE corpus = 'code') OVER () AS nc, count(*) FILTER (WHERE corpus = 'prose') OVER () AS np FROM t),
      x AS (SELECT *, path || ':' || (start + 1) || ' | ' || coalesce(list_filter(list_transform(head, lambda y: trim(y, ' ')), lambda y: regexp_matches(y, '[\\p{{L}}\\p{{N}}]'))[1], head[1], '') AS shown FROM h WHERE k <= CASE WHEN nc = 0 OR np = 0 THEN 10 WHEN corpus = 'code' THEN least(nc, 6) ELSE 10 - least(nc, 6) END),
      y AS (SELECT CAST(row_number() OVER (ORDER BY corpus, k) AS INTEGER) AS place, * FROM x)"""


_HITS = " SELECT place, corpus, vec_id, path, start + 1 AS line, round(score, 6) AS score, rtrim(array_to_string(head, chr(10)), ' ') AS snippet, shown FROM y"
_ENVELOPE = """, z AS (SELECT count(*) AS n, string_agg(shown, chr(10) ORDER BY place) AS lines, max(nc) AS nc, max(np) AS np FROM y)
  SELECT lines AS result, CASE WHEN n > 0 AND nc = 0 THEN 'no-code-matches' WHEN np > nc THEN 'prose-heavy' ELSE '' END AS gap, CASE WHEN (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) = 0 THEN 'no-index' WHEN n = 0 THEN 'below-floor' END AS reason,
  CASE WHEN n > 0 THEN CASE WHEN nc = 0 OR np > nc THEN 'partial' ELSE 'complete' END END AS confidence FROM z"""


def _map(budget: int) -> str:
    return f"""{ALL}, {D}, t AS (SELECT y.id, name, file, n FROM y JOIN (SELECT dst, count(*) AS n FROM r GROUP BY dst) f ON f.dst = y.id ORDER BY n DESC, y.id LIMIT 40),
      a AS (SELECT 'ranked' AS section, row_number() OVER (ORDER BY n DESC, id) AS place, '| `' || name || '` | ' || file || ' | ' || n || ' |' AS line FROM (SELECT * FROM t WHERE file <> 'Brand#1' ORDER BY n DESC, id LIMIT 30)),
      b AS (SELECT 'entry' AS section, row_number() OVER (ORDER BY id) AS place, '- `' || name || '` (' || file || ')' AS line FROM (SELECT y.* FROM y JOIN d ON d.id = y.id WHERE in_degree = 0 AND out_degree > 0 ORDER BY y.id LIMIT 10)),
      o AS (SELECT 'nodes' AS s, '' AS k, count(*) AS n FROM y UNION ALL SELECT 'label', label, count(*) FROM y GROUP BY label UNION ALL SELECT 'family', family, count(*) FROM y GROUP BY family
        UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'edge_type', type, count(*) FROM e GROUP BY type),
      c AS (SELECT 'overview' AS section, row_number() OVER (ORDER BY s, k) AS place, '- ' || s || CASE WHEN k <> '' THEN ' ' || k ELSE '' END || ': ' || n AS line FROM o),
      f AS (SELECT * FROM b UNION ALL SELECT * FROM c), g AS (SELECT sum(octet_length(encode(line)) + 1) AS fixed FROM f), h AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (ORDER BY place) AS upto, sum(octet_length(encode(line)) + 1) OVER () AS whole FROM a)
      SELECT section, CAST(place AS INTEGER) AS place, line FROM f UNION ALL SELECT section, CAST(place AS INTEGER), line FROM h, g WHERE fixed + whole <= {budget} OR fixed + length('> Truncated to fit {budget} bytes.') + 1 + upto <= {budget}
      UNION ALL SELECT 'notice', 1, '> Truncated to fit {budget} bytes.' FROM g WHERE fixed + (SELECT sum(octet_length(encode(line)) + 1) FROM a) > {budget}"""


ORACLES = {
    "index_pass": f"""{_CATALOGUES}, s AS (SELECT new.*, CASE WHEN old.chunk_id IS NULL THEN 'new' WHEN old.content_hash = new.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM new LEFT JOIN old ON old.chunk_id = new.chunk_id),
      n AS (SELECT *, row_number() OVER (ORDER BY path, start) AS k FROM s WHERE status <> 'unchanged'), p AS (SELECT DISTINCT path FROM n WHERE k > 60)
      SELECT chunk_id, path, content_hash, status FROM n WHERE k <= 60 UNION ALL SELECT chunk_id, path, content_hash, status FROM s WHERE status = 'unchanged'
      UNION ALL SELECT old.chunk_id, old.path, old.content_hash, 'stale' FROM old JOIN n ON n.chunk_id = old.chunk_id WHERE k > 60
      UNION ALL SELECT chunk_id, path, content_hash, 'orphan' FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) AND path IN (SELECT path FROM live) AND path IN (SELECT path FROM p)""",
    "index_stream": _CHUNKS["index_diff_status"],
    "code_map_budget": _map(1000),
    "code_map_whole": _map(32_768),
    "gateway_answers": f"""WITH {_ASKED}, g AS (SELECT *, CASE WHEN role IS NULL OR role = 'role3' OR (role = 'role1' AND op NOT IN ('callers', 'context')) OR (role = 'role2' AND op NOT IN ('overview', 'search', 'context')) THEN 'op-not-allowed-for-role'
        WHEN NOT (role = 'role0' OR (role = 'role1' AND (root IN ('/r0', '/r1') OR starts_with(root, '/r0/') OR starts_with(root, '/r1/'))) OR (role = 'role2' AND (root = '/r2' OR starts_with(root, '/r2/')))) THEN 'root-not-allowed-for-role'
        WHEN engine = 'none' THEN 'unknown-engine' END AS refusal FROM rq),
      a AS (SELECT request, op, engine = 'auto' AND op = 'overview' AS spare, CASE WHEN engine <> 'auto' THEN engine WHEN op = 'search' THEN 'semantic' WHEN op = 'context' THEN 'both' ELSE 'graph' END AS asked FROM g WHERE refusal IS NULL),
      s AS (SELECT request, asked, spare, unnest(CASE WHEN spare THEN ['graph', 'lsp'] WHEN asked = 'both' THEN ['graph', 'lsp'] WHEN asked = 'all' THEN ['graph', 'lsp', 'semantic'] ELSE [asked] END) AS engine FROM a),
      p AS (SELECT *, CASE engine WHEN 'graph' THEN 3 WHEN 'lsp' THEN 4 ELSE 5 END AS m FROM s),
      w AS (SELECT *, CASE WHEN (request + m) % 6 <> 0 AND request % m <> 0 THEN engine || ' ~/x' || request END AS result,
        CASE WHEN (request + m) % 6 = 0 THEN 'engine-unavailable' WHEN request % m = 0 THEN ['project-not-indexed', 'no-result', 'timeout'][request % 3 + 1] END AS reason FROM p),
      v AS (SELECT request, max(CAST(engine = 'graph' AND reason IN ('engine-unavailable', 'project-not-indexed') AS INTEGER)) = 1 AND max(CAST(engine = 'lsp' AND result IS NOT NULL AS INTEGER)) = 1 AS other FROM w WHERE spare GROUP BY request),
      l AS (SELECT w.*, m - 2 AS place FROM w LEFT JOIN v ON v.request = w.request WHERE NOT spare OR (engine = 'lsp') = other),
      f AS (SELECT request, asked AS engine, string_agg('## [' || engine || ']' || chr(10) || result, chr(10) || chr(10) ORDER BY place) FILTER (WHERE result IS NOT NULL) AS result,
        coalesce(string_agg(engine || ':' || reason, ',' ORDER BY place) FILTER (WHERE result IS NULL), '') AS gaps,
        CASE WHEN count(result) = 0 THEN CASE WHEN bool_and(reason IN ('engine-unavailable', 'project-not-indexed', 'timeout')) THEN 'engines-unavailable' ELSE 'no-result' END END AS reason,
        CASE WHEN count(result) > 0 THEN CASE WHEN count(result) < count(*) THEN 'partial' ELSE 'complete' END END AS confidence FROM l WHERE asked IN ('both', 'all') GROUP BY request, asked)
      SELECT * FROM f UNION ALL SELECT request, engine, result, '', reason, CASE WHEN result IS NOT NULL THEN 'complete' END FROM l WHERE asked NOT IN ('both', 'all') UNION ALL SELECT request, NULL, NULL, '', refusal, NULL FROM g WHERE refusal IS NOT NULL""",
    "pattern_by_symbol": f"""WITH {_sql_files()}, l AS (SELECT path, unnest(lines) AS line, unnest(range(0, n)) AS i FROM f), h AS (SELECT path, i FROM l WHERE regexp_matches(line, '{THE}')),
      d AS (SELECT *, i // 10 AS k, i % 10 AS m FROM h), x AS (SELECT path, i, CASE WHEN k > 12 OR m >= 6 THEN '' WHEN m BETWEEN 2 AND 4 THEN 'g' || k ELSE 'f' || k END AS name, CASE WHEN k > 12 OR m >= 6 THEN NULL WHEN m BETWEEN 2 AND 4 THEN 10 * k + 2 ELSE 10 * k END AS start FROM d)
      SELECT path, name, CAST(start AS INTEGER) AS start, count(*) AS n, string_agg(CAST(i + 1 AS VARCHAR), ',' ORDER BY i) AS lines FROM x GROUP BY path, name, start""",
    "changed_report": f"""WITH RECURSIVE {ALL.removeprefix('WITH ')}, up AS (SELECT id, 0 AS hop FROM y WHERE id % 200 = 0 UNION ALL SELECT r.src, hop + 1 FROM up JOIN r ON r.dst = up.id WHERE hop < 2),
      s AS (SELECT DISTINCT CASE WHEN id % 7 = 0 THEN p ELSE file || '.' || name END AS label, CASE WHEN id % 5 <> 0 THEN p ELSE '' END AS path FROM (SELECT *, file || CASE WHEN id % 3 = 0 THEN '.md' ELSE '.py' END AS p FROM y WHERE id IN (SELECT id FROM up))),
      t AS (SELECT * FROM s WHERE label <> path), u AS (SELECT * FROM t WHERE path = '' OR path LIKE '%.py'), c AS (SELECT DISTINCT file || CASE WHEN id % 3 = 0 THEN '.md' ELSE '.py' END AS path FROM y WHERE id % 200 = 0),
      k AS (SELECT * FROM c WHERE path LIKE '%.py'), lf AS (SELECT 'files' AS section, '- ' || path AS line FROM k), ls AS (SELECT 'symbols' AS section, '- ' || label || CASE WHEN path <> '' THEN '  (' || path || ')' ELSE '' END AS line FROM u),
      b AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY line) AS p, count(*) OVER (PARTITION BY section) AS n FROM (SELECT * FROM lf UNION ALL SELECT * FROM ls)),
      m AS (SELECT (SELECT count(*) FROM k) AS files, (SELECT count(*) FROM u) AS syms, (SELECT count(*) FROM c) - (SELECT count(*) FROM k) + (SELECT count(*) FROM t) - (SELECT count(*) FROM u) AS dropped)
      SELECT section, CAST(p AS INTEGER) AS place, line FROM b WHERE p <= 10 UNION ALL SELECT DISTINCT section, 11, '… (+' || (n - 10) || ' more)' FROM b WHERE n > 10
      UNION ALL SELECT 'head', 0, CASE WHEN files + syms > 0 THEN files || ' files, ' || syms || ' symbols' WHEN dropped > 0 THEN 'no source changes: ' || dropped || ' of other files' ELSE 'clean' END FROM m""",
    "deadcode_report": f"""{_DEAD} SELECT id, name, file, lines, 'verified' AS state FROM k WHERE name NOT IN (SELECT w.name FROM w JOIN (SELECT name, count(*) AS defined FROM k GROUP BY name) x ON x.name = w.name WHERE used > defined) ORDER BY lines DESC, id LIMIT 30""",
    "deadcode_raw": f"{_DEAD} SELECT id, name, file, lines, 'raw' AS state FROM k ORDER BY lines DESC, id LIMIT 30",
    "search_answer": _found(True) + _HITS,
    "search_answer_plain": _found(False) + _HITS,
    "search_envelope": _found(True) + _ENVELOPE,
    "search_below_floor": _found(True, 1.5) + _ENVELOPE,
    "symbol_listing": f"{ALL}, {D} SELECT y.id, name, file, label, complexity, lines, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree FROM y JOIN d ON d.id = y.id WHERE label = 'Method' AND in_degree BETWEEN 2 AND 6 ORDER BY y.id LIMIT 200",
    "payload_nodes": f"""{ALL}, {D}, f AS (SELECT * FROM r WHERE type = 'CALLS' ORDER BY src, dst LIMIT 50), n AS (SELECT src AS id FROM f UNION SELECT dst FROM f)
      SELECT n.id, coalesce(name, '') AS name, coalesce(file, '') AS file, coalesce(complexity, 0) AS complexity, coalesce(lines, 0) AS lines, CAST(CASE WHEN n.id % 9 = 0 THEN 0 ELSE in_degree END AS BIGINT) AS in_degree, CAST(CASE WHEN n.id % 9 = 0 THEN 0 ELSE out_degree END AS BIGINT) AS out_degree
      FROM n LEFT JOIN y ON y.id = n.id AND n.id % 9 <> 0 JOIN d ON d.id = n.id""",
    "label_lines": f"""{ALL}, c AS (SELECT r.src, r.dst, '- ' || CASE WHEN r.src % 3 = 0 THEN a.file ELSE a.name END || ' [' || r.type || ']' || CASE WHEN r.src % 3 = 0 THEN '' ELSE ' (' || a.file || ')' END AS line
        FROM r JOIN y b ON b.id = r.dst JOIN y a ON a.id = r.src WHERE b.name = 'red widget' ORDER BY r.src, r.dst, r.type LIMIT 50), n AS (SELECT *, row_number() OVER (ORDER BY line, src, dst) AS p, count(*) OVER () AS n FROM c)
      SELECT CAST(p AS INTEGER) AS place, line FROM n WHERE p <= 12 UNION ALL SELECT DISTINCT 13, '… (+' || (n - 12) || ' more)' FROM n WHERE n > 12""",
    "session_cooldown": _fires(86_400, "op = 'error'", "root"),
    "engine_reprobe": _fires(3_600, "true", "0"),
    "no_engine": f"WITH {_ASKED} SELECT request, op, CAST(NULL AS VARCHAR) AS result, 'none' AS engine, 'no-engine' AS reason FROM rq WHERE engine = 'none'",
    "cache_keys": """WITH k AS (SELECT event_id AS request, '/r' || (event_id % 4) AS root, 'p' || (event_id % 300) AS name FROM events), t AS (SELECT *, CASE request % 3 WHEN 0 THEN name WHEN 1 THEN root || '/' || name ELSE './' || name END AS target FROM k)
      SELECT request, 'overview|' || target || '|lsp|' || root || '|' || coalesce(sha256(html), sha256(target)) AS key FROM t LEFT JOIN pages ON name = 'p' || page_id AND root = '/r' || (page_id % 4)""",
}
ORACLES["catalogue_committed"] = f"SELECT chunk_id, path, content_hash FROM ({ORACLES['index_pass']})"
