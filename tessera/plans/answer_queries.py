"""Queries of what an answer may claim: scope, validity of stored answers, ambiguity, what was not retrieved, withdrawal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import gateway, graph, references
from tessera.sources.views import edges, requests, symbols, table

from .graph_queries import ALL, NOISE, D, E, Y
from .state_queries import _Q, _REGISTRY, _registry, _targets

OPS = ("callers", "overview", "deadcode", "search", "hotspots", "chain")


def _scoped(unverified):
    def run(spark, d):
        asked = _targets(spark, d).unionByName(_targets(spark, d).where("length(target) % 3 = 0").select(F.concat(F.lit("/else"), "target").alias("target")))
        op = F.element_at(F.array(*[F.lit(x) for x in OPS]), F.length("target") % len(OPS) + 1)
        return gateway.scoped(asked.select(F.col("target").alias("request"), op.alias("op"), F.col("target").alias("root")), _registry(spark, d), unverified)

    return run


def _hits(spark, d):
    """Requests about pages; some are silent, some of ops that are never stored, and a page's contents change back and forth."""
    k, u = F.col("event_id"), F.col("root")
    op = F.element_at(F.array(*[F.lit(x) for x in ("callers", "overview", "changed", "search")]), (k % 4 + 1).cast("int"))
    hash_ = F.when(u % 3 != 0, F.concat(F.lit("h"), (F.floor(F.col("latency")) % 2).cast("string")))
    result = F.when(k % 5 != 0, F.lit("said"))
    rows = requests(spark, d).select(k.alias("request"), "us", op.alias("op"), F.concat(F.lit("p"), (u % 40).cast("string")).alias("target"), F.lit("graph").alias("engine"), F.lit("/r").alias("root"), hash_.alias("hash"), (F.col("generation") % 3).alias("generation"), result.alias("result"))
    return gateway.cache_hits(rows)


def _unique(spark, d):
    return symbols(spark, d).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))


def _shared(spark, d):
    return symbols(spark, d).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 20).cast("string")))


def _symbol_states(spark, d):
    y = symbols(spark, d)
    k = F.col("id")
    asked = y.select(k.alias("request"), F.when(k % 4 == 0, F.concat(F.lit("no "), "name")).otherwise(F.col("name")).alias("name"), F.when(k % 7 == 0, F.lit(False)).when(k % 11 == 0, F.lit(None)).otherwise(F.lit(True)).alias("found"), (k % 5 != 0).alias("referred"), (k % 60).cast("int").alias("retry_after"))
    defined = y.select("id", F.col("name").alias("name_path"), F.col("file").alias("path"), F.col("lines").alias("start"))
    referred = edges(spark, d).where(F.col("type").isin("CALLS", "USAGE")).select(F.col("dst").alias("id"), F.col("src").alias("path"))
    return references.symbol_answers(asked, defined, referred)


def _dead(files, enabled, words=True):
    def run(spark, d):
        y = symbols(spark, d).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 50).cast("string")))
        used = table(spark, d, "events").select(F.concat(F.lit("n"), (F.col("event_id") % 40).cast("string")).alias("name")).groupBy("name").agg(F.count("*").alias("used"))
        return graph.deadcode_answer(y, edges(spark, d), NOISE, "id % 10 = 0", used if words else None, files, enabled=enabled)

    return run


def _json(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    got = graph.payload_json(y.withColumn("name", F.concat("name", F.lit("</x>"))), e, 50, NOISE)
    return got.select("json", F.sha2("json", 256).alias("sha"))


def _lookups(spark, d):
    outcome = F.element_at(F.array(F.lit("missing"), F.lit("unreachable"), F.lit("missing"), F.lit("ok")), (F.col("event_id") % 4 + 1).cast("int"))
    return gateway.lookups(requests(spark, d).select("event_id", "root", "us", outcome.alias("outcome")), 86_400)


def _sessions(spark, d):
    rows = requests(spark, d).select("event_id", "root", "us", F.round(F.greatest("latency", F.lit(0.0)) * 600_000_000).cast("long").alias("took"), (F.col("event_id") % 5 == 0).alias("ok"))
    return gateway.sessions(rows, 43_200)


COLLIDING = ["red widget", "blue widget", "large gear", "no such name"]
QUERIES = {
    "project_lookups": _lookups,
    "session_states": _sessions,
    "callees_answer": lambda s, d: graph.callees_answer(symbols(s, d), edges(s, d), COLLIDING),
    "scope_gate": _scoped(False),
    "scope_gate_unverified": _scoped(True),
    "cache_validity": _hits,
    "chain_answer": lambda s, d: graph.chain_answer(_unique(s, d), edges(s, d), "n1", 2),
    "chain_answer_ambiguous": lambda s, d: graph.chain_answer(_shared(s, d), edges(s, d), "n1", 2),
    "symbol_states": _symbol_states,
    "deadcode_withdrawn": _dead(10, False),
    "deadcode_checked": _dead(10, True),
    "deadcode_capped": _dead(6001, True),
    "deadcode_no_root": _dead(10, True, words=False),
    "payload_json": _json,
}

_scope = lambda unverified: f"""WITH {_REGISTRY}, asked AS (SELECT target FROM tg UNION ALL SELECT '/else' || target FROM tg WHERE length(target) % 3 = 0),
  a AS (SELECT target, ['callers', 'overview', 'deadcode', 'search', 'hotspots', 'chain'][length(target) % 6 + 1] AS op FROM asked),
  c AS (SELECT target, name, root_path = target AS ex, row_number() OVER (PARTITION BY target ORDER BY root_path = target DESC, length(root_path) DESC, CASE WHEN root_path = target THEN -nodes END, ordinal) AS k
    FROM asked JOIN reg ON root_path = target OR starts_with(target, rtrim(root_path, '/') || '/')),
  j AS (SELECT a.target, op, name, CASE WHEN ex THEN 'exact' WHEN NOT ex THEN 'ancestor' END AS scope FROM a LEFT JOIN c ON c.target = a.target AND k = 1),
  r AS (SELECT *, CASE WHEN name IS NULL THEN 'project-not-indexed' WHEN op = 'search' THEN 'unsupported-op' WHEN scope = 'ancestor' AND op IN ('overview', 'deadcode', 'hotspots') THEN 'project-not-indexed-standalone'
    WHEN op = 'deadcode' AND {'false' if unverified else 'true'} THEN 'op-withdrawn' END AS reason FROM j)
  SELECT target AS request, op, target AS root, name AS project, scope, reason, CASE WHEN reason IS NULL AND scope = 'ancestor' THEN 'ancestor-scope' END AS gap FROM r"""  # noqa: E731
_CANDIDATES = f"""{ALL}, {D}, z AS (SELECT y.* REPLACE ('n' || (y.id % 50) AS name) FROM y JOIN d ON d.id = y.id WHERE label = 'Function' AND in_degree = 0 AND y.id % 10 <> 0 ORDER BY y.id LIMIT 200), k AS (SELECT * FROM z WHERE file <> 'Brand#1'),
  w AS (SELECT 'n' || (event_id % 40) AS name, count(*) AS used FROM events GROUP BY 1)"""
_named = lambda where, state: f"{_CANDIDATES} SELECT id, name, file, lines, '{state}' AS state FROM k WHERE {where} ORDER BY lines DESC, id LIMIT 30"
_VERIFIED = "name NOT IN (SELECT w.name FROM w JOIN (SELECT name, count(*) AS defined FROM k GROUP BY name) x ON x.name = w.name WHERE used > defined)"

_lasting = lambda lasts: f"""WITH RECURSIVE {_Q}, m AS (SELECT event_id, root, us, CASE event_id % 4 WHEN 1 THEN 'unreachable' WHEN 3 THEN 'ok' ELSE 'missing' END AS outcome, CAST(round(greatest(latency, 0) * 600000000) AS BIGINT) AS took, event_id % 5 = 0 AS ok FROM q),
  n AS (SELECT *, {lasts} AS lasts, row_number() OVER (PARTITION BY root ORDER BY us, event_id) AS k FROM m),
  f AS (SELECT event_id, root, us, k, true AS fired, us + greatest(lasts, 1) AS ready, us AS began, outcome, took, ok FROM n WHERE k = 1 UNION ALL
    SELECT n.event_id, n.root, n.us, n.k, n.us >= ready, CASE WHEN n.us >= ready THEN n.us + greatest(n.lasts, 1) ELSE ready END, CASE WHEN n.us >= ready THEN n.us ELSE began END,
      CASE WHEN n.us >= ready THEN n.outcome ELSE f.outcome END, CASE WHEN n.us >= ready THEN n.took ELSE f.took END, CASE WHEN n.us >= ready THEN n.ok ELSE f.ok END FROM f JOIN n ON n.root = f.root AND n.k = f.k + 1)"""  # noqa: E731
_asked = " UNION ALL ".join(f"SELECT '{n}' AS name" for n in ("red widget", "blue widget", "large gear", "no such name"))

ORACLES = {
    "project_lookups": _lasting("CASE event_id % 4 WHEN 3 THEN 1152921504606846976 WHEN 1 THEN 1 ELSE 86400000000 END")
    + " SELECT event_id, root, fired AS asked, CASE outcome WHEN 'ok' THEN 'ok' WHEN 'missing' THEN 'not-indexed' ELSE 'backend-unreachable' END AS answer FROM f",
    "session_states": _lasting("CASE WHEN ok THEN 1152921504606846976 ELSE took + 43200000000 END") + " SELECT event_id, root, fired AS started, CASE WHEN us < began + took THEN 'warming' WHEN ok THEN 'ready' ELSE 'cooling' END AS state FROM f",
    "callees_answer": f"""{ALL}, asked AS ({_asked}), c AS (SELECT a.name, b.non_code OR (a.family <> '' AND b.family <> '' AND a.family <> b.family) AS lost, row_number() OVER (PARTITION BY a.name ORDER BY src, dst, type) AS k FROM r JOIN y a ON a.id = r.src JOIN y b ON b.id = r.dst),
      n AS (SELECT asked.name, count(k) FILTER (WHERE NOT lost) AS n, count(k) FILTER (WHERE lost) AS dropped, count(k) > 0 AS there FROM asked LEFT JOIN c ON c.name = asked.name AND k <= 50 GROUP BY asked.name)
      SELECT name, n, dropped, CASE WHEN there THEN '## Callees of ' || name || ' (' || n || ')' || CASE WHEN n = 0 THEN chr(10) || '(no callee survived name-collision filtering)' ELSE '' END END AS line,
        CASE WHEN dropped > 0 THEN 'name-collisions-dropped' END AS gap, CASE WHEN NOT there THEN 'not-in-graph' END AS reason FROM n""",
    "scope_gate": _scope(False),
    "scope_gate_unverified": _scope(True),
    "cache_validity": f"""WITH {_Q}, r AS (SELECT event_id AS request, us, ['callers', 'overview', 'changed', 'search'][event_id % 4 + 1] AS op, 'p' || (root % 40) AS target,
        CASE WHEN root % 3 <> 0 THEN 'h' || CAST(floor(latency) % 2 AS BIGINT) ELSE sha256('p' || (root % 40)) END || ':' || (generation % 3) AS stamp, event_id % 5 <> 0 AS said FROM q)
      SELECT request, coalesce(last_value(CASE WHEN said THEN stamp END IGNORE NULLS) OVER (PARTITION BY op, target ORDER BY us, request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = stamp AND op <> 'changed', false) AS hit FROM r""",
    "chain_answer": f"""WITH RECURSIVE {ALL.removeprefix('WITH ')}, down AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION SELECT r.dst, hop + 1 FROM down JOIN r ON r.src = down.id WHERE hop < 2),
      up AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION SELECT r.src, hop + 1 FROM up JOIN r ON r.dst = up.id WHERE hop < 2),
      m AS (SELECT 'callees' AS section, id, min(hop) AS place FROM down GROUP BY id UNION ALL SELECT 'callers', id, min(hop) FROM up GROUP BY id)
      SELECT section, CAST(place AS INTEGER) AS place, '- n' || id || ' [hop ' || place || '] [risk: ' || CASE place WHEN 1 THEN 'CRITICAL' ELSE 'HIGH' END || ']' AS line FROM m WHERE place > 0
      UNION ALL SELECT s, 0, '(none)' FROM (VALUES ('callees'), ('callers')) v(s) WHERE EXISTS (SELECT 1 FROM m WHERE place > 0) AND NOT EXISTS (SELECT 1 FROM m WHERE section = s AND place > 0)
      UNION ALL SELECT 'head', 0, '## Call chain for n1' WHERE EXISTS (SELECT 1 FROM m WHERE place > 0)""",
    "chain_answer_ambiguous": f"""WITH {Y}, b AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM y WHERE id % 20 = 1)
      SELECT 'head' AS section, 0 AS place, '## Ambiguous symbol ''n1'' — candidates' AS line UNION ALL SELECT 'candidates', CAST(k AS INTEGER), '- n1 (' || file || ') #' || id FROM b WHERE k <= 5""",
    "symbol_states": f"""WITH {Y}, {E}, a AS (SELECT id AS request, CASE WHEN id % 4 = 0 THEN 'no ' || name ELSE name END AS name, id % 7 <> 0 AND id % 11 <> 0 AS found, id % 5 <> 0 AS referred, id % 60 AS retry FROM y),
      h AS (SELECT name, count(*) AS d, arg_min(id, (file, lines, id)) AS id FROM y GROUP BY name), c AS (SELECT dst, count(*) AS r FROM e WHERE type IN ('CALLS', 'USAGE') GROUP BY dst),
      s AS (SELECT a.*, d, coalesce(r, 0) AS r, CASE WHEN NOT found THEN 'could-not-ask' WHEN d IS NULL THEN 'not-found' WHEN NOT referred THEN 'references-not-retrieved' ELSE 'complete' END AS state FROM a LEFT JOIN h ON h.name = a.name LEFT JOIN c ON c.dst = h.id)
      SELECT request, state, CASE WHEN found THEN coalesce(d, 0) END AS n_definitions, CASE WHEN state = 'complete' THEN r END AS n_references,
        CASE state WHEN 'complete' THEN '### References (' || least(r, 50) || ')' WHEN 'references-not-retrieved' THEN '### References (not retrieved)' END AS head,
        CASE WHEN state IN ('could-not-ask', 'references-not-retrieved') THEN CAST(retry AS INTEGER) END AS retry_after FROM s""",
    "deadcode_withdrawn": _named("false", "ok"),
    "deadcode_checked": _named(_VERIFIED, "ok"),
    "deadcode_capped": _named("true", "capped"),
    "deadcode_no_root": _named("true", "no-root"),
    "payload_json": f"""{ALL}, {D}, f AS (SELECT * FROM r WHERE type = 'CALLS' ORDER BY src, dst LIMIT 400), l AS (SELECT f.* FROM f JOIN y a ON a.id = f.src AND a.file <> 'Brand#1' JOIN y b ON b.id = f.dst AND b.file <> 'Brand#1' ORDER BY src, dst LIMIT 50),
      n AS (SELECT src AS id FROM l UNION SELECT dst FROM l),
      p AS (SELECT string_agg('{{"id":' || n.id || ',"name":"' || name || '<\\/x>","file":"' || file || '","complexity":' || complexity || ',"lines":' || lines || ',"in_degree":' || in_degree || ',"out_degree":' || out_degree || '}}', ',' ORDER BY n.id) AS nodes FROM n JOIN y ON y.id = n.id JOIN d ON d.id = n.id),
      q AS (SELECT string_agg('{{"from":' || src || ',"to":' || dst || ',"type":"' || type || '"}}', ',' ORDER BY src, dst) AS links FROM l), j AS (SELECT '{{"nodes":[' || nodes || '],"edges":[' || links || ']}}' AS json FROM p, q)
      SELECT json, sha256(json) AS sha FROM j""",
}
