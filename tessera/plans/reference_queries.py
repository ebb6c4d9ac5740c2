"""Symbol, reply and sink queries with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking, graph, references
from tessera.sources import sinks
from tessera.sources.views import edges, symbols, table

from .chunk_queries import _sql_chunks, _sql_files, files
from .graph_queries import ALL, E, Y

NAME = "red widget"


def _symbol(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    defined = y.select("id", F.col("name").alias("name_path"), F.col("file").alias("path"), F.col("lines").alias("start"))
    used = e.join(y.select(F.col("id").alias("src"), F.col("file").alias("path"), F.col("lines").alias("line"), F.col("name").alias("name_path")), "src")
    return references.symbol(defined, used.select(F.col("dst").alias("id"), "path", "line", "name_path").distinct(), NAME)


def _replies(spark, d):
    """Every event as a reply of a language server; some are prose, some broken."""
    text = F.format_string('{"f%d.py": {"Function": [{"name_path": " n%d ", "content_around_reference": "  ...  >   %d:from"}]}}', F.col("user_id"), F.col("event_id"), F.col("event_id") % 97)
    k = F.col("event_id") % 5
    return table(spark, d, "events").select(F.col("event_id").alias("reply"), F.when(k == 0, " Error executing tool x").when(k == 1, "[1, 'Exception: y']").when(k == 2, F.concat(F.lit("Exception: "), text)).otherwise(text).alias("json"))


def _graph_json(spark, d):
    y, e = symbols(spark, d), edges(spark, d)
    kept = graph.payload(y, e, 50, "false")
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return sinks.graph_json(y.join(ends, "id"), kept)


def _map(spark, d):
    """The code map's rows: ranked symbols with their share of all references."""
    y, e = symbols(spark, d), edges(spark, d)
    top = graph.fan_in(y, e, "file = 'Brand#1'", shown=10)
    entry = graph.entry_points(y, e)
    return top.select(F.lit("ranked").alias("section"), F.concat_ws(" ", "name", F.concat(F.lit("("), F.col("file"), F.lit(")")), F.col("fan_in").cast("string")).alias("line")).unionByName(entry.select(F.lit("entry").alias("section"), F.concat_ws(" ", "name", F.concat(F.lit("("), F.col("file"), F.lit(")"))).alias("line")))


QUERIES = {
    "symbol_references": _symbol,
    "kind_overview": lambda s, d: references.overview(symbols(s, d).where("file = 'Brand#2'"), "label"),
    "reference_lines": lambda s, d: references.flattened(_replies(s, d)),
    "backend_errors": lambda s, d: _replies(s, d).select("reply", references.backend_error(F.col("json")).alias("error")),
    "graph_json": _graph_json,
    "code_map": _map,
    "reset_dry_run": lambda s, d: sinks.reset_counts(chunking.chunks(files(s, d), 20, 10)),
}

_RAW = """raw AS (SELECT event_id AS reply, CASE event_id % 5 WHEN 0 THEN ' Error executing tool x' WHEN 1 THEN '[1, ''Exception: y'']' WHEN 2 THEN 'Exception: ' || t ELSE t END AS raw FROM (
  SELECT event_id, '{"f' || user_id || '.py": {"Function": [{"name_path": " n' || event_id || ' ", "content_around_reference": "  ...  >   ' || (event_id % 97) || ':from"}]}}' AS t FROM events))"""
_TOP = "t AS (SELECT y.id, name, file, n AS fan_in FROM y JOIN (SELECT dst, count(*) AS n FROM r GROUP BY dst) f ON f.dst = y.id ORDER BY n DESC, y.id LIMIT 40)"
ORACLES = {
    "symbol_references": f"""WITH {Y}, {E}, d AS (SELECT *, row_number() OVER (ORDER BY file, lines, id) AS k FROM (SELECT * FROM y WHERE name = '{NAME}' ORDER BY file, lines, id LIMIT 5)),
      u AS (SELECT DISTINCT a.file AS path, a.lines AS line, a.name FROM e JOIN d ON d.k = 1 AND e.dst = d.id JOIN y a ON a.id = e.src ORDER BY 1, 2, 3 LIMIT 50)
      SELECT 'definition' AS part, CAST(k AS INTEGER) AS ordinal, file AS path, lines AS start, name AS name_path FROM d UNION ALL SELECT 'reference', CAST(row_number() OVER (ORDER BY path, line, name) AS INTEGER), path, line, name FROM u""",
    "kind_overview": f"WITH {Y} SELECT label AS kind, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM y WHERE file = 'Brand#2' GROUP BY label",
    "reference_lines": f"""WITH {_RAW}, f AS (SELECT reply, raw, unnest(json_keys(CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END)) AS path FROM raw),
      k AS (SELECT reply, path, json_extract(raw, '$."' || path || '"') AS kinds FROM f), e AS (SELECT reply, path, kinds, unnest(json_keys(kinds)) AS kind FROM k),
      x AS (SELECT reply, path, kind, unnest(CAST(json_extract(kinds, '$."' || kind || '"') AS JSON[])) AS entry FROM e)
      SELECT reply, path, kind, trim(entry->>'$.name_path') AS name_path, TRY_CAST(regexp_extract(entry->>'$.content_around_reference', '>\\s*(\\d+):', 1) AS INTEGER) AS line FROM x""",
    "backend_errors": f"""WITH {_RAW}, h AS (SELECT *, lower(regexp_replace(raw, '^\\s+', '')) AS head FROM raw) SELECT reply, left(head, 1) NOT IN ('[', '{{') AND (starts_with(head, 'error executing tool') OR starts_with(head, 'exception:')
      OR starts_with(head, 'traceback (most recent call last)') OR starts_with(head, 'the language server manager is not initialized')) AS error FROM h""",
    "graph_json": f"""{ALL}, f AS (SELECT * FROM r WHERE type = 'CALLS' ORDER BY src, dst LIMIT 50)
      SELECT 'node' AS part, '{{"id":' || id || ',"name":"' || name || '","file":"' || file || '"}}' AS line FROM y WHERE id IN (SELECT src FROM f UNION SELECT dst FROM f)
      UNION ALL SELECT 'edge', '{{"from":' || src || ',"to":' || dst || ',"type":"' || type || '"}}' FROM f""",
    "code_map": f"""{ALL}, {_TOP}, a AS (SELECT * FROM t WHERE file <> 'Brand#1' ORDER BY fan_in DESC, id LIMIT 10), b AS (SELECT * FROM y WHERE id NOT IN (SELECT dst FROM r) AND id IN (SELECT src FROM r) ORDER BY id LIMIT 10)
      SELECT 'ranked' AS section, name || ' (' || file || ') ' || fan_in AS line FROM a UNION ALL SELECT 'entry', name || ' (' || file || ')' FROM b""",
    "reset_dry_run": f"WITH {_sql_files()}, {_sql_chunks()} SELECT project, count(*) AS chunks, count(DISTINCT path) AS files FROM c GROUP BY project",
}
