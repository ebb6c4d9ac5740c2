"""Graph queries over the stand-in views, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources.views import edge_index, edges, symbols, table

NAME = "red widget"
Y = """y AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS file, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'Function' ELSE 'Method' END AS label,
    CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'STANDARD' THEN 'ts-js' WHEN 'MEDIUM' THEN 'go' WHEN 'LARGE' THEN 'jvm' ELSE '' END AS family,
    p_type = 'SMALL' AS non_code, p_size AS complexity, CAST(floor(p_retailprice) AS INTEGER) AS lines FROM part)"""
E = """e AS (
  SELECT DISTINCT src, dst, type FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
      CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'USAGE' ELSE 'TESTS' END AS type, l_quantity FROM lineitem)
  WHERE l_quantity >= 40 AND dst IS NOT NULL AND src <> dst)"""
R = "r AS (SELECT * FROM e WHERE type IN ('CALLS', 'USAGE'))"
D = """d AS (SELECT y.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM y
  LEFT JOIN (SELECT dst, count(*) AS n FROM r GROUP BY dst) i ON i.dst = y.id LEFT JOIN (SELECT src, count(*) AS n FROM r GROUP BY src) o ON o.src = y.id)"""
ALL = f"WITH {Y}, {E}, {R}"
NOISE = "file = 'Brand#1'"
CALLERS = f"SELECT r.src, a.name AS from_name, a.file AS from_file, r.dst, r.type FROM r JOIN y b ON b.id = r.dst JOIN y a ON a.id = r.src WHERE b.name = '{NAME}' ORDER BY r.src, r.dst, r.type LIMIT 50"
CALLEES = f"""SELECT src, dst, to_name, to_file, type, CASE WHEN non_code THEN 'non-code' WHEN ff <> '' AND tf <> '' AND ff <> tf THEN 'other-language' ELSE '' END AS dropped FROM (
  SELECT r.src, r.dst, b.name AS to_name, b.file AS to_file, r.type, b.non_code, a.family AS ff, b.family AS tf FROM r JOIN y a ON a.id = r.src JOIN y b ON b.id = r.dst
  WHERE a.name = '{NAME}' ORDER BY r.src, r.dst, r.type LIMIT 50)"""
HOT = """h AS (SELECT y.*, d.in_degree, row_number() OVER (PARTITION BY label ORDER BY complexity DESC, in_degree DESC, y.id) AS k FROM y JOIN d ON d.id = y.id WHERE in_degree >= 1),
  hot AS (SELECT id, name, file, label, family, complexity, in_degree FROM h WHERE k <= 2000 AND file <> 'Brand#1' ORDER BY complexity DESC, in_degree DESC, label, id LIMIT 25)"""


def _both(ask):
    return lambda spark, d: ask(symbols(spark, d), edges(spark, d))


def _kept(ask):
    """Questions whose degrees the index keeps."""

    def run(spark, d):
        index = edge_index(spark, d).open()
        return ask(symbols(spark, d), index.edges, index.degrees)

    return run


def _dead(y, e):
    return graph.dead(y, e, NOISE).orderBy(F.desc("lines"), "id").limit(200)


def _names(spark, d):
    word = lambda t: F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name")
    return graph.unused_names(table(spark, d, "benchmark").select(word("text")), table(spark, d, "documents").select(word("text")))


def _first_edges(spark, d):
    item = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("ordinal"), "l_linenumber", "l_quantity", "l_extendedprice")
    return graph.first_of(item, ["src", "dst"], ["ordinal", "l_linenumber", "l_quantity", "l_extendedprice"]).select("src", "dst", "ordinal", "l_linenumber")


def _changed(y, e):
    return graph.reach(e, y.where("id % 50 = 0"), 2, back=True)


QUERIES = {
    "callers_topn": _both(lambda y, e: graph.callers(y, e, NAME)),
    "callees_collision_filter": _both(lambda y, e: graph.callees(y, e, NAME)),
    "impact_union": _both(lambda y, e: graph.impact(y, e, NAME)),
    "fan_in_top": _kept(lambda y, e, k: graph.fan_in(y, e, NOISE, kept=k)),
    "entry_points": _kept(lambda y, e, k: graph.entry_points(y, e, kept=k)),
    "overview_counts": _both(graph.overview),
    "degree_in_out": _kept(graph.degrees),
    "hotspots_rank": _kept(lambda y, e, k: graph.hotspots(y, e, NOISE, kept=k)),
    "language_coverage": _kept(lambda y, e, k: graph.coverage(graph.hotspots(y, e, NOISE, shown=30, kept=k), "family")),
    "deadcode_anti": _both(_dead),
    "deadcode_verified": _names,
    "graph_payload_edges": _both(lambda y, e: graph.payload(y, e, 200, NOISE)),
    "edge_dedup_first": _first_edges,
    "chain_bfs_hops": _both(lambda y, e: graph.chain(e, y.where("id = 1"), 3)),
    "chain_ambiguous": lambda spark, d: graph.ambiguous(symbols(spark, d)),
    "changed_impact_depth2": _both(_changed),
}

ORACLES = {
    "callers_topn": f"{ALL} {CALLERS}",
    "callees_collision_filter": f"{ALL} {CALLEES}",
    "impact_union": f"{ALL} SELECT 'callers' AS direction, src, dst, type FROM ({CALLERS}) UNION ALL SELECT 'callees', src, dst, type FROM ({CALLEES}) WHERE dropped = ''",
    "fan_in_top": f"""{ALL}, t AS (SELECT y.id, name, file, n AS fan_in FROM y JOIN (SELECT dst, count(*) AS n FROM r GROUP BY dst) f ON f.dst = y.id ORDER BY n DESC, y.id LIMIT 40)
      SELECT * FROM t WHERE file <> 'Brand#1' ORDER BY fan_in DESC, id LIMIT 30""",
    "entry_points": f"{ALL}, {D} SELECT y.id, name, file, CAST(out_degree AS BIGINT) AS out_degree FROM y JOIN d ON d.id = y.id WHERE in_degree = 0 AND out_degree > 0 ORDER BY y.id LIMIT 10",
    "overview_counts": f"""{ALL} SELECT 'nodes' AS section, '' AS key, count(*) AS n FROM y UNION ALL SELECT 'label', label, count(*) FROM y GROUP BY label UNION ALL SELECT 'family', family, count(*) FROM y GROUP BY family
      UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'edge_type', type, count(*) FROM e GROUP BY type""",
    "degree_in_out": f"{ALL}, {D} SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree FROM d",
    "hotspots_rank": f"{ALL}, {D}, {HOT} SELECT * FROM hot",
    "language_coverage": f"""{ALL}, {D}, {HOT.replace('LIMIT 25', 'LIMIT 30')}, n AS (SELECT family, count(*) AS n FROM hot WHERE family <> '' GROUP BY family), m AS (SELECT *, row_number() OVER (ORDER BY n DESC, family DESC) AS k FROM n)
      SELECT family AS top, n AS top_n, CAST((SELECT sum(n) FROM n) AS BIGINT) AS total, (SELECT sum(n) FROM n) >= 5 AND n / (SELECT sum(n) FROM n) >= 0.9 AS warns FROM m WHERE k = 1""",
    "deadcode_anti": f"{ALL} SELECT id, name, file, lines FROM y WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dst = y.id) AND file <> 'Brand#1' ORDER BY lines DESC, id LIMIT 200",
    "deadcode_verified": r"""WITH b AS (SELECT name, count(*) AS defined FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS name FROM benchmark) GROUP BY name),
      o AS (SELECT name, count(*) AS used FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS name FROM documents) GROUP BY name)
      SELECT b.name, defined, coalesce(used, 0) AS used FROM b LEFT JOIN o ON o.name = b.name WHERE coalesce(used, 0) <= defined""",
    "graph_payload_edges": f"""{ALL}, f AS (SELECT * FROM r WHERE type = 'CALLS' ORDER BY src, dst LIMIT 600)
      SELECT f.src, a.name AS from_name, f.dst, b.name AS to_name, f.type FROM f JOIN y a ON a.id = f.src JOIN y b ON b.id = f.dst WHERE a.file <> 'Brand#1' AND b.file <> 'Brand#1' ORDER BY f.src, f.dst LIMIT 200""",
    "edge_dedup_first": """SELECT src, dst, ordinal, l_linenumber FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey AS ordinal, l_linenumber,
      row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1""",
    "chain_bfs_hops": f"""WITH RECURSIVE {Y}, {E}, {R}, down AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION ALL SELECT r.dst, hop + 1 FROM down JOIN r ON r.src = down.id WHERE hop < 3),
      up AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION ALL SELECT r.src, hop + 1 FROM up JOIN r ON r.dst = up.id WHERE hop < 3),
      m AS (SELECT 'callees' AS direction, id, min(hop) AS hop FROM down GROUP BY id UNION ALL SELECT 'callers', id, min(hop) FROM up GROUP BY id)
      SELECT direction, id, hop, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM m WHERE hop > 0""",
    "chain_ambiguous": f"""WITH {Y}, k AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM y)
      SELECT name, count(*) AS candidates, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE k <= 5) AS ids FROM k GROUP BY name HAVING count(*) >= 2""",
    "changed_impact_depth2": f"""WITH RECURSIVE {Y}, {E}, {R}, up AS (SELECT id, 0 AS hop FROM y WHERE id % 50 = 0 UNION ALL SELECT r.src, hop + 1 FROM up JOIN r ON r.dst = up.id WHERE hop < 2)
      SELECT id, min(hop) AS hop FROM up GROUP BY id""",
}
