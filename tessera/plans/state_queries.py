"""State, policy and envelope queries over the request log, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quantiles, state
from tessera.sources.views import requests, table
from tessera.streaming import replay

DAY, HALF, HOUR = 86_400_000_000, 43_200_000_000, 3_600_000_000
KNOWN = ("view", "click", "purchase")
ROUTED = {"view": "callers", "click": "symbol", "purchase": "search", "error": "context"}


def _answers(spark, d):
    """Of each user and engine the first event; weak ones count as silent."""
    e = requests(spark, d).where("op in ('view', 'click', 'purchase')")
    first = e.groupBy("root", "op").agg(F.min(F.struct("us", "event_id", "latency", "generation")).alias("x"))
    silent = F.col("x.latency") < 20
    engine = F.when(F.col("op") == "view", "graph").when(F.col("op") == "click", "lsp").otherwise("semantic")
    return first.select(
        F.col("root").alias("request"), engine.alias("engine"), F.when(~silent, F.concat(F.lit("e"), F.col("x.event_id").cast("string"))).alias("result"),
        F.when(silent, F.when(F.col("x.generation") % 2 == 0, "no-result").otherwise("engine-unavailable")).alias("reason"),
    )


def _host(column, level):
    return F.regexp_extract(column, r"^(https?://[^/]+)" if level == 1 else r"^(https?://[^/]+/[a-z]+)", 1)


def _registry(spark, d):
    """Hosts (twice, with other sizes) and language folders as registered projects."""
    p = table(spark, d, "pages")
    one = p.select(_host("url", 1).alias("root_path"), "page_id").groupBy("root_path").agg(F.min("page_id").alias("m"), F.count("*").alias("nodes"))
    two = p.select(_host("url", 2).alias("root_path"), "page_id").where("root_path <> ''").groupBy("root_path").agg(F.min("page_id").alias("m"), F.count("*").alias("nodes"))
    twice = one.where("m % 2 = 0").select("root_path", (F.col("m") + 2_000_000).alias("m"), (F.col("nodes") + 5).alias("nodes"))
    some = two.where("m % 3 = 0").select(F.concat("root_path", F.when(F.col("m") % 2 == 0, "/").otherwise("")).alias("root_path"), (F.col("m") + 1_000_000).alias("m"), "nodes")
    return one.unionByName(twice).unionByName(some).select(F.col("m").alias("ordinal"), F.concat(F.lit("p"), F.col("m").cast("string")).alias("name"), "root_path", "nodes")


def _targets(spark, d):
    url = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    p = table(spark, d, "pages")
    return p.select(url.alias("target")).unionByName(p.select(_host("url", 1).alias("target"))).unionByName(p.select(_host("url", 2).alias("target")).where("target <> ''")).distinct()


def _root_policy(spark, d):
    p, roles = table(spark, d, "pages"), table(spark, d, "nation").where("n_nationkey < 8").select(F.col("n_name").alias("role"), "n_nationkey")
    asked = p.select(F.col("page_id").alias("request"), F.regexp_replace("url", "[?#].*$", "").alias("root"), (F.col("page_id") % 8).cast("int").alias("n_nationkey")).join(roles, "n_nationkey").drop("n_nationkey")
    own = p.where("page_id % 5 <> 0").select(_host("url", 1).alias("allowed_root"), (F.col("page_id") % 8).cast("int").alias("n_nationkey")).join(roles.where("n_nationkey < 6"), "n_nationkey").select("role", "allowed_root")
    star = roles.where("n_nationkey = 6").select("role", F.lit("*").alias("allowed_root"))
    return state.root_allowed(asked, own.unionByName(star)).select("request", "role", "allowed")


def _op_policy(spark, d):
    rules = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("role"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("view"), F.lit("click"))).otherwise(F.array(F.lit("error"))).alias("ops"))
    asked = requests(spark, d).select("event_id", F.concat(F.lit("NATION_"), (F.col("root") % 20).cast("string")).alias("role"), "op")
    return state.op_allowed(asked, rules)


def _roles(spark, d):
    """Tokens configured plainly and as digests, presented plainly and (in vain) as digests, and what their roles may do."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    digest = F.sha2("n_name", 256)
    token = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.concat(F.lit("sha256:"), digest)).otherwise(F.concat(F.lit("SHA256: "), F.upper(digest)))
    tokens = state.token_digests(n.where(k < 20).select(token.alias("token"), F.concat(F.lit("role"), (k % 4).cast("string")).alias("role")))
    roles = spark.createDataFrame([("role0", ["view", "*"]), ("role1", ["view", None]), ("role2", None)], "role string, ops array<string>")
    asked = n.select(k, F.when(k % 5 == 0, "").when(k % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("sha256:"), digest)).alias("token"))
    said, rules = state.role_of(asked, tokens).select("n_nationkey", "role"), state.rules_of(roles, tokens)
    for op in ("view", "drop"):
        said = state.op_allowed(said.withColumn("op", F.lit(op)), rules).withColumnRenamed("allowed", op).drop("op")
    return said.select("n_nationkey", "role", "view", "drop")


def _probes(spark, d):
    k, flag = F.col("s_suppkey"), lambda c: F.when(c == 0, F.lit(False)).when(c <= 3, F.lit(True))
    return table(spark, d, "supplier").select(
        F.when(k == 1, "graph").otherwise(F.concat(F.lit("e"), k.cast("string"))).alias("engine"), flag(k % 11).alias("installed"), flag(F.col("s_nationkey") % 5).alias("runnable"), flag((k + 1) % 7).alias("indexed")
    )


def _ages(spark, d):
    e = requests(spark, d)
    now = e.agg(F.max("us")).first()[0]
    return e.groupBy("root").agg(((F.lit(now) - F.max("us")) / 1_000_000).alias("age")).select("root", F.round("age", 3).alias("age"))


def _metrics(spark, d):
    status = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), F.col("generation") % 3 + 1)
    return state.metrics(requests(spark, d), state.folded_path(F.col("op"), KNOWN), status)


def _settings(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "-3").when(F.col("event_id") % 4 == 1, "x7").when(F.col("event_id") % 4 == 2, F.get_json_object("props", "$.k")).otherwise(F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", state.setting(raw, 30).alias("k"))


def _passes(spark, d):
    """Requests that begin a pass if they fire; it takes an hour for each unit of latency."""
    return requests(spark, d).select("event_id", "root", "us", F.round(F.greatest("latency", F.lit(0.0)) * HOUR).cast("long").alias("lasts"))


def _latencies(spark, d):
    got = quantiles.exact(requests(spark, d), "op", "latency", {"p50": 0.5, "p95": 0.95})
    return got.select("op", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


QUERIES = {
    "debounce_fold": lambda s, d: state.debounced(requests(s, d), DAY).where("fired").select("event_id", "root", "us"),
    "generation_counter": lambda s, d: state.debounced(requests(s, d), DAY).select("event_id", "generation"),
    "inflight_flag": lambda s, d: state.reindexing(_passes(s, d), DAY, "lasts").select("event_id", "reindexing"),
    "debounce_passes": lambda s, d: state.debounced(_passes(s, d), DAY, "lasts").where("fired").select("event_id", "root", "us", "generation"),
    "negative_cache": lambda s, d: state.debounced(requests(s, d).where("op = 'error'"), HALF).select("event_id", (~F.col("fired")).alias("served")),
    "cache_replay": lambda s, d: state.cache_replay(requests(s, d), ("purchase",), ("error",)).select("event_id", "hit"),
    "lru_recent": lambda s, d: state.most_recent(requests(s, d), 100).select("root", "op", "last_us"),
    "inflight_overlap": lambda s, d: state.load(requests(s, d), 600.0, 2),
    "metrics_rollup": _metrics,
    "prometheus_lines": lambda s, d: state.exposition(_metrics(s, d)),
    "percentile_latency": _latencies,
    "readiness_rollup": lambda s, d: state.readiness(_probes(s, d)),
    "readiness_health": lambda s, d: state.healthy(state.readiness(_probes(s, d))),
    "fanout_merge_gaps": lambda s, d: state.merged(_answers(s, d)),
    "envelope_confidence": lambda s, d: state.merged(_answers(s, d)).groupBy("confidence", "reason").agg(F.count("*").alias("n")),
    "auto_route": lambda s, d: requests(s, d).select("event_id", state.routed(F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in ROUTED.items()], F.col("op"))).alias("engine")),
    "project_longest_prefix": lambda s, d: state.resolved(_targets(s, d), _registry(s, d)),
    "root_policy_prefix": _root_policy,
    "op_policy": _op_policy,
    "token_roles": _roles,
    "index_age": _ages,
    "config_positive": _settings,
    "debounce_stream": lambda s, d: replay.debounce_stream(s, d, DAY),
    "metrics_stream": lambda s, d: replay.metrics_stream(s, d),
}

_Q = "q AS (SELECT event_id, epoch_us(ts) AS us, user_id AS root, event_type AS op, value AS latency, CAST(props->>'$.k' AS INTEGER) AS generation FROM events)"


def _folded(window: int, where: str = "true") -> str:
    return f"""WITH RECURSIVE {_Q}, n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY us, event_id) AS k FROM q WHERE {where}),
      f AS (SELECT event_id, root, us, k, true AS fired, us AS last_fired, CAST(1 AS BIGINT) AS generation FROM n WHERE k = 1 UNION ALL
        SELECT n.event_id, n.root, n.us, n.k, n.us - f.last_fired >= {window}, CASE WHEN n.us - f.last_fired >= {window} THEN n.us ELSE f.last_fired END, f.generation + CASE WHEN n.us - f.last_fired >= {window} THEN 1 ELSE 0 END
        FROM f JOIN n ON n.root = f.root AND n.k = f.k + 1)"""


_RUNS = f"""WITH RECURSIVE {_Q}, n AS (SELECT *, CAST(round(greatest(latency, 0) * {HOUR}) AS BIGINT) AS lasts, row_number() OVER (PARTITION BY root ORDER BY us, event_id) AS k FROM q),
  f AS (SELECT event_id, root, us, k, true AS fired, us + lasts AS fin, us + greatest(lasts, {DAY}) AS ready, CAST(1 AS BIGINT) AS generation FROM n WHERE k = 1 UNION ALL
    SELECT n.event_id, n.root, n.us, n.k, n.us >= ready, CASE WHEN n.us >= ready THEN n.us + lasts ELSE fin END, CASE WHEN n.us >= ready THEN n.us + greatest(lasts, {DAY}) ELSE ready END, f.generation + CASE WHEN n.us >= ready THEN 1 ELSE 0 END
    FROM f JOIN n ON n.root = f.root AND n.k = f.k + 1)"""
_ANSWERS = f"""{_Q}, g AS (SELECT *, row_number() OVER (PARTITION BY root, op ORDER BY us, event_id) AS k FROM q WHERE op IN ('view', 'click', 'purchase')),
  a AS (SELECT root AS request, CASE op WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place, CASE op WHEN 'view' THEN 'graph' WHEN 'click' THEN 'lsp' ELSE 'semantic' END AS engine, CASE WHEN latency >= 20 THEN 'e' || event_id END AS result,
    CASE WHEN latency < 20 THEN CASE WHEN generation % 2 = 0 THEN 'no-result' ELSE 'engine-unavailable' END END AS reason FROM g WHERE k = 1),
  m AS (SELECT request, string_agg('## [' || engine || ']' || chr(10) || result, chr(10) || chr(10) ORDER BY place) FILTER (WHERE result IS NOT NULL) AS result, coalesce(string_agg(engine || ':' || reason, ',' ORDER BY place) FILTER (WHERE result IS NULL), '') AS gaps,
    CASE WHEN count(result) = 0 THEN CASE WHEN bool_and(reason = 'engine-unavailable') THEN 'engines-unavailable' ELSE 'no-result' END END AS reason,
    CASE WHEN count(result) > 0 THEN CASE WHEN count(result) < count(*) THEN 'partial' ELSE 'complete' END END AS confidence FROM a GROUP BY request)"""
_METRICS = f"""{_Q}, r AS (SELECT op, CASE WHEN op IN ('view', 'click', 'purchase') THEN op ELSE 'other' END AS label, [200, 404, 503][generation % 3 + 1] AS status, count(*) AS n, round(sum(greatest(latency, 0)), 2) AS seconds FROM q GROUP BY ALL)"""
_H1, _H2 = "regexp_extract(url, '^(https?://[^/]+)', 1)", "regexp_extract(url, '^(https?://[^/]+/[a-z]+)', 1)"
_REGISTRY = f"""one AS (SELECT {_H1} AS root_path, min(page_id) AS m, count(*) AS nodes FROM pages GROUP BY 1), two AS (SELECT {_H2} AS root_path, min(page_id) AS m, count(*) AS nodes FROM pages WHERE {_H2} <> '' GROUP BY 1),
  reg AS (SELECT m AS ordinal, 'p' || m AS name, root_path, nodes FROM (SELECT root_path, m, nodes FROM one UNION ALL SELECT root_path, m + 2000000, nodes + 5 FROM one WHERE m % 2 = 0 UNION ALL SELECT root_path || CASE WHEN m % 2 = 0 THEN '/' ELSE '' END, m + 1000000, nodes FROM two WHERE m % 3 = 0)),
  tg AS (SELECT DISTINCT target FROM (SELECT rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS target FROM pages UNION ALL SELECT {_H1} FROM pages UNION ALL SELECT {_H2} FROM pages WHERE {_H2} <> ''))"""

_flag = lambda x: f"CASE WHEN {x} = 0 THEN false WHEN {x} <= 3 THEN true END"
_PROBES = f"""p AS (SELECT CASE s_suppkey WHEN 1 THEN 'graph' ELSE 'e' || s_suppkey END AS engine, {_flag('s_suppkey % 11')} AS installed, {_flag('s_nationkey % 5')} AS runnable, {_flag('(s_suppkey + 1) % 7')} AS indexed FROM supplier),
  o AS (SELECT engine, CASE WHEN installed IS NOT true OR runnable IS false OR indexed IS false THEN 'fail' WHEN runnable IS NULL THEN 'warn' ELSE 'ok' END AS status FROM p)"""

ORACLES = {
    "debounce_fold": f"{_folded(DAY)} SELECT event_id, root, us FROM f WHERE fired",
    "generation_counter": f"{_folded(DAY)} SELECT event_id, generation FROM f",
    "inflight_flag": f"{_RUNS} SELECT event_id, us < fin AS reindexing FROM f",
    "debounce_passes": f"{_RUNS} SELECT event_id, root, us, generation FROM f WHERE fired",
    "negative_cache": _folded(HALF, "op = 'error'") + " SELECT event_id, NOT fired AS served FROM f",
    "cache_replay": f"WITH {_Q} SELECT event_id, coalesce(op NOT IN ('purchase', 'error') AND lag(generation) OVER (PARTITION BY root, op ORDER BY us, event_id) = generation, false) AS hit FROM q",
    "lru_recent": f"WITH {_Q} SELECT root, op, last_us FROM (SELECT root, op, max(us) AS last_us, max(event_id) AS last_id FROM q GROUP BY root, op) ORDER BY last_us DESC, last_id DESC LIMIT 100",
    "inflight_overlap": f"""WITH RECURSIVE {_Q}, n AS (SELECT root, us, greatest(us + CAST(round(latency * 600.0 * 1000000) AS BIGINT), us + 1) AS fin, row_number() OVER (PARTITION BY root ORDER BY us, event_id) AS k FROM q),
      f AS (SELECT root, k, us, true AS ok, fin AS e1, CAST(0 AS BIGINT) AS e2 FROM n WHERE k = 1 UNION ALL
        SELECT n.root, n.k, n.us, least(e1, e2) <= n.us, CASE WHEN e1 <= e2 AND e1 <= n.us THEN n.fin ELSE e1 END, CASE WHEN e2 < e1 AND e2 <= n.us THEN n.fin ELSE e2 END FROM f JOIN n ON n.root = f.root AND n.k = f.k + 1)
      SELECT root, CAST(max(CAST(e1 > us AS INTEGER) + CAST(e2 > us AS INTEGER)) AS BIGINT) AS most, count(*) FILTER (WHERE NOT ok) AS over FROM f GROUP BY root""",
    "metrics_rollup": f"WITH {_METRICS} SELECT * FROM r",
    "prometheus_lines": f"""WITH {_METRICS} SELECT 'requests_total{{op="' || op || '",path="' || label || '",status="' || status || '"}} ' || n AS line FROM r""",
    "percentile_latency": f"WITH {_Q} SELECT op, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM q GROUP BY op",
    "readiness_rollup": f"WITH {_PROBES} SELECT * FROM o",
    "readiness_health": f"WITH {_PROBES} SELECT count(*) FILTER (WHERE status = 'ok') AS ready, count(*) FILTER (WHERE status = 'fail' AND engine <> 'graph') = 0 AS healthy FROM o",
    "fanout_merge_gaps": f"WITH {_ANSWERS} SELECT * FROM m",
    "envelope_confidence": f"WITH {_ANSWERS} SELECT confidence, reason, count(*) AS n FROM m GROUP BY confidence, reason",
    "auto_route": f"WITH {_Q} SELECT event_id, CASE op WHEN 'click' THEN 'lsp' WHEN 'purchase' THEN 'semantic' WHEN 'error' THEN 'both' ELSE 'graph' END AS engine FROM q",
    "project_longest_prefix": f"""WITH {_REGISTRY}, c AS (SELECT target, name, root_path, root_path = target AS ex, row_number() OVER (PARTITION BY target ORDER BY root_path = target DESC, length(root_path) DESC, CASE WHEN root_path = target THEN -nodes END, ordinal) AS k
      FROM tg JOIN reg ON root_path = target OR starts_with(target, rtrim(root_path, '/') || '/')) SELECT target, name, root_path AS matched_root, CASE WHEN ex THEN 'exact' ELSE 'ancestor' END AS scope FROM c WHERE k = 1""",
    "root_policy_prefix": f"""WITH ask AS (SELECT page_id AS request, regexp_replace(url, '[?#].*$', '') AS root, page_id % 8 AS k FROM pages), own AS (SELECT {_H1} AS allowed_root, page_id % 8 AS k FROM pages WHERE page_id % 5 <> 0)
      SELECT request, n_name AS role, k = 6 OR (k < 6 AND EXISTS (SELECT 1 FROM own WHERE own.k = ask.k AND (root = allowed_root OR starts_with(root, allowed_root || '/')))) AS allowed FROM ask JOIN nation ON n_nationkey = k""",
    "op_policy": f"""WITH {_Q} SELECT event_id, 'NATION_' || (root % 20) AS role, op, CASE WHEN root % 20 >= 10 THEN true WHEN root % 2 = 0 THEN op IN ('view', 'click') ELSE op = 'error' END AS allowed FROM q""",
    "token_roles": """WITH c AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'sha256:' || sha256(n_name) ELSE 'SHA256: ' || upper(sha256(n_name)) END AS token, 'role' || (n_nationkey % 4) AS role FROM nation WHERE n_nationkey < 20),
      t AS (SELECT CASE WHEN lower(substr(token, 1, 7)) = 'sha256:' THEN lower(trim(substr(token, 8))) ELSE sha256(token) END AS digest, role FROM c),
      a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'sha256:' || sha256(n_name) END AS token FROM nation)
      SELECT n_nationkey, role, coalesce(role IN ('role0', 'role1'), false) AS view, coalesce(role = 'role0', false) AS drop FROM a LEFT JOIN t ON token <> '' AND sha256(token) = digest""",
    "index_age": f"WITH {_Q} SELECT root, round(((SELECT max(us) FROM q) - max(us)) / 1000000, 3) AS age FROM q GROUP BY root",
    "config_positive": """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-3' WHEN 1 THEN 'x7' WHEN 2 THEN props->>'$.k' END AS raw FROM events)
      SELECT event_id, CASE WHEN TRY_CAST(raw AS INTEGER) > 0 THEN TRY_CAST(raw AS INTEGER) ELSE 30 END AS k FROM r""",
}
ORACLES["debounce_stream"] = ORACLES["debounce_fold"]
ORACLES["metrics_stream"] = f"WITH {_Q} SELECT op, count(*) AS n, round(sum(latency), 2) AS seconds FROM q GROUP BY op"
