"""Replaying a request log: debounce, generations, cache, time limits, load, metrics, merge and policy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import firing, intervals

#: Microseconds.
HOUR = 3_600_000_000
# Engines in their order, reasons that mean "could not ask", served paths, engines by op, ops on live state.
ENGINES = ("graph", "lsp", "semantic")
UNREACHABLE = ("engine-unavailable", "boot-failed", "warming", "project-not-indexed", "project-not-indexed-standalone", "error", "timeout")
KNOWN_PATHS = ("/code/query", "/code/doctor", "/code/status", "/healthz", "/readyz", "/metrics")
ROUTES = {
    "impact": "graph", "callers": "graph", "callees": "graph", "chain": "graph", "pattern": "graph", "overview": "graph", "changed": "graph", "changes": "graph", "deadcode": "graph", "hotspots": "graph",
    "symbol": "lsp", "search": "semantic", "context": "both",
}
UNCACHED = ("changed", "changes")


def debounced(events: DataFrame, window_us: int, lasts: str | None = None) -> DataFrame:
    """``event_id, root, us, fired, generation, last_fired`` of ``events(event_id, root, us)``.

    Firing compares with the last *fired* time, and waits for the end of that firing where ``lasts`` says how long it takes.
    """
    return firing.fired(events, window_us, lasts)


def reindexing(events: DataFrame, window_us: int, lasts: str, width: int = HOUR) -> DataFrame:
    """``event_id, root, reindexing``: whether a pass of the root runs when an event comes, its own included.

    Passes are the firings of ``events(event_id, root, us, lasts)``; each runs for its own ``lasts`` microseconds. A pass that takes no
    time is over when it begins.
    """
    passes = debounced(events, window_us, lasts).where("fired").select("event_id", "root", "us")
    spans = passes.join(events.select("event_id", lasts), "event_id").select("root", F.col("us").alias("start"), (F.col("us") + F.col(lasts)).alias("end"), F.lit("").alias("name"))
    found = intervals.innermost(events.select("event_id", "root", "us"), spans, "root", "us", "event_id", width=width)
    return found.select("event_id", "root", F.col("start").isNotNull().alias("reindexing"))


def cache_replay(requests: DataFrame, uncached: tuple[str, ...], empty: tuple[str, ...]) -> DataFrame:
    """``hit``: the same root and op was answered and stored under the same generation the time before.

    Ops on live state are never stored, nor are empty answers.
    """
    before = F.lag("generation").over(Window.partitionBy("root", "op").orderBy("us", "event_id"))
    kept = ~F.col("op").isin(*uncached, *empty)
    return requests.withColumn("hit", F.coalesce(kept & (before == F.col("generation")), F.lit(False)))


def most_recent(requests: DataFrame, entries: int) -> DataFrame:
    """The keys that a cache of ``entries`` places still holds: those used last."""
    return requests.groupBy("root", "op").agg(F.max("us").alias("last_us"), F.max("event_id").alias("last_id")).orderBy(F.desc("last_us"), F.desc("last_id")).limit(entries)


def _slots(cap: int):
    """Admits a request if one of the root's ``cap`` slots is free when it begins; a refused one takes none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends = None, []
        for f in frames:
            admitted, now = [], []
            for root, us, end in zip(f["root"].tolist(), f["us"].tolist(), f["end"].tolist()):
                if root != key:
                    key, ends = root, []
                while ends and ends[0] <= us:
                    heapq.heappop(ends)
                admitted.append(len(ends) < cap)
                if admitted[-1]:
                    heapq.heappush(ends, end)
                now.append(len(ends))
            yield f.assign(admitted=admitted, now=pd.Series(now, f.index, "int64"))

    return run


def load(requests: DataFrame, seconds: float, cap: int) -> DataFrame:
    """``root, most, over``: most admitted requests at once by root, and how many were refused beyond the cap.

    A fold over each root in time order; a task holds one batch and at most ``cap`` ends.
    """
    end = F.greatest(F.col("us") + 1, F.col("us") + F.round(F.col("latency") * seconds * 1_000_000).cast("long"))
    rows = requests.where("root is not null and us is not null").select("event_id", "root", "us", end.alias("end")).repartition("root").sortWithinPartitions("root", "us", "event_id")
    said = rows.mapInPandas(_slots(cap), "event_id long, root long, us long, end long, admitted boolean, now long")
    return said.groupBy("root").agg(F.max("now").alias("most"), F.count_if(~F.col("admitted")).alias("over"))


def metrics(requests: DataFrame, label: Column, status: Column) -> DataFrame:
    """Requests by op, folded path label and status, with summed latencies that are never negative."""
    return requests.groupBy("op", label.alias("label"), status.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(F.greatest("latency", F.lit(0.0))), 2).alias("seconds"))


def folded_path(path: Column, known: tuple[str, ...] = KNOWN_PATHS) -> Column:
    return F.when(path.isin(*known), path).otherwise("other")


def exposition(counts: DataFrame) -> DataFrame:
    """``line``: one text line for each metric, in order."""
    one = F.format_string('requests_total{op="%s",path="%s",status="%d"} %d', "op", "label", "status", "n")
    return counts.select(one.alias("line")).orderBy("line")


def routed(op: Column, routes: dict[str, str] = ROUTES) -> Column:
    """The engine for an op; unknown ops go to the graph."""
    out = F.lit("graph")
    for k, v in routes.items():
        out = F.when(op == k, F.lit(v)).otherwise(out)
    return out


def readiness(probes: DataFrame) -> DataFrame:
    """``engine, status`` of ``probes(engine, installed, runnable, indexed)``: fail, warn (unknown yet) or ok."""
    bad = ~F.coalesce("installed", F.lit(False)) | F.coalesce(~F.col("runnable"), F.lit(False)) | F.coalesce(~F.col("indexed"), F.lit(False))
    return probes.select("engine", F.when(bad, "fail").when(F.col("runnable").isNull(), "warn").otherwise("ok").alias("status"))


def healthy(statuses: DataFrame, optional: tuple[str, ...] = ("graph",)) -> DataFrame:
    """``ready, healthy``: engines that are ok, and whether all but the optional ones don't fail."""
    return statuses.agg(F.count_if(F.col("status") == "ok").alias("ready"), F.bool_and(F.col("engine").isin(*optional) | (F.col("status") != "fail")).alias("healthy"))


def merged(answers: DataFrame) -> DataFrame:
    """One envelope for each request of ``answers(request, engine, result, reason)``, engines in fixed order.

    Bodies are joined; silent engines become gaps; if all are silent the reason tells "could not ask" from
    "nothing found". At most one answer of each engine, so a group holds at most a few rows.
    """
    place = F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("engine"))
    why = F.coalesce("reason", F.lit("no-result"))
    got = answers.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "engine", "result", why.alias("reason")))).alias("a"))
    said, silent = F.filter("a", lambda x: x["result"].isNotNull()), F.filter("a", lambda x: x["result"].isNull())
    body = F.array_join(F.transform(said, lambda x: F.concat(F.lit("## ["), x["engine"], F.lit("]\n"), x["result"])), "\n\n")
    gaps = F.array_join(F.transform(silent, lambda x: F.concat_ws(":", x["engine"], x["reason"])), ",")
    none = F.size(said) == 0
    reason = F.when(none, F.when(F.forall("a", lambda x: x["reason"].isin(*UNREACHABLE)), "engines-unavailable").otherwise("no-result"))
    confidence = F.when(~none, F.when(F.size(silent) > 0, "partial").otherwise("complete"))
    return got.select("request", F.when(~none, body).alias("result"), gaps.alias("gaps"), reason.alias("reason"), confidence.alias("confidence"))


def rules_of(roles: DataFrame, tokens: DataFrame) -> DataFrame:
    """``role, ops``: the restricted roles of ``roles(role, ops)`` and of ``tokens(digest, role)``.

    A role that may do ``*`` has no rule. One whose ops are missing may do nothing, nor may one that a token names
    and nobody defines.
    """
    ops = F.coalesce("ops", F.array().cast("array<string>"))
    named = tokens.select("role").where("role is not null").distinct().join(roles.select("role"), "role", "left_anti")
    return roles.where(~F.coalesce(F.exists(ops, lambda x: x == "*"), F.lit(False))).select("role", ops.alias("ops")).unionByName(named.withColumn("ops", F.array().cast("array<string>")))


def op_allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``allowed`` for ``requests(role, op, ...)``: a role without a rule may do all, others what ``rules(role, ops)`` lists; none may do nothing."""
    listed = F.coalesce(F.exists("ops", lambda x: x == F.col("op")), F.lit(False))
    said = requests.join(rules.select("role", "ops", F.lit(True).alias("ruled")), "role", "left")
    return said.withColumn("allowed", F.col("role").isNotNull() & (F.col("ruled").isNull() | listed)).drop("ops", "ruled")


def ancestors(path: Column) -> Column:
    """The path and every directory above it, without trailing slashes."""
    clean = F.regexp_replace(path, "/+$", "")
    parts = F.split(clean, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def root_allowed(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """``allowed`` for ``requests(request, role, root)`` under ``roots(role, allowed_root)``; fails closed.

    Containment is an equi-join on the ancestors of the root instead of a join on prefixes.
    """
    asked = requests.where("trim(coalesce(root, '')) <> ''").select("request", "role", F.explode(F.concat(ancestors(F.col("root")), F.array(F.lit("*")))).alias("allowed_root"))
    star = requests.where("trim(coalesce(root, '')) = ''").select("request", "role", F.lit("*").alias("allowed_root"))
    clean = roots.select("role", F.regexp_replace("allowed_root", "(.)/+$", "$1").alias("allowed_root")).where("allowed_root <> ''").distinct()
    yes = asked.unionByName(star).join(clean, ["role", "allowed_root"]).select("request", "role").distinct().withColumn("allowed", F.lit(True))
    return requests.join(yes, ["request", "role"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def resolved(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """``target, name, matched_root, scope``: the project of each path in ``registry(ordinal, name, root_path, nodes)``.

    A root that is the path itself wins, of several the one with most nodes; else the longest root above, which may be
    stored with a slash at its end; ties to the first listed.
    """
    up = targets.select("target", F.posexplode(F.reverse(ancestors(F.col("target")))).alias("up", "above"))
    known = registry.where("coalesce(root_path, '') <> ''").withColumn("above", F.regexp_replace("root_path", "/+$", ""))
    hits = up.join(known, "above").where("up > 0 or root_path = target")
    best = Window.partitionBy("target").orderBy("up", F.when(F.col("up") == 0, -F.coalesce("nodes", F.lit(0))), F.desc(F.length("root_path")), "ordinal")
    first = hits.withColumn("k", F.row_number().over(best)).where("k = 1")
    return first.select("target", "name", F.col("root_path").alias("matched_root"), F.when(F.col("up") == 0, "exact").otherwise("ancestor").alias("scope"))


def token_digests(config: DataFrame) -> DataFrame:
    """``digest, role`` of ``config(token, role)``, where a token stands as itself or as ``sha256:`` and its digest."""
    marked = F.lower(F.substring("token", 1, 7)) == "sha256:"
    digest = F.when(marked, F.lower(F.trim(F.expr("substring(token, 8)")))).otherwise(F.sha2("token", 256))
    return config.where("token is not null").groupBy(digest.alias("digest")).agg(F.max("role").alias("role"))


def role_of(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """``role`` by the sha256 of the presented ``token``, whatever it looks like, in ``tokens(digest, role)``; a known role or none."""
    return requests.withColumn("digest", F.when(F.col("token") != "", F.sha2("token", 256))).join(tokens, "digest", "left").drop("digest")


def setting(value: Column, default: int) -> Column:
    """A usable positive number or the default."""
    n = value.try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))
