"""One question, one envelope: policy, routing, fan-out, fallback and merge of a table of requests.

``requests(request, op, engine, role, root)`` are answered from ``answers(request, engine, result, reason)``, what the
engines said or why they were silent. Everything is joins by request and engine; a request has at most four rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import state
from tessera.storage import cut, join_hot

# Engines that fan out, and those that may be asked for.
FAN_OUT = {"both": ("graph", "lsp"), "all": ("graph", "lsp", "semantic")}
ASKABLE = ("auto", *state.ENGINES, *FAN_OUT)
# What the graph answers, what of it is about a root as a whole, and what is withdrawn.
GRAPH_OPS = ("impact", "context", "callers", "callees", "chain", "pattern", "overview", "changed", "changes", "deadcode", "hotspots")
ROOT_SCOPED = ("overview", "changed", "changes", "deadcode", "hotspots")
WITHDRAWN = ("deadcode",)
#: Silence of the graph after which an overview may come from the language server.
SPARE_AFTER = ("engine-unavailable", "project-not-indexed")
#: Seconds for which a failed session isn't tried again, and between two looks for missing engines.
COOLDOWN, REPROBE = 60, 30
#: Seconds for which a project that isn't there is remembered so. A fixed value.
MISSED = 30
#: Microseconds after which what is settled for good would be asked again: never.
_NEVER = 1 << 60


def refused(requests: DataFrame, rules: DataFrame, roots: DataFrame) -> DataFrame:
    """``requests`` with ``reason`` where policy refuses or the engine is unknown; policy comes first."""
    by_op = state.op_allowed(requests, rules).withColumnRenamed("allowed", "op_ok")
    by_root = state.root_allowed(requests.select("request", "role", "root"), roots).select("request", F.col("allowed").alias("root_ok"))
    said = by_op.join(by_root, "request")
    reason = F.when(~F.col("op_ok"), "op-not-allowed-for-role").when(~F.col("root_ok"), "root-not-allowed-for-role").when(~F.coalesce(F.col("engine").isin(*ASKABLE), F.lit(False)), "unknown-engine")
    return said.withColumn("reason", reason).drop("op_ok", "root_ok")


def resolved_engine(op: Column, engine: Column) -> Column:
    return F.when(engine == "auto", state.routed(op)).otherwise(engine)


def answered(requests: DataFrame, answers: DataFrame, rules: DataFrame, roots: DataFrame, home: str | None = None) -> DataFrame:
    """``request, engine, result, gaps, reason, confidence``, one row a request; ``home`` is redacted from results.

    An overview that was routed by itself and that the graph can't give is taken from the language server, if that has one.
    """
    gate = refused(requests, rules, roots)
    engine = resolved_engine(F.col("op"), F.col("engine"))
    asked = gate.where("reason is null").select("request", engine.alias("asked"), (F.col("engine") == "auto").alias("auto"), "op")
    each = F.array(F.col("asked"))
    for name, parts in FAN_OUT.items():
        each = F.when(F.col("asked") == name, F.array(*[F.lit(p) for p in parts])).otherwise(each)
    spare = F.col("auto") & (F.col("op") == "overview") & (F.col("asked") == "graph")
    rows = asked.select("request", "asked", F.explode(F.when(spare, F.array(F.lit("graph"), F.lit("lsp"))).otherwise(each)).alias("engine"), spare.alias("spare"))
    rows = rows.join(answers, ["request", "engine"], "left").withColumn("reason", F.when(F.col("result").isNull(), F.coalesce("reason", F.lit("engine-unavailable"))))
    every = Window.partitionBy("request")
    fails = F.max((F.col("engine") == "graph") & F.col("result").isNull() & F.coalesce(F.col("reason").isin(*SPARE_AFTER), F.lit(False))).over(every)
    helps = F.max((F.col("engine") == "lsp") & F.col("result").isNotNull()).over(every)
    rows = rows.withColumn("other", F.col("spare") & fails & helps).where(~F.col("spare") | ((F.col("engine") == "lsp") == F.col("other")))
    fan = state.merged(rows.where(F.col("asked").isin(*FAN_OUT))).withColumn("engine", F.lit(None).cast("string"))
    lone = rows.where(~F.col("asked").isin(*FAN_OUT)).select("request", "engine", "result", F.lit("").alias("gaps"), "reason", F.when(F.col("result").isNotNull(), "complete").alias("confidence"))
    columns = ["request", "engine", "result", "gaps", "reason", "confidence"]
    fan = fan.join(asked.select("request", "asked"), "request").withColumn("engine", F.col("asked"))
    none = F.lit(None).cast("string")
    no = gate.where("reason is not null").select("request", none.alias("engine"), none.alias("result"), F.lit("").alias("gaps"), "reason", none.alias("confidence"))
    out = fan.select(*columns).unionByName(lone.select(*columns)).unionByName(no)
    return out.withColumn("result", paths.redacted(F.col("result"), home)) if home else out


def no_engine(requests: DataFrame) -> DataFrame:
    """What stands in for an engine that isn't there: no result, with the reason."""
    return requests.select("request", "op", F.lit(None).cast("string").alias("result"), F.lit("none").alias("engine"), F.lit("no-engine").alias("reason"))


def cooled(attempts: DataFrame, seconds: int = COOLDOWN) -> DataFrame:
    """``event_id, tried`` of failing ``attempts(event_id, root, us)``: after a failure a root isn't tried for ``seconds``."""
    return state.debounced(attempts, seconds * 1_000_000).select("event_id", F.col("fired").alias("tried"))


def cache_key(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``request, key``: of ``requests(request, op, target, engine, root)``; a target that is a file of its root goes in with its bytes.

    ``files(root, path, content)``: paths below their root. Any other target goes in by its text.
    """
    relative = F.when(F.col("target").startswith(F.concat(F.col("root"), F.lit("/"))), F.expr("substring(target, length(root) + 2)")).otherwise(F.col("target"))
    hashes = files.select("root", F.col("path").alias("path__"), F.sha2("content", 256).alias("hash__"))
    said = requests.withColumn("path__", F.regexp_replace(relative, r"^(\./)+", "")).join(hashes, ["root", "path__"], "left")
    return said.select("request", F.concat_ws("|", "op", "target", "engine", "root", F.coalesce("hash__", F.sha2("target", 256))).alias("key"))


def scoped(requests: DataFrame, registry: DataFrame, unverified: bool = False) -> DataFrame:
    """``request, op, root, project, scope, reason, gap`` of ``requests(request, op, root)`` to the graph.

    ``registry(ordinal, name, root_path, nodes)`` tells the project of a root: one of its own, or one above it. What is
    asked of a whole root is refused where only a project above is indexed, for that describes another tree; what is asked of a symbol is
    answered from it with a gap. Withdrawn ops are refused unless ``unverified``. The first reason counts.
    """
    found = state.resolved(requests.select(F.col("root").alias("target")).where("target is not null").distinct(), registry)
    known = requests.join(found.select(F.col("target").alias("root"), F.col("name").alias("project"), "scope"), "root", "left")
    above = F.col("scope") == "ancestor"
    reason = F.when(F.col("project").isNull(), "project-not-indexed").when(~F.coalesce(F.col("op").isin(*GRAPH_OPS), F.lit(False)), "unsupported-op")
    reason = reason.when(above & F.col("op").isin(*ROOT_SCOPED), "project-not-indexed-standalone").when(F.col("op").isin(*WITHDRAWN) & F.lit(not unverified), "op-withdrawn")
    return known.withColumn("reason", reason).select("request", "op", "root", "project", "scope", "reason", F.when(F.col("reason").isNull() & above, "ancestor-scope").alias("gap"))


def cache_hits(requests: DataFrame, uncached: tuple[str, ...] = state.UNCACHED) -> DataFrame:
    """``request, hit`` of ``requests(request, us, op, target, engine, root, hash, generation, result)`` in order of time.

    An answer is stored under op, target, engine and root with the hash of the target's contents and the root's generation; it is valid while
    both are what they were. A request without a result, or of an uncached op, stores nothing, so what was stored before stays and is
    valid again when contents and generation are. ``result`` is what the engine would say. A window over each key, streamed.
    """
    stamp = F.concat_ws(":", F.coalesce("hash", F.sha2(F.coalesce("target", F.lit("")), 256)), F.coalesce("generation", F.lit(0)).cast("string"))
    stored = F.when(F.col("result").isNotNull(), stamp)
    key = Window.partitionBy("op", "target", "engine", "root").orderBy("us", "request").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(stored, ignorenulls=True).over(key)
    return requests.select("request", F.coalesce((held == stamp) & ~F.col("op").isin(*uncached), F.lit(False)).alias("hit"))


def lookups(requests: DataFrame, seconds: int = MISSED) -> DataFrame:
    """``event_id, root, asked, answer`` of ``requests(event_id, root, us, outcome)``: who asks the backend for a root's project, and what each is told.

    ``outcome`` is what the backend would say: ``ok``, ``missing``, or nothing it can be held to (``unreachable``). A project that was found is
    kept; one that is missing is remembered for ``seconds``; a failure is no miss and is not remembered, so the next request asks again.
    """
    micros = seconds * 1_000_000
    lasts = F.when(F.col("outcome") == "ok", F.lit(_NEVER)).when(F.col("outcome") == "missing", F.lit(micros)).otherwise(F.lit(1))
    told = state.debounced(requests.withColumn("lasts", lasts), 1, "lasts")
    return _from_starter(told, requests.select("event_id", "outcome"), "outcome").select(
        "event_id", "root", F.col("fired").alias("asked"), F.when(F.col("outcome") == "ok", "ok").when(F.col("outcome") == "missing", "not-indexed").otherwise("backend-unreachable").alias("answer")
    )


def sessions(requests: DataFrame, seconds: int = COOLDOWN) -> DataFrame:
    """``event_id, root, started, state`` of ``requests(event_id, root, us, took, ok)`` to a server that has to warm up.

    A request without a session starts one, which warms up for its ``took`` microseconds and then is ready for good if ``ok``. If not it has failed,
    and for ``seconds`` after that no other is started: a request in that time is told so (``cooling``). The next one starts anew.
    """
    lasts = F.when(F.col("ok"), F.lit(_NEVER)).otherwise(F.col("took") + seconds * 1_000_000)
    told = state.debounced(requests.withColumn("lasts", lasts.cast("long")), 1, "lasts")
    known = _from_starter(told, requests.select("event_id", "took", "ok"), "took", "ok")
    state_ = F.when(F.col("us") < F.col("last_fired") + F.col("took"), "warming").when(F.col("ok"), "ready").otherwise("cooling")
    return known.select("event_id", "root", F.col("fired").alias("started"), state_.alias("state"))


def _from_starter(told: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``told``, the outcome of ``state.debounced``, with ``columns`` of the event that fired last; a starter that very many hang on is broadcast."""
    key = F.concat_ws(":", "root", "last_fired")
    keyed = cut(told.withColumn("key__", key))
    counts = keyed.groupBy("key__").agg(F.count("*").alias("n__"))
    starters = keyed.where("fired").select("event_id", "key__").join(rows, "event_id").join(counts, "key__").select("key__", "n__", *columns)
    return join_hot(keyed, cut(starters), "key__", "n__", keyed.count(), *columns)
