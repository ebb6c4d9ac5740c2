"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows down that tree: each node's budget is shared
among its children by weight, no child getting more than it can supply (its tokens times ``max_epochs``,
summed over its leaves). What a child cannot supply goes to its siblings by weight; since a node's supply is
the sum of its children's, a shortage reaches an ancestor's siblings only once all siblings are full. The
water level of a sibling group has a closed form on the group sorted by supply per weight; it is sought over steps of that
ratio, so siblings are never sorted in one task but for those next to the level; only of trees with at most ``SMALL`` leaves, counted,
are siblings simply put in order, with the same result. All arithmetic is on integers.

A leaf's budget is spent on seeded epochs: whole passes first, then a token-prefix of the pass in which the
documents are ordered by md5(seed:epoch:id). The prefix is found in steps: tokens are summed by the next two
hex digits of the hash, running sums over those 256 sums find the one bucket where the budget ends, and so
on inside it; only the rows of the last bucket (of 65,536 in each leaf) are ordered, those of one repeated or null id
counted as one. So no leaf is ever sorted in one task, however large it is.

Weights default to 1 for each sibling; ``weights`` maps "domain", "domain/language" or
"domain/language/source" to a positive integer. Tokens are white-space separated words, at least 1.

Defined results: a null or blank text counts one token; a null language or source is the empty name; a null
doc_id takes part under the empty id; rows of one id are ordered by length, and of equal ones any are taken; an empty table gives an empty result; extra columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, cut_packed, join_counted, join_hot

SEED, EPOCHS = 17, 3
#: Rounds of two hex digits that narrow a leaf down to the bucket in which its budget ends.
ROUNDS = 2
#: Steps of supply per weight to a doubling, and slices of a group of rows that share place and length.
STEPS, SLICES = 64, 256
#: Leaves of a tree whose sibling groups are put in order as they are.
SMALL = BROADCAST_ROWS
#: Fixed target weights of the registered query: domains as ``domain_of`` names them.
WEIGHTS = {"web": 3, "reference": 2, "web/en": 4, "reference/en": 3}
LEVELS = ("domain", "language", "source")
#: Share of all tokens that the budget is, in thousandths.
BUDGET = 800


def domain_of(source: Column) -> Column:
    """The registered query's domains: sources that end in an odd digit are reference works, the others web."""
    return F.when(source.rlike("[13579]$"), "reference").otherwise("web")


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), " "))).cast("long")


def _weight(weights: dict[str, int], path: Column) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(path == k, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(38,0)")


def _levels_of_water(nodes: DataFrame) -> DataFrame:
    """``(parent, kids, used, open_w)`` of ``nodes(parent, s, w, b)``: what full children use, and the weight of the others.

    Children are taken by supply per weight: the first are full, and the level at which that ends is sought in steps. Equal
    children are combined first, then steps of 2**(1/``STEPS``) in the ratio, a few thousand to a parent. A step that
    lies whole on one side of the level counts as one; only the children of the step in between are put in order.
    """
    big = lambda x: x.cast("decimal(38,0)")
    ratio = F.col("s").cast("double") / F.col("w").cast("double")
    same = nodes.groupBy("parent", "s", "w").agg(F.count("*").alias("n"), F.first("b").alias("b"))
    same = same.select("parent", "s", "w", "n", "b", big(F.col("s") * F.col("n")).alias("all_s"), big(F.col("w") * F.col("n")).alias("all_w"), F.floor(F.log2(ratio) * STEPS).cast("int").alias("step"))
    up = Window.partitionBy("parent").orderBy("step")
    steps = same.groupBy("parent", "step").agg(big(F.sum("all_s")).alias("step_s"), big(F.sum("all_w")).alias("step_w"), F.first("b").alias("b"), F.sum("n").alias("n"))
    steps = steps.withColumn("before", big(F.sum("step_s").over(up)) - F.col("step_s")).withColumn("rest_w", big(F.sum("step_w").over(Window.partitionBy("parent"))) - big(F.sum("step_w").over(up)))
    d, slack = lambda c: F.col(c).cast("double"), 1e-6
    full = d("before") + d("step_s") + F.pow(2.0, (F.col("step") + 1) / STEPS) * (1 + slack) * d("rest_w") <= d("b") * (1 - slack)
    over = d("before") + F.pow(2.0, F.col("step") / STEPS) * (1 - slack) * (d("rest_w") + d("step_w")) > d("b") * (1 + slack)
    steps = cut_packed(steps.withColumn("side", F.when(full, "full").when(over, "open").otherwise("mixed")))
    mixed = steps.where("side = 'mixed'").groupBy("parent").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    within = steps.join(mixed, "parent").where("low <= step and step <= high").select("parent", "step", F.first("before").over(Window.partitionBy("parent").orderBy("step")).alias("base"), F.max(F.col("rest_w") + F.col("step_w")).over(Window.partitionBy("parent")).alias("top_w"))
    order = Window.partitionBy("parent").orderBy(ratio, "s", "w")
    near = same.join(within, ["parent", "step"]).withColumn("past", F.col("base") + big(F.sum("all_s").over(order)) - F.col("all_s")).withColumn("left_w", F.col("top_w") - big(F.sum("all_w").over(order)) + F.col("all_w"))
    near = near.withColumn("filled", (F.col("b") - F.col("past")) * F.col("w") >= F.col("s") * F.col("left_w"))
    inner = near.groupBy("parent").agg(big(F.sum(F.when(F.col("filled"), F.col("all_s")).otherwise(0))).alias("in_s"), big(F.sum(F.when(F.col("filled"), F.lit(0)).otherwise(F.col("all_w")))).alias("in_w"))
    outer = steps.join(mixed, "parent", "left").withColumn("out", F.col("low").isNull() | (F.col("step") < F.col("low")) | (F.col("step") > F.col("high")))
    is_full = F.col("out") & (F.col("side") == "full")
    outer = outer.groupBy("parent").agg(
        F.sum("n").alias("kids"), big(F.sum(F.when(is_full, F.col("step_s")).otherwise(0))).alias("out_s"), big(F.sum(F.when(F.col("out") & (F.col("side") == "open"), F.col("step_w")).otherwise(0))).alias("out_w")
    )
    return cut_packed(outer.join(inner, "parent", "left").select("parent", "kids", big(F.col("out_s") + F.coalesce("in_s", F.lit(0))).alias("used"), big(F.col("out_w") + F.coalesce("in_w", F.lit(0))).alias("open_w")))


def _ordered_budgets(leaves: DataFrame, weights: dict[str, int], given: Column) -> DataFrame:
    """``budgets`` of a small tree: siblings in order of supply per weight, level by level, without a job in between."""
    big = lambda x: x.cast("decimal(38,0)")
    nodes, above = leaves, None
    for k, level in enumerate(LEVELS):
        done = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*done).agg(big(F.sum("supply")).alias("s")).withColumn("w", _weight(weights, F.concat_ws("/", *done)))
        nodes = nodes.withColumn("b", given) if above is None else nodes.join(above, done[:-1])
        group = Window.partitionBy(*(done[:-1] or [F.lit(0)]))
        upto = group.orderBy(F.col("s").cast("double") / F.col("w").cast("double"), *done).rowsBetween(Window.unboundedPreceding, 0)
        open_w = big(F.sum("w").over(group)) - big(F.sum("w").over(upto)) + F.col("w")
        nodes = nodes.withColumn("filled", (F.col("b") - big(F.sum("s").over(upto)) + F.col("s")) * F.col("w") >= F.col("s") * open_w)
        nodes = nodes.withColumn("used", big(F.sum(F.when(F.col("filled"), F.col("s")).otherwise(0)).over(group))).withColumn("open_w", big(F.sum(F.when(F.col("filled"), F.lit(0)).otherwise(F.col("w"))).over(group)))
        share = F.expr("cast(((b - used) * w) div open_w as decimal(38,0))")
        nodes = nodes.select(*done, big(F.when(F.col("filled"), F.col("s")).otherwise(F.least(F.col("s"), share))).alias("budget"))
        above = nodes.withColumnRenamed("budget", "b")
    return nodes


def budgets(leaves: DataFrame, weights: dict[str, int], total: Column, epochs: int = EPOCHS) -> DataFrame:
    """``leaves(domain, language, source, tokens)`` with ``budget``, the tokens that each may spend."""
    leaves = cut_packed(leaves.withColumn("supply", (F.col("tokens") * epochs).cast("decimal(38,0)")))
    given = total.cast("decimal(38,0)")
    if leaves.count() <= SMALL:
        nodes = _ordered_budgets(leaves, weights, given)
        return leaves.join(nodes, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))
    above = None
    for k, level in enumerate(LEVELS):
        done = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*done).agg(F.sum("supply").cast("decimal(38,0)").alias("s")).withColumn("w", _weight(weights, F.concat_ws("/", *done)))
        nodes = nodes.withColumn("parent", F.concat_ws("\x1f", F.lit("root"), *done[:-1]))
        if above is None:
            nodes = cut_packed(nodes.withColumn("b", given))
        else:
            nodes = cut_packed(join_hot(nodes, above, "parent", "kids", above.agg(F.coalesce(F.sum("kids"), F.lit(0)).alias("n")).first()["n"], "b"))
        water = _levels_of_water(nodes)
        nodes = join_hot(nodes, water, "parent", "kids", nodes.count(), "used", "open_w")
        # full: its supply per weight is under the level that the rest of the budget gives the others
        filled = (F.col("open_w") == 0) | (F.col("s") * F.col("open_w") <= (F.col("b") - F.col("used")) * F.col("w"))
        share = F.expr("cast(((b - used) * w) div open_w as decimal(38,0))")
        nodes = nodes.select(*done, F.when(filled, F.col("s")).otherwise(F.least(F.col("s"), share)).cast("decimal(38,0)").alias("budget"))
        kids = leaves.select(*LEVELS[: k + 2]).distinct().groupBy(*done).agg(F.count("*").alias("kids")) if k + 1 < len(LEVELS) else None
        above = None if kids is None else cut_packed(nodes.join(kids, done).select(F.concat_ws("\x1f", F.lit("root"), *done).alias("parent"), "kids", F.col("budget").alias("b")))
    return leaves.join(nodes, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def _order(epoch: Column, seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _by_row(docs: DataFrame, rid: Column, weights: dict[str, int] | None = None, budget: int = BUDGET, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """``planned`` with ``rid``, which tells rows apart."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = cut_packed(docs.select(
        rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (domain if domain is not None else domain_of(source)).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), source.alias("source"), tokens_of(F.col("text").cast("string")).alias("n_tokens"),
    ))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    all_tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    plan = budgets(leaves, WEIGHTS if weights is None else weights, F.lit(min(all_tokens * budget // 1000, all_tokens * epochs)), epochs)
    plan = cut_packed(plan.select(*LEVELS, F.expr("budget div tokens").alias("passes"), F.expr("budget % tokens").alias("left")))
    placed = join_counted(rows, plan, [*LEVELS], "doc_id").withColumn("place", _order(F.col("passes"), seed, F.col("doc_id"))).drop("left")
    edge, upto = plan.select(*LEVELS, "left", F.lit("").alias("edge"), F.lit(0).cast("long").alias("before")), Window.partitionBy(*LEVELS).orderBy("bucket")
    for k in range(ROUNDS):
        inside = join_counted(placed, edge, [*LEVELS], "doc_id").where(F.substring("place", 1, 2 * k) == F.col("edge"))
        sums = inside.groupBy(*LEVELS, F.substring("place", 1, 2 * k + 2).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"), F.first("before").alias("base"))
        sums = sums.withColumn("before", F.col("base") + F.sum("n").over(upto) - F.col("n"))
        edge = cut_packed(sums.where("before <= left and before + n > left").select(*LEVELS, "left", F.col("bucket").alias("edge"), "before"))
    placed = join_counted(placed, edge, [*LEVELS], "doc_id").withColumn("bucket", F.substring("place", 1, 2 * ROUNDS))
    whole = placed.where("bucket <> edge").withColumn("last", F.col("bucket") < F.col("edge"))
    part = cut_packed(placed.where("bucket = edge").withColumn("g", F.concat_ws("\x1f", *LEVELS, "place", F.col("n_tokens").cast("string"))))
    whole = whole.select("rid", "doc_id", *LEVELS, "n_tokens", "passes", "last")
    return whole.unionByName(_prefix(part)).select("rid", "doc_id", *LEVELS, "n_tokens", (F.col("passes") + F.col("last").cast("long")).alias("copies"))


def _prefix(part: DataFrame) -> DataFrame:
    """Rows of the buckets in which budgets end, with ``last``: whether the row is in its leaf's prefix.

    Rows of one place and length (repeated or null ids) are counted as one group ``g``; how many of a group are taken
    follows from the sums. Where that is a part of it, slices of the group are counted, and rows ordered in a slice.
    """
    upto = Window.partitionBy(*LEVELS).orderBy("place", "n_tokens")
    groups = part.groupBy("g", *LEVELS, "place", "n_tokens").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("before").alias("before"))
    reach = F.col("before") + F.sum(F.col("n") * F.col("n_tokens")).over(upto) - F.col("n") * F.col("n_tokens")
    groups = cut_packed(groups.select("g", "n", F.greatest(F.lit(0).cast("long"), F.least("n", F.floor((F.col("left") - reach) / F.col("n_tokens")))).alias("taken")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = join_hot(part.drop("before", "left"), groups.withColumnRenamed("n", "of"), "g", "of", total, "of", "taken").withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(SLICES)).cast("int"))
    some = rows.where("0 < taken and taken < of")
    sums = some.groupBy("g", "slice").agg(F.count("*").alias("n"))
    sums = sums.select("g", "slice", (F.sum("n").over(Window.partitionBy("g").orderBy("slice")) - F.col("n")).alias("past"))
    order = F.row_number().over(Window.partitionBy("g", "slice").orderBy("rid"))
    some = some.join(sums, ["g", "slice"]).withColumn("last", F.col("past") + order <= F.col("taken"))
    keep = ["rid", "doc_id", *LEVELS, "n_tokens", "passes", "last"]
    return rows.where("taken = 0 or taken = of").withColumn("last", F.col("taken") > 0).select(*keep).unionByName(some.select(*keep))


def planned(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of ``docs``: doc_id, domain, language, source, n_tokens and ``copies``, how often it is taken."""
    return _by_row(docs, F.monotonically_increasing_id(), **how).drop("rid")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The chosen documents: doc_id, domain, language, source, n_tokens, copies (1 or more)."""
    return planned(docs, **how).where("copies > 0")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the plan takes it; rows are told apart by position, never by id."""
    held = cut_packed(docs.withColumn("rid__", F.monotonically_increasing_id()))
    taken = _by_row(held, F.col("rid__"), **how).where("copies > 0").select(F.col("rid").alias("rid__"), F.col("copies").alias("copies__"))
    out = held.join(taken, "rid__").withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
