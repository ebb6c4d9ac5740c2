"""Questions about symbols and call edges as joins, aggregates and bounded traversals.

Noise and skip rules are SQL conditions on a symbol row. ``symbols(id, name, file, label, family, non_code,
complexity, lines)`` and ``edges(src, dst, type)`` are
tables; no graph is ever held in one place. Joins carry no broadcast hints: statistics and adaptive execution
choose, so a plan fits whatever a filter leaves over. Every limit has a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import cut

REFERENCES = ("CALLS", "USAGE")
#: Files beyond which candidates of dead code aren't held against the texts. A fixed value.
VERIFIED_FILES = 6000
CAP, SHOWN_FAN_IN, FETCHED_FAN_IN, SHOWN_HOT = 50, 30, 40, 25


def _named(symbols: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return symbols.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _references(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*REFERENCES))


def callers(symbols: DataFrame, edges: DataFrame, name: str, cap: int = CAP) -> DataFrame:
    """Who refers to a symbol called ``name``."""
    target = _named(symbols.where(F.col("name") == name), "to", "id", "name").withColumnRenamed("to_id", "dst")
    found = _references(edges).join(target, "dst").join(_named(symbols, "from", "id", "name", "file").withColumnRenamed("from_id", "src"), "src")
    return found.select("src", "from_name", "from_file", "dst", "type").orderBy("src", "dst", "type").limit(cap)


def callees(symbols: DataFrame, edges: DataFrame, name: str, cap: int = CAP) -> DataFrame:
    """What symbols called ``name`` reach, at most ``cap`` rows, with the reason why a row is no real callee.

    ``dropped``: the callee's file can't define symbols, or both language families are known and differ.
    """
    source = _named(symbols.where(F.col("name") == name), "from", "id", "family").withColumnRenamed("from_id", "src")
    to = _named(symbols, "to", "id", "name", "file", "family", "non_code").withColumnRenamed("to_id", "dst")
    found = _references(edges).join(source, "src").join(to, "dst").orderBy("src", "dst", "type").limit(cap)
    clash = (F.col("from_family") != "") & (F.col("to_family") != "") & (F.col("from_family") != F.col("to_family"))
    reason = F.when(F.col("to_non_code"), "non-code").when(clash, "other-language").otherwise("")
    return found.select("src", "dst", "to_name", "to_file", "type", reason.alias("dropped"))


def callees_answer(symbols: DataFrame, edges: DataFrame, names: list[str], cap: int = CAP) -> DataFrame:
    """``name, n, dropped, line, gap, reason``: a row a name: how many callees are shown, and what the answer lacks.

    Callees that are dropped as collisions of names are a gap; where all were, the answer is empty by that filter and not because nothing is
    called, and says so. Only a name without any row is not in the graph.
    """
    asked = symbols.sparkSession.createDataFrame([(n,) for n in names], "name string")
    told = reduce(DataFrame.unionByName, [callees(symbols, edges, n, cap).select(F.lit(n).alias("name"), "dropped") for n in names])
    n = told.groupBy("name").agg(F.count_if(F.col("dropped") == "").alias("n"), F.count_if(F.col("dropped") != "").alias("dropped"))
    rows = asked.join(n, "name", "left").withColumn("there", F.col("n").isNotNull()).fillna(0, ["n", "dropped"])
    none = F.when(F.col("n") == 0, "\n(no callee survived name-collision filtering)").otherwise("")
    head = F.concat(F.lit("## Callees of "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"), none)
    return rows.select("name", "n", "dropped", F.when(F.col("there"), head).alias("line"), F.when(F.col("dropped") > 0, "name-collisions-dropped").alias("gap"), F.when(~F.col("there"), "not-in-graph").alias("reason"))


def impact(symbols: DataFrame, edges: DataFrame, name: str, cap: int = CAP) -> DataFrame:
    """Callers and real callees in one result with a direction."""
    up = callers(symbols, edges, name, cap).select(F.lit("callers").alias("direction"), "src", "dst", "type")
    down = callees(symbols, edges, name, cap).where("dropped = ''").select(F.lit("callees").alias("direction"), "src", "dst", "type")
    return up.unionByName(down)


def degrees(symbols: DataFrame, edges: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``id, in_degree, out_degree`` over references: from ``kept(id, type, i, o)``, where an index keeps them, else in one pass over the edges."""
    if kept is not None:
        sums = kept.where(F.col("type").isin(*REFERENCES)).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    else:
        ends = _references(edges).select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
        sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return symbols.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def fan_in(symbols: DataFrame, edges: DataFrame, skip: str, fetched: int = FETCHED_FAN_IN, shown: int = SHOWN_FAN_IN, kept: DataFrame | None = None) -> DataFrame:
    """The most referred-to symbols: the first ``fetched`` by edges, then without ``skip``, then ``shown`` of them. ``kept`` as in ``degrees``."""
    if kept is not None:
        n = kept.where(F.col("type").isin(*REFERENCES) & (F.col("i") > 0)).groupBy(F.col("id").alias("dst")).agg(F.sum("i").alias("fan_in"))
    else:
        n = _references(edges).groupBy("dst").agg(F.count("*").alias("fan_in"))
    top = symbols.join(n, symbols["id"] == n["dst"]).orderBy(F.desc("fan_in"), "id").limit(fetched)
    return top.where(f"not ({skip})").orderBy(F.desc("fan_in"), "id").limit(shown).select("id", "name", "file", "fan_in")


def entry_points(symbols: DataFrame, edges: DataFrame, cap: int = 10, kept: DataFrame | None = None) -> DataFrame:
    """Symbols that call but are never referred to."""
    flagged = degrees(symbols, edges, kept).where("in_degree = 0 and out_degree > 0")
    return symbols.join(flagged, "id").orderBy("id").limit(cap).select("id", "name", "file", "out_degree")


def overview(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, key, n``: totals and counts by label, family and edge type."""
    nodes = symbols.groupingSets([[F.col("label")], [F.col("family")], []], "label", "family").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    named = nodes.select(F.when(F.col("g") == 3, "nodes").when(F.col("g") == 1, "label").otherwise("family").alias("section"), F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("label")).otherwise(F.col("family")).alias("key"), "n")
    links = edges.rollup("type").agg(F.grouping("type").alias("g"), F.count("*").alias("n"))
    return named.unionByName(links.select(F.when(F.col("g") == 1, "edges").otherwise("edge_type").alias("section"), F.coalesce("type", F.lit("")).alias("key"), "n"))


def hotspots(symbols: DataFrame, edges: DataFrame, noise: str, shown: int = SHOWN_HOT, fetched: int = 2000, kept: DataFrame | None = None) -> DataFrame:
    """The most complex referred-to functions and methods: ``fetched`` of each label by complexity, noise dropped, ranked."""
    ranked = symbols.join(degrees(symbols, edges, kept).where("in_degree >= 1"), "id")
    slices = [ranked.where(F.col("label") == lb).orderBy(F.desc("complexity"), F.desc("in_degree"), "id").limit(fetched) for lb in ("Function", "Method")]
    both = reduce(DataFrame.unionByName, slices).where(f"not ({noise})")
    return both.orderBy(F.desc("complexity"), F.desc("in_degree"), "label", "id").limit(shown).select("id", "name", "file", "label", "family", "complexity", "in_degree")


def coverage(ranked: DataFrame, key: str, least: int = 5, share: float = 0.9) -> DataFrame:
    """``top, top_n, total, warns``: whether one key holds nearly all of a ranking. Unknown keys don't count."""
    n = ranked.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"))
    one = n.agg(F.max(F.struct("n", F.col(key).alias("k"))).alias("m"), F.sum("n").alias("total"))
    return one.select(F.col("m.k").alias("top"), F.col("m.n").alias("top_n"), "total", F.coalesce((F.col("total") >= least) & (F.col("m.n") / F.col("total") >= share), F.lit(False)).alias("warns"))


def dead(symbols: DataFrame, edges: DataFrame, noise: str) -> DataFrame:
    """Symbols that nothing refers to, longest first (the caller limits)."""
    lone = symbols.join(_references(edges).select(F.col("dst").alias("id")), "id", "left_anti")
    return lone.where(f"not ({noise})").select("id", "name", "file", "lines")


def unused_names(definitions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``name, defined, used`` of ``definitions(name)`` whose ``occurrences(name)`` are no more than the definitions.

    A name is dead only if text shows it no oftener than it is defined.
    """
    have = definitions.groupBy("name").agg(F.count("*").alias("defined"))
    seen = occurrences.groupBy("name").agg(F.count("*").alias("used"))  # combined map-side before they meet
    return have.join(seen, "name", "left").select("name", "defined", F.coalesce("used", F.lit(0)).alias("used")).where("used <= defined")


def payload(symbols: DataFrame, edges: DataFrame, limit: int, noise: str) -> DataFrame:
    """Edges of a call graph with both ends: a bounded fetch, then noise dropped, then ``limit`` edges kept."""
    n = max(1, min(2000, limit))
    fetched = _references(edges).where("type = 'CALLS'").orderBy("src", "dst").limit(min(max(3 * n, 400), 1500))
    ends = fetched.join(_named(symbols.where(f"not ({noise})"), "from", "id", "name").withColumnRenamed("from_id", "src"), "src").join(_named(symbols.where(f"not ({noise})"), "to", "id", "name").withColumnRenamed("to_id", "dst"), "dst")
    return ends.orderBy("src", "dst").limit(n).select("src", "from_name", "dst", "to_name", "type")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order``, which must be total."""
    return rows.withColumn("k__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k__ = 1").drop("k__")


def reach(edges: DataFrame, start: DataFrame, hops: int, back: bool = False, types: tuple[str, ...] = REFERENCES) -> DataFrame:
    """``id, hop``: the fewest hops from ``start(id)``, up to ``hops``.

    Each round extends only ids not met before, so cycles cost nothing; a round is one join on the edges and one on
    the ids met, and is cut, so a plan holds two joins whatever the number of hops. It ends where nothing is new.
    """
    a, b = ("dst", "src") if back else ("src", "dst")
    steps = edges.where(F.col("type").isin(*types)).select(F.col(a).alias("id"), F.col(b).alias("to"))
    front = seen = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, hops + 1):
        met = front.select("id").join(steps, "id").select(F.col("to").alias("id")).distinct()
        front = cut(met.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def risk(hop: Column) -> Column:
    """Our labels: the nearer, the riskier."""
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def chain(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``direction, id, hop, risk`` of everything that ``start`` reaches or that reaches it."""
    out = [reach(edges, start, hops, back).where("hop > 0").select(F.lit(d).alias("direction"), "id", "hop", risk(F.col("hop")).alias("risk")) for d, back in (("callees", False), ("callers", True))]
    return out[0].unionByName(out[1])


def ambiguous(symbols: DataFrame, least: int = 2, shown: int = 5) -> DataFrame:
    """``name, candidates, ids``: names that several symbols bear, with up to five of them.

    Symbols without a name don't count. Names are counted map-side; the window's limit is applied in each task before ids are dealt out, so no task
    holds more of a name than ``shown`` ids from each other.
    """
    some = symbols.groupBy("name").agg(F.count("*").alias("candidates")).where(F.col("candidates") >= least)
    first = symbols.select("name", "id", F.row_number().over(Window.partitionBy("name").orderBy("id")).alias("k")).where(F.col("k") <= shown)
    ids = first.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return some.join(ids, "name").select("name", "candidates", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def chain_answer(symbols: DataFrame, edges: DataFrame, name: str, hops: int, shown: int = 5) -> DataFrame:
    """``section, place, line``: the call chain of the symbol called ``name``, or its bearers where there are several; no rows without one.

    Of an ambiguous name nothing is traversed: which symbol is meant is the asker's to say. A direction that reaches nothing says so.
    """
    bearers = cut(symbols.where(F.col("name") == name).select("id", "name", "file").orderBy("id").limit(shown + 1))  # a few rows
    n = symbols.where(F.col("name") == name).count()
    label = F.concat(F.lit("- "), "name", F.lit(" ("), "file", F.lit(") #"), F.col("id").cast("string"))
    order = Window.orderBy("id")  # of ``shown`` rows at most
    spark = symbols.sparkSession
    if n > 1:
        few = bearers.orderBy("id").limit(shown)
        head = spark.createDataFrame([("head", 0, f"## Ambiguous symbol '{name}' — candidates")], "section string, place int, line string")
        return head.unionByName(few.select(F.lit("candidates").alias("section"), F.row_number().over(order).alias("place"), label.alias("line")))
    if n == 0:
        return spark.createDataFrame([], "section string, place int, line string")
    met = cut(chain(edges, bearers.select("id"), hops))
    named = met.join(symbols.select("id", "name"), "id", "left")
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("?")), F.lit(" [hop "), F.col("hop").cast("string"), F.lit("] [risk: "), "risk", F.lit("]"))
    rows = named.select(F.col("direction").alias("section"), F.col("hop").alias("place"), line.alias("line"))
    empty = spark.createDataFrame([("callees",), ("callers",)], "section string").join(met.select(F.col("direction").alias("section")).distinct(), "section", "left_anti")
    head = spark.createDataFrame([("head", 0, f"## Call chain for {name}")], "section string, place int, line string")
    return head.unionByName(rows).unionByName(empty.select("section", F.lit(0).alias("place"), F.lit("(none)").alias("line"))).where(F.lit(True) if not met.isEmpty() else F.lit(False))


def listing(symbols: DataFrame, edges: DataFrame, label: str | None = None, least: int = 0, most: int | None = None, entry: str | None = None, limit: int = 200, kept: DataFrame | None = None) -> DataFrame:
    """``id, name, file, label, complexity, lines, in_degree, out_degree`` of symbols by label and references to them, in order of id.

    ``entry``, a condition on a symbol, tells the entry points that are left out.
    """
    rows = symbols.join(degrees(symbols, edges, kept), "id").where(F.col("in_degree") >= least)
    rows = rows if label is None else rows.where(F.col("label") == label)
    rows = rows if most is None else rows.where(F.col("in_degree") <= most)
    rows = rows if entry is None else rows.where(f"not ({entry})")
    return rows.orderBy("id").limit(limit).select("id", "name", "file", "label", "complexity", "lines", "in_degree", "out_degree")


def label_line(name: Column, file: Column, edge: Column) -> Column:
    """``- name [EDGE] (file)``; the file is left out where it is the name, the edge where there is none."""
    badge = F.when(F.trim(F.coalesce(edge, F.lit(""))) != "", F.concat(F.lit(" ["), F.trim(edge), F.lit("]"))).otherwise("")
    tail = F.when((F.coalesce(file, F.lit("")) != "") & (file != name), F.concat(F.lit(" ("), file, F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), F.coalesce(F.nullif(name, F.lit("")), F.lit("?")), badge, tail)


def capped(lines: DataFrame, order: list, shown: int) -> DataFrame:
    """``place, line`` of ``lines(line)``: the first ``shown`` in ``order``, then one that says how many more there are."""
    top = lines.orderBy(*order).limit(shown)
    place = F.row_number().over(Window.orderBy(*order))  # of ``shown`` rows at most
    more = lines.agg(F.count("*").alias("n")).where(F.col("n") > shown).select(F.lit(shown + 1).alias("place"), F.concat(F.lit("… (+"), (F.col("n") - shown).cast("string"), F.lit(" more)")).alias("line"))
    return top.select(place.alias("place"), "line").unionByName(more)


def payload_nodes(symbols: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``id, name, file, complexity, lines, in_degree, out_degree`` of both ends of the ``kept`` edges; what is unknown is 0."""
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = ends.join(symbols, "id", "left").join(degrees(symbols, edges), "id", "left")
    return rows.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("file", F.lit("")).alias("file"), zero("complexity"), zero("lines"), zero("in_degree"), zero("out_degree"))


def changed(files: DataFrame, impacted: DataFrame, code: str, shown: int = 40) -> DataFrame:
    """``section, place, line`` of changed ``files(path)`` and ``impacted(label, path)`` symbols: a head, then files, then symbols.

    Each file and symbol counts once. Files that ``code`` (a condition on ``path``) denies are left out, and symbols
    with such a file; symbols without a file stay, bare file markers (the label is the path) don't. Nothing left reads as a clean
    tree, or as changes that are none of source.
    """
    all_files = files.where("coalesce(path, '') <> ''").select("path").distinct()
    sources = all_files.where(code)
    real = impacted.withColumn("label", F.trim("label")).withColumn("path", F.coalesce("path", F.lit(""))).where("coalesce(label, '') <> '' and label <> path").distinct()
    symbols = real.where(f"path = '' or ({code})")
    tagged = [x.select(F.lit(k).alias("k")) for k, x in (("all", all_files), ("files", sources), ("real", real), ("symbols", symbols))]
    n = reduce(DataFrame.unionByName, tagged).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("all", "files", "real", "symbols")])
    dropped = (F.col("all") - F.col("files") + F.col("real") - F.col("symbols")).cast("string")
    head = F.when(F.col("files") + F.col("symbols") > 0, F.concat(F.col("files").cast("string"), F.lit(" files, "), F.col("symbols").cast("string"), F.lit(" symbols")))
    head = head.when(dropped != "0", F.concat(F.lit("no source changes: "), dropped, F.lit(" of other files"))).otherwise("clean")
    tail = F.when(F.col("path") != "", F.concat(F.lit("  ("), F.col("path"), F.lit(")"))).otherwise("")
    one = capped(sources.select(F.concat(F.lit("- "), "path").alias("line")), ["line"], shown)
    two = capped(symbols.select(F.concat(F.lit("- "), F.col("label"), tail).alias("line")), ["line"], shown)
    return n.select(F.lit("head").alias("section"), F.lit(0).alias("place"), head.alias("line")).unionByName(one.select(F.lit("files").alias("section"), "place", "line")).unionByName(two.select(F.lit("symbols").alias("section"), "place", "line"))


def deadcode(symbols: DataFrame, edges: DataFrame, noise: str, entry: str | None = None, words: DataFrame | None = None, fetched: int = 200, shown: int = 30) -> DataFrame:
    """``id, name, file, lines, state``: the longest functions that nothing refers to and no text names more often than it is defined.

    ``words(name, used)`` counts each word of the source texts; without it candidates are ``raw``, with it ``verified``.
    """
    rows = listing(symbols, edges, "Function", most=0, entry=entry, limit=fetched).where(f"not ({noise})")
    if words is not None:
        defined = rows.groupBy("name").agg(F.count("*").alias("defined"))
        live = words.join(defined, "name").where("used > defined").select("name")
        rows = rows.join(live, "name", "left_anti")
    return rows.orderBy(F.desc("lines"), "id").limit(shown).select("id", "name", "file", "lines", F.lit("raw" if words is None else "verified").alias("state"))


def code_map(symbols: DataFrame, edges: DataFrame, noise: str, budget: int, shown: int = SHOWN_FAN_IN) -> DataFrame:
    """``section, place, line``: overview, ranked symbols and entry points in at most ``budget`` bytes, line ends included.

    What does not fit is cut from the end of the ranking, and a notice says so; overview and entry points stay.
    """
    top = fan_in(symbols, edges, noise, shown=shown)  # each part is a few dozen rows at most, so are the windows over them
    ranked = top.select(F.lit("ranked").alias("section"), F.row_number().over(Window.orderBy(F.desc("fan_in"), "id")).alias("place"), F.concat(F.lit("| `"), "name", F.lit("` | "), "file", F.lit(" | "), F.col("fan_in").cast("string"), F.lit(" |")).alias("line"))
    lone = entry_points(symbols, edges)
    entry = lone.select(F.lit("entry").alias("section"), F.row_number().over(Window.orderBy("id")).alias("place"), F.concat(F.lit("- `"), "name", F.lit("` ("), "file", F.lit(")")).alias("line"))
    head = overview(symbols, edges).select(F.lit("overview").alias("section"), F.row_number().over(Window.orderBy("section", "key")).alias("place"), F.concat(F.lit("- "), F.concat_ws(" ", "section", F.nullif(F.col("key"), F.lit(""))), F.lit(": "), F.col("n").cast("string")).alias("line"))
    notice = F.concat(F.lit("> Truncated to fit "), F.lit(str(budget)), F.lit(" bytes."))
    size = F.octet_length("line") + 1
    every = Window.partitionBy(F.lit(1))  # of a few dozen rows
    rows = head.unionByName(entry).unionByName(ranked).withColumn("own", F.when(F.col("section") == "ranked", size).otherwise(0))
    rows = rows.withColumn("all", F.sum(size).over(every)).withColumn("fixed", F.col("all") - F.sum("own").over(every)).withColumn("upto", F.sum("own").over(every.orderBy("place", "section")))
    fits = F.col("all") <= budget
    some = rows.where((F.col("section") != "ranked") | fits | (F.col("fixed") + F.octet_length(notice) + 1 + F.col("upto") <= budget))
    return some.select("section", "place", "line").unionByName(rows.where(~fits).select(F.lit("notice").alias("section"), F.lit(1).alias("place"), notice.alias("line")).distinct())


def deadcode_answer(symbols: DataFrame, edges: DataFrame, noise: str, entry: str | None, words: DataFrame | None, files: int, most: int = VERIFIED_FILES, enabled: bool = False, fetched: int = 200, shown: int = 30) -> DataFrame:
    """``id, name, file, lines, state``: as ``deadcode``, with how far its candidates were held against the source texts.

    The op is withdrawn: without ``enabled`` there are no rows, for a list of names to delete does harm where it is wrong. Candidates are
    ``ok`` if all texts were counted; without texts (``words`` is None) they are ``no-root``; of more than ``most`` ``files`` the
    count would be partial, so candidates stay as they are and are ``capped``.
    """
    state = "no-root" if words is None else "capped" if files > most else "ok"
    rows = deadcode(symbols, edges, noise, entry, words if state == "ok" else None, fetched, shown)
    return rows.where(F.lit(enabled)).withColumn("state", F.lit(state))


def payload_json(symbols: DataFrame, edges: DataFrame, limit: int, noise: str) -> DataFrame:
    """``json``, one row: the call graph's nodes with their measures and its edges, safe inside a script element.

    At most a few hundred edges are fetched, so the row is bounded.
    """
    kept = cut(payload(symbols, edges, limit, noise))
    nodes = payload_nodes(symbols, edges, kept)
    node = F.array_sort(F.collect_list(F.struct("id", "name", "file", "complexity", "lines", "in_degree", "out_degree")))
    link = F.array_sort(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type")))
    both = nodes.agg(node.alias("nodes")).withColumn("k", F.lit(0)).join(kept.agg(link.alias("edges")).withColumn("k", F.lit(0)), "k")
    return both.select(F.replace(F.to_json(F.struct("nodes", "edges")), F.lit("</"), F.lit("<\\/")).alias("json"))
