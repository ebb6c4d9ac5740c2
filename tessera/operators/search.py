"""Exact vector search with a floor, lexical rerank by rank fusion, and a quota for each corpus.

The query vector is one literal; scoring is a projection and the top-k a bounded heap in each task
(TakeOrderedAndProject), so nothing but at most ``FETCH`` rows reaches one place. Windows over candidates
have no partition key because candidates are bounded by that number. Only ids, places and scores go through the top-k;
texts are fetched afterwards, for the survivors alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.sources.views import text_lines
from tessera.storage import cut

FETCH, FLOOR, RRF, BOOST, READ_LINES, SNIPPET, DISPLAY = 200, 0.25, 60, 0.1, 40, 5, 10
#: Hits for each one shown: what is shown is divided between code and prose, so more must be found.
WIDEN = 6
IDENTIFIER = r"[\p{L}\p{N}_]+"
PIECES = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(column: str) -> Column:
    return F.sqrt(_dot(F.col(column), F.col(column)))


def cosine(column: str, query: list[float], length: Column | None = None) -> Column:
    """In double precision; null for a vector of length zero. ``length``: the vector's norm, where it is stored."""
    q = F.array(*[F.lit(float(x)) for x in query])
    both = (norm(column) if length is None else length) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(both > 0, _dot(F.col(column), q) / both)


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``vec_id, score``: the k rows with the highest cosine, ties to the smaller id."""
    return vectors.select("vec_id", cosine("embedding", query).alias("score")).where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


def floored(found: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Scores under the floor go, by the exact score; what stays is rounded to 6 digits."""
    return found.where(F.col("score") >= floor).withColumn("score", F.round("score", 6))


def tokens(text: Column) -> Column:
    """Identifiers and their camel or snake pieces, lower-cased, each once."""
    all_ = F.concat(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)))
    return F.array_distinct(F.transform(all_, F.lower))


def lexical(text: Column, query_tokens: list[str]) -> Column:
    """The share of the query's tokens that the text has."""
    if not query_tokens:
        return F.lit(0.0)
    return shared_tokens(text, F.array(*[F.lit(t) for t in query_tokens]))


def shared_tokens(text: Column, wanted: Column) -> Column:
    """The share of the tokens in ``wanted`` that the text has; without any it is 0."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens(text))) / F.size(wanted)).otherwise(0.0)


def symbol_boost(text: Column, query: str, boost: float = BOOST) -> Column:
    """Only for a query that is one identifier: its definition in the text, or else the word alone, counts extra."""
    q = query.strip()
    if not q.isidentifier():
        return F.lit(0.0)
    a, b = r"(?i)(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    return F.when(text.rlike(rf"{a}(def|class)[ \t\r\n]+{q}{b}"), F.lit(boost)).when(text.rlike(a + q + b), F.lit(boost / 2)).otherwise(0.0)


def owned_text(lines: Column, start: Column, following: Column) -> Column:
    """What a chunk owns of its file: up to the next stored chunk, at most ``READ_LINES`` lines, at least one."""
    n = F.least(F.lit(READ_LINES), F.greatest(F.lit(1), F.coalesce(following - start, F.lit(READ_LINES))))
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def fused(candidates: DataFrame, lex: Column, boost: Column, k: int = RRF) -> DataFrame:
    """Candidates (in cosine order ``i`` from 0) reordered by reciprocal rank fusion plus the boost."""
    rank = F.row_number().over(Window.orderBy(F.desc("lex"), "i")) - 1
    score = 1 / (k + F.col("i")) + 1 / (k + F.col("lex_rank")) + F.col("boost")
    got = candidates.withColumn("lex", lex).withColumn("boost", boost).withColumn("lex_rank", rank).withColumn("fused", score)
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fused"), "i")))


def numbered(found: DataFrame) -> DataFrame:
    """``i``: the place of each bounded result in cosine order, from 0."""
    return found.withColumn("i", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1)


def quota(hits: DataFrame, prose: str, display: int = DISPLAY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Code first, then prose: two thirds of the places for code if both have hits, no backfill. ``carry`` comes along."""
    kind = hits.withColumn("corpus", F.when(F.expr(prose), "prose").otherwise("code"))
    kind = kind.withColumn("k", F.row_number().over(Window.partitionBy("corpus").orderBy("i")))
    every = Window.partitionBy(F.lit(1))
    kind = kind.withColumn("n_code", F.count_if(F.col("corpus") == "code").over(every)).withColumn("n_prose", F.count_if(F.col("corpus") == "prose").over(every))
    both = (F.col("n_code") > 0) & (F.col("n_prose") > 0)
    keep = F.least("n_code", F.lit(max(1, display * 2 // 3)))
    most = F.when(~both, F.lit(display)).when(F.col("corpus") == "code", keep).otherwise(F.lit(display) - keep)
    return kind.where(F.col("k") <= most).withColumn("place", F.row_number().over(Window.orderBy("corpus", "k"))).select("place", "corpus", "vec_id", "score", *carry)


def corpus_gap(hits: DataFrame, prose: str) -> DataFrame:
    """``n_code, n_prose, gap``: whether prose alone, or mostly prose, was found."""
    n = hits.agg(F.count_if(~F.expr(prose)).alias("n_code"), F.count_if(F.expr(prose)).alias("n_prose"))
    return n.withColumn("gap", F.when((F.col("n_code") == 0) & (F.col("n_prose") > 0), "no-code-matches").when(F.col("n_prose") > F.col("n_code"), "prose-heavy").otherwise(""))


def within_bytes(ranked: DataFrame, line: Column, order: list, budget: int) -> DataFrame:
    """The longest prefix of a bounded ranking whose UTF-8 lines fit the budget, line ends included."""
    sized = ranked.withColumn("line", line).withColumn("bytes", F.sum(F.octet_length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("bytes") <= budget)


def hits(catalogue: DataFrame, files: DataFrame, query: list[float], text: str, project: str, k: int, floor: float = FLOOR, rerank: object = "on", candidates: int = 30) -> DataFrame:
    """``i, vec_id, path, start, next, score, lines``: at most ``k`` chunks of one project in the order of the answer, from 0.

    ``catalogue(project, path, start, next, vec_id, embedding)`` holds chunks with the start of the file's next one, and their ``norm`` where it is
    stored; ``files(project, path, text)`` the texts. The project is filtered before any distance. With rerank on, at
    least ``candidates`` chunks are fetched and fused with their lexical ranks; with it off, or of a lone candidate, cosine
    decides. A file's text is read and cut into lines only for the chunks that came through; a file that is gone counts as empty.
    """
    fuse = str(rerank).strip().lower() not in ("off", "false", "0", "no", "none")
    length = F.col("norm") if "norm" in catalogue.columns else None
    mine = catalogue.where(F.col("project") == project).select("vec_id", "path", "start", "next", cosine("embedding", query, length).alias("score"))
    near = cut(numbered(mine.where(F.col("score") >= floor).orderBy(F.desc("score"), "vec_id").limit(max(k, min(candidates, FETCH)) if fuse else k)))
    wanted = F.broadcast(near.select("path").distinct())  # a few hundred rows at most
    texts = files.where(F.col("project") == project).select("path", "text").join(wanted, "path", "left_semi")
    rows = text_lines(near.join(texts, "path", "left").withColumn("text", F.coalesce("text", F.lit(""))))
    if fuse:
        own = owned_text(F.col("lines"), F.col("start"), F.col("next"))
        rows = fused(rows, shared_tokens(own, tokens(F.lit(text))), symbol_boost(own, text)).withColumn("i", F.col("place") - 1)
    return rows.where(F.col("i") < k).select("i", "vec_id", "path", "start", "next", "score", "lines")


def answer(catalogue: DataFrame, files: DataFrame, query: list[float], text: str, project: str, prose: str, k: int = DISPLAY, floor: float = FLOOR, rerank: object = "on", candidates: int = 30) -> DataFrame:
    """``place, corpus, vec_id, path, line, score, snippet, shown``: the answer to a search in one project; tables as in ``hits``.

    ``WIDEN`` hits are found for each of the ``k`` that are shown, and divided between code and prose: a project full of
    prose that speaks the question's language would else show nothing of its code. ``shown`` is the line of the answer.
    """
    head = F.slice("lines", F.col("start") + 1, F.lit(SNIPPET))
    found = hits(catalogue, files, query, text, project, WIDEN * k, floor, rerank, candidates).withColumn("head", head)
    label = F.concat(paths.line_label(F.col("path"), F.col("start")), F.lit(" | "), paths.first_meaningful(F.col("head")))
    placed = quota(found, prose, k, ("path", "start", "head"))
    return placed.select("place", "corpus", "vec_id", "path", (F.col("start") + 1).alias("line"), F.round("score", 6).alias("score"), F.rtrim(F.array_join("head", "\n")).alias("snippet"), label.alias("shown")).orderBy("place")


def envelope(catalogue: DataFrame, files: DataFrame, query: list[float], text: str, project: str, prose: str, k: int = DISPLAY, floor: float = FLOOR, rerank: object = "on", candidates: int = 30) -> DataFrame:
    """``result, gap, reason, confidence``, one row: the lines of the answer, what it lacks, or why there is none.

    A project without chunks has no index; one whose chunks all stay under the floor has no answer. Prose alone, and more prose than
    code among all hits, is a gap: that no code was found says nothing about the code.
    """
    found = hits(catalogue, files, query, text, project, WIDEN * k, floor, rerank, candidates).withColumn("head", F.slice("lines", F.col("start") + 1, F.lit(SNIPPET)))
    label = F.concat(paths.line_label(F.col("path"), F.col("start")), F.lit(" | "), paths.first_meaningful(F.col("head")))
    every = Window.partitionBy(F.lit(1))  # of ``WIDEN * k`` hits at most
    known = found.withColumn("prose", F.expr(prose)).withColumn("code", F.count_if(~F.col("prose")).over(every)).withColumn("other", F.count_if("prose").over(every))
    rows = quota(known, prose, k, ("path", "start", "head", "code", "other")).withColumn("shown", label)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]), "\n")
    code, other = F.max("code"), F.max("other")
    said = rows.agg(F.count("*").alias("n"), lines.alias("lines"), F.when((code == 0) & (other > 0), "no-code-matches").when(other > code, "prose-heavy").otherwise("").alias("gap"))
    there = catalogue.where(F.col("project") == project).select(F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("there"))
    both = said.withColumn("key", F.lit(0)).join(there.withColumn("key", F.lit(0)), "key")
    some = F.col("n") > 0
    return both.select(
        F.when(some, F.col("lines")).alias("result"), F.col("gap"), F.when(F.col("there") == 0, "no-index").when(~some, "below-floor").alias("reason"),
        F.when(some, F.when(F.col("gap") != "", "partial").otherwise("complete")).alias("confidence"),
    )
