"""Search queries with their SQL equivalents. Vector ``vec_id`` belongs to document ``doc_id``; English documents count as code."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, search
from tessera.sources.views import edges, symbols, table, text_lines

WORD = "erst"


def _query(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _knn(spark, d, k):
    return search.knn(table(spark, d, "embeddings"), _query(spark, d), k)


def _tokens(spark, d):
    return sorted(table(spark, d, "benchmark").where("item_id = 0").select(search.tokens(F.col("text")).alias("t")).first()["t"])


def _candidates(spark, d, k):
    """The k nearest vectors with their documents; only the candidates' texts are kept."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return search.numbered(_knn(spark, d, k)).join(docs, "vec_id")


def _rerank(spark, d):
    c = text_lines(_candidates(spark, d, 30)).withColumn("own", search.owned_text(F.col("lines"), F.lit(0), F.lit(20)))
    ranked = search.fused(c, search.lexical(F.col("own"), _tokens(spark, d)), search.symbol_boost(F.col("own"), WORD))
    return ranked.select("place", "vec_id", F.col("i").cast("int").alias("i"), F.col("lex_rank").cast("int").alias("lex_rank"), F.round("fused", 9).alias("fused"))


def _budget(spark, d):
    top = graph.fan_in(symbols(spark, d), edges(spark, d), "file = 'Brand#1'")
    line = F.concat_ws(" | ", "name", F.col("id").cast("string"), F.col("fan_in").cast("string"))
    return search.within_bytes(top, line, [F.desc("fan_in"), "id"], 300).select("id", "line", F.col("bytes").cast("long").alias("bytes"))


QUERIES = {
    "knn_cosine_topk": lambda s, d: _knn(s, d, 60).select("vec_id", F.round("score", 6).alias("score")),
    "cosine_floor": lambda s, d: search.floored(_knn(s, d, 200), 0.15),
    "lexical_overlap": lambda s, d: table(s, d, "documents").select("doc_id", F.round(search.lexical(F.col("text"), _tokens(s, d)), 6).alias("score")),
    "symbol_boost": lambda s, d: table(s, d, "documents").select("doc_id", search.symbol_boost(F.col("text"), WORD).alias("boost")),
    "rrf_rerank": _rerank,
    "corpus_quota": lambda s, d: search.quota(_candidates(s, d, 60), "lang <> 'en'").select("place", "corpus", "vec_id"),
    "corpus_gaps": lambda s, d: search.corpus_gap(_candidates(s, d, 60), "lang <> 'en'"),
    "byte_budget_prefix": _budget,
}

from .graph_queries import ALL  # noqa: E402

_SCORED = """k AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""
_TOKENS = r"""list_distinct(list_transform(list_concat(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), regexp_extract_all(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')), lambda x: lower(x)))"""
_Q = f"q AS (SELECT {_TOKENS.format(t='text')} AS qt FROM benchmark WHERE item_id = 0)"
_LEX = "len(list_intersect(qt, {tokens})) / len(qt)"
_A, _B = r"(?i)(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_boost = lambda t: f"CASE WHEN regexp_matches({t}, '{_A}(def|class)[ \\t\\r\\n]+{WORD}{_B}') THEN 0.1 WHEN regexp_matches({t}, '{_A}{WORD}{_B}') THEN 0.05 ELSE 0 END"
_TOP = "n AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS i FROM k), c AS (SELECT n.*, text, lang FROM n JOIN documents ON doc_id = vec_id WHERE i < {k})"

ORACLES = {
    "knn_cosine_topk": f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, vec_id LIMIT 60",
    "cosine_floor": f"WITH {_SCORED}, t AS (SELECT * FROM k ORDER BY score DESC, vec_id LIMIT 200) SELECT vec_id, round(score, 6) AS score FROM t WHERE t.score >= 0.15",
    "lexical_overlap": f"WITH {_Q} SELECT doc_id, round({_LEX.format(tokens=_TOKENS.format(t='text'))}, 6) AS score FROM documents, q",
    "symbol_boost": f"SELECT doc_id, CAST({_boost('text')} AS DOUBLE) AS boost FROM documents",
    "rrf_rerank": f"""WITH {_SCORED}, {_TOP.format(k=30)}, {_Q}, o AS (SELECT vec_id, i, array_to_string(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))[1:20], chr(10)) AS own FROM c),
      l AS (SELECT vec_id, i, {_LEX.format(tokens=_TOKENS.format(t='own'))} AS lex, {_boost('own')} AS boost FROM o, q),
      r AS (SELECT *, row_number() OVER (ORDER BY lex DESC, i) - 1 AS lex_rank FROM l), f AS (SELECT *, CAST(1 AS DOUBLE) / (60 + i) + CAST(1 AS DOUBLE) / (60 + lex_rank) + boost AS fused FROM r)
      SELECT CAST(row_number() OVER (ORDER BY fused DESC, i) AS INTEGER) AS place, vec_id, CAST(i AS INTEGER) AS i, CAST(lex_rank AS INTEGER) AS lex_rank, round(fused, 9) AS fused FROM f""",
    "corpus_quota": f"""WITH {_SCORED}, {_TOP.format(k=60)}, g AS (SELECT *, CASE WHEN lang <> 'en' THEN 'prose' ELSE 'code' END AS corpus FROM c),
      h AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY i) AS k, count(*) FILTER (WHERE corpus = 'code') OVER () AS nc, count(*) FILTER (WHERE corpus = 'prose') OVER () AS np FROM g)
      SELECT CAST(row_number() OVER (ORDER BY corpus, k) AS INTEGER) AS place, corpus, vec_id FROM h WHERE k <= CASE WHEN nc = 0 OR np = 0 THEN 10 WHEN corpus = 'code' THEN least(nc, 6) ELSE 10 - least(nc, 6) END""",
    "corpus_gaps": f"""WITH {_SCORED}, {_TOP.format(k=60)}, m AS (SELECT count(*) FILTER (WHERE lang = 'en') AS n_code, count(*) FILTER (WHERE lang <> 'en') AS n_prose FROM c)
      SELECT n_code, n_prose, CASE WHEN n_code = 0 AND n_prose > 0 THEN 'no-code-matches' WHEN n_prose > n_code THEN 'prose-heavy' ELSE '' END AS gap FROM m""",
    "byte_budget_prefix": f"""{ALL}, t AS (SELECT y.id, name, file, n AS fan_in FROM y JOIN (SELECT dst, count(*) AS n FROM r GROUP BY dst) f ON f.dst = y.id ORDER BY n DESC, y.id LIMIT 40),
      s AS (SELECT id, name || ' | ' || id || ' | ' || fan_in AS line, fan_in FROM t WHERE file <> 'Brand#1' ORDER BY fan_in DESC, id LIMIT 30)
      SELECT id, line, bytes FROM (SELECT *, CAST(sum(octet_length(encode(line)) + 1) OVER (ORDER BY fan_in DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM s) WHERE bytes <= 300""",
}
