"""Symbol definitions with references, overviews by kind, and reading a language server's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFINITIONS, REFERENCES = 5, 50
# How a failure in prose begins.
ERRORS = ("error executing tool", "exception:", "traceback (most recent call last)", "the language server manager is not initialized")
REFERENCE_TYPE = "map<string,map<string,array<struct<name_path:string,content_around_reference:string>>>>"


def symbol(definitions: DataFrame, references: DataFrame, name: str, most: int = DEFINITIONS, shown: int = REFERENCES) -> DataFrame:
    """``part, ordinal, path, start, name_path``: up to five definitions of ``name``, then the references of the first.

    ``definitions(id, name_path, path, start)``, ``references(id, path, line, name_path)``; lines count from 0.
    """
    found = definitions.where(F.col("name_path") == name).orderBy("path", "start", "id").limit(most)
    k = F.row_number().over(Window.orderBy("path", "start", "id"))
    numbered = found.withColumn("ordinal", k)
    first = numbered.where("ordinal = 1").select("id")
    refs = references.join(first, "id", "left_semi").orderBy("path", "line", "name_path").limit(shown)
    refs = refs.withColumn("ordinal", F.row_number().over(Window.orderBy("path", "line", "name_path")))
    return numbered.select(F.lit("definition").alias("part"), "ordinal", "path", "start", "name_path").unionByName(refs.select(F.lit("reference").alias("part"), "ordinal", "path", F.col("line").alias("start"), "name_path"))


def symbol_answers(asked: DataFrame, definitions: DataFrame, references: DataFrame, shown: int = REFERENCES) -> DataFrame:
    """``request, state, n_definitions, n_references, head, retry_after`` of ``asked(request, name, found, referred, retry_after)``.

    ``found`` and ``referred`` say whether the language server's two replies came at all. Without the first nothing is known of the
    symbol (``could-not-ask``), which is not that it isn't there (``not-found``). Without the second its references are not
    retrieved, which is not that there are none: ``n_references`` is null and not 0. ``retry_after`` is passed on only where a reply is missing.
    """
    have = definitions.groupBy(F.col("name_path").alias("name")).agg(F.count("*").alias("d"), F.min(F.struct("path", "start", "id")).alias("first"))
    refs = references.groupBy("id").agg(F.count("*").alias("r"))
    known = asked.join(have, "name", "left").withColumn("id", F.col("first.id")).join(refs, "id", "left")
    found, referred = F.coalesce("found", F.lit(False)), F.coalesce("referred", F.lit(False))
    state = F.when(~found, "could-not-ask").when(F.col("d").isNull(), "not-found").when(~referred, "references-not-retrieved").otherwise("complete")
    n = F.when(F.col("state").isin("complete"), F.coalesce("r", F.lit(0)))
    out = known.withColumn("state", state).withColumn("n_references", n)
    head = F.when(F.col("state") == "complete", F.concat(F.lit("### References ("), F.least("n_references", F.lit(shown)).cast("string"), F.lit(")"))).when(F.col("state") == "references-not-retrieved", "### References (not retrieved)")
    return out.select(
        "request", "state", F.when(found, F.coalesce("d", F.lit(0))).alias("n_definitions"), "n_references", head.alias("head"), F.when(~found | ((F.col("state") == "references-not-retrieved")), F.col("retry_after")).alias("retry_after")
    )


def overview(symbols: DataFrame, kind: str) -> DataFrame:
    """``kind, names``: the distinct names of one file by kind, sorted and comma-joined."""
    return symbols.groupBy(F.col(kind).alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def flattened(replies: DataFrame) -> DataFrame:
    """``reply, path, kind, name_path, line`` of ``replies(reply, json)``: the nested map as rows; bad JSON has none."""
    parsed = replies.select("reply", F.from_json("json", REFERENCE_TYPE).alias("m")).where("m is not null")
    files = parsed.select("reply", F.explode("m").alias("path", "kinds"))
    kinds = files.select("reply", "path", F.explode("kinds").alias("kind", "entries"))
    return kinds.select("reply", "path", "kind", F.explode("entries").alias("e")).select("reply", "path", "kind", F.trim(F.coalesce("e.name_path", F.lit(""))).alias("name_path"), reference_line(F.col("e.content_around_reference")).alias("line"))


def reference_line(text: Column) -> Column:
    """The marked line's number as replied, from 0; null without a mark."""
    return F.regexp_extract(text, r">\s*(\d+):", 1).try_cast("int")


def backend_error(text: Column) -> Column:
    """Prose that begins like a failure; a structured reply never counts, whatever it quotes."""
    head = F.lower(F.regexp_replace(text, r"^\s+", ""))
    starts = F.lit(False)
    for e in ERRORS:
        starts = starts | head.startswith(e)
    return ~text.rlike(r"^\s*[\[{]") & starts
