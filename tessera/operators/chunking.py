"""Cutting texts into chunks, and keeping a catalogue of them by content hash."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import braces
from tessera.operators import intervals
from tessera.storage import cut

WINDOW, STRIDE, CAP, CHARS = 20, 10, 500, 200_000
SYNTAX = "(" + "|".join(re.escape(e) for e in (".py", *(e for ends in braces.FAMILIES.values() for e in ends))) + ")$"
SPANS = "array<struct<start:int,end:int>>"


def _starts(a: Column, b: Column, stride: int) -> Column:
    return F.when(b > a, F.sequence(a, b - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def spans_between(a: Column, b: Column, window: int, stride: int) -> Column:
    """``array<struct<start,end>>``: overlapping windows over [a, b)."""
    return F.transform(_starts(a, b, stride), lambda s: F.struct(s.alias("start"), F.least(s + window, b).alias("end")))


def windows(files: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """``files(path, lines)`` with one row for each window: ``start``, ``end``."""
    return files.withColumn("w", F.explode(spans_between(F.lit(0), F.size("lines"), window, stride))).select(*files.columns, "w.start", "w.end")


def cover(files: DataFrame, primary: DataFrame, window: int = WINDOW, stride: int = STRIDE, whole: int | None = None) -> DataFrame:
    """``path, start, end``: a gapless cover of ``files(path, n)`` by the definitions ``primary(path, start, end)``.

    Gaps are windowed, definitions of over ``whole`` lines (two windows by default) are windowed, overlaps
    are clamped to what came before.
    """
    whole = 2 * window if whole is None else whole
    spans = primary.join(files, "path").select("path", "n", "start", F.least("end", "n").alias("end")).where("start < end")
    tail = files.select("path", "n", F.col("n").alias("start"), F.col("n").alias("end"))
    before = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.unionByName(tail).withColumn("cursor", F.coalesce(F.max("end").over(before), F.lit(0))).withColumn("from", F.greatest("start", "cursor"))
    # the tail row, and any definition that is covered already, only closes the gap before it
    own = F.when(F.col("from") >= F.col("end"), F.array().cast("array<struct<start:int,end:int>>")).when(
        F.col("end") - F.col("from") <= whole, F.array(F.struct(F.col("from").alias("start"), F.col("end").alias("end")))
    ).otherwise(spans_between(F.col("from"), F.col("end"), window, stride))
    gap = F.when((F.col("from") < F.col("end")) | (F.col("start") == F.col("n")), spans_between(F.col("cursor"), F.least("from", "n"), window, stride)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return rows.select("path", F.explode(F.concat(gap, own)).alias("s")).select("path", "s.start", "s.end")


def chunk_text(lines: Column, start: Column, end: Column, closed: Column) -> Column:
    """The chunk's lines with their line ends; ``closed``: the text ends in one."""
    return F.concat(F.array_join(F.slice(lines, start + 1, end - start), "\n"), F.when((end < F.size(lines)) | closed, "\n").otherwise(""))


def covered(definitions: list[tuple[int, int]], n: int, window: int, stride: int) -> list[tuple[int, int]]:
    """``cover`` of one file: between the running maximum of ends and the next start lies a gap, and what a definition adds to that maximum is its own."""
    spans = np.array(sorted((a, min(b, n)) for a, b in definitions if a < min(b, n)), dtype=int).reshape(-1, 2)
    edges = np.concatenate([[0], np.maximum.accumulate(spans[:, 1])]) if len(spans) else np.array([0])
    starts = np.maximum(spans[:, 0], edges[:-1])
    adds = starts < spans[:, 1]
    runs = [(a, b, False) for a, b in zip(np.append(edges[:-1][adds], edges[-1]), np.append(starts[adds], n))] + [(a, b, True) for a, b in zip(starts[adds], spans[adds, 1])]
    whole = [(int(a), int(b)) for a, b, own in runs if own and b - a <= 2 * window]
    cut_up = [(k, min(k + window, int(b))) for a, b, own in runs if not (own and b - a <= 2 * window) for k in range(int(a), int(b), stride)]
    return sorted(whole + cut_up)


def _syntax_spans(window: int, stride: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [[{"start": a, "end": b} for a, b in covered(definitions_of(text, n, path), n, window, stride)] for text, n, path in zip(f["text"], f["lines"].map(len), f["path"])]
            yield f.drop(columns="text").assign(spans=spans)

    return run


def chunks(files: DataFrame, window: int = WINDOW, stride: int = STRIDE, cap: int = CAP, chars: int = CHARS, strategy: str = "syntax") -> DataFrame:
    """``project, path, start, chunk_id, content_hash, content`` of ``files(project, path, lines, closed)``.

    By the strategy ``syntax`` files of Python and of the brace languages are cut at their definitions (one pass, no shuffle), all others
    and those that don't parse by line windows; by ``lines`` all are windowed. The cap counts all spans of a file, also those
    that are dropped for holding no letter.
    """
    files = files.select("project", "path", "lines", "closed")
    is_code = F.lit(strategy == "syntax") & F.coalesce(F.lower("path").rlike(SYNTAX), F.lit(False))
    plain = files.where(~is_code).withColumn("spans", spans_between(F.lit(0), F.size("lines"), window, stride))
    if strategy == "syntax":
        code = files.where(is_code).withColumn("text", F.concat(F.array_join("lines", "\n"), F.lit("\n")))
        plain = plain.unionByName(code.mapInPandas(_syntax_spans(window, stride), f"project string, path string, lines array<string>, closed boolean, spans {SPANS}"))
    spans = plain.select("project", "path", "lines", "closed", F.explode(F.slice("spans", 1, cap)).alias("s")).select("project", "path", "lines", "closed", "s.start", "s.end")
    text = F.substring(chunk_text(F.col("lines"), F.col("start"), F.col("end"), F.col("closed")), 1, chars)
    some = spans.select("project", "path", "start", text.alias("content")).where(F.col("content").rlike(r"\p{L}"))
    return some.withColumn("chunk_id", chunk_id(F.col("project"), F.col("path"), F.col("start"))).withColumn("content_hash", content_hash(F.col("content")))


def chunk_id(project: Column, path: Column, start: Column) -> Column:
    return F.concat_ws(":", F.substring(F.sha2(project, 256), 1, 12), path, start.cast("string"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def ceiling(new: DataFrame, most: int) -> DataFrame:
    """The first ``most`` new chunks by path and start; ``complete``: no chunk of the file was cut off."""
    all_ = new.groupBy("path").agg(F.count("*").alias("have"))
    kept = new.orderBy("path", "start").limit(most)
    got = kept.groupBy("path").agg(F.count("*").alias("got"))
    return kept.join(got, "path").join(all_, "path").select("path", "start", (F.col("got") == F.col("have")).alias("complete"))


def difference(stored: DataFrame, produced: DataFrame, live: DataFrame) -> DataFrame:
    """``chunk_id, path, status``: new, changed, unchanged; stored ones no longer produced are orphan, or deleted with their file.

    ``stored`` and ``produced`` are catalogues (project, path, chunk_id, content_hash), ``live(path)`` the files.
    """
    a = stored.select("chunk_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old"))
    b = produced.select("chunk_id", F.col("path").alias("new_path"), F.col("content_hash").alias("new"))
    both = a.join(b, "chunk_id", "full").withColumn("path", F.coalesce("new_path", "old_path"))
    known = both.join(live.select("path", F.lit(True).alias("live")).distinct(), "path", "left")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNotNull(), F.when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")).when(F.col("live"), "orphan").otherwise("deleted")
    return known.select("chunk_id", "path", status.alias("status"))


def index_pass(stored: DataFrame, produced: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """``chunk_id, path, content_hash, status``: the catalogue after a pass over ``live(path)`` files; catalogues as in ``difference``.

    New and changed chunks are written, the first ``most`` by path and start; a file of which some were cut off is not
    complete: it keeps what was stored of it, and only complete files lose chunks that they no longer produce. Deleted files lose all.
    """
    # each is read several times below; texts are cut up and hashed once
    stored, produced = cut(stored.select("path", "chunk_id", "content_hash")), cut(produced.select("path", "start", "chunk_id", "content_hash"))
    told = cut(difference(stored, produced, live))
    fresh = cut(produced.join(told.where(F.col("status").isin("new", "changed")), ["chunk_id", "path"]))
    kept = cut(ceiling(fresh, most).join(fresh, ["path", "start"]).select("chunk_id", "path", "content_hash", "status", "complete"))
    late = fresh.join(kept.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "path")
    partial = late.select("path").distinct()
    same = stored.join(told.where("status = 'unchanged'").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "path", "content_hash", F.lit("unchanged").alias("status"))
    stale = stored.join(late.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "path", "content_hash", F.lit("stale").alias("status"))
    left = stored.join(told.where("status = 'orphan'").select("chunk_id"), "chunk_id", "left_semi").join(partial, "path", "left_semi").select("chunk_id", "path", "content_hash", F.lit("orphan").alias("status"))
    return kept.drop("complete").unionByName(same).unionByName(stale).unionByName(left)


def orphans(stored: DataFrame, produced: DataFrame, complete: DataFrame) -> DataFrame:
    """Stored chunks that a fully processed file no longer produces."""
    return stored.join(complete.select("path").distinct(), "path", "left_semi").join(produced.select("chunk_id"), "chunk_id", "left_anti")


def deleted_files(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.select("path").distinct().join(live.select("path"), "path", "left_anti")


def upsert(stored: DataFrame, produced: DataFrame) -> DataFrame:
    """The catalogue after a pass: produced rows replace stored ones of the same chunk."""
    return stored.join(produced.select("chunk_id"), "chunk_id", "left_anti").select(*stored.columns).unionByName(produced.select(*stored.columns))


def next_start(catalogue: DataFrame) -> DataFrame:
    """``next``: the start of the file's following chunk, null for the last."""
    return catalogue.withColumn("next", F.lead("start").over(Window.partitionBy("path").orderBy("start")))


def matching_lines(files: DataFrame, pattern: str) -> DataFrame:
    """``path, n, lines`` of files with matching lines; lines are numbered from 1 and comma-joined."""
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    return files.select("path", numbers.alias("at")).where(F.size("at") > 0).select("path", F.size("at").alias("n"), F.array_join(F.transform("at", lambda i: i.cast("string")), ",").alias("lines"))


def matching_places(files: DataFrame, pattern: str) -> DataFrame:
    """``path, i``: a row for each matching line of ``files(path, lines)``, from 0. Lines are tested where they lie; no text is shuffled."""
    found = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    return files.select("path", F.explode(found).alias("i"))


def matches_by_symbol(files: DataFrame, definitions: DataFrame, pattern: str, width: int = intervals.WIDTH) -> DataFrame:
    """``path, name, start, n, lines``: matching lines of ``files(path, lines)`` by the innermost of ``definitions(path, name, start, end)``.

    Lines outside any definition have no name. Lines are numbered from 1. A file is cut into runs of ``width`` lines, so many
    matches and definitions of one file are many tasks' work, linear in both but for a logarithm.
    """
    named = intervals.innermost(matching_places(files, pattern), definitions, "path", "i", width=width).withColumn("name", F.coalesce("name", F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("i") + 1)), lambda x: x.cast("string")), ",")
    return named.groupBy("path", "name", F.col("start").cast("int").alias("start")).agg(F.count("*").alias("n"), lines.alias("lines"))


def pattern_lines(files: DataFrame, definitions: DataFrame, pattern: str) -> DataFrame:
    """``place, line``: the answer to a pattern: a head with the number of symbols, then one line each; or that nothing matched.

    A symbol's line names its file and first line (from 1) and the matching lines; what lies outside any definition goes by its file alone.
    """
    got = matches_by_symbol(files, definitions, pattern)
    label = F.concat(F.col("path"), F.when(F.col("start").isNotNull(), F.concat(F.lit(":"), (F.col("start") + 1).cast("string"))).otherwise(""))
    line = F.concat(F.lit("- "), F.when(F.col("name") != "", F.concat("name", F.lit(" "))).otherwise(""), label, F.lit("  (lines "), F.replace(F.col("lines"), F.lit(","), F.lit(", ")), F.lit(")"))
    body = got.select(line.alias("line"))
    head = body.agg(F.count("*").alias("n")).withColumn("head", F.concat(F.lit(f'## Pattern matches for "{pattern}"'), F.when(F.col("n") > 0, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.lit("\n(no matches)"))))
    return head.select(F.lit(0).alias("place"), F.col("head").alias("line")).unionByName(body.select(F.lit(1).alias("place"), "line"))


_DEFINES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _lines(node: ast.stmt) -> tuple[int, int]:
    """The lines of a definition, its decorators included, from 0, half-open."""
    return min(x.lineno for x in (node, *node.decorator_list)) - 1, node.end_lineno


def python_definitions(source: str, n: int) -> list[tuple[int, int]]:
    """Half-open line spans of top-level functions and, for classes, a header and each member."""
    out = []
    for top in (x for x in ast.parse(source).body if isinstance(x, _DEFINES)):
        inner = [_lines(x) for x in top.body if isinstance(top, ast.ClassDef) and isinstance(x, _DEFINES)]
        begin, end = _lines(top)
        out += [(begin, min([end, *(a for a, _ in inner)])), *inner]
    return sorted((a, min(b, n)) for a, b in out if a < min(b, n))


def definitions_of(source: str, n: int, path: str = ".py") -> list[tuple[int, int]]:
    """The spans of a file's definitions by its ending; text that doesn't parse has none, so windows cover it."""
    if family := braces.family_of(path):
        return braces.definitions(source, family, n)
    try:
        return python_definitions(source, n)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def definition_spans(files: DataFrame) -> DataFrame:
    """``path, start, end`` of the definitions in ``files(path, text, n)``, by the ending of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, a, b) for path, text, n in zip(f["path"], f["text"], f["n"]) for a, b in definitions_of(text, n, path)]
            yield pd.DataFrame(rows, columns=["path", "start", "end"])

    return files.select("path", "text", "n").mapInPandas(run, "path string, start int, end int")


def python_spans(files: DataFrame) -> DataFrame:
    """``path, start, end`` of the definitions in Python ``files(path, text, n)``, whatever they are called."""
    return definition_spans(files.withColumn("path", F.concat("path", F.lit(".py")))).withColumn("path", F.expr("substring(path, 1, length(path) - 3)"))
