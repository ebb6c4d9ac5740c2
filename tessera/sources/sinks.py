"""Sinks: maps, injected blocks, graph pages, metric lines, catalogues and resets."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<!-- code-map:start -->", "<!-- code-map:end -->"
STUB = "_No index yet._"


def write_map(path: str, text: str) -> bool:
    """Writes the map unless it would replace a populated one with a stub."""
    p = Path(path)
    if STUB in text and p.exists() and STUB not in p.read_text(encoding="utf-8"):
        return False
    p.write_text(text, encoding="utf-8")
    return True


_BLOCK = re.compile(re.escape(START) + "(?:.*?" + re.escape(END) + ")?", re.DOTALL)


def injected(content: str, block: str) -> tuple[str, str]:
    """``content`` with the marked block, and what was done: updated, repaired or appended. Repeating changes nothing.

    The first start mark and what follows up to its end mark give way to the block. A start mark without an end after
    it, while an end stands before it, is repaired: the block takes the rest of the content.
    """
    full, found = f"{START}{block}{END}", _BLOCK.search(content)
    whole = bool(found) and found[0].endswith(END)
    if whole or (found and END in content):
        return content[: found.start()] + full + (content[found.end() :] if whole else ""), "updated" if whole else "repaired"
    return re.sub(r"(\n?)\Z", "\n\n", content, count=1) + full, "appended"


def spliced(content: Column, block: str) -> tuple[Column, Column]:
    """``injected`` for a column of contents: the new content, and what was done. A null counts as empty."""
    content, full = F.coalesce(content, F.lit("")), F.lit(f"{START}{block}{END}")
    past = lambda text, mark: F.substr(text, F.length(F.substring_index(text, mark, 1)) + 1 + len(mark))
    before, after = F.substring_index(content, START, 1), past(content, START)
    opened = F.contains(content, F.lit(START))
    whole = opened & F.contains(after, F.lit(END))
    stray = opened & F.contains(content, F.lit(END))
    text = F.when(whole, F.concat(before, full, past(after, END))).when(stray, F.concat(before, full)).otherwise(F.concat(F.regexp_replace(content, r"\n\z", ""), F.lit("\n\n"), full))
    return text, F.when(whole, "updated").when(stray, "repaired").otherwise("appended")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, line``: nodes and edges as JSON that is safe inside a script element."""
    safe = lambda c: F.replace(F.to_json(c), F.lit("</"), F.lit("<\\/"))
    return nodes.select(F.lit("node").alias("part"), safe(F.struct("id", "name", "file")).alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), safe(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type")).alias("line")))


def graph_page(payload: dict, template: str) -> str:
    return template.replace("__DATA__", json.dumps(payload, default=str).replace("</", "<\\/"))


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """Chunks by project, so that a reset or a search of one project touches its files alone; a large one is
    dealt out over tasks by path."""
    catalogue.repartition("project", F.pmod(F.xxhash64("path"), F.lit(64))).sortWithinPartitions("path", "start").write.mode("overwrite").partitionBy("project").parquet(path)


def without_project(catalogue: DataFrame, project: str) -> DataFrame:
    return catalogue.where(F.col("project") != project)


def of_present(catalogue: DataFrame, roots: DataFrame) -> DataFrame:
    """The catalogue without the projects that are not in ``roots(project)``: whose root is gone is forgotten."""
    return catalogue.join(roots.select("project").distinct(), "project", "left_semi")


def reset_counts(catalogue: DataFrame) -> DataFrame:
    """What a reset of each project would remove, without removing it."""
    return catalogue.groupBy("project").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"))
