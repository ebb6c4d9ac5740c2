"""Source trees as tables: the walk, ignore rules, line reading and settings.

Path rules are filters on the path alone and come before those on content.
"""

from __future__ import annotations

import math
import os
import re
import tomllib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.storage import cut

# Folders that never hold a project's own source: tools' and caches', build output of web tools, old copies;
# and folders that hold output at a project's root.
SKIPPED = (
    "__pycache__", ".git", "node_modules", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".tox", ".idea", ".vscode", ".cache",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache",
    ".archive", ".archived", "_archive", "_archived", ".backup", ".backups", ".old", ".deprecated", ".trash",
)
SKIPPED_AT_ROOT = ("out", "vendor", "vendored", "third_party", "thirdparty", "site-packages", "coverage", "generated", "dist", "build", "target")
PACKAGE_MARKERS = ("__init__.py", "package.json", "index.ts", "index.js", "go.mod", "Cargo.toml")
INDEXED = (*paths.CODE_EXTS, ".md")
# Settings with their defaults, and what the others than numbers may be.
DEFAULTS = {
    "backend": "auto", "semantic": "on", "reindex": "on-demand", "window": 20, "stride": 10, "max_chunks": 500, "max_total_chunks": 100_000,
    "cosine_floor": 0.25, "model": "BAAI/bge-small-en-v1.5", "chunk_strategy": "syntax", "rerank": "on", "rerank_candidates": 30,
}
CHOICES = {"backend": ("auto", "graph", "lsp", "semantic"), "semantic": ("on", "off"), "reindex": ("on-demand", "never"), "chunk_strategy": ("syntax", "lines"), "rerank": ("on", "off")}
_PLAIN_NAME = re.compile(r"^[ \t]*/?(?![#!\s])([^*/\n]*[^*/\s])/?[ \t]*$", re.MULTILINE)
_MARKED = re.compile(r"^[ \t]*([^#\s]\S*)[^\n]*?\slinguist-(?:generated|vendored)(?:=true)?(?=\s|$)", re.MULTILINE | re.IGNORECASE)


def ignored_names(gitignore: str) -> list[str]:
    """Plain names of an ignore file, each once: comments, negations, globs and paths are left out."""
    return list(dict.fromkeys(m[1] for m in _PLAIN_NAME.finditer(gitignore)))


def declared_globs(gitattributes: str) -> list[str]:
    """Patterns that the project itself marks as generated or vendored."""
    return [m[1] for m in _MARKED.finditer(gitattributes)]


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for full, path in zip(f["full"], f["path"]):
            where, name = fs.FileSystem.from_uri(full)
            try:
                with where.open_input_stream(name) as stream:
                    content = stream.read()
            except OSError:  # gone since it was listed, or not ours to read
                continue
            yield pd.DataFrame({"path": [path], "content": [content]})


#: Folders that a task lists before it hands on those that it met.
FOLDERS = 256
#: Tasks over which the folders of a round are dealt out.
ROUND_TASKS = 64


def _listed(top: str, skip: tuple[str, ...], most: int):
    """``full, path, is_folder``: the files below each given folder of ``top``, and the folders that are left over after ``most`` were listed.

    Folders that can't be listed, or are gone, hold nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(top)
        local = isinstance(system, fs.LocalFileSystem)
        real = os.path.realpath(root) if local else root
        todo = [unquote(f) for frame in frames for f in frame["folder"]]  # of one round, dealt out over tasks
        for _ in range(most):
            if not todo:
                return
            here, rows = todo.pop(), []
            try:
                entries = system.get_file_info(fs.FileSelector(f"{root}/{here}" if here else root, allow_not_found=True))
            except OSError:
                continue
            for x in entries:
                path = f"{here}/{x.base_name}" if here else x.base_name
                target = os.path.realpath(x.path) if local else ""
                if local and os.path.commonpath([real, target]) != real:
                    continue  # a link out of the tree
                if x.type == fs.FileType.File:
                    if not local or os.stat(x.path).st_nlink == 1:  # else it may be a file from outside under a second name
                        rows.append((f"{top}/{quote(path)}", path, False))
                elif x.type == fs.FileType.Directory and x.base_name not in skip and not (local and _is_loop(real, target, path)):
                    todo.append(path)
            yield pd.DataFrame(rows, columns=["full", "path", "is_folder"])
        yield pd.DataFrame([("", quote(f), True) for f in todo], columns=["full", "path", "is_folder"])

    return run


def _is_loop(root: str, target: str, path: str) -> bool:
    """A link to a folder that it lies in, or to one that is listed under its own name."""
    return target != os.path.normpath(f"{root}/{path}")


def list_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, folders: int = FOLDERS) -> DataFrame:
    """``full, path`` (below the root) of every file outside folders named in ``skip``.

    Listed in rounds: a task lists up to ``folders`` folders below those that it was given, and what is left is dealt out again, so a tree
    whose files all lie below one folder is many tasks' work, and a small one a single round. ``contents`` reads where ``full`` says.
    Links that lead out of the tree are left out, as are links to folders (those have names of their own) and files with several hard links.
    Spark's own file sources leave out names that begin with an underscore, which source trees are full of.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(base).toUri().toString().rstrip("/")
    top = top if "://" in top else top.replace(":/", ":///", 1)
    todo, found = spark.createDataFrame([("",)], "folder string"), []
    while True:
        got = cut(todo.mapInPandas(_listed(top, tuple(skip), folders), "full string, path string, is_folder boolean"))
        found.append(got.where("not is_folder").select("full", "path"))
        left = got.where("is_folder")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        todo = left.select(F.col("path").alias("folder")).repartition(ROUND_TASKS, "folder")


def contents(listed: DataFrame) -> DataFrame:
    """``path, content`` of listed files; one that is gone or can't be read has no row."""
    return listed.select("full", "path").repartition(F.xxhash64("path")).mapInPandas(_contents, "path string, content binary")


def _folders(path: Column) -> Column:
    s = F.split(path, "/")
    return F.slice(s, F.lit(1), F.greatest(F.lit(0), F.size(s) - 1))


def worth_reading(tree: DataFrame, ignored: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """The files of a listing that path rules let through.

    A folder name that means output at the root is kept if the folder is itself a package (has a marker file).
    """
    p, names = F.col("path"), [*SKIPPED, *ignored]
    folders = _folders(p)
    fine = ~F.exists(folders, lambda s: s.isin(*names) | s.endswith(".egg-info")) & ~F.element_at(F.split(p, "/"), -1).isin(*names)
    fine = fine & paths.extension(p).isin(*INDEXED) & ~paths.generated_path(p)
    for g in globs:
        fine = fine & ~paths.glob(p, g)
    own = tree.where(F.element_at(F.split(p, "/"), -1).isin(*PACKAGE_MARKERS) & (F.size(F.split(p, "/")) == 2)).select(F.element_at(F.split(p, "/"), 1).alias("top")).distinct()
    kept = tree.where(fine).withColumn("top", F.get(folders, F.lit(0)))
    output = F.coalesce(F.lower("top").isin(*SKIPPED_AT_ROOT), F.lit(False))
    return kept.join(own.withColumn("own", F.lit(True)), "top", "left").where(~output | F.coalesce("own", F.lit(False))).select(*tree.columns)


def source_files(tree: DataFrame, ignored: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """``path, text`` of the files worth indexing of a listing: path rules first, then binary and generated content.

    Bytes that aren't UTF-8 read as replacement characters, so a file in another encoding is read for what it has in common.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return contents(worth_reading(tree, ignored, globs)).where(~paths.binary(F.col("content"))).select("path", text.alias("text")).where(~paths.generated_file(F.col("text")))


def settings(*texts: str) -> dict:
    """Defaults overlaid by TOML texts, later ones last; unreadable text and unusable values leave the default."""
    given: dict = {}
    for t in texts:
        try:
            given |= tomllib.loads(t)
        except tomllib.TOMLDecodeError:
            continue
    usable = {k: _usable(k, v) for k, v in given.items()}
    return DEFAULTS | {k: v for k, v in usable.items() if v is not None}


def _usable(key: str, value: object) -> object | None:
    """The value as its setting takes it, or None; unknown keys pass as they are."""
    kind = type(DEFAULTS.get(key))
    try:
        if kind is int:
            return n if (n := int(value)) > 0 else None
        if kind is float:
            return None if math.isnan(x := float(value)) else min(1.0, max(0.0, x))
    except (TypeError, ValueError, OverflowError):
        return None
    if key in CHOICES:
        return word if (word := str(value).strip().lower()) in CHOICES[key] else None
    return (str(value).strip() or None) if kind is str else value
