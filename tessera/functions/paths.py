"""Predicates on file paths and texts: generated, prose, code, archived, test, noise, language."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and patterns that decide the classes.
GENERATED_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "site-packages", "pods", "venv", ".venv", "__pycache__",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".gradle", ".terraform", ".angular", ".docusaurus", ".vercel", ".serverless", ".webpack", ".output", "_build",
    "deriveddata", "htmlcov", ".nyc_output", "_generated", "__generated__",
    ".archive", ".archived", "_archive", "_archived", ".backup", ".backups", ".bak", ".old", ".deprecated", ".trash",
)
GENERATED_PREFIXES = ("bazel-", "cmake-build-")
GENERATED_NAME = (
    r"^(.*\.min\.(js|css|mjs|cjs)|.*[.\-_]bundle\.(js|css|mjs|cjs)|.*\.pb\.(go|cc|h|py)|.*_pb2(_grpc)?\.pyi?|.*_pb\.(js|ts)|.*\.generated\.[a-z0-9]+|.*\.g\.(dart|cs|kt)"
    r"|.*\.designer\.cs|.*\.d\.ts|.*\.(map|lock)|(package-lock|yarn|pnpm-lock|composer|poetry|cargo|gemfile)\.(json|lock|yaml))$"
)
BANNER = (
    r"(?i)(@generated\b|\bcode generated by\b|\bgenerated by\b.{0,40}\bdo not edit\b|\bautogenerated\b|\bauto-generated\b|\bdo not edit\b.{0,40}\bgenerated\b"
    r"|\bthis file (was|is) automatically generated\b)"
)
BANNER_LINES, SAMPLE, LONG_LINE, LARGE, LARGE_MEAN = 40, 8192, 2000, 50_000, 200
PROSE_EXTS = (".md", ".mdx", ".markdown", ".rst", ".txt", ".adoc", ".org")
PROSE_PARTS = ("/docs/", "/doc/", "/snapshots/", "/__snapshots__/", "/.archive/", "/adr/", "/rfc/", "/changelog/")
CODE_EXTS = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh")
ARCHIVE_DIRS = (".archive", ".archived", ".backup", ".backups", ".bak", ".old", ".deprecated", ".trash", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".gradle", ".terraform")
OUTPUT_DIRS = (
    "node_modules", "__pycache__", "dist", "build", "out", "target", "vendor", "vendored", "third_party", "thirdparty", "venv", "env", "site-packages", "coverage", "generated",
)
NON_CODE_EXTS = (
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".md", ".mdx", ".rst", ".txt", ".csv", ".tsv", ".lock", ".log",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".html", ".htm", ".css", ".scss", ".sass", ".less",
)
FAMILIES = {
    "python": (".py", ".pyi", ".pyx"), "ts-js": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"), "go": (".go",), "rust": (".rs",), "ruby": (".rb",), "php": (".php",),
    "jvm": (".java", ".kt", ".scala"), "c-cpp": (".c", ".h", ".cc", ".cpp", ".hpp"), "dotnet": (".cs",), "swift": (".swift",), "shell": (".sh", ".bash"),
}
FILE_NAMES = (
    "py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "rs", "java", "kt", "rb", "php", "cs", "swift", "scala", "c", "h", "cpp", "cc", "hpp", "css", "scss", "less", "html", "vue", "svelte",
    "md", "mdx", "rst", "txt", "json", "yaml", "yml", "toml", "ini", "cfg", "xml", "sql", "sh", "bash", "zsh", "graphql", "proto",
)


def segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda s: s != "")


def basename(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(segments(path)), F.lit(0)), F.lit(""))


def directories(path: Column) -> Column:
    s = segments(path)
    return F.slice(s, F.lit(1), F.greatest(F.lit(0), F.size(s) - 1))


def extension(path: Column) -> Column:
    """From the last dot of the name, lower-cased; a name that only begins with dots has none."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1)


def generated_path(path: Column) -> Column:
    named = F.exists(directories(path), lambda s: s.isin(*GENERATED_DIRS) | s.startswith(GENERATED_PREFIXES[0]) | s.startswith(GENERATED_PREFIXES[1]))
    return named | basename(path).rlike(GENERATED_NAME)


def generated_text(text: Column) -> Column:
    """A generator's banner near the top, a line no human writes, or a large text of long lines."""
    top = F.array_join(F.slice(F.split(F.substring(text, 1, SAMPLE), "\n"), 1, BANNER_LINES), "\n")
    lines = F.split(text, "\n")
    longest = F.array_max(F.transform(lines, F.length))
    return top.rlike(BANNER) | (longest > LONG_LINE) | ((F.length(text) > LARGE) & (F.length(text) / F.size(lines) > LARGE_MEAN))


def generated_file(text: Column) -> Column:
    """As ``generated_text``; a sample without any line end counts too, even of a tiny file."""
    return ~F.contains(F.substring(text, 1, SAMPLE), F.lit("\n")) | generated_text(text)


def glob(path: Column, pattern: str) -> Column:
    """A shell pattern on the path or any tail of it; one without a star at its end also names a file, or a folder with all below.

    Slashes at the beginning don't count on either side, and a backslash in the path is a slash.
    """
    as_java = lambda p: fnmatch.translate(p).replace("(?s:", "(?s:^").replace(r"\Z", "$")
    plain, wanted = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""), pattern.lstrip("/")
    found = plain.rlike(as_java(wanted)) | plain.rlike(as_java(f"*/{wanted}"))
    return found if wanted.endswith("*") else found | (plain == wanted) | plain.startswith(wanted.rstrip("/") + "/")


def prose(path: Column) -> Column:
    p = F.lower(F.concat(F.lit("/"), F.regexp_replace(path, r"^/+", "")))
    inside = F.lit(False)
    for part in PROSE_PARTS:
        inside = inside | F.contains(p, F.lit(part))
    return (F.coalesce(path, F.lit("")) != "") & (extension(path).isin(*PROSE_EXTS) | inside)


def code(path: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & extension(path).isin(*CODE_EXTS) & ~prose(path) & ~generated_path(path)


def archived(path: Column) -> Column:
    """In a folder of old copies, of vendored trees or of build output, or generated."""
    return F.exists(directories(path), lambda s: s.isin(*ARCHIVE_DIRS, *OUTPUT_DIRS)) | generated_path(path)


def test_like(path: Column, name: Column) -> Column:
    """By place and file name, or by the symbol's name; a backend's own flag is not trusted."""
    b = basename(path)
    return path.rlike(r"(^|/)tests?/") | b.rlike(r"^test_|_test\.py$|^conftest\.py$") | name.startswith("test_")


def synthetic(path: Column) -> Column:
    return (F.coalesce(path, F.lit("")) == "") | path.startswith("<")


def noise(path: Column, name: Column) -> Column:
    return synthetic(path) | test_like(path, name) | archived(path)


def family(path: Column) -> Column:
    e, out = extension(path), F.lit("")
    for name, exts in FAMILIES.items():
        out = F.when(e.isin(*exts), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def non_code(path: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & extension(path).isin(*NON_CODE_EXTS)


def contained(path: Column, root: Column) -> Column:
    """The path is the root or lies below it, separator included; slashes at the end don't count."""
    clean = lambda c: F.regexp_replace(c, "/+$", "")
    return (clean(path) == clean(root)) | path.startswith(F.concat(clean(root), F.lit("/")))


def without_project(name: Column) -> Column:
    """A leading path-slug segment is dropped from a dotted name; file names and real modules stay."""
    head = F.substring_index(name, ".", 1)
    tail = F.regexp_extract(name, r"(?s)^[^.]*\.(.*)$", 1)
    is_slug = F.contains(head, F.lit("-")) & ~F.contains(name, F.lit(" ")) & (tail != "") & ~F.substring_index(name, ".", -1).isin(*FILE_NAMES)
    return F.when(is_slug, tail).otherwise(name)


def without_repeats(name: Column) -> Column:
    """Equal neighbouring identifier segments of a dotted name collapse; numbers never do."""
    fold = F.aggregate(F.split(name, r"\."), F.array().cast("array<string>"), lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1) == s) & s.rlike(r"^[\p{L}_]\w*$"), a).otherwise(F.concat(a, F.array(s))))
    return F.array_join(fold, ".")


def line_label(path: Column, line: Column) -> Column:
    """``path:line``, lines counted from 1; a negative or missing line shows the path alone, a missing path a question mark."""
    shown = F.coalesce(F.nullif(F.trim(path), F.lit("")), F.lit("?"))
    return F.when(line >= 0, F.concat(shown, F.lit(":"), (line + 1).cast("string"))).otherwise(shown)


def span_label(path: Column, start: Column, end: Column) -> Column:
    """``path:start-end``, lines counted from 1; without a usable end the start alone, without a start the path alone."""
    head = line_label(path, start)
    return F.when((start >= 0) & (end >= 0), F.concat(head, F.lit("-"), (end + 1).cast("string"))).otherwise(head)


def redacted(text: Column, home: str) -> Column:
    """The home directory as ``~``, also below /private, and its flattened form as ``<home>``."""
    flat = home.strip("/").replace("/", "-").replace(":", "")
    out = F.replace(F.replace(text, F.lit(f"/private{home}"), F.lit("~")), F.lit(home), F.lit("~"))
    return F.replace(out, F.lit(flat), F.lit("<home>"))


def redacted_within(value: Column, kind: T.DataType, home: str) -> Column:
    """``value`` of type ``kind`` with every text in its arrays, maps and fields redacted; keys and field names stay."""
    if isinstance(kind, T.StringType):
        return redacted(value, home)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted_within(x, kind.elementType, home))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redacted_within(x, kind.valueType, home))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redacted_within(value.getField(f.name), f.dataType, home).alias(f.name) for f in kind]))
    return value


def escaped(text: Column) -> Column:
    """``text`` that HTML shows as it is."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def leaks(text: Column) -> Column:
    return text.rlike(r"/(Users|home)/[^/\s]+/")


def first_meaningful(lines: Column) -> Column:
    """The first line with a letter or digit, trimmed; else the first line; else the empty text."""
    return F.coalesce(F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(r"[\p{L}\p{N}]")), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))


def substance(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def binary(content: Column) -> Column:
    """A zero byte among the first 8192 bytes."""
    return F.contains(F.substring(content, 1, SAMPLE), F.lit(b"\0"))
