"""Definition spans of languages with braces: which lines hold functions, and classes with their members.

Strings, templates and comments are blanked, so that every bracket left is code; what stands before an opening brace,
since the statement began, says whether it opens a definition. Text whose brackets don't match has no spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# The languages by ending.
FAMILIES = {
    "js": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "go": (".go",), "rust": (".rs",), "java": (".java",), "c": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh"),
}
_COMMENT, _TEXT = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_BLANK = {
    "js": rf"{_COMMENT}|{_TEXT}|'(?:\\.|[^'\\\n])*'|`|[{{}}]",
    "go": rf"{_COMMENT}|{_TEXT}|{_CHAR}|`[^`]*`",
    "rust": rf'{_COMMENT}|\bb?r(?P<hash>#*)".*?"(?P=hash)|{_TEXT}|{_CHAR}',
    "java": rf'{_COMMENT}|""".*?"""|{_TEXT}|{_CHAR}',
    "c": rf"{_COMMENT}|^[ \t]*#(?:\\.|[^\n\\])*|{_TEXT}|{_CHAR}",
}
_BLANK = {k: re.compile(p, re.DOTALL | re.MULTILINE) for k, p in _BLANK.items()}
_TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.DOTALL)
_TYPE = re.compile(r"\b(class|interface|enum|struct|union|impl|trait|mod|namespace|record|module)\b(?!\s*[.=(])")
_BLOCK = re.compile(r"(?:else|if|for|while|switch|do|try|catch|finally|match|loop|with|synchronized|select|defer|go|return|case|throw|await|yield|new)\b")
_LABEL = re.compile(r"(?:\w+\s*:(?!:)\s*)+")
_CALLED = re.compile(r"[\w$#~\]>]\s*\(.*\)[^=]*$", re.DOTALL)
_JS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b|(?:export\s+)?(?:const|let|var)\s+[\w$]+.*?(?:=>\s*$|\bfunction\b[^{]*$)", re.DOTALL)
_MARKS = r"[{}()\[\];,]"
#: Where line ends end statements: not after or before what goes on, as an operator does.
_LINE_ENDS = r"(?<=[^\s,=(&|+\-*/<>:?.{\[])[ \t]*\n(?=\s*(?![.?:=)&|+*/{<]|extends\b|implements\b)\S)"
_TOKENS = {f: re.compile(f"{_MARKS}|{_LINE_ENDS}" if f in ("js", "go") else _MARKS) for f in FAMILIES}


@dataclass
class _Open:
    """An open brace: what it opens, where its statement began, where the one inside it begins, and the definitions inside."""

    kind: str
    start: int = 0
    begin: int = 0
    depth: int = 0
    members: list = field(default_factory=list)


def family_of(path: str) -> str | None:
    return next((f for f, ends in FAMILIES.items() if path.lower().endswith(ends)), None)


def blanked(text: str, family: str) -> str:
    """``text`` with comments and quoted parts as spaces, line ends kept. Code inside a template's ``${}`` stays, its brackets don't."""
    out, at, braces = [], 0, []
    blank = lambda a, b: out.append(re.sub(r"[^\n]", " ", text[a:b]))
    while found := _BLANK[family].search(text, at):
        out.append(text[at : found.start()])
        token, at = found[0], found.end()
        if token == "{":
            braces.append("{")
            out.append(token)
        elif token == "}" and (not braces or braces.pop() == "{"):
            out.append(token)
        elif token in "`}":  # a template begins or goes on
            part = _TEMPLATE.match(text, at)
            blank(found.start(), part.end())
            at = part.end()
            braces += ["$"] if part[1] == "${" else []
        else:
            blank(found.start(), at)
    out.append(text[at:])
    return "".join(out)


def opened(head: str, family: str) -> str:
    """What a brace opens after ``head``: a function, a type, or a mere block, in which definitions may stand."""
    types = _TYPE.search(head)
    if (family == "go" and head.startswith("func")) or (family == "rust" and re.search(r"\bfn\s+\w", head)) or (family == "js" and _JS_FUNCTION.match(head)):
        return "function"
    if types and not re.search(r"[=(]", re.sub(r"@[\w.]+\([^)]*\)|\bpub\s*\([^)]*\)", "", head[: types.start()])):
        if not (family == "c" and types[1] in ("struct", "union", "enum") and "(" in head[types.end() :]):
            return "type"
    if _BLOCK.match(head) or family in ("go", "rust") or "=>" in head:
        return "block"
    return "function" if _CALLED.search(head) and "=" not in head.split("(")[0] else "block"


def definitions(text: str, family: str, n: int) -> list[tuple[int, int]]:
    """Half-open line spans of functions, and of types a header and each member; none where brackets don't match."""
    code = blanked(text, family)
    ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(ends, at - 1) if at else 0
    frames = [_Open("block")]
    for m in _TOKENS[family].finditer(code):
        c, here = m[0], frames[-1]
        if c in "([":
            here.depth += 1
        elif c in ")]":
            here.depth -= 1
        elif c == "{":
            head = code[here.begin : m.start()]
            start = here.begin + len(head) - len(head.lstrip())
            if family == "c" and (label := _LABEL.match(code, start)) and label.end() <= m.start():
                start = label.end()
            kind = "inside" if here.kind in ("function", "inside") else "block" if here.depth else opened(code[start : m.start()].strip(), family)
            frames.append(_Open(kind, start, m.end()))
        elif c == "}":
            if len(frames) == 1 or here.depth:
                return []
            frames.pop()
            up = frames[-1]
            if here.kind in ("function", "type"):
                up.members.append((line(here.start), min(n, line(m.start()) + 1), here.members))
            else:
                up.members += here.members
            up.begin = m.end() if not up.depth else up.begin
        elif not here.depth and (c != "," or here.kind == "block"):
            here.begin = m.end()
        if frames[-1].depth < 0:
            return []
    return sorted(_spans(frames[0].members)) if len(frames) == 1 and not frames[0].depth else []


def _spans(found: list) -> list[tuple[int, int]]:
    out, todo = [], list(found)
    while todo:
        start, end, members = todo.pop()
        out.append((start, max(start + 1, min(min(m[0] for m in members), end)) if members else end))
        todo += members
    return out
