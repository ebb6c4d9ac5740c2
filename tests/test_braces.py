"""Definition spans of brace languages: nested, quoted and broken braces."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import braces
from tessera.operators import chunking

CASES = {
    "a.ts": ("export class Widget {\n  greet(name: string) {\n    return name;\n  }\n}\nfunction top() {\n  return 1;\n}\n", [(0, 1), (1, 4), (5, 8)]),
    "b.go": ("package p\n\nfunc Free() int {\n\treturn 1\n}\n\nfunc (t T) Method() int {\n\treturn 2\n}\ntype S struct {\n\tx int\n}\n", [(2, 5), (6, 9), (9, 12)]),
    "c.rs": ("struct S { x: i32 }\n\nimpl<'a> S {\n    fn method(&'a self) -> char {\n        '}'\n    }\n}\nconst R: &str = r#\"} \" {\"#;\npub fn f() {}\n", [(0, 1), (2, 3), (3, 6), (8, 9)]),
    "d.java": ("class A {\n    @Over(\"{\")\n    void m() throws X {\n        if (x) { y(); }\n        String s = \"}\";\n    }\n    static { z(); }\n    Map<String, Integer> g() { return null; }\n}\n", [(0, 1), (1, 6), (7, 8)]),
    "c.tsx": ("import x from 'y';\n\nexport const Header = () => {\n  return null;\n};\n\nconst useThing = (id) => {\n  return id;\n};\n\nconst PLAIN = { a: 42 };\nconst T = `a ${f({b: `}`})} {`;\nconst go = async function (q) {\n};\n", [(2, 5), (6, 9), (12, 14)]),
    "e.cpp": ("#define M(x) { x\nclass C {\npublic:\n  int m() { return 1; }\n};\nstruct S make(int a) {\n  return {a};\n}\nnamespace n {\nint free_fn() { return 2; }\n}\n", [(1, 3), (3, 4), (5, 8), (8, 9), (9, 10)]),
    "f.js": ("// function no() {\n/* { */\nif (a) {\n  function inner() {\n  }\n}\nmodule.exports = {\n  run(x) {\n    return x\n  },\n}\n", [(3, 5), (7, 10)]),
    "two.ts": ("function a() {\n  return 1;\n}\nfunction b() {\n  return 2;\n}\n", [(0, 3), (3, 6)]),
}


@pytest.mark.parametrize("path", CASES)
def test_spans(path):
    text, want = CASES[path]
    assert braces.definitions(text, braces.family_of(path), text.count("\n")) == want


@pytest.mark.parametrize("text", ["function a() {\n", "}\n", "f(]{)}\n", "x = '{\n", "`${\n", ""])
def test_brackets_that_do_not_match_have_no_spans(text):
    assert braces.definitions(text, "js", text.count("\n")) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("{}()[];,`'\"$/*\\\n fa=>:#r"), max_size=60), st.sampled_from(sorted(braces.FAMILIES)))
def test_any_text(text, family):
    n = len(text.splitlines()) or 1
    assert len(braces.blanked(text, family)) == len(text) and braces.blanked(text, family).count("\n") == text.count("\n")
    assert all(0 <= a < b for a, b in braces.definitions(text, family, n))


def test_chunks_by_language(spark):
    rows = [("p", path, text.split("\n")[:-1], True) for path, (text, _) in CASES.items()] + [("p", "bad.ts", ["function a() {", "x", "y"], True), ("p", "note.txt", ["function a() {", "}"], True)]
    files = spark.createDataFrame(rows, "project string, path string, lines array<string>, closed boolean")
    got = {}
    for r in chunking.chunks(files, 4, 4).collect():
        got.setdefault(r["path"], set()).add(r["start"])
    for path, (text, spans) in CASES.items():
        held = {a for a, b in chunking.covered(spans, text.count("\n"), 4, 4) if any(c.isalpha() for c in "".join(text.split("\n")[a:b]))}
        assert got[path] == held, path
    assert got["bad.ts"] == {0} and got["note.txt"] == {0}
    assert len({a for a, _ in CASES["a.ts"][1]} & got["a.ts"]) == 3
