import hashlib
import re

from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tessera.llm import op12_middle as op

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The rule in plain steps, apart from the operator."""
    text, shown = text or "", "" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"42:{shown}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i * 8 : i * 8 + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_equals_sql(spark, small, documents):
    compare(op.digests(documents), op.ORACLE, small)


def test_whole_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = op.digests(clash(documents)).collect()
    assert len(got) == len(texts) and {"plain", "spm", "psm"} == {r["form"] for r in got}
    for r in got:
        *head, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert tuple(head) == (r["n"], r["form"], r["prefix_chars"], r["middle_chars"])
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(output), sha(texts[r["doc_id"]]))


ODD = [None, "", " ", "\t\n \x0b\x0c\r", "a", "  a  b\n\n c ", "has <P> in it", "<S>", "x<M>y", "<P", "a<", "< P > <", "日本語 👩‍👩‍👧 é́ z", "\x00 \x1c\x85 　 b", "a" * 300_000, "word " * 200_000, "same", "same"]


def test_odd_texts(spark, docs_of):
    rows = [(i, t) for t in ODD for i in (None, *range(40))]
    docs = docs_of([t for _, t in rows if t is None or len(t) < 100], ids=[i for i, t in rows if t is None or len(t) < 100])
    want = sorted(str((i, *plain(i, t))) for i, t in rows if t is None or len(t) < 100)
    made = op.examples(clash(docs))
    assert sorted(str(tuple(r)) for r in made.collect()) == want
    assert sorted(str(tuple(r)) for r in op.restored(made).collect()) == sorted(str((i, t or "")) for i, t in rows if t is None or len(t) < 100)
    long = docs_of([t for t in ODD if t and len(t) >= 100] * 20)
    for r, t in zip(op.examples(long).orderBy("doc_id").collect(), [t for t in ODD if t and len(t) >= 100] * 20):
        assert tuple(r)[1:] == plain(r["doc_id"], t)


def test_equal_rows_and_partitions(docs_of):
    docs = docs_of(["one two three four"] * 50, ids=[7] * 50)
    assert len({tuple(r) for r in op.digests(docs).collect()}) == 1
    many = docs_of([f"a b c {k}" for k in range(60)])
    one, two = ({tuple(r) for r in op.digests(x).collect()} for x in (many.repartition(7), many.coalesce(1)))
    assert one == two and len(one) == 60


def test_empty_table(docs_of):
    none = docs_of(["x"]).limit(0)
    assert op.digests(none).collect() == [] and op.restored(op.examples(none)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(st.sampled_from("ab <PSM>\n\x00é👩"), max_size=40))
def test_any_text_comes_back(doc_id, text):
    made = op.example(doc_id, text)
    assert tuple(made) == plain(doc_id, text)
    assert op.original(made.output, made.form) == text


def test_parameters(docs_of):
    docs = docs_of(["a b c d"] * 30)
    assert {r["form"] for r in op.examples(docs, cut=0).collect()} == {"plain"}
    assert {r["form"] for r in op.examples(docs, cut=100, suffix_first=100).collect()} == {"spm"}
    every = op.examples(docs, pattern=".", cut=100, suffix_first=0)
    assert {(r["n"], r["form"]) for r in every.collect()} == {(7, "psm")}
    assert {r["text"] for r in op.restored(every).collect()} == {"a b c d"}
