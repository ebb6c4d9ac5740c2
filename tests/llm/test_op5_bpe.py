import base64
import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op5_bpe as op


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(row, text, plain):
    ids = plain.encode_ordinary(text or "")
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_documents(documents, plain):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = op.digests(clash(documents)).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r["doc_id"]], plain)


def test_odd_rows(docs_of, plain):
    texts = [None, "", " ", "  a  b\n\n c", "<|endoftext|>", "日本語 👩‍👩‍👧 é", "\x00\x1c\x85 　", "a" * 70_000, "word " * 100_000, "dup", "dup"]
    ids = [None, *range(1, len(texts))]
    for r in op.digests(docs_of(texts, ids=ids)).collect():
        check(r, texts[r["doc_id"] or 0], plain)
    assert op.digests(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\ta'sé1!²日　\x1c") | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_text(plain, text):
    c = op.codec()
    ids = np.frombuffer(c.encode(text), "<u4")
    assert ids.tolist() == plain.encode_ordinary(text)
    raw = c.decode(ids)
    assert raw == text.encode()
    start, end = c.offsets(ids, raw)
    at = 0
    for i, a, b in zip(ids.tolist(), start.tolist(), end.tolist()):
        width = len(c.bytes[i])
        first = sum((x & 0xC0) != 0x80 for x in raw[: at + 1]) - 1
        assert (a, b) == (first, sum((x & 0xC0) != 0x80 for x in raw[: at + width]))
        at += width


def test_full_cache(monkeypatch, plain):
    monkeypatch.setattr(op, "CACHE", 2)
    op.codec.cache_clear()
    c = op.codec()
    for t in ("one two three four", "one five\n\nsix", "two  three"):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == plain.encode_ordinary(t)
    op.codec.cache_clear()


def test_encoded_rows(docs_of):
    got = {r["doc_id"]: r for r in op.encoded(docs_of(["héllo 日本", None])).collect()}
    assert got[0]["decoded"] == "héllo 日本" and got[0]["starts"][0] == 0 and got[0]["ends"][-1] == 8
    assert got[1]["ids"] == [] and got[1]["decoded"] == ""
