import hashlib
import random
import zlib

import pytest
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op10_ogg as op


def slow_checksum(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200))
def test_checksum(data):
    assert op.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255 * 64, 65_025, 65_025 * 2, 96_000, 96_000 * 2, 192_000 * 2 + 1, 255 * 254 * 2])
@pytest.mark.parametrize("packet", [255, 1000, op.PACKET])
def test_round_trip_and_damage(n, packet):
    rng = random.Random(n)
    payload = op.padded(rng.randbytes(n))
    media = op.write(payload, packet)
    back, found = op.read(media)
    assert back == payload and found["streams"] == 2 and found["seconds"] == len(payload) / op.RATE
    assert max(found["times"]) == (len(payload) - len(payload) // 2) / op.RATE
    for _ in range(20):
        k = rng.randrange(len(media))
        with pytest.raises(op.OggError):
            op.read(media[:k] + bytes([media[k] ^ (1 << rng.randrange(8))]) + media[k + 1 :])
    with pytest.raises(op.OggError):
        op.read(media[: len(media) - 1 - rng.randrange(20)])


def pages(media):
    at = 0
    while at < len(media):
        n = media[at + 26]
        size = 27 + n + sum(media[at + 27 : at + 27 + n])
        yield media[at : at + size]
        at += size


def test_lost_or_swapped_pages():
    all_ = list(pages(op.write(random.Random(3).randbytes(400_000))))
    for k in range(len(all_)):
        with pytest.raises(op.OggError):
            op.read(b"".join(all_[:k] + all_[k + 1 :]))
    a = [i for i, p in enumerate(all_) if p[14:18] == all_[0][14:18]]
    all_[a[1]], all_[a[2]] = all_[a[2]], all_[a[1]]
    with pytest.raises(op.OggError):
        op.read(b"".join(all_))


def check(r, text):
    raw = (text or "").encode()
    payload = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = op.write(payload)
    assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_whole_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = op.media(clash(documents)).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r["doc_id"]])


def test_odd_rows(docs_of):
    texts = [None, "", "x", "x", "é" * 200_000, "\x00", "a" * 64]
    got = op.media(docs_of(texts, ids=[None, 1, 2, 3, 4, 5, 6])).collect()
    for r in got:
        check(r, texts[r["doc_id"] or 0])
    by = {r["doc_id"]: r for r in got}
    assert by[2]["feature"] == by[3]["feature"] and by[None]["feature"] == by[1]["feature"]
    assert op.media(docs_of([])).count() == 0


def test_files_as_rows(spark, docs_of):
    files = op.stored(docs_of(["héllo", "y" * 300_000]))
    got = {r["doc_id"]: r for r in op.samples(files).collect()}
    assert bytes(got[0]["payload"]).rstrip(b"\x00") == "héllo".encode() and got[1]["error"] is None
    bad = spark.createDataFrame([(1, b"OggS"), (2, None)], "doc_id long, media binary")
    errors = {r["doc_id"]: r["error"] for r in op.samples(bad).collect()}
    assert errors[1]


def foreign(packets, serial=7, first=0):
    """A sound Ogg file of another codec, written page by page here: one packet a page."""
    out = b""
    for i, p in enumerate(packets):
        lace = [255] * (len(p) // 255) + [len(p) % 255]
        flags = op.FIRST * (i == 0) | op.LAST * (i == len(packets) - 1)
        page = b"OggS" + bytes([0, flags]) + (i * 960).to_bytes(8, "little") + serial.to_bytes(4, "little") + (first + i).to_bytes(4, "little") + bytes(4) + bytes([len(lace), *lace]) + p
        out += page[:22] + slow_checksum(page).to_bytes(4, "little") + page[26:]
    return out


def test_other_codecs_and_odd_headers(spark):
    opus = foreign([b"OpusHead" + bytes(11), b"OpusTags" + bytes(300), b"\x01" * 77])
    streams, pages = op.demux(opus)
    assert pages == 3 and [len(p) for p in streams[7]["packets"]] == [19, 308, 77] and streams[7]["granules"] == [(1, 0), (2, 960), (3, 1920)]
    good = op.write(op.padded(b"abc"))
    bad = [
        opus, foreign([b"RAWBYTES" + bytes(12)]), foreign([b""]), foreign([b"RAWBYTES" + (8000).to_bytes(4, "little") + (9).to_bytes(8, "little"), b"abc"]),
        b"", b"O", b"OggS", bytes(500), good + good, good + b"x", opus + good, good[:-1], foreign([b"RAWBYTES" + bytes(12)], first=3),
    ]
    for m in bad:
        with pytest.raises(op.OggError):
            op.read(m)
    files = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(bad)] + [(99, bytearray(good)), (None, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in op.samples(files).collect()}
    assert all(got[i]["error"] and got[i]["payload"] is None for i in range(len(bad))) and bytes(got[99]["payload"]) == op.padded(b"abc") and got[None]["error"]
    rows = op.packets(files).collect()
    assert [(r["ordinal"], len(r["packet"]), r["granule"]) for r in sorted((r for r in rows if r["doc_id"] == 0), key=lambda r: r["ordinal"])] == [(0, 19, 0), (1, 308, 960), (2, 77, 1920)]
    assert {r["doc_id"] for r in rows if r["error"]} == {4 + k for k in (1, 2, 3, 4, 5, 7)}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 1 << 30))
def test_any_bytes_raise_only_ogg_errors(junk, seed):
    rng = random.Random(seed)
    good = op.write(op.padded(rng.randbytes(200)))
    k = rng.randrange(len(good))
    for m in (junk, b"OggS" + junk, good[:k] + junk + good[k:], good[:k] + junk):
        try:
            op.read(m)
        except op.OggError:
            pass
