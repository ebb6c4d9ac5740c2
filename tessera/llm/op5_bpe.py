"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A text is cut by the pre-tokenizer's pattern; every match is encoded on its own by the library (its regex
step is off: the pattern has cut already), and the token ids of a match are kept in a bounded cache of each
Python worker, as little-endian bytes. Decoding looks ids up in the reversed byte-to-character table, so characters split over tokens come back
whole once the bytes are joined. Offsets of a token: its bytes, and the characters that those bytes touch.

One narrow pass without a shuffle. A worker holds the vocabulary (a few MB) and at most ``CACHE`` matches.

Defined results: a null text counts as empty (no ids; decoded bytes empty); strings of special tokens in a
text are ordinary text; null ids and repeated rows pass through; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is, if the caller names none: the public package's files.
VOCABULARY = "byte_bpe_50k.json"
#: Matches that a worker keeps; further ones are encoded each time.
CACHE = 400_000
#: Matches that are handed to the library at once, and the longest match that is kept.
AT_ONCE, KEPT = 2000, 64


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a vocabulary file of the tokenizers library and a pre-tokenizer pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.find = regex.compile(pattern).findall
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {c: b for b, c in byte_characters().items()}
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(table[c] for c in token)
        self.widths = np.array([len(b) for b in self.bytes])
        self.known: dict[str, bytes] = {}

    def _encode(self, matches: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(matches), AT_ONCE):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(matches[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        matches, known = self.find(text), self.known
        try:
            return b"".join(map(known.__getitem__, matches))
        except KeyError:
            pass
        new = [m for m in dict.fromkeys(matches) if m not in known]
        fresh = dict(zip(new, self._encode(new)))
        if len(known) < CACHE:
            known.update((m, ids) for m, ids in fresh.items() if len(m) <= KEPT)
        return b"".join([fresh[m] if m in fresh else known[m] for m in matches])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last; a split character belongs to each of its tokens."""
        ends = np.cumsum(self.widths[ids])
        lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        return (lead[ends - self.widths[ids]] - 1, lead[ends - 1]) if len(ids) else (ends, ends)


@lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def _digests(path: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            rows = []
            for text in _texts(b.column(1)):
                ids = c.encode(text)
                raw = c.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):  # ids and offsets of many texts are large
                b, out = whole.slice(k, 256), ([], [], [], [])
                for text in _texts(b.column(1)):
                    ids = np.frombuffer(c.encode(text), "<u4")
                    start, end = c.offsets(ids, raw := c.decode(ids))
                    for to, x in zip(out, (ids.astype(np.int32), start.astype(np.int32), end.astype(np.int32), raw.decode("utf-8", "replace"))):
                        to.append(x)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, ints) for x in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return run


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, starts, ends, decoded``: token ids with character offsets, and the text decoded from the ids."""
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(_encoded(path, pattern), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")
