"""Fill-in-the-middle examples: texts cut at token boundaries, parts swapped behind sentinels, and put back.

The ``Split`` pre-tokenizer of the tokenizers library, with a regular expression whose matches stand isolated, gives
the code-point offsets of the tokens of a text; nothing is trained. The pattern matches every character, so the length
of the offsets is the number of tokens ``n``, and the offsets of two drawn ranks are the ends of prefix and middle.

Draws are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``: they depend on nothing else, so any
partitioning and any repeated task gives the same examples. One pass over whole texts, without a shuffle; a task holds a
batch of rows and the offsets of one text.

Defined results: a null text counts as empty; an empty text, or one that holds a sentinel, stays as it is (``plain``); a
null id draws as the empty text; rows with equal id and text give equal examples; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not looked at. Texts of any length are cut as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_size

#: A token is a word with the white space before it, or white space at the end.
PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed of the draws, and how many of a hundred texts are cut, and of those have the suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
#: Characters of the texts whose examples are handed on together.
AT_ONCE = 1 << 24


class Example(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


@lru_cache(maxsize=4)
def splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated")


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def example(doc_id: int | None, text: str, pattern: str = PATTERN, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> Example:
    """The example of one text."""
    first, second, whether, which = draws(seed, doc_id)
    ends = [0, *(end for _, (_, end) in splitter(pattern).pre_tokenize_str(text))]
    n = len(ends) - 1
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= cut:
        return Example(n, "plain", None, None, text)
    low, high = sorted((ends[first % (n + 1)], ends[second % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if which % 100 < suffix_first:
        return Example(n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Example(n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def original(output: str, form: str) -> str:
    """The text that an example was made of: no part holds a sentinel, so the first of each is the one that was set."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, middle = output.removeprefix(one).partition(MIDDLE)
    a, _, b = head.partition(two)
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return prefix + middle + suffix


def _rows(batches: Iterator[pa.RecordBatch], row, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for a, b in by_size(columns[1], AT_ONCE):
            rows = [row(*values) for values in zip(*(c[a:b] for c in columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_EXAMPLE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_DIGEST = pa.schema([*[_EXAMPLE.field(k) for k in range(5)], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def examples(docs: DataFrame, pattern: str = PATTERN, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one example a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, lambda i, text: (i, *example(i, text or "", pattern, seed, cut, suffix_first)), _EXAMPLE)

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """``doc_id, text`` from the output and form of ``examples`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, lambda i, output, form: (i, original(output, form)), _TEXT)

    return made.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: ``examples`` with digests of the output and of the text restored from it, in one pass."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        made = example(doc_id, text or "")
        return (doc_id, *made[:4], *(hashlib.sha256(x.encode()).hexdigest() for x in (made.output, original(made.output, made.form))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, row, _DIGEST)

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS whether, CAST('0x' || h[25:32] AS BIGINT) % 100 AS which FROM t),
v AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR whether >= 50 THEN 'plain' WHEN which < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:], '') AS s FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM v
"""
