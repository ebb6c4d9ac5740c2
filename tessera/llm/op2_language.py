"""Language identification by bit-sliced Bloom filters over character n-grams.

One Bloom filter per language, stored sliced: slot i of the table holds a 64-bit word for every 64 languages,
whose bit l is bit i of language l's filter. Looking an n-gram up reads ``HASHES`` slots and ands the words: the result is the
mask of all languages that contain the n-gram. Per language the popcount over a text's n-grams is corrected
for the filter's false positives (fill ** HASHES), and the language with most wins; ties go to the first
name. A language contains an n-gram if it is among its ``GRAMS`` commonest of the training rows and its
rate there is at least half of the highest rate of any language that has it more than twice. One seen at most
twice counts only in languages of up to ``GRAMS`` different n-grams, or of none more frequent. A language of which
nothing would be left keeps all its n-grams, so every language whose training rows hold a letter has a filter.

Bounds: about ``TRAIN_ROWS`` different training texts per language (by a hash of the text) and ``GRAMS`` n-grams per
language; the table takes ``SLOTS`` words (2 MB) for every 64 languages of the training rows. Counting is a map-side
combined aggregation; prediction is one pass over Arrow batches without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0; if nothing was learned all is
``und``; a text with letters but no known n-gram gets the language with most training rows and score 0; a
null doc_id is not held out; rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fold

TRAIN_ROWS, GRAMS, ORDER = 2000, 20_000, 3
SLOTS, HASHES = 1 << 18, 2
#: Languages to a word of the table.
WORD = 64
FOLDS, HELD = 3, 1
#: Characters that are held as numbers at once.
CHUNK = 1 << 20
#: Counts by text and language that are held at once.
COUNTS = 1 << 21
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x33480):  # no letters are assigned beyond
        if (c := chr(i)).isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Parts of the texts, at most ``CHUNK`` characters together: rows, hashes of the n-grams, row place of each."""
    rows, parts, size = [], [], 0

    def out() -> tuple[list[int], np.ndarray, np.ndarray]:
        c = folded()[np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")]
        sizes = np.array([len(p) for p in parts])
        middle = c != 0x20  # an n-gram counts if its middle is a letter
        middle[np.cumsum(sizes) - 1] = middle[np.cumsum(sizes) - sizes] = False  # a part's ends are its neighbours' characters or spaces
        at, where = np.repeat(np.arange(len(parts)), sizes), np.flatnonzero(middle)
        wide = c.astype(np.uint64)
        return rows, wide[where - 1] * _MIX[0] + wide[where] * _MIX[1] + wide[where + 1] * _MIX[2], at[where]

    for i, t in enumerate(texts):
        for k in range(0, len(t or ""), CHUNK):
            p = (t[k - 1] if k else " ") + t[k : k + CHUNK] + (t[k + CHUNK : k + CHUNK + 1] or " ")
            if size + len(p) > CHUNK and parts:
                yield out()
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(p)
            size += len(p)
    if parts:
        yield out()


def slots(h: np.ndarray) -> tuple[np.ndarray, ...]:
    x = h ^ (h >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return tuple(((x >> np.uint64(k * 20)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES))


class Filters:
    """The sliced table, the languages by bit, each filter's false-positive rate and the fallback language."""

    def __init__(self, grams: dict[str, np.ndarray], rows: dict[str, int]):
        self.names = sorted(grams)
        self.table = np.zeros((max(1, -(-len(self.names) // WORD)), SLOTS), np.uint64)
        for i, name in enumerate(self.names):
            for s in slots(grams[name].astype(np.uint64)):
                self.table[i // WORD, s] |= np.uint64(1 << i % WORD)
        fill = np.array([np.count_nonzero(self.table[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) / SLOTS for i in range(len(self.names))])
        self.false = fill**HASHES
        self.usual = min(self.names, key=lambda n: (-rows.get(n, 0), n)) if self.names else None

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram hash the mask of those of a word's languages that contain it."""
        return reduce(operator.and_, [self.table[word, s] for s in slots(h)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(texts) > (step := max(1, COUNTS // max(1, len(self.names)))):
            parts = [self.predict(texts[k : k + step]) for k in range(0, len(texts), step)]
            return [x for names, _ in parts for x in names], [x for _, score in parts for x in score]
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), max(1, len(self.names))))
        for rows, h, at in pieces(texts):
            rows = np.array(rows)
            np.add.at(n, rows, np.bincount(at, minlength=len(rows)))
            for word in range(len(self.table)):
                m = self.masks(h, word)
                for i in range(word * WORD, min(len(self.names), (word + 1) * WORD)):
                    np.add.at(hits[:, i], rows, np.bincount(at[(m >> np.uint64(i % WORD) & np.uint64(1)).astype(bool)], minlength=len(rows)))
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
        best, total = true.argmax(axis=1), true.sum(axis=1)
        names = ["und" if not n[i] else self.usual if not total[i] else self.names[best[i]] for i in range(len(texts))]
        return names, [float(true[i, best[i]] / total[i]) if n[i] and total[i] else 0.0 for i in range(len(texts))]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams of a partition's training rows by language, added up as far as memory bounds allow."""
    sums: dict[str, Counter] = {}
    flush = lambda: pd.DataFrame([(lang, g, n) for lang, c in sums.items() for g, n in c.items()], columns=["lang", "gram", "n"])
    for f in frames:
        langs = f["lang"].tolist()
        for rows, h, at in pieces(f["text"].tolist()):
            lang = np.array([langs[r] for r in rows], dtype=object)[at]
            for name in set(lang):
                g, n = np.unique(h[lang == name].view(np.int64), return_counts=True)
                sums.setdefault(name, Counter()).update(dict(zip(g.tolist(), n.tolist())))
        if sum(map(len, sums.values())) > 500_000:
            yield flush()
            sums = {}
    yield flush()


def sampled(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``(lang, text)``, about ``TRAIN_ROWS`` different texts of each language, and the training rows by language.

    Texts are chosen by a hash of the text, so neither null nor repeated ids, nor copies, decide whether a language
    is learned: one of at most ``TRAIN_ROWS`` different texts keeps them all.
    """
    lang, text = F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    usable = docs.where(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD)).select(lang, text, F.xxhash64(text).alias("h"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("text").isNotNull(), F.col("h")), 0.02).alias("kinds")).collect()
    if not sizes:
        return usable.select("lang", "text"), {}
    span = 1 << 30
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(span * min(1.0, TRAIN_ROWS / max(1, r["kinds"])))) for r in sizes], "lang string, most long")
    kept = usable.where("text is not null").join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(span)) < F.col("most"))  # a row a language
    return kept.dropDuplicates(["lang", "h"]).select("lang", "text"), {r["lang"]: r["n"] for r in sizes}


def learn(docs: DataFrame) -> Filters:
    """Filters from rows with a language outside the held-out fold."""
    kept, rows = sampled(docs)
    if not rows:
        return Filters({}, {})
    span = 1 << 30
    counts = cut(kept.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # n-grams seen once or twice count where a language has few others; they never take an n-gram from another language
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.count_if(F.col("n") > 2).alias("common"))
    rate = counts.join(F.broadcast(total), "lang").where((F.col("n") > 2) | (F.col("kinds") <= GRAMS) | (F.col("common") == 0)).withColumn("rate", F.col("n") / F.col("all"))  # a row a language
    top = rate.groupBy("gram").agg(F.max(F.when(F.col("n") > 2, F.col("rate"))).alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("each"))  # a row a language at most
    own = top.select("gram", "top", F.explode("each").alias("e")).select("e.lang", "gram", "e.n", F.expr("top is null or e.rate >= top / 2").alias("own"))
    # the commonest, down to a count below which a language would get over GRAMS: counts in steps of 2 ** (1/16)
    own = cut(own.withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    steps = own.groupBy("lang", "own", "step").count().collect()
    has = {r["lang"] for r in steps if r["own"]}  # a language all of whose n-grams are commoner elsewhere keeps them all
    least: dict[str, tuple[int, int]] = {}
    for lang, group in groupby(sorted(((r["lang"], r["step"], r["count"]) for r in steps if r["own"] or r["lang"] not in has), key=lambda x: (x[0], -x[1])), key=lambda x: x[0]):
        reach = 0
        for _, step, n in group:
            if (reach := reach + n) > GRAMS:
                least.setdefault(lang, (step, span * GRAMS // n))  # the commonest alone are too many: GRAMS of them by hash
                break
            least[lang] = step, span
    if not least:
        return Filters({}, rows)
    names = sorted(least)
    floors = docs.sparkSession.createDataFrame([(k, *least[k], i, k not in has) for i, k in enumerate(names)], "lang string, least int, most long, i int, every boolean")
    kept = own.join(F.broadcast(floors), "lang").where((F.col("own") | F.col("every")) & (F.col("step") >= F.col("least")) & (F.pmod(F.xxhash64("gram"), F.lit(span)) < F.col("most")))
    got = kept.select("i", "gram").toPandas()  # at most about GRAMS rows a language, 12 bytes each
    return Filters({names[i]: g["gram"].to_numpy(np.int64).view(np.uint64) for i, g in got.groupby("i")}, rows)


def languages(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score."""
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs))  # SLOTS words, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = filters.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
