"""Quality classifier: Bradley-Terry pairwise ranking over text statistics.

A pair of a good and a bad labelled document is a preference; the probability that i is preferred to j is
the logistic of s(i) - s(j), s linear in the features, so learning is logistic regression on feature
differences. Features are whole-text statistics, each cut into quantile bins of the training rows (an
additive step function, so no feature has to act monotonically). The threshold is the quantile of the
training scores at the share of rejected training rows; a Platt fit turns scores into probabilities, shifted
so that the threshold scores ``THRESHOLD``.

Every labelled row outside the held-out fold trains, in every pair of a good and a bad row (``all_pairs``). The pairs are never
listed: a row's share of the gradient is a smooth function of its score, the sum of logistics over the other class's scores. So a
Newton step is two passes over the rows: one counts scores, one adds gradients and curvature up. Edges, threshold and Platt fit come
from counts of all rows as well. The driver holds such sums alone (under 1 MB a task); features are computed once, in one
pass over Arrow batches, and lie in the shared folder.

Defined results: a null text counts as empty, and an empty text gets the model's score of its features; a
null doc_id is not held out and never trains; rows may repeat; a label that is null or not 0 or 1 is
ignored; without labels of both classes every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import cut_packed, fold, logistic, summed

#: ``PAIRS``: how many pairs the mean loss over all pairs weighs, beside the penalty ``L2``.
THRESHOLD, PAIRS, BINS, L2 = 0.7, 20_000, 8, 2.0
#: Places at which scores are counted for gradients, curvature, and threshold and Platt fit; bits of a feature's mantissa by which its values are counted.
FINE, COARSE, PLACES, MANTISSA = 1024, 64, 16_384, 8
FOLDS, HELD = 4, 2

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_COMMON = b".,"
_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
NAMES = (
    "length", "upper", "digit", "mark", "odd_mark", "wide", "runs", "word_length", "repeat", "distinct", "top_word",
    "bare_mark", "line_length", "line_repeat", "packed", "long_word", "ends_marked",
)


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; all are rates but the first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    words = raw.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in re.split(rb"[.\n]+\s*", raw) if x]
    k = max(1, len(lines))
    lengths = list(map(len, words))
    return [
        math.log1p(len(raw)), share(_UPPER), share(_DIGIT), share(_MARK), share(bytes(set(_MARK) - set(_COMMON))), len(raw.translate(None, bytes(range(128)))) / n,
        len(_RUN.findall(raw)) / m, sum(lengths) / m, sum(map(operator.eq, words, words[1:])) / m, len(counts) / m ** 0.8, max(counts.values(), default=0) / m,
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum() and w < b"\x7f") / m, math.log1p(m / k), 1 - len(set(lines)) / k,
        len(zlib.compress(raw, 1)) / (n + 12), sum(x > 20 for x in lengths) / m, sum(c for w, c in counts.items() if w[-1:] in b"!%&*$#|@^~=+<>") / m,
    ]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column for each feature and bin: whether the value reaches the bin's lower edge."""
    return (x[:, :, None] >= edges[None, :, :]).reshape(len(x), -1).astype(np.float64)


def fit(x: np.ndarray, y: np.ndarray, base: float, pairs: int = PAIRS, bins: int = BINS, seed: int = 7) -> dict | None:
    """The model of a few rows in memory, from drawn ``pairs``: edges, weights and calibration; ``base`` is the share of label 0. The queries use ``fit_all``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(np.concatenate([x[good], x[bad]]), np.linspace(0, 1, bins + 2)[1:-1], axis=0).T
    tails = np.quantile(x[good], [0.005, 0.025, 0.975, 0.995], axis=0).T  # what good texts hardly reach
    edges = np.sort(np.concatenate([edges, tails], axis=1), axis=1)
    z, rng = binned(x, edges), np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    flip = rng.random(pairs) < 0.5  # both orders, so that no intercept can stand in for the ranking
    d = np.where(flip[:, None], z[j] - z[i], z[i] - z[j])
    w = logistic(d, (~flip).astype(float), l2=L2)
    s = z @ w
    weight = np.where(y == 1, (1 - base) / len(good), base / len(bad))  # the sample is balanced, the corpus is not
    order = np.argsort(s, kind="stable")
    reach = np.cumsum(weight[order])
    cut = s[order][min(np.searchsorted(reach, base), len(s) - 1)]
    a, _ = logistic(np.stack([s, np.ones_like(s)], axis=1), y.astype(float), weight=weight * len(y), l2=0.01)
    return {"edges": edges, "w": w, "cut": float(cut), "slope": float(max(a, 1e-3))}


def scores(x: np.ndarray, model: dict | None, threshold: float = THRESHOLD) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = binned(x, model["edges"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["cut"]) + math.log(threshold / (1 - threshold)), -30, 30)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "hash", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash, x)``: the features of each row, computed once."""
    text = F.col("text").cast("string")
    return cut_packed(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(_measured, "doc_id long, hash long, x array<double>"))


def training_rows(rows: DataFrame, labels: DataFrame, parts: int = FOLDS, held: int = HELD) -> DataFrame:
    """``(y, x)`` of every labelled id outside the held-out fold, from the rows of ``measured``."""
    return shared.training_rows(rows, labels, "quality", parts, held)


def _counted_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each feature has values that agree in sign, exponent and ``MANTISSA`` bits, by label; no feature is negative."""
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        y = b.column("y").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            for f in range(x.shape[1]):
                v, n = np.unique(np.ascontiguousarray(x[y == k, f]).view(np.int64) >> (52 - MANTISSA), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.full(len(v), f, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["y", "f", "v", "n"])


def edges_of(train: DataFrame, bins: int = BINS) -> np.ndarray | None:
    """For each feature the lower edges of its bins: quantiles of all rows, both labels weighing the same, and tails of the good ones; None without both labels."""
    c = train.select("y", "x").mapInArrow(_counted_values, "y int, f int, v long, n long").groupBy("y", "f", "v").agg(F.sum("n").alias("n")).toPandas()  # bounded by the values' coarseness
    if c["y"].nunique() < 2:
        return None
    c["low"] = (c["v"].to_numpy() << (52 - MANTISSA)).view(np.float64)
    c["share"] = c["n"] / c.groupby(["y", "f"])["n"].transform("sum")

    def at(d: pd.DataFrame, shares: np.ndarray) -> list[float]:
        d = d.groupby("low")["share"].sum().sort_index()
        return d.index.to_numpy()[np.minimum(np.searchsorted(d.to_numpy().cumsum() / d.sum(), shares - 1e-12), len(d) - 1)].tolist()

    out = [at(d, np.linspace(0, 1, bins + 2)[1:-1]) + at(d[d["y"] == 1], np.array([0.005, 0.025, 0.975, 0.995])) for _, d in c.groupby("f")]
    return np.sort(np.array(out), axis=1)


def _span(edges: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """The least and largest score that ``w`` allows."""
    steps = np.concatenate([np.zeros((len(edges), 1)), np.cumsum(w.reshape(edges.shape), axis=1)], axis=1)
    low, high = float(steps.min(axis=1).sum()), float(steps.max(axis=1).sum())
    return low - 1e-9, max(high, low + 1e-6) + 1e-9


def _place(s: np.ndarray, low: float, high: float, places: int) -> np.ndarray:
    return np.clip(((s - low) / (high - low) * places).astype(np.int64), 0, places - 1)


def scores_counted(train: DataFrame, edges: np.ndarray, w: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """By label and place of the score: how many rows, and their mean score (the place's middle where there are none)."""
    low, high = _span(edges, w)

    def tally(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        s = binned(x, edges) @ w
        at = y.astype(np.int64) * places + _place(s, low, high, places)
        return [np.bincount(at, minlength=2 * places), np.bincount(at, weights=s, minlength=2 * places)]

    n, total = (a.reshape(2, places) for a in summed(train, tally))
    middle = low + (np.arange(places) + 0.5) * (high - low) / places
    return n, np.where(n > 0, total / np.maximum(n, 1), middle)


def _logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def all_pairs(train: DataFrame, edges: np.ndarray, weight: float = PAIRS, l2: float = L2, steps: int = 30) -> np.ndarray:
    """The weights of least ``weight`` * mean of log(1 + exp(s(bad) - s(good))) over all pairs of a good and a bad row + ``l2`` / 2 * |w|**2, by Newton's method."""
    d = edges.size
    w = np.zeros(d)
    for _ in range(steps):
        low, high = _span(edges, w)
        n, mean = scores_counted(train, edges, w, FINE)
        grid = np.linspace(low, high, FINE)
        pull = []  # of a row of either label with a score of the grid: the sum over the other label's rows
        for other, sign in ((1, 1), (0, -1)):
            there = np.flatnonzero(n[other])
            p = np.concatenate([_logistic(sign * (g[:, None] - mean[other, there])) @ n[other, there] for g in np.array_split(grid, 32)])
            pull.append(sign * p)
        rough, step = n.reshape(2, COARSE, -1), FINE // COARSE
        rows = rough.sum(axis=2)
        middle = np.where(rows > 0, (rough * mean.reshape(2, COARSE, step)).sum(axis=2) / np.maximum(rows, 1), low + (np.arange(COARSE) + 0.5) * (high - low) / COARSE)
        p = _logistic(middle[1][:, None] - middle[0][None, :])
        bend = p * (1 - p)  # of a good and a bad row by their places
        own = np.stack([rows[1] @ bend, bend @ rows[0]])

        def tally(x: np.ndarray, y: np.ndarray, w=w, low=low, high=high, grid=grid, pull=pull, own=own) -> list[np.ndarray]:
            z = binned(x, edges)
            s = z @ w
            at = _place(s, low, high, FINE) // step
            g = np.where(y == 1, np.interp(s, grid, pull[1]), np.interp(s, grid, pull[0]))
            place = (y * COARSE + at)[:, None] == np.arange(2 * COARSE)
            return [g @ z, (z * own[y, at][:, None]).T @ z, place.T.astype(np.float64) @ z]

        g, h, held = summed(train, tally)
        bad, good = held.reshape(2, COARSE, d)
        cross = good.T @ bend @ bad
        scale = weight / (n[0].sum() * n[1].sum())
        move = np.linalg.solve(scale * (h.reshape(d, d) - cross - cross.T) + l2 * np.eye(d), scale * g + l2 * w)
        w = w - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-3:
            break
    return w


def fit_all(train: DataFrame, base: float) -> dict | None:
    """The model of all rows of ``train(y, x)``; ``base`` is the share of label 0 among all labelled training rows."""
    edges = edges_of(train)
    if edges is None:
        return None
    w = all_pairs(train, edges)
    n, mean = scores_counted(train, edges, w, PLACES)
    weight = n * np.array([[base], [1 - base]]) / n.sum(axis=1, keepdims=True)
    both = weight.sum(axis=0)
    reach = np.cumsum(both)
    at = min(np.searchsorted(reach, base - 1e-12), PLACES - 1)
    held = np.flatnonzero(n[:, at])
    cut_at = mean[held, at].min() if len(held) else mean[0, at]
    y, s, some = np.repeat([0.0, 1.0], PLACES), mean.ravel(), n.ravel() > 0
    a, _ = logistic(np.stack([s[some], np.ones(some.sum())], axis=1), y[some], weight=weight.ravel()[some] * n.sum(), l2=0.01)
    return {"edges": edges, "w": w, "cut": float(cut_at), "slope": float(max(a, 1e-3))}


def learn_measured(rows: DataFrame, labels: DataFrame, parts: int = FOLDS, held: int = HELD) -> dict | None:
    """The model from every labelled row of ``measured`` outside the held-out fold."""
    base = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", parts) != held)).agg(F.avg(F.lit(1) - F.col("quality"))).first()[0]
    return None if base is None else fit_all(training_rows(rows, labels, parts, held), float(base))


def learn(docs: DataFrame, labels: DataFrame, parts: int = FOLDS, held: int = HELD) -> dict | None:
    """The model from every labelled row of ``docs`` outside the held-out fold."""
    return learn_measured(measured(docs.where(fold("doc_id", parts) != held)), labels, parts, held)


def _scored(model: dict | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(x, model, threshold))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    rows = measured(docs)
    out = rows.select("doc_id", "x").mapInArrow(_scored(learn_measured(rows, labels), threshold), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score under ``threshold``."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(scores(x, model, threshold) >= threshold))

    return docs.mapInArrow(run, docs.schema)
