"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text becomes clauses of token classes: I insult, W doubtful insult (learned only), V threat, T target, N
negation, R reported speech, O any other. Five transducers read a clause; each passes its input on and rewrites some
symbols: the insult transducer marks insults, the threat transducer marks a threat that is followed by its target,
the target transducer marks insults in a clause with a target, the negation transducer cancels an event shortly after
a negation, the reporting transducer marks events after a reporting verb. They are composed once into one
deterministic machine.

Scores come from matched clauses alone. A clause's amount of a kind of event is log2(1 + events), so the second insult of a
clause adds less than the first; its score (``clause_score``) is the sum of weight * amount. A text's score is the logistic of a
base, of its clauses' amounts by kind (log2(1 + their sum), so further clauses add less and less), and of the mean amount of plain and of
doubtful insults over all its clauses, matched or not: how much of the text its matched clauses make up. No word counts
outside its clause. So "You idiot. You moron. You scum." scores higher than "You idiot moron scum."

Learned from labels: the insult lexicon is extended by word stems that are nearly sure signs of label 1 in
varied contexts (copies of one passage don't count as variety); stems that clean texts hold too, but only now and
then, become doubtful insults, which count by the share of clauses that hold them. Event weights come from logistic regression with the grammar's
hand-set weights as prior, so patterns that the labels never show keep their meaning.

Every labelled id outside the held-out fold trains, with one document each. Stems are counted in the tasks, then by stem over
all rows; weights come from Newton steps on sums of the tasks, so the driver gets at most ``STEMS`` stems of a kind and such sums. Texts of
training rows are shuffled once; features are computed once, lie in the shared folder and are what both training and scoring read.

Defined results: null and empty texts have no clause and get the base score; without labels of both classes
the prior weights score; a null doc_id is held out as the empty text's fold says and never trains; rows may
repeat; labels that are null or not 0 or 1 are ignored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .shared import cut_packed, fold, labelled, labelled_texts, summed, training_rows

FOLDS, HELD, THRESHOLD = 5, 0, 0.5
#: A learned stem: its lengths, how sure a sign it is at the corpus's rate of labels, the evidence for it in nats
#: (contexts times divergence from the training rows' rate), and how many are learned.
LENGTHS, SURE, EVIDENCE, STEMS = range(3, 9), 0.9, 18.0, 500
#: A doubtful stem is a sure sign where it is dense: twice in a row and in at least this share of its words.
RATE = 0.01
#: Most Newton steps, and the penalty on what differs from the prior weights.
STEPS, L2 = 30, 1.0
#: Of a doubtful stem and a sure one that is a form of it, the sure one gives way if the other has ``FORMS`` times its rows.
FORMS = 1.5
#: A longer stem replaces a shorter one if it keeps so large a share of its rows.
KEEPS = 0.95

# The lexicon of each class.
LEXICON = {
    "I": "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting imbecile fool cretin bastard asshole bitch whore slut filth vermin scumbag dumbass jerk degenerate "
    "idiote imbécile connard salaud crétin ordure abruti idiotin dummkopf arschloch abschaum trottel versager idiota imbécil estúpido estúpida basura escoria cabrón",
    "V": "kill hurt destroy beat burn shoot stab murder hang strangle crush slaughter tuer frapper töten umbringen matar golpear",
    "T": "you your yours you're youre u ur he she him her they them these those tu toi vous du dich ihr dein ustedes usted tú",
    "N": "not no never isn't aren't wasn't don't doesn't nobody neither without hardly isnt arent nicht kein keine nie pas jamais ni nunca",
    "R": "said says say wrote writes claimed called calls quote quoted quoting reported alleged allegedly according told dit disait sagte schrieb dijo",
}
#: How far a negation reaches, and how soon a threat's target follows, in tokens.
NEAR, SOON = 3, 4

Arc = tuple[object, str]


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, output symbol)``; each state accepts."""

    start: object
    arcs: dict[tuple[object, str], Arc]

    def alphabet(self) -> set[str]:
        return {s for _, s in self.arcs}


def build(start: object, alphabet: Iterable[str], step) -> Transducer:
    """The machine that ``step(state, symbol) -> (next, output)`` describes, over the states reached."""
    arcs, todo, alphabet = {}, [start], sorted(alphabet)
    while todo:
        q = todo.pop()
        for a in alphabet:
            arcs[q, a] = step(q, a)
            if (nxt := arcs[q, a][0]) != q and (nxt, alphabet[0]) not in arcs and nxt not in todo:
                todo.append(nxt)
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` makes of its output."""

    def step(q: tuple, a: str) -> Arc:
        p, b = first.arcs[q[0], a]
        r, c = second.arcs[q[1], b]
        return (p, r), c

    return build((first.start, second.start), first.alphabet(), step)


def outputs(t: Transducer) -> set[str]:
    return {out for _, out in t.arcs.values()}


CLASSES = "IWVTNRO"
#: Events start with i (insult), w (doubtful insult) or v (threat); marks follow: t target, n negated, r reported.


def insult_machine() -> Transducer:
    return build(0, CLASSES, lambda q, a: (0, a.lower() if a in "IW" else a))


def threat_machine(alphabet: set[str]) -> Transducer:
    """A threat verb waits for its target; the target's place then carries the event."""

    def step(left: int, a: str) -> Arc:
        if a == "V":
            return SOON, "O"
        if a == "T" and left:
            return 0, "v"
        return max(0, left - 1), a

    return build(0, alphabet, step)


def target_machine(alphabet: set[str]) -> Transducer:
    """Once a target was named in the clause, insults are aimed; a threat has its target already."""
    return build(False, alphabet, lambda q, a: (q or a in "Tv", "it" if a == "i" and q else "vt" if a == "v" else a))


def negation_machine(alphabet: set[str]) -> Transducer:
    def step(left: int, a: str) -> Arc:
        if a == "N":
            return NEAR, a
        return max(0, left - 1), a + "n" if left and a[0] in "iwv" else a

    return build(0, alphabet, step)


def report_machine(alphabet: set[str]) -> Transducer:
    return build(False, alphabet, lambda q, a: (q or a == "R", a + "r" if q and a[0] in "iwv" else a))


def grammar() -> Transducer:
    machine = insult_machine()
    for make in (threat_machine, target_machine, negation_machine, report_machine):
        machine = compose(machine, make(outputs(machine)))
    return machine


EVENTS = tuple(f"{e}{n}{r}" for e in ("i", "it", "vt", "w") for n in ("", "n") for r in ("", "r"))
#: Hand-set weights, the prior of the learned ones: a negated or reported event hardly counts.
PRIOR = {"i": 4.0, "it": 5.0, "vt": 4.0, "w": 0.5}
NEGATED, REPORTED, BASE = 0.2, 0.5, -3.0
#: Kinds whose mean amount over the clauses counts, and the prior weight of that.
DENSE, DENSITY = (("i", "it"), ("w",)), 0.0
WIDTH = len(EVENTS) + len(DENSE) + 1


def prior() -> np.ndarray:
    weight = lambda e: PRIOR[e.rstrip("nr")] * (NEGATED if "n" in e else 1) * (REPORTED if "r" in e else 1)
    return np.array([*map(weight, EVENTS), *[DENSITY] * len(DENSE), BASE])


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")


class Grammar:
    """The composed machine as a table over numbered states, with the lexicon and the learned insult stems."""

    def __init__(self, stems: Iterable[str] = (), doubtful: Iterable[str] = ()):
        self.classes = {w: c for c in LEXICON for w in reversed(LEXICON[c].split())}
        self.stems = {**dict.fromkeys(doubtful, "W"), **dict.fromkeys(stems, "I")}
        self.lengths = sorted({len(x) for x in self.stems}, reverse=True)
        machine = grammar()
        number = {q: i for i, q in enumerate(dict.fromkeys(q for q, _ in machine.arcs))}
        self.next = {(number[q], a): (number[p], out) for (q, a), (p, out) in machine.arcs.items()}
        self.start, self.stops = number[machine.start], frozenset(".!?;:\n")
        self.heads = frozenset(w[:3] for w in [*self.stems, *(w for w, c in self.classes.items() if c in "IV")])

    def of(self, token: str) -> str:
        """The token's class: by the lexicon, else by its longest learned stem."""
        return self.classes.get(token) or next((self.stems[token[:n]] for n in self.lengths if token[:n] in self.stems), "O")

    def events(self, text: str | None) -> list[list[str]]:
        """The events of each clause that has any."""
        return self._events(self._tokens(text))

    @staticmethod
    def _tokens(text: str | None) -> list[str]:
        return _TOKEN.findall((text or "").lower().replace("’", "'"))

    def _events(self, tokens: list[str]) -> list[list[str]]:
        live = {t for t in tokens if t[:3] in self.heads}
        live = {t for t in live if self.of(t) in "IWV"}
        if not live:
            return []
        out, start = [], 0
        for k, t in enumerate([*tokens, "."]):
            if t in self.stops:
                if not live.isdisjoint(clause := tokens[start:k]) and (got := self._run(clause)):
                    out.append(got)
                start = k + 1
        return out

    def _run(self, clause: list[str]) -> list[str]:
        q, got = self.start, []
        for t in clause:
            q, out = self.next[q, self.of(t)]
            if out[0] in "iwv":
                got.append(out)
        return got

    def features(self, text: str | None) -> list[float]:
        """For each kind of event the amount over the clauses, then the mean amounts over all clauses, and 1."""
        tokens = self._tokens(text)
        found = self._events(tokens)
        if not found:
            return [0.0] * (WIDTH - 1) + [1.0]
        amount = dict.fromkeys(EVENTS, 0.0)
        for clause in found:
            for e in set(clause):
                amount[e] += log2(1 + clause.count(e))
        clauses = sum(t not in self.stops and (k == 0 or tokens[k - 1] in self.stops) for k, t in enumerate(tokens))
        mean = lambda kinds: sum(log2(1 + sum(map(c.count, kinds))) for c in found) / clauses
        return [*[log2(1 + x) for x in amount.values()], *[log2(1 + 100 * mean(kinds)) for kinds in DENSE], 1.0]


def clause_score(events: list[str], weights: np.ndarray) -> float:
    """The score of one matched clause."""
    return float(sum(weights[EVENTS.index(e)] * log2(1 + events.count(e)) for e in dict.fromkeys(events)))


#: For each stem how many rows of label 1 and 0 hold it, and one of 64 bits for the words around its first place in each row of label 1; then the same of the rows where it is dense.
SUMS = ("sure_pos", "sure_neg", "sure_bits", "dense_pos", "dense_neg", "dense_bits")
#: Stems that a task counts before it passes them on.
STEM_BLOCK = 100_000


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SUMS`` by stem over the training rows of a task, in blocks; a stem may come in several."""
    rows: dict[str, list[int]] = {}

    def block() -> pa.RecordBatch:
        sums = np.array(list(rows.values()), np.uint64).reshape(-1, len(SUMS)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *[pa.array(np.ascontiguousarray(x)) for x in sums.T]], ["stem", *SUMS])

    for b in batches:
        for y, text in zip(b.column("y").to_pylist(), b.column("text")):
            words = ["", *re.findall(r"[^\W\d_]+", (text.as_py() or "").lower()), ""]
            places, first, n = {}, {}, Counter(words)
            for i in range(1, len(words) - 1):
                places.setdefault(words[i], i)
            by_stem: dict[str, int] = {}
            for w, i in places.items():
                for stem in [w[:k] for k in LENGTHS if len(w) >= k]:
                    first.setdefault(stem, i)
                    by_stem[stem] = by_stem.get(stem, 0) + n[w]
            least = max(2, RATE * len(words))
            for stem, i in first.items():
                s = rows.setdefault(stem, [0] * len(SUMS))
                bit = 1 << (xxh32_intdigest(f"{words[i - 1]} {words[i + 1]}".encode()) & 63) if y else 0
                for at in (0, 3) if by_stem[stem] >= least else (0,):
                    s[at + 1 - y] += 1
                    s[at + 2] |= bit
            if len(rows) >= STEM_BLOCK:
                yield block()
                rows.clear()
    yield block()


def learned_stems(train: DataFrame, bad: int, good: int, base: float) -> tuple[list[str], list[str]]:
    """Sure and doubtful stems that mark label 1, among ``bad`` and ``good`` rows of ``train(y, text)``; ``base`` is the corpus's rate of label 1."""
    each = train.select("y", "text").mapInArrow(_stems, f"stem string, {', '.join(f'{c} long' for c in SUMS)}")
    seen = each.groupBy("stem").agg(*[F.expr(f"{'bit_or' if c.endswith('bits') else 'sum'}({c})").alias(c) for c in SUMS])
    p, ratio = bad / (bad + good), (1 - base) / base * bad / good

    def passing(kind: str) -> dict[str, int]:
        pos, neg, bits = (F.col(f"{kind}_{x}") for x in ("pos", "neg", "bits"))
        # distinct contexts from the share of the 64 bits that are set
        contexts = F.least(pos.cast("double"), -64 * F.log(1 - F.least(F.bit_count(bits), F.lit(63)) / 64))
        share = pos / (pos + neg)
        divergence = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0)
        good_ones = seen.where(pos >= 3).where((pos >= SURE * (pos + ratio * neg)) & (contexts * divergence >= EVIDENCE))
        return {r["stem"]: r["n"] for r in good_ones.select("stem", pos.alias("n")).orderBy(F.desc("n"), F.length("stem"), "stem").limit(STEMS).collect()}

    seen = cut_packed(seen)
    sure, dense = _families(passing("sure")), _families(passing("dense"))
    dense = {x: n for x, n in dense.items() if not any(y.startswith(x) and m * FORMS > n for y, m in sure.items())}
    return sorted(x for x in sure if not any(x.startswith(y) for y in dense)), sorted(dense)


def _families(found: dict[str, int]) -> dict[str, int]:
    """Of each stem the longest form that keeps nearly all its rows, and no stem inside another's reach."""
    final: dict[str, int] = {}
    for stem in sorted(found, key=len):
        while longer := [x for x in found if len(x) == len(stem) + 1 and x.startswith(stem) and found[x] >= KEEPS * found[stem]]:
            stem = longer[0]
        if not any(stem.startswith(x) for x in final):
            final[stem] = found[stem]
    return final


def rate(labels: DataFrame) -> float | None:
    """The share of label 1 among all labels outside the held-out fold."""
    return labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD)).agg(F.avg("toxic")).first()[0]


def learn_words(docs: DataFrame, labels: DataFrame, base: float | None) -> tuple[list[str], list[str]]:
    """Learned stems from every labelled id of ``docs`` outside the held-out fold."""
    mine = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = cut_packed(labelled(labels, "toxic", FOLDS, HELD).join(mine.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    return learned_stems(labelled_texts(mine, ids), sizes[1], sizes[0], base) if len(sizes) == 2 else ([], [])


def measured(docs: DataFrame, words: tuple[list[str], list[str]]) -> DataFrame:
    """``(doc_id, hash, x)``: the features of each row under the learned ``words``, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(*words)
        for b in batches:
            x = [machine.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "hash", "x"])

    text = F.col("text").cast("string")
    return cut_packed(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(run, "doc_id long, hash long, x array<double>"))


def learn_weights(train: DataFrame, base: float) -> np.ndarray:
    """The weights of least logistic loss over all rows of ``train(y, x)``, classes weighing as in the corpus, by Newton's method from sums of tasks."""
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return prior()
    share = np.array([(1 - base) / sizes[0], base / sizes[1]]) * (sizes[0] + sizes[1])
    w = prior()
    for _ in range(STEPS):

        def tally(x: np.ndarray, y: np.ndarray, w=w) -> list[np.ndarray]:
            p, weight = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), share[y]
            return [x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x]

        grad, hess = summed(train, tally)
        step = np.linalg.solve(hess.reshape(WIDTH, WIDTH) + L2 * np.eye(WIDTH), grad + L2 * (w - prior()))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    base = rate(labels)
    rows = measured(docs, learn_words(docs, labels, base))
    weights = prior() if base is None else learn_weights(training_rows(rows, labels, "toxic", FOLDS, HELD), base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], ["doc_id", "score"])

    out = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clauses(docs: DataFrame, words: Iterable[str] = (), doubtful: Iterable[str] = (), weights: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, clauses)``: of each clause with an event its events, comma-joined, and its score."""
    words, doubtful, weights = list(words), list(doubtful), prior() if weights is None else weights
    kind = pa.list_(pa.struct([("events", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(words, doubtful)
        for b in batches:
            got = [[{"events": ",".join(c), "score": clause_score(c, weights)} for c in machine.events(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["doc_id", "clauses"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, clauses array<struct<events:string,score:double>>")
