from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest_llm import clash

from tessera.llm import op3_toxicity as op


@pytest.mark.parametrize(
    ("text", "events"),
    [
        ("You are an idiot.", [["it"]]),
        ("You are not an idiot.", [["itn"]]),
        ("He said you are an idiot", [["itr"]]),
        ("I will kill you", [["vt"]]),
        ("I will never kill you", [["vtn"]]),
        ("They kill the process. You wait", []),
        ("the worthless, and", [["i"]]),
        ("not here and there or anywhere an idiot", [["i"]]),
        ("You idiot! You moron", [["it"], ["it"]]),
        ("", []),
        (None, []),
        ("clean words only", []),
    ],
)
def test_clauses(text, events):
    assert op.Grammar().events(text) == events


def test_composition_equals_running_machines_in_turn():
    rng, whole = np.random.default_rng(0), op.grammar()
    chain = [op.insult_machine()]
    for make in (op.threat_machine, op.target_machine, op.negation_machine, op.report_machine):
        alphabet = op.outputs(chain[-1]) if len(chain) == 1 else op.outputs(composed)
        composed = op.compose(chain[0] if len(chain) == 1 else composed, machine := make(alphabet))
        chain.append(machine)
    for _ in range(300):
        word = [op.CLASSES[i] for i in rng.integers(0, len(op.CLASSES), 12)]
        states, q = [m.start for m in chain], whole.start
        for a in word:
            q, out = whole.arcs[q, a]
            for k, m in enumerate(chain):
                states[k], a = m.arcs[states[k], a]
            assert out == a


def test_scores_come_from_clauses():
    g, w = op.Grammar(), op.prior()
    score = lambda t: float(np.array(g.features(t)) @ w)
    assert score("You idiot. You moron. You scum.") > score("You idiot moron scum.") > score("You idiot.") > score("You rest.")
    assert score("You are not an idiot.") < score("He said you are an idiot.") < score("You are an idiot.")
    assert op.clause_score(["it", "it", "vtn"], w) == pytest.approx(w[op.EVENTS.index("it")] * np.log2(3) + w[op.EVENTS.index("vtn")])
    for t in ("You idiot moron scum. I will kill you! A fool", "you idiot", "fine words"):  # one clause: the clause's score, the mean and the base
        parts = [op.clause_score(c, w) for c in g.events(t)]
        assert len(parts) != 1 or score(t) <= sum(parts) + op.BASE + 1e-9
    assert g.features("a. " * 5000 + "idiot")[-3] < g.features("a. " * 20 + "idiot")[-3]  # one clause of many, however long they are


def test_doubtful_stems_are_learned_where_they_are_dense(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    make = lambda k: " ".join([*(f"zorgle{word()}" for _ in range(k)), *(word() for _ in range(150))])
    rows = [(1, make(4)) for _ in range(150)] + [(0, make(int(k < 30))) for k in range(300)]
    sure, doubtful = op.learned_stems(spark.createDataFrame(rows, "y int, text string"), 150, 300, 1 / 3)
    assert not sure and doubtful == ["zorgle"]
    g = op.Grammar(sure, doubtful)
    assert g.events("a zorglexy b. not zorglexy") == [["w"], ["wn"]] and g.of("zorgl") == "O"


def test_held_out_recall(spark):
    d = "/root/testdata/sf0.1"
    got = op.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels := spark.read.parquet(f"{d}/labels.parquet")).where("held_out")
    rows = got.join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) >= 0.9
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) <= 0.01


def test_ties_and_repeats(docs_of, labels):
    got = op.toxicity(docs_of(["you idiot", "you idiot", "you idiot", "fine"], ids=[4, 4, None, 9]), labels).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] != 9}) == 1


def test_clause_rows(docs_of):
    got = {r["doc_id"]: r["clauses"] for r in op.clauses(docs_of(["You idiot! fine. I will kill you", "fine", None])).collect()}
    assert [c["events"] for c in got[0]] == ["it", "vt"] and got[0][0]["score"] == op.PRIOR["it"] and got[1] == got[2] == []


def test_learned_stems_do_not_break_the_lexicon():
    g = op.Grammar(["lowei"])
    assert g.events("a loweich b") == [["i"]] and g.events("a lowe b") == []


def test_held_out_rows(documents, labels):
    got = op.toxicity(documents, labels).collect()
    assert len(got) == documents.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    clean = [r["predicted"] for r in got if truth.get(r["doc_id"]) == 0]
    assert np.mean(clean) <= 0.02
    english = {r["doc_id"] for r in documents.where("lang = 'en' and text rlike 'idiot|moron|scum|worthless'").select("doc_id").collect()}
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in english)


def test_odd_rows(spark, docs_of, labels):
    texts = [None, "", "you idiot", "x " * 200_000 + "you are an idiot", "fine"]
    none = labels.where("false")
    got = sorted(op.toxicity(clash(docs_of(texts, ids=[None, 1, 2, 3, 4])), none).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [r["predicted"] for r in got] == [0, 0, 1, 1, 0]
    assert got[0]["score"] == got[1]["score"]
    assert op.toxicity(docs_of([]), none).count() == 0


def test_stems_need_varied_contexts(spark):
    w = lambda i: chr(97 + i % 26) * (1 + i // 26) + "q"
    rows = [(1, f"{w(i)} badstem {w(i + 7)}") for i in range(40)] + [(1, "same copied passage onlyhere again")] * 40 + [(0, f"{w(i)} good {w(i + 3)}") for i in range(80)]
    stems = op.learned_stems(spark.createDataFrame(rows, "y int, text string"), 80, 80, 0.5)
    stems = [*stems[0], *stems[1]]
    assert "badstem" in stems and not any(s.startswith(("copied", "onlyher", "passage")) for s in stems)


def test_features_are_of_clauses():
    """Against a plain loop: amounts by kind over the matched clauses, and mean amounts over all clauses; words outside clauses don't matter."""
    import re
    from math import log2

    machine = op.Grammar(["blarg"], ["snor"])
    texts = ["You blarg idiot. Fine day here! Not a moron; he said: scum", "snorfle snorty. a b c. snor", "nothing at all", "", "You idiot " + "and so on " * 40 + ". ok"]
    for text in texts:
        clauses = [c for c in re.split(r"[.!?;:\n]", text.lower()) if re.search(r"[^\W\d_]", c)]
        found = [e for e in (machine._run(re.findall(r"[^\W\d_]+", c)) for c in clauses) if e]
        want = [log2(1 + sum(log2(1 + c.count(e)) for c in found)) for e in op.EVENTS]
        want += [log2(1 + 100 * sum(log2(1 + sum(c.count(e) for e in kinds)) for c in found) / max(1, len(clauses))) for kinds in op.DENSE]
        assert machine.features(text) == pytest.approx([*want, 1.0])
        score = sum(op.clause_score(c, op.prior()) for c in found)
        assert (score > 0) == bool(found)
    longer = machine.features("You idiot. ok " + "word " * 500)
    assert longer == machine.features("You idiot. ok")  # the length of a clause is nothing


def test_every_labelled_row_trains(spark, docs_of, monkeypatch):
    """Far more labelled rows than a sample of 4,000 holds: stems and weights are learned from each id outside the held-out fold."""
    n, seen = 9000, []
    docs = docs_of([f"you idiot {i}" if i % 3 else f"fine {i}" for i in range(n)], ids=list(range(n)))
    labels = spark.range(n).selectExpr("id as doc_id", "0 as quality", "cast(id % 3 > 0 as int) as toxic")
    stems = op.learned_stems
    monkeypatch.setattr(op, "learned_stems", lambda train, bad, good, base: (seen.append((train.count(), bad, good)), stems(train, bad, good, base))[1])
    assert op.toxicity(docs, labels).count() == n
    ids = [i for i in range(n) if crc32(str(i).encode()) % 5 != 0]
    assert seen == [(len(ids), sum(i % 3 > 0 for i in ids), sum(i % 3 == 0 for i in ids))] and len(ids) > 6000


def test_weights_equal_the_fit_in_memory(spark, docs_of):
    """Newton steps on sums of tasks against the same loss over rows held in memory."""
    from tessera.llm.shared import logistic

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.exponential(size=(400, op.WIDTH - 1)), np.ones(400)])
    y = (x[:, 0] - x[:, 4] + rng.normal(size=400) > 0.8).astype(int)
    train = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, x array<double>").repartition(7)
    share = np.where(y == 1, 0.1 / y.sum(), 0.9 / (1 - y).sum()) * len(y)
    assert op.learn_weights(train, 0.1) == pytest.approx(logistic(x, y, weight=share, prior=op.prior()), abs=1e-5)


def test_stems_are_counted_as_by_a_plain_loop(spark, monkeypatch):
    import re
    from collections import Counter

    rng = np.random.default_rng(4)
    rows = [(int(i % 3 == 0), " ".join("".join(rng.choice(list("abc"), rng.integers(2, 9))) for _ in range(60))) for i in range(50)] + [(1, None), (0, "")]
    want = Counter()
    for y, text in rows:
        words = re.findall(r"[^\W\d_]+", text or "")
        n = Counter(w[:k] for w in words for k in op.LENGTHS if len(w) >= k)
        want.update({(s, "sure", y): 1 for s in n} | {(s, "dense", y): 1 for s, c in n.items() if c >= max(2, op.RATE * (len(words) + 2))})
    op_rows = spark.createDataFrame(rows, "y int, text string").repartition(3).mapInArrow(op._stems, f"stem string, {', '.join(f'{c} long' for c in op.SUMS)}").collect()
    got = Counter()
    monkeypatch.setattr(op, "STEM_BLOCK", 300)
    batch = pa.RecordBatch.from_pylist([{"y": y, "text": t} for y, t in rows])
    blocks = list(op._stems(iter([batch])))
    assert len(blocks) > 2 and sum(pc.sum(b["sure_pos"]).as_py() + pc.sum(b["sure_neg"]).as_py() for b in blocks) == sum(n for (_, k, _), n in want.items() if k == "sure")
    many = pa.RecordBatch.from_pylist([{"y": 1, "text": " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(200_000))}])
    assert all(isinstance(b, pa.RecordBatch) for b in op._stems(iter([many])))
    for r in op_rows:
        got.update({(r["stem"], k, y): r[f"{k}_{'pos' if y else 'neg'}"] for k in ("sure", "dense") for y in (0, 1)})
    assert +got == want


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_a_label_are_not_shuffled(spark, docs_of, monkeypatch):
    """However many labelled ids there are: no bound decides, and the same rows come out."""
    from tessera.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 10)
    rng, n = np.random.default_rng(5), 400
    docs = docs_of([rng.bytes(2000).hex() for _ in range(n)], ids=[i - 40 for i in range(n)])
    ids = spark.range(0, n, 10).selectExpr("id as doc_id", "cast(id % 20 = 0 as int) as y")
    before = shuffled(spark)
    got = shared.labelled_texts(docs, ids).collect()
    assert shuffled(spark) - before < 0.25 * n * 4000
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(tuple(r) for r in got) == sorted((r["y"], texts[r["doc_id"]]) for r in ids.collect() if r["doc_id"] in texts)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15, 64, 1])
def test_a_full_bitmap_loses_no_row(spark, monkeypatch, bits):
    from tessera.llm import shared

    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    rows = spark.range(-300, 3000).selectExpr("id * 7919 as k", "id as text").union(spark.sql("select 9223372036854775807L, 1L union all select -9223372036854775807L - 1, 2L"))
    keys = rows.where("text % 3 = 1")
    got = [r["text"] for r in shared.may_match(rows, keys, "k").collect()]
    mine = [r["text"] for r in keys.collect()]
    assert len(got) == len(rows.where("true").collect()) if bits == 1 else set(mine) <= set(got)
    assert not set(mine) - set(got) and (bits < 1 << 26 or len(got) <= len(mine) + 2)
    assert shared.may_match(rows, keys.where("false"), "k").count() == 0
