import random
import re

from conftest_llm import clash
from pyspark.sql import functions as F

from tessera.llm import op8_licenses as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check(r, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in op.PHRASES.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
    assert r["base_labels"] == ",".join(sorted(labels))
    assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_whole_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = op.licenses(clash(documents)).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r["doc_id"]])


def test_odd_rows(docs_of):
    texts = ["CC BY cc-by CC. By, ALL rights  reserved cc", None, "", "cc bYé general Public Lİcense cK by cc by", "a " * 150_000 + "general public license", "cc by cc by", "by", "\x00CC\x00BY\x7f"]
    ids = list(range(len(texts)))
    got = op.licenses(docs_of(texts + texts[:2], ids=ids + [0, None])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        check(r, texts[r["doc_id"]] if r["doc_id"] is not None else None)
    assert op.licenses(docs_of([])).count() == 0


def test_diagonals(docs_of):
    notice = op.TEMPLATES["mit"][2]
    edited = notice.replace("granted", "granted now").replace("deal in", "deal freely in")  # words put in: neighbouring diagonals
    half = " ".join(notice.split()[:8])
    got = {r["doc_id"]: r for r in op.licenses(docs_of([f"x {notice} y", f"Z. {edited}", half, "released software license mit the under", f"{notice} {notice}"])).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "", "", "mit"]
    assert got[0]["score"] == 1.0 and 0.6 <= got[1]["score"] < 1.0 and got[2]["score"] == 0.0
    rows = op.spans(op.votes(docs_of([f"x {notice} y"]).selectExpr("doc_id as rid", "split(text, ' ') as words"), docs_of([]).sparkSession)).where("label = 'mit'").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(1, 1 + len(notice.split()))]


def test_stays_native(documents):
    plan = op.licenses(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_spans(words, k=op.K):
    """Votes, merged diagonals and verification by plain loops."""
    out = []
    for label, body in [(lb, t.split()) for lb, ts in op.TEMPLATES.items() for t in ts]:
        diagonals = {}
        for j in range(len(body) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == body[j : j + k]:
                    diagonals.setdefault(i - j, set()).add(j)
        runs = []
        for d in sorted(diagonals):
            if runs and d - runs[-1][1] <= op.NEIGHBOURS:
                runs[-1][1:] = [d, runs[-1][2] + len(diagonals[d])]
            else:
                runs.append([d, d, len(diagonals[d])])
        for low, _, n in runs:
            if n < op.LEAST * (len(body) - k + 1):
                continue
            start = at = max(0, low - op.NEIGHBOURS)
            end, missed, places = start + 2 * (len(body) + op.NEIGHBOURS), op.NEIGHBOURS, []
            for w in body:
                ahead = words[at : min(end, at + op.NEIGHBOURS + 1 + missed)]
                if w in ahead:
                    at, missed = at + ahead.index(w) + 1, 0
                    places.append(at - 1)
                else:
                    missed += 1
            share = len(places) / max(len(body), places[-1] - places[0] + 1) if places else 0
            if share >= op.VERIFY:
                out.append((label, places[0], places[-1] + 1, share))
    return sorted(out)


def test_spans_against_plain_loops(docs_of, documents):
    rng, notices = random.Random(1), [t for ts in op.TEMPLATES.values() for t in ts]
    texts = [r["text"].lower() for r in documents.where("text rlike '(?i)licen|rights'").limit(60).collect()]
    for _ in range(120):
        w = rng.choice(notices).split()
        for _ in range(rng.randrange(6)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["other"], [w[p], "more"], ["the", "software"]])
        texts.append(" ".join(["x"] * rng.randrange(4) + w + ["y"] * rng.randrange(3) + rng.choice(notices).split()[: rng.randrange(40)]))
    docs = docs_of(texts).selectExpr("doc_id as rid", "text").withColumn("words", op.words_of(F.col("text"))).drop("text")
    want = {r["rid"]: plain_spans(r["words"]) for r in docs.collect()}
    got = {i: [] for i in want}
    for r in op.spans(op.votes(docs, docs.sparkSession)).collect():
        got[r["rid"]].append((r["label"], r["start"], r["end"], r["share"]))
    assert {i: sorted(x) for i, x in got.items()} == want and sum(map(len, want.values())) > 100


def test_words_out_of_place_are_no_notice(docs_of):
    words = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    torn = " filler filler filler filler filler ".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    got = {r["doc_id"]: r["labels"] for r in op.licenses(docs_of([" ".join(words), torn, " ".join(words[:15] + ["else"] * 3 + words[18:])])).collect()}
    assert got == {0: "bsd", 1: "", 2: "bsd"}
