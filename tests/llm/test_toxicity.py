import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfmesh.llm import toxicity as T


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choices(["th", "er", "on", "an", "re", "he"], k=rng.randint(2, 4))) for _ in range(40)]
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zonkhead", "vilely" + rng.choice(["er", "on", "an"])])
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return T.train([t for _, t, _ in rows], [y == 1 for *_, y in rows])


def test_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    trans = rng.normal(size=(2, 2))
    sizes = [1, 3, 6, 2]
    emit = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(emit), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    p, _, _ = T.marginals(emit, first, trans)
    at = 0
    for n in sizes:
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emit[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[at : at + n], on / total)
        at += n


def test_lanes_of_a_long_text_agree_with_one_sweep():
    rng = np.random.default_rng(6)
    trans = np.array([[0.5, -0.6], [-0.6, 1.5]])
    emit = rng.normal(size=3000) - 1
    first = np.zeros(3000, dtype=bool)
    first[0] = True
    p, ahead, _ = T.marginals(emit, first, trans)
    a, m = [], 0.0
    for e in emit:
        a.append(m)
        x = m + e
        m = np.logaddexp(trans[0, 1], x + trans[1, 1]) - np.logaddexp(trans[0, 0], x + trans[1, 0])
    assert np.allclose(ahead, a, atol=1e-9)


@pytest.mark.parametrize("pull", [0.0, 0.5, 3.0, 12.0])
def test_marginals_do_not_depend_on_their_neighbours(pull):
    """However strongly labels stick together, a text between others has the marginals that it has alone."""
    rng = np.random.default_rng(8)
    trans = np.array([[pull, 0.0], [0.0, pull]])
    texts = [rng.normal(size=n) * 2 - 0.3 for n in (700, 3, 1, 900, 260)]
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    p, _, _ = T.marginals(np.concatenate(texts), first, trans)
    alone = np.concatenate([T.marginals(t, np.arange(len(t)) == 0, trans)[0] for t in texts])
    assert np.abs(p - alone).max() < 1e-11


def test_training_in_chunks_is_training_at_once(monkeypatch):
    rows = corpus(120)
    texts, toxic = [t for _, t, _ in rows], [y == 1 for *_, y in rows]
    whole = T.train(texts, toxic)
    monkeypatch.setattr(T.chunks_of, "__defaults__", (100,))
    parts = T.train(texts, toxic)
    assert whole.weights.keys() == parts.weights.keys() and all(abs(whole.weights[k] - parts.weights[k]) < 1e-6 for k in whole.weights)
    assert np.allclose(whole.doc, parts.doc, atol=1e-6)


def test_long_texts_are_learnt_from(spark, docs):
    """All toxic texts are long ones."""
    rows = [(i, t if not y else t + " harmless filler" * 30_000, y) for i, t, y in corpus(100)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs([(i, t, "s") for i, t, _ in rows]), labels)
    assert any("zonk" in f for f in model.weights)


def test_scores_tell_held_out_texts_apart(docs, model):
    rows = corpus(200, seed=7)
    got = {r.doc_id: r for r in T.score(docs([(i, t, "s") for i, t, _ in rows]), model).collect()}
    right = sum(got[i].predicted == y for i, _, y in rows)
    assert right >= 195
    for i, text, y in rows:
        if y:
            found = [text[s.start : s.end] for s in got[i].spans]
            assert found and all("zonkhead" in f or "vilely" in f for f in found)


def by_hand(text, model):
    """The score and the tagged spans by plain loops over the words, in log space."""
    found = [(w.start(), w.end(), model.emission(w.group())) for w in T._WORD.finditer(T.lowered(text))]
    if not found:
        sums = [1, 0, 0, 0, 0]
    else:
        lse = lambda a, b: max(a, b) + np.log1p(np.exp(-abs(a - b)))
        t, n = model.trans, len(found)
        ahead, back = [(0.0, 0.0)], [(0.0, 0.0)]
        for *_, e in found[:-1]:
            a, b = ahead[-1]
            ahead.append((lse(a + t[0][0], b + e + t[1][0]), lse(a + t[0][1], b + e + t[1][1])))
        for *_, e in found[:0:-1]:
            a, b = back[-1]
            back.append((lse(t[0][0] + a, t[0][1] + e + b), lse(t[1][0] + a, t[1][1] + e + b)))
        back.reverse()
        p = [1 / (1 + np.exp(np.clip(-(ahead[k][1] - ahead[k][0] + found[k][2] + back[k][1] - back[k][0]), -700, 700))) for k in range(n)]
        total, top = sum(max(x - T._DOUBT, 0) for x in p), sorted(p)[::-1]
        sums = [1, np.log1p(total), np.sqrt(total / n), top[0], top[1] if n > 1 else 0]
        spans, last = [], None
        for k, x in enumerate(p):
            if x >= 0.5:
                if last == k - 1:
                    spans[-1] = (spans[-1][0], found[k][1])
                else:
                    spans.append((found[k][0], found[k][1]))
                last = k
        return 1 / (1 + np.exp(-np.dot(sums, model.doc))), spans
    return 1 / (1 + np.exp(-np.dot(sums, model.doc))), []


def test_the_query_matches_plain_loops(spark):
    """op1 over a whole table: every score and span by hand from the same model, which is learnt outside the held-out fold alone."""
    import zlib

    from surfmesh.llm import queries

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    seen = labels.where(F.col("doc_id").isin([r.doc_id for r in labels.collect() if not held(r.doc_id)]))
    model = T.fit(docs, seen)
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        score, spans = by_hand(r.text or "", model)
        assert got[r.doc_id].held_out == held(r.doc_id)
        assert abs(got[r.doc_id].score - score) < 1e-8 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert [(s.start, s.end) for s in got[r.doc_id].spans] == spans


def test_odd_rows(docs, model):
    rows = [(1, None, "s"), (2, "", "s"), (None, "zonkhead " * 9, None), (3, "İI zonkhead zonkhead zonkhead", "s"), (3, "İI zonkhead zonkhead zonkhead", "s"), (4, "clean " * 40_000, "s")]
    got = T.score(docs(rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == by[2].predicted == 0 and by[1].spans == []
    assert rows[3][1][by[3].spans[0].start : by[3].spans[0].end] == "zonkhead zonkhead zonkhead"
    table = docs(rows)
    kept = T.kept(table, model)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert T.score(docs([]), model).count() == 0


def test_fit_learns_only_where_it_may(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(docs([(i, t, "s") for i, t, _ in rows]), labels, learn=lambda i: i < 300)
    assert any("zonk" in f for f in model.weights)
    nothing = T.fit(docs([(i, t, "s") for i, t, _ in rows]), labels, learn=lambda i: F.lit(False))
    assert nothing.weights == {}
