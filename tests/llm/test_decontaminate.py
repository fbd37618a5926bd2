import random
import re
from collections import Counter

from pyspark.sql import functions as F

from surfmesh.llm import decontaminate as D


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(t, n=5):
    w = words(t)
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])


def brute(docs, items, threshold=0.8):
    """Best similarity of any item-sized window, of every document with every item."""
    out = {}
    for i, t in docs:
        a = grams(t)
        for k, b in items:
            b = grams(b)
            if not a or not b:
                continue
            best = 0
            for at in range(max(1, len(a) - len(b) + 1)):
                w = Counter(a[at : at + len(b)])
                o = sum((w & Counter(b)).values())
                best = max(best, o / (sum(w.values()) + len(b) - o))
            if best >= threshold:
                out[i, k] = round(best, 6)
    return out


def cases():
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(text(rng.randint(12, 50)))) for k in range(12)] + [(20, "a b c a b c a b c a b c a b c a b d e f"), (21, "only four words here"), (22, None), (23, "")]
    docs = []
    for k in range(60):
        body, item = text(rng.randint(0, 120)), words(items[k % 14][1])
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            put = list(item)
            if k % 6 == 0 and len(put) > 20:  # a changed word leaves a similarity of about 0.8
                put[0 if k % 4 else len(put) - 1] = "changed"
            body[at:at] = put
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "ONLY, four: words -- here!"), (103, items[3][1]), (104, items[3][1]), (105, "word1 " * 3000 + items[5][1])]
    return docs, items


def test_matches_are_those_of_brute_force(spark, docs):
    rows, items = cases()
    table = docs([(i, t, "s") for i, t in rows] + [(103, items[3][1], "s")])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_n", F.lit(1))
    got = D.matches(table, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == brute(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {r.doc_id for r in got} >= {0, 103, 104, 102, 105}
    kept = D.decontaminated(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {r.doc_id for r in got}


def test_shuffled_joins_give_the_same(spark, docs, monkeypatch):
    rows, items = cases()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    got = D.matches(docs([(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == brute(rows, items)


def test_fingerprint_and_blocks(spark):
    rng = random.Random(10)
    grams = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40)]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(grams)], "k int, g array<bigint>")
    got = {r.k: r for r in df.select("k", D.simhash(F.col("g")).alias("fp")).withColumn("blocks", F.array(*(D.block(F.col("fp"), k) for k in range(8)))).collect()}
    for k, g in enumerate(grams):
        want = sum(1 << b for b in range(64) if 2 * sum((x & (1 << 64) - 1) >> b & 1 for x in g) > len(g))
        assert got[k].fp & (1 << 64) - 1 == want
        assert got[k].blocks == [want >> 8 * b & 255 for b in range(8)]


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs([]), bench).count() == 0
    assert D.decontaminated(docs([(1, "a b", "s"), (None, None, "s")]), bench).count() == 2
