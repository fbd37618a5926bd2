import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import pytest
from surfmesh.llm import simhash as S


def plain(text):
    """The fingerprint, straight from its definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs, radius=3):
    """component ids of (id, fp) by comparing all."""
    parent = {fp: fp for _, fp in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for i, fp in pairs:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return [(i, fp, least.get(find(fp))) for i, fp in pairs]


def test_fingerprint_is_its_definition():
    for text in ("", " \t\n", "one", "one two", "A b C d e É f", "the the the the the", "x y z " * 40, "ÀB c\x0bd\x0ce"):
        assert S.simhash((text or "").encode()) & (1 << 64) - 1 == plain(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in S.covering_masks(3)]
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        flip = sum(1 << b for b in bits)
        assert any(not flip & m for m in masks)


def test_forest_links_like_all_pairs():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(30)]
    a, b = S.forest(np.array(fps, dtype=np.uint64), 3)
    own = {int(f): int(f) for f in fps} | dict(zip(map(int, a), map(int, b)))
    want = {fp: c for i, fp, c in brute(list(enumerate(fps)))}
    groups = {}
    for fp in own:
        groups.setdefault(own[fp], set()).add(want[fp])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_components_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 8)  # so that buckets are dealt in blocks
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(5)]
    rows = []
    for k in range(150):
        t = base[k % 5].split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, " ", None), (None, base[0], "s"), (503, "long " * 30_000, "s"), (503, "long " * 30_000, "s"), (None, "alone here now", "s")]
    got = S.near_duplicates(docs(rows)).select("doc_id", "fp", "component_id").collect()
    want = brute([(i, plain(t)) for i, t, _ in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=key) == sorted(want, key=key)


def test_keep_one_leaves_one_of_each_component(docs):
    text = "a passage of plain words that stands in several rows of this table"
    rows = [(3, text, "s"), (2, text, "s"), (2, text, "s"), (None, text, "s"), (9, "quite other words than those above stand here", "t"), (None, "only here without an id", "t"), (None, "only here without an id", "t")]
    table = docs(rows)
    kept = S.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 9), (True, None)]


def test_empty_table(docs):
    assert S.near_duplicates(docs([])).count() == 0
    assert S.keep_one(docs([])).count() == 0


def test_hexadecimal_form(docs):
    got = S.near_duplicates(docs([(1, "", "s")])).select(F.lower(F.lpad(F.hex("fp"), 16, "0"))).first()[0]
    assert got == "0" * 16


def jaccard_groups(rows, n=5, threshold=0.8):
    """Brute force: the ids that keep_one_similar() leaves, of distinct ids."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for k in sets:
            a, b = sets[i], sets[k]
            if i < k and (not a and not b or a | b and len(a & b) / len(a | b) >= threshold):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


def near_copies():
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = []
    for k in range(80):
        own = text(rng.choice((6, 40, 120, 400)))
        rows.append((10 * k, " ".join(own)))
        for c in range(1, k % 4 + 1):
            edited = list(own)
            for _ in range(rng.randint(1, max(1, len(own) // 45))):  # each edit changes five shingles at most
                edited[rng.randrange(len(own))] = f"x{rng.randrange(9000)}"
            rows.append((10 * k + c, " ".join(edited)))
    return [*rows, (5000, None), (5001, " "), (5002, "a b"), (5003, "A  b"), (5004, "a c")]


def test_near_copies_go_as_by_brute_force(docs):
    rows = near_copies()
    table = docs([(i, t, "s") for i, t in rows] + [(5000, None, "s")])
    got = S.keep_one_similar(table)
    assert got.columns == table.columns
    want = jaccard_groups(rows)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows) - 60
    assert S.keep_one_similar(docs([])).count() == 0


@pytest.mark.parametrize("limit", [("BUCKET", 2), ("BLOCK_SHINGLES", 100)])
def test_near_copies_in_blocks(docs, monkeypatch, limit):
    monkeypatch.setattr(S, *limit)
    rows = near_copies()
    assert sorted(r.doc_id for r in S.keep_one_similar(docs([(i, t, "s") for i, t in rows])).collect()) == jaccard_groups(rows)


def test_parts_cover_every_pair_within_their_radius():
    """Bits of all parts as far apart as PARTS * (PART_RADIUS + 1) - 1 allow: the worst case, no part closer than its radius, and others."""
    rng = np.random.default_rng(5)
    weights, n = S.table_weights(), 300
    a = rng.integers(-(1 << 63), 1 << 63, (n, S.WORDS))
    flips = np.zeros((n, 64 * (S.WORDS - S.CHECK)), dtype=np.uint8)
    for k in range(n):
        in_part = np.full(S.PARTS, S.PART_RADIUS + 1)
        in_part[rng.integers(S.PARTS)] -= 1
        for part in range(S.PARTS):
            flips[k, part * S.PART + rng.choice(S.PART, in_part[part], replace=False)] = 1
    b = a.copy()
    b[:, S.CHECK :] ^= np.packbits(flips, axis=1).view(np.int64)
    assert flips.sum(axis=1).tolist() == [S.PARTS * (S.PART_RADIUS + 1) - 1] * n
    assert (S.table_keys(a, weights) == S.table_keys(b, weights)).any(axis=1).all()


def apart(a, b):
    """Whether two fingerprints are too far apart to be compared, straight from the definition."""
    bits = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[: S.CHECK], b[: S.CHECK], strict=True)]
    return bits[0] > S.SIMILAR_RADIUS or sum(bits) > S.CHECK_RADIUS


@pytest.mark.parametrize("limits", [{}, {"_SHORT": 2}, {"BUCKET": 3}, {"BUCKET": 3, "_STEP": 7}, {"_STEP": 7}])
def test_covering_links_are_those_of_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(12)]
    prints = set()
    for k in range(90):
        words = list(texts[k % len(texts)])
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(60)] = "x"
        prints.add(tuple(S.set_print(S.shingle_set(" ".join(words).encode(), {})).tolist()))
    prints = sorted(prints)
    keys = S.table_keys(np.array(prints), S.table_weights())
    root = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (keys[i] == keys[j]).any() and not apart(prints[i], prints[j]):
            root = [root[i] if r == root[j] else r for r in root]
    want = {frozenset(prints[i][0] for i in range(len(prints)) if root[i] == r) for r in root}
    table = spark.createDataFrame([(60, list(p)) for p in prints], "size long, print array<long>").repartition(3)
    groups = {p[0]: {p[0]} for p in prints}
    for r in S.covering_links(table).collect():
        one = groups[r.a] | groups[r.b]
        groups.update(dict.fromkeys(one, one))
    assert {frozenset(g) for g in groups.values()} == want
    assert 12 <= len(want) < len(prints) - 20


def test_candidates_come_from_the_covering_tables_alone(docs, monkeypatch):
    """Without their links only copies go."""
    monkeypatch.setattr(S, "covering_links", lambda reps: reps.selectExpr("fp as a", "fp as b").where("false"))
    rows = near_copies()
    left = {i for i, _ in rows} - {r.doc_id for r in S.keep_one_similar(docs([(i, t, "s") for i, t in rows])).collect()}
    texts = {i: " ".join((t or "").split()).lower() for i, t in rows}
    assert left == {i for i in texts if any(k < i and texts[k] == texts[i] for k in texts)}


def test_fewer_links_connect_the_same(spark):
    rng = random.Random(4)
    links = [(a, rng.randrange(a + 1)) for a in range(300, 600) for _ in range(rng.randint(0, 2))] + [(a, b) for a in range(100, 200) for b in range(8)]
    table = spark.createDataFrame(links, "a long, b long")
    got = S.fewer_links(table)
    assert got.count() < len(set(links)) - 600

    def components(edges):
        return {(r.node, r.root) for r in S.connected_components(edges).collect()}

    assert components(got) == components(table)


def test_small_sets_meet_in_wider_tables(docs):
    """Texts of nine words and the first eight of them: 4 of 5 shingles. Of 4,000 such pairs the other tables miss some."""
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 62, (4000, 9))
    rows = [(2 * k + c, " ".join(map(str, w[: 9 - c])), "s") for k, w in enumerate(words.tolist()) for c in (0, 1)]
    sets = [[S.set_print(S.shingle_set(t.encode(), {})) for _, t, _ in rows[c::2]] for c in (0, 1)]
    a, b = map(np.array, sets)
    assert not (S.table_keys(a, S.table_weights()) == S.table_keys(b, S.table_weights())).any(axis=1).all()
    assert sorted(r.doc_id for r in S.keep_one_similar(docs(rows)).collect()) == list(range(0, 8000, 2))
