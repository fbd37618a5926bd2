import re
from collections import Counter

import zstandard

from surfmesh.llm import compression as C


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(inside) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


TEXTS = [None, "", "  \n\t", "one two three", "a b c d e " * 9, "é ü ## *$ %&|<>\n x\n x\nx\n\n\n", "line one is here\n" * 3 + "and others follow it with words", " ".join(f"w{k}" for k in range(300)), "w " * 20_000, " ".join(f"{k * 7919 % 9973}" for k in range(5000)), "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z 1 2 3"]


def test_counts_match_their_definition(docs):
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(None, "x", "s"), (3, TEXTS[3], "s")]
    got = C.quality(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, t in enumerate(TEXTS):
        r = by[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t and t[:40]
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_noise_and_keep_prose(docs):
    import random

    rng = random.Random(3)
    sounds = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    prose = " ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(600))
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + " " * (k % 7 == 0) for k in range(3000))
    low = " ".join(f"word{k % 10} again{k % 7}" for k in range(600))
    got = {r.doc_id: r for r in C.quality(docs([(1, prose, "s"), (2, noise, "s"), (3, low, "s")])).collect()}
    assert got[1].kept
    assert not got[2].kept and not got[3].kept


def verdict(text, bands):
    """kept by the statement of the method: base rules, the whole text's ratio within its band, and not more than the share of chunks out of theirs."""
    raw = (text or "").encode()
    if plain(text)[5]:
        return False

    def inside(piece):
        ratio = len(zstandard.ZstdCompressor(level=bands.level).compress(piece)) / len(piece)
        low, high = [(low, high) for least, low, high in bands.limits if least <= len(piece)][-1]
        return low <= ratio <= high

    n, size = len(raw), bands.chunk_bytes
    starts = [k * size for k in range(max(1, (n + size // 2) // size))]
    chunks = [raw[lo:hi] for lo, hi in zip(starts, [*starts[1:], n], strict=True)]
    bad = sum(not inside(c) for c in chunks) if len(chunks) > 1 else 0
    return inside(raw) and bad <= bands.chunk_share * (len(chunks) if len(chunks) > 1 else 0)


def test_verdicts_match_brute_force(spark, docs):
    """Over a whole table, and over texts that sit on the limits of lengths and chunks."""
    import random

    rng = random.Random(23)
    prose = lambda n: " ".join("".join(rng.choices("th er on an re he in ed nd ha at en".split(), k=rng.randint(1, 4))) for _ in range(n))
    texts = [*TEXTS, *(prose(n) for n in (9, 10, 11, 20, 50, 300, 900, 3000))]
    texts += [prose(3000).encode()[:n].decode() for n in (63, 64, 127, 128, 511, 512, 2047, 2048, 4096, 6143, 6144, 6145, 8191, 8192, 10_240)]
    texts += [prose(700) + "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + " " * (k % 9 == 0) for k in range(k)) for k in (500, 1500, 4000)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in C.quality(docs([(i, t, "s") for i, t in rows])).collect()}
    assert all(got[i].kept == verdict(t, C.Bands()) for i, t in rows)
    assert 8 <= sum(r.kept for r in got.values()) < len(rows) - 5
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in C.quality(table).collect()}
    for r in table.collect():
        assert found[r.doc_id].kept == verdict(r.text, C.Bands())


def test_every_length_has_a_band():
    bands = C.Bands()
    assert bands.limits[0][0] == 1 and not bands.within(100, 0.2) and bands.within(100, 0.9) and not bands.within(40, 0.3)


def test_chunks_cover_the_whole_text():
    packer = zstandard.ZstdCompressor(level=3)
    for n in (1, 4096, 6143, 6144, 8192, 50_001):
        _, chunks = C.ratios(b"x" * n, packer, 4096)
        assert sum(x for x, _ in chunks) in (0, n)
        assert all(2048 <= x < 6144 for x, _ in chunks)


def test_empty_table(docs):
    assert C.quality(docs([])).count() == 0
