import random

from surfmesh.llm import unitdedup as U
from surfmesh.llm import winnowing as W
from surfmesh.llm.spans import joined, without


def text(rng, n):
    return " ".join("w" + str(rng.randrange(5000)) for _ in range(n))


def test_spans():
    assert joined([(5, 7), (0, 2), (1, 5)]) == [(0, 7)]
    assert without("abcdef", [(1, 2), (4, 6)]) == "acd"


def passages(rng):
    shared = [text(rng, 70) for _ in range(4)]
    rows = []
    for k in range(40):
        own = text(rng, 120).split()
        at = rng.randrange(len(own))
        rows.append((k, " ".join(own[:at] + (shared[k % 5].split() if k % 5 < 4 else []) + own[at:])))
    return shared, rows


def test_later_passages_go_and_the_first_stays(docs):
    shared, rows = passages(random.Random(11))
    got = {r.doc_id: r for r in U.deduplicated(docs([(i, t, "s") for i, t in rows])).collect()}
    for i, t in rows:
        r = got[i]
        assert r.text == without(t, [(s.start, s.end) for s in r.removed])
        assert r.n_removed == len(t) - len(r.text)
        if i < 5 or i % 5 == 4:
            assert r.text == t
        else:
            gone = " ".join(t[s.start : s.end] for s in r.removed).split()
            assert len(gone) >= 40 and set(gone) <= set(shared[i % 5].split())


def plain(line):
    """A line as it is compared: words without anything but letters and digits, in lower case."""
    return " ".join(w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in line.split()) if w)


def line_rows(rng, n=60):
    pool = [text(rng, rng.choice([1, 2, 5, 12, 30, 90])) for _ in range(40)]
    rows = []
    for k in range(n):
        lines = [rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) if rng.random() < 0.5 else text(rng, rng.choice([1, 3, 15, 70])) for _ in range(rng.randint(0, 9))]
        rows.append((k, "\n".join([*lines, *[""] * rng.randint(0, 2), *lines[: rng.randint(0, 2)]])))
    return rows


def test_whole_repeated_lines_match_brute_force(docs):
    """With min_line_words=1 what stays of every line that equals an earlier one is nothing, and other lines lose no more than units."""
    rows = line_rows(random.Random(21))
    got = {r.doc_id: r for r in U.deduplicated(docs([(i, t, "s") for i, t in rows]), min_line_words=1).collect()}
    kept = {r.doc_id: r for r in U.deduplicated(docs([(i, t, "s") for i, t in rows])).collect()}
    seen, repeats = set(), 0
    for i, t in rows:
        at, want = 0, []
        for line in t.split("\n"):
            if plain(line):
                start = at + len(line) - len(line.lstrip())
                if plain(line) in seen:
                    want.append((start, start + len(line.strip())))
                seen.add(plain(line))
            at += len(line) + 1
        listed = [(s.start, s.end) for s in got[i].repeated_lines]
        # A line may also be pieced together from units of several earlier ones.
        assert set(want) <= set(listed) and len(listed) - len(want) <= 1
        assert listed == [(s.start, s.end) for s in kept[i].repeated_lines]
        gone = [(s.start, s.end) for s in got[i].removed]
        assert all(any(lo <= a and b <= hi for lo, hi in gone) for a, b in want)
        assert got[i].text == without(t, gone) and kept[i].text == without(t, [(s.start, s.end) for s in kept[i].removed])
        repeats += len(want)
    assert repeats > 100


def test_repeated_windows_match_brute_force(docs):
    """Of every run of 50 words and more that stands earlier too, at most a few words at either end stay; nothing else goes but repeats."""
    rng = random.Random(22)
    broken = lambda n: [w + rng.choice(["", "", "", "\n"]) for w in text(rng, n).split()]
    shared = [broken(rng.choice([55, 70, 200])) for _ in range(12)]
    rows = []
    for k in range(70):
        words = broken(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r for r in U.deduplicated(docs([(i, t, "s") for i, t in rows])).collect()}
    windows, words_before, runs = set(), set(), 0
    for i, t in rows:
        words = t.split()
        own = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        again = [w in windows for w in own]
        inside = [any(again[max(0, k - 49) : k + 1]) for k in range(len(words))]
        place, at = [], 0
        for w in words:
            at = t.index(w, at)
            place.append(at)
            at += len(w)
        gone = [any(s.start <= p < s.end for s in got[i].removed) for p in place]
        k = 0
        while k < len(words):
            if inside[k]:
                end = k
                while end < len(words) and inside[end]:
                    end += 1
                assert sum(not g for g in gone[k:end]) <= 24, (i, k, end)
                runs += 1
                k = end
            else:
                k += 1
        before = words_before | set(words)
        assert all(w in before for w, g in zip(words, gone) if g)
        if not any(w in windows for w in own) and not set(own) & windows and len(set(words)) == len(words) and not set(words) & words_before:
            assert not any(gone)
        windows |= set(own)
        words_before |= set(words)
    assert runs > 30


def test_a_common_line_is_dealt_out(docs):
    """Of a line that every text has, a batch sends its first place alone to the digest's task."""
    rows = [(k, f"the same line in all of them\nown {k}", "s") for k in range(500)]
    found = U.units(docs(rows).coalesce(1)).collect()
    keys = [r._key for r in found]
    assert max(keys.count(k) for k in set(keys)) <= 2
    assert sum(r._words >= U.LATER for r in found) >= 498


def test_units_are_found_again_in_other_surroundings():
    rng = random.Random(12)
    passage = text(rng, 60)
    a = U.units_of(text(rng, 30) + " " + passage + " " + text(rng, 30), {})
    b = U.units_of("x\ty\n" + text(rng, 9) + "  " + passage.upper().replace(" ", ", "), {})
    common = set(a[0].tolist()) & set(b[0].tolist())
    assert sum(n for d, n in zip(a[0].tolist(), a[1].tolist()) if d in common) >= 30


def test_odd_texts_for_units(docs):
    t = text(random.Random(13), 80)
    rows = [(3, t, "s"), (1, t, "s"), (1, t, "s"), (2, None, "s"), (4, "", "s"), (5, " \n\t ", "s"), (None, t, "s"), (6, "same " * 30_000, "s"), (7, "İ é\r\n" + t, "s")]
    got = U.deduplicated(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text == t and by[1].removed == []
    assert all(len(by[k].text.split()) < 15 for k in (3, None, 7))
    assert by[2].text is None and by[4].text == "" and by[5].text == " \n\t "
    assert len(by[6].text) < 1000
    assert U.deduplicated(docs([])).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(14)
    for _ in range(100):
        common = [rng.getrandbits(60) for _ in range(W.GRAM + W.WINDOW - 1)]
        a = [rng.getrandbits(60) for _ in range(rng.randint(0, 9))] + common + [rng.getrandbits(60) for _ in range(rng.randint(0, 9))]
        b = [rng.getrandbits(60) for _ in range(rng.randint(0, 9))] + common
        marks = [set(g[W.winnow(g)].tolist()) for g in (W.grams_of(a), W.grams_of(b))]
        assert marks[0] & marks[1]


def test_extension():
    assert W.extended([1, 2, 3, 4, 9], [7, 2, 3, 4, 8], 2, 2) == (1, 4)
    assert W.extended([1, 1, 1, 1], [1, 1, 1, 1], 2, 0) == (2, 4)


def line_lists(rows):
    """The lines that count of each text, in order of id, without the operator's help."""
    return [(i, [" ".join(x.split()) for x in t.split("\n") if x.split()]) for i, t in sorted(rows)]


def runs_to_go(rows, least):
    """For each text which of its lines are in a run of at least `least` lines that stands at an earlier place."""
    seen, out = set(), {}
    for i, lines in line_lists(rows):
        gone = [False] * len(lines)
        for k in range(len(lines) - least + 1):
            run = tuple(lines[k : k + least])
            if run in seen:
                gone[k : k + least] = [True] * least
            seen.add(run)
        out[i] = gone
    return out


def lines_left(text, removed):
    """Which of a text's lines that count are not within the removed spans."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.split():
            out.append(not any(s.start <= at and at + len(line) <= s.end for s in removed))
        at += len(line) + 1
    return out


def check_runs(docs, rows):
    got = {r.doc_id: r for r in W.deduplicated(docs([(i, t, "s") for i, t in rows])).collect()}
    sure, may, texts, n = runs_to_go(rows, W.GRAM + W.WINDOW - 1), runs_to_go(rows, 1), dict(rows), 0
    for i, lines in line_lists(rows):
        left = lines_left(texts[i], got[i].removed)
        long = [len(x.split()) >= W.LONG_WORDS for x in lines]
        # Runs of four and long lines that stand earlier go, whatever else they stand beside; what stands nowhere earlier stays.
        assert not any(stays and (must or (big and again)) for stays, must, big, again in zip(left, sure[i], long, may[i], strict=True)), i
        assert all(stays or again for stays, again in zip(left, may[i], strict=True)), i
        assert got[i].text == without(texts[i], [(s.start, s.end) for s in got[i].removed])
        n += sum(sure[i])
    return n


def test_line_runs_match_brute_force(docs):
    rng = random.Random(15)
    pool = [f"line {k} of the pool" + " and more" * rng.choice([0, 0, 9]) for k in range(40)]
    rows = []
    for k in range(120):
        lines = [f"own {k} {rng.random()}" if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randint(1, 12))]
        at = rng.randrange(30)
        lines[rng.randrange(len(lines)) :] = pool[at : at + rng.randint(0, 8)]
        rows.append((k, "\n".join(lines)))
    assert check_runs(docs, rows) > 100


def test_runs_longer_than_their_first_place_go_whole(docs):
    """Trios: the first text has two or three lines of a passage, a middle one has other parts of it, a later one all of what the second has."""
    rng = random.Random(18)
    rows = []
    for k in range(60):
        passage = [f"passage {k} line {j}" for j in range(rng.randint(4, 9))]
        parts = [passage[:2], passage, passage[1:3], passage[-3:], passage]
        for j, part in enumerate(parts):
            rows.append((k * 5 + j, "\n".join([f"head {k} {j}", *part, f"tail {k} {j}"])))
    assert check_runs(docs, rows) > 300


def test_one_text_that_all_others_match(docs):
    """The first text is long and every other one has a piece of it."""
    rng = random.Random(19)
    first = [f"line {j} of the first" for j in range(400)]
    rows = [(0, "\n".join(first))]
    for k in range(1, 150):
        at = rng.randrange(390)
        rows.append((k, "\n".join([f"own {k}", *first[at : at + rng.randint(4, 9)], f"end {k}"])))
    assert check_runs(docs, rows) > 500


def test_odd_texts_for_lines(docs):
    t = "\n".join(f"line {k}" for k in range(9))
    rows = [(2, t, "s"), (1, t, "s"), (1, t, "s"), (3, None, "s"), (4, "\n\n", "s"), (None, "own\n" + t.replace("line", " line\t") + "\n", "s"), (5, "again\n" * 5000, "s")]
    got = W.deduplicated(docs(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == t and by[2].text == "" and by[None].text == "own\n"
    assert by[3].text is None and by[4].text == "\n\n" and len(by[5].text) < 100
    assert W.deduplicated(docs([])).count() == 0


def test_repeats_of_more_than_fifty_words_on_few_lines_go(docs):
    rng = random.Random(17)
    shared = [[text(rng, n) for n in sizes] for sizes in ((51,), (26, 25), (3, 48), (17, 17, 17), (17, 33, 2), (40, 5, 6))] + [["語" * 100]]
    rows = []
    for k in range(42):
        own = [text(rng, rng.randint(1, 30)) for _ in range(rng.randint(2, 9))]
        at = rng.randrange(1, len(own))
        rows.append((k, "\n".join([*own[:at], *shared[k % 7], *own[at:]])))
    rows += [(50, shared[0][0]), (51, "first\n" + shared[0][0])]
    got = {r.doc_id: r for r in W.deduplicated(docs([(i, t, "s") for i, t in rows])).collect()}
    for i, t in rows:
        kept = got[i].text.split("\n")
        if i < 7:
            assert got[i].text == t
        elif i < 42:
            assert not set(kept) & set(shared[i % 7])
            assert len(kept) == len(t.split("\n")) - len(shared[i % 7])
    assert got[50].text == "" and got[51].text == "first\n"
