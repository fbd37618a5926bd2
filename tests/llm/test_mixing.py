from collections import Counter

import pytest

from surfmesh.llm import mixing as M


def schedule(spark, quanta):
    return spark.createDataFrame([(quanta,)], "q array<bigint>").selectExpr(f"{M.schedule_sql()} as s").first().s


@pytest.mark.parametrize("quanta", [[1], [1, 1], [5, 3, 2], [1, 1, 1, 97], [7, 11, 13, 17, 19], [50] * 20, [1] * 40 + [60]])
def test_every_prefix_is_less_than_a_block_off(spark, quanta):
    h, picks = sum(quanta), schedule(spark, quanta)
    done = Counter()
    for t, s in enumerate(picks, 1):
        done[s] += 1
        for k, q in enumerate(quanta):
            assert abs(done[k] - t * q / h) < 1
    assert [done[k] for k in range(len(quanta))] == quanta


def check(rows, got, block, weights=None):
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, ((i, s) for i, _, s in rows)))
    assert len({r._position for r in got}) == len(got)
    # Blocks are full but for each source's last.
    sizes = Counter((r.source, r._block) for r in got)
    for s, n in Counter(r[2] for r in rows).items():
        assert sorted(v for (t, _), v in sizes.items() if t == s) == sorted([block] * (n // block) + [n % block] * (n % block > 0))
    slots = {r._slot: r.source for r in got}
    assert len({(r._slot, r.source) for r in got}) == len(slots)
    return slots


def test_mix_holds_its_target_until_a_source_runs_dry(docs, monkeypatch):
    monkeypatch.setattr(M, "RUN_ROWS", 50)  # so that sources have several runs
    rows = [(k, f"t{k}", "hot" if k % 3 == 0 else f"s{k % 5}" if k % 7 else None) for k in range(1200)] + [(None, "t", "hot"), (None, "u", None), (7, "t7", "s2"), (7, "t7", "s2")]
    table = docs(rows)
    out = M.mixed(table, block=8, period=100)
    got = out.collect()
    slots = check(rows, got, 8)
    shares = Counter(r[2] for r in rows)
    total = sum(n**0.5 for n in shares.values())
    quanta = {s: max(1, round(n**0.5 / total * 100)) for s, n in shares.items()}
    h, end = sum(quanta.values()), 1 + max(r._slot for r in got if r._in_target)
    done = Counter()
    for t in range(end):
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * q / h) < 1 for s, q in quanta.items())
    assert end > 20
    laid = M.laid_out(table, block=8, period=100)
    assert laid.columns == table.columns
    place = {(r.doc_id, r.text, r.source): r._position for r in got}
    order = [place[r.doc_id, r.text, r.source] for r in laid.collect() if r.doc_id != 7]  # of which there are copies
    assert len(order) == len(rows) - 3 and order == sorted(order)


def test_weights_and_pool(docs):
    rows = [(k, "t", f"s{k % 6}") for k in range(600)]
    got = M.mixed(docs(rows), weights={"s0": 0.5, "s1": 0.25, None: 0.25}, block=10, period=4).collect()
    first = Counter({r._slot: r.source if r.source in ("s0", "s1") else "pool" for r in got if r._slot < 20}.values())
    assert first == {"s0": 10, "s1": 5, "pool": 5}
    few = M.mixed(docs(rows), sources=2, block=10).collect()
    assert len(few) == 600 and len({r._position for r in few}) == 600
    with pytest.raises(ValueError):
        M.mixed(docs(rows), weights={"s0": 0.0})


def test_small_tables(docs):
    assert M.mixed(docs([])).count() == 0
    one = M.mixed(docs([(None, None, None)])).collect()
    assert [(r._position, r._in_target) for r in one] == [(0, True)]


def drift(weights, slots, end):
    """The largest distance of any source from its exact share, in blocks, before `end`."""
    total, worst = sum(weights), 0
    for w, own in zip(weights, slots, strict=True):
        for j, t in enumerate(own):
            if t < end:  # just before and just after the block
                worst = max(worst, t * w / total - j, j + 1 - (t + 1) * w / total)
    return worst


@pytest.mark.parametrize("rows", [150_000, 1_000_000, 10_000_000])
def test_drift_from_the_exact_weights_does_not_grow(rows):
    sizes = [rows // 3] + [rows * 2 // 60] * 20
    weights, blocks = [n**0.5 for n in sizes], [-(-n // 64) for n in sizes]
    slots, end = M.scheduled(M.exact(weights), blocks)
    assert [len(x) for x in slots] == blocks and sorted(t for x in slots for t in x) == list(range(sum(blocks))) and end > 0.5 * sum(blocks)
    assert drift(weights, slots, end) < 1 + 1e-6


def test_a_thousand_sources_and_a_rare_one():
    """Each of 1,000 sources is less than a block off its own weight, and so is one with 1/3000 of the whole."""
    weights = [1.0 + k % 7 for k in range(1000)]
    slots, end = M.scheduled(M.exact(weights), [40 * (1 + k % 7) for k in range(1000)])
    assert end > 100_000 and drift(weights, slots, end) < 1 + 1e-6
    slots, end = M.scheduled(M.exact([1.0, 2999.0]), [20, 2999 * 20])
    assert drift([1.0, 2999.0], slots, end) < 1 + 1e-6 and end == 60_000


def test_slots_are_those_of_the_sql(spark):
    for quanta in ([5, 3, 2], [1, 1, 1, 97], [7, 11, 13, 17, 19]):
        slots, end = M.scheduled(quanta, quanta)
        want = schedule(spark, quanta)
        assert all(want[t] == s for s, own in enumerate(slots) for t in own) and [len(x) for x in slots] == quanta and end == sum(quanta)


def test_mix_takes_small_weights_exactly(docs):
    rows = [(k, "t", "rare" if k % 30 == 0 else "hot") for k in range(9000)]
    got = M.mixed(docs(rows), weights={"hot": 0.9998, "rare": 0.0002}, block=1).collect()
    slots = {r._slot: r.source for r in got if r._in_target}
    assert len(slots) > 8000 and sum(s == "rare" for s in slots.values()) in (1, 2)


def test_every_source_has_its_own_weight(docs):
    rows = [(k, "t", f"s{k % 400:03}") for k in range(4000)]
    got = M.mixed(docs(rows), block=2).collect()
    assert all(r._in_target for r in got)
    # Equal sources take turns: of any 400 slots each has one.
    for lo in range(0, 2000, 400):
        assert len({r.source for r in got if lo <= r._slot < lo + 400}) == 400
    weights = {f"s{k:03}": 1.0 + k % 2 for k in range(400)}
    first = Counter({r._slot: r.source for r in M.mixed(docs(rows), weights=weights, block=2).collect() if r._slot < 600}.values())
    assert first == {s: int(w) for s, w in weights.items()}


def test_a_pool_weighs_what_its_members_do(docs):
    rows = [(k, "t", f"s{k % 10}") for k in range(1000)]
    got = M.mixed(docs(rows), sources=2, block=1).collect()
    assert Counter(r.source in ("s0", "s1") for r in got if r._slot < 100) == {True: 20, False: 80}


def test_blocks_grow_so_that_the_schedule_stays_small(docs, monkeypatch):
    monkeypatch.setattr(M, "MOST_BLOCKS", 20)
    rows = [(k, "t", f"s{k % 3}") for k in range(2000)]
    got = M.mixed(docs(rows), block=2).collect()
    check(rows, got, 100)
    assert len({r._slot for r in got}) <= 23


def test_ties_and_clashing_names(spark):
    """Rows that share an id come in the order of their texts' hashes, whatever the partitioning; own columns of the added names stay when laid out."""
    rows = [(k % 5, f"text {k}", "s", 100 + k, {"a": k}) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _slot long, _block map<string,int>")
    want = {r.text: r._position for r in M.mixed(df.coalesce(1)).collect()}
    assert want == {r.text: r._position for r in M.mixed(df.repartition(7)).collect()}
    assert "_slot" in M.mixed(df).columns and M.mixed(df).columns.count("_slot") == 1
    laid = M.laid_out(df)
    assert laid.columns == df.columns and sorted((r.text, r._slot) for r in laid.collect()) == sorted((r[1], r[3]) for r in rows)
    # Partition after partition in the order of the mix.
    assert [want[r.text] for r in laid.collect()] == sorted(want.values())
