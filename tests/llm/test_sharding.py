from collections import defaultdict

from pyspark.sql import functions as F

from surfmesh.llm import sharding as S


def brute(rows, limit):
    """The shards of (hash, bytes) rows by splitting bucket by bucket."""
    out, todo = {}, [("", rows)]
    while todo:
        name, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(name) == S.MOST_BITS:
            out |= {h: name for h, _ in own}
            continue
        for bit in "01":
            part = [(h, b) for h, b in own if f"{h:0{S.MOST_BITS}b}"[len(name)] == bit]
            if part:
                todo.append((name + bit, part))
    return out


def hashes(df):
    return [(r[0], r[1]) for r in df.select(S.hash_of(F.col("doc_id"), F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0))).collect()]


def test_buckets_split_only_while_oversized(docs):
    rows = [(k, "x" * (k * 37 % 400), "s") for k in range(700)] + [(1000, "y" * 5000, "s"), (1001, None, "s"), (None, "é" * 90, "s"), (None, None, "s")]
    table = docs(rows)
    limit = 2000
    out = S.sharded(table, limit=limit)
    assert out.columns == [*table.columns, "_shard", "_bytes"]
    got = out.withColumn("h", S.hash_of(F.col("doc_id"), F.col("text"))).collect()
    assert len(got) == len(rows)
    want = brute(hashes(table), limit)
    sizes = defaultdict(int)
    for r in got:
        sizes[r._shard] += r._bytes
        if r.doc_id != 1000:
            assert r._shard == want[r.h]
    assert [s for s, n in sizes.items() if n > limit] == [r._shard for r in got if r.doc_id == 1000]
    assert sum(r._shard == next(x._shard for x in got if x.doc_id == 1000) for r in got) == 1


def test_rows_that_no_bit_tells_apart(docs):
    rows = [(5, "z" * 300, "s")] * 50 + [(5, "w" * 900, "s")] + [(6, "a", "s")]
    got = S.sharded(docs(rows), limit=1000).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r._shard] += r._bytes
    assert len(got) == 52 and max(sizes.values()) <= 1000


def test_one_shard_and_none(docs):
    assert {r._shard for r in S.sharded(docs([(1, "a", "s"), (2, None, "s")])).collect()} == {""}
    assert S.sharded(docs([])).count() == 0


def test_many_rows_of_one_id_in_many_partitions(docs):
    rows = [(5, "z" * (100 + k % 3), "s") for k in range(400)] + [(5, "w" * 900, "s")] * 3 + [(6, "a", "s")]
    got = S.sharded(docs(rows).repartition(9), limit=1000).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r._shard] += r._bytes
    assert len(got) == 404 and max(sizes.values()) <= 1000 and len(sizes) < 60


def test_a_kept_directory_deals_later_rows(spark, docs, tmp_path):
    """Old rows keep their shards; a new row's shard is that of the old ones it shares a bucket with, or an empty bucket beside them."""
    old = [(k, "x" * (k * 37 % 400), "s") for k in range(300)]
    new = [(k, "y" * 10, "s") for k in range(300, 900)]
    S.directory(docs(old), limit=2000).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    before = {r.doc_id: r._shard for r in S.sharded(docs(old), limit=2000).collect()}
    after = S.sharded(docs(old + new), limit=2000, cells=cells).withColumn("h", S.hash_of(F.col("doc_id"), F.col("text"))).collect()
    assert all(r._shard == before[r.doc_id] for r in after if r.doc_id in before)
    names = set(before.values())
    for r in after:
        bits = f"{r.h:0{S.MOST_BITS}b}"
        assert bits.startswith(r._shard)
        fits = [n for n in names if bits.startswith(n)]
        assert fits == [r._shard] if fits else r._shard not in names and any(n.startswith(r._shard[:-1]) for n in names)
    assert len(after) == 900
    none = S.directory(docs([]), limit=2000)
    assert {r._shard for r in S.sharded(docs(old), limit=10**9, cells=none).collect()} == {""}
