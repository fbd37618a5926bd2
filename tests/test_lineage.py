import random

import pytest
from pyspark.sql import functions as F

from surfmesh.plans import lineage
from surfmesh.plans.lineage import connected_components, numbered


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    values = [rng.randrange(100) for _ in range(500)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int").repartition(7)
    got = numbered(df, "n", "v", "k").orderBy("n").collect()
    assert [(r.v, r.k) for r in got] == sorted(zip(values, range(500), strict=True)) and [r.n for r in got] == list(range(500))
    assert numbered(df.where("v < 0"), "n", "v").count() == 0


@pytest.mark.parametrize(("chunk", "kind"), [(1_000_000, "long"), (20, "int"), (1, "long"), (20, "string")])
def test_components_by_chunks(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(lineage, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(170)] + [(100 + rng.randrange(300),) * 2]
    root = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    found = connected_components(df.select(F.col("a").cast(kind), F.col("b").cast(kind)))
    assert found.schema["node"].dataType == found.schema["root"].dataType == df.select(F.col("a").cast(kind)).schema["a"].dataType
    assert sorted((int(r.node), int(r.root)) for r in found.collect()) == sorted(root.items())


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path, rounds=3).where("root = 0").count() == 3001


def test_components_like_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
