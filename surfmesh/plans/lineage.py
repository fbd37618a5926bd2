"""Durable cuts of lineage, numbering of rows, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

#: Edges that are contracted at a time: some 100 bytes each.
CHUNK = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset and all run on this machine.

    On a cluster without one this raises, as executors can't read a folder of the driver's.
    """
    context = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="surfmesh-checkpoint-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def removed_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written here, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't cost its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows numbered from 0 in this order, cut. Sorted parts are numbered by themselves and moved up by the rows of the parts
    before, so that no task sees all rows; only the table of part sizes is broadcast."""
    parts = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return cut(own.join(F.broadcast(ahead), "_part").withColumn(name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hands its neighbours (large: greater ones; small: smaller ones) to the least it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _forest(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that aren't their component's least node, and that node of each: roots hook on to the least root that an edge leads to,
    and paths are halved, until nothing changes."""
    names, ends = np.unique(np.concatenate([lows, highs]), return_inverse=True)
    root, (a, b) = np.arange(len(names)), ends.reshape(2, -1)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while np.any((up := root[root]) != root):
            root = up
        a, b = root[a], root[b]
        a, b = a[open_ := a != b], b[open_]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, of whole numbers, b < a: those of up to CHUNK edges at a time become stars. Edges come sorted by their ends, so
    that what is numbered along a surface or a path is joined within few chunks."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(2)])
                n += batch.num_rows
            if n and (batch is None or n >= CHUNK):
                a, b = _forest(*(np.concatenate([x[k] for x in held]) for k in range(2)))
                held, n = [], 0
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

    return edges.repartitionByRange("b", "a").sortWithinPartitions("b", "a").mapInArrow(stage, "a long, b long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), root its component's least node. Nulls and self-links are no edges. An empty table
    gives an empty table.

    Edges of whole numbers are contracted by chunks first; only links between the chunks' roots go through the rounds.
    """
    plain = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if not all(isinstance(plain.schema[c].dataType, (IntegerType, LongType)) for c in "ab"):
        return _by_stars(plain.distinct(), rounds)
    kind = plain.schema["a"].dataType
    stars = cut(_contracted(plain.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    # A node goes to the least of its chunks' roots. Roots are tied where a node has several, and where one is a node below another.
    least = cut(stars.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("_most")))
    many = least.where("b <> _most").select("a", F.col("b").alias("m"))
    ties = stars.join(many, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    heads = least.select("b").distinct().unionByName(ties.select(F.col("a").alias("b"))).distinct()
    below = least.join(heads.select(F.col("b").alias("a")), "a", "left_semi").select("a", "b")
    linked = _by_stars(cut(ties.unionByName(below).distinct()), rounds).select(F.col("node").alias("b"), F.col("root").alias("_root"))
    top = F.coalesce("_root", "b").cast(kind).alias("root")
    found = least.select(F.col("a").alias("node"), "b").join(linked, "b", "left").select(F.col("node").cast(kind).alias("node"), top)
    # What is below nothing: roots of chunks that aren't nodes of others.
    heads = heads.join(least.select(F.col("a").alias("b")), "b", "left_anti")
    return found.unionByName(heads.join(linked, "b", "left").select(F.col("b").cast(kind).alias("node"), top))


def _by_stars(edges: DataFrame, rounds: int) -> DataFrame:
    """connected_components() of different edges with b < a.

    Alternates large-star and small-star steps until nothing changes; each round is a few aggregations and equi-joins, is written to
    the shared folder, and leaves stars only.
    """
    now, seen = cut(edges), None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        now = cut(_star(_star(now, True), False))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
