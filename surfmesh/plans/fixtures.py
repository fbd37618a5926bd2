"""Meshes, points and layers made from the driver's tables: coordinates are dyadic, and points lie off all edges, so nothing ties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.operators.grid import GridInfo
from surfmesh.operators.layers import put_layer
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import LayerType

#: Terrain columns; cells of a floor's side and their size; floor height.
WIDTH, SIDE, CELL, STOREY = 40, 10, 4, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two(base, step: int, width: int, cid):
    """Both triangles of a cell whose low corner is base, in rows of step vertices."""
    return F.explode(F.array(F.struct((cid * 2).alias("cid"), base.alias("v0"), (base + 1).alias("v1"), (base + step + 1).alias("v2")), F.struct((cid * 2 + 1).alias("cid"), base.alias("v0"), (base + step + 1).alias("v1"), (base + step).alias("v2"))))


def terrain_height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] // WIDTH


def terrain(spark: SparkSession, sf_dir: str, *, without: tuple[int, ...] = (), layers: bool = False) -> MeshMap:
    """A sloped surface over part, 39 cells wide; `without` leaves out columns of cells. layers: U8 `occ`, F64 `cost` (with NaN)."""
    part, hmax = table(spark, sf_dir, "part"), terrain_height(spark, sf_dir)
    i, j = F.pmod("p_partkey", F.lit(WIDTH)), F.floor(F.col("p_partkey") / WIDTH)
    vertices = part.select(F.col("p_partkey").cast("long").alias("vid"), i.cast("double").alias("x"), j.cast("double").alias("y"), (F.col("p_size") / 64.0).alias("z"))
    cells = part.select(F.col("p_partkey").cast("long").alias("v"), i.cast("long").alias("i"), j.cast("long").alias("j")).where((F.col("i") < WIDTH - 1) & (F.col("j") < hmax) & ~F.col("i").isin(*without or (-1,)))
    navcels = cells.select(_two(F.col("v"), WIDTH, WIDTH, F.col("j") * (WIDTH - 1) + F.col("i")).alias("t")).select("t.*")
    mesh = MeshMap.of(vertices, navcels, "terrain")
    if layers:
        mesh = put_layer(mesh, "occ", LayerType.U8, navcels.select("cid", F.pmod("cid", F.lit(256)).alias("value")), description="cost", unit="level")
        cost = F.when(F.pmod("cid", F.lit(101)) == 0, F.lit(float("nan"))).otherwise(F.pmod("cid", F.lit(97)) * 3.25 - 20.0)
        mesh = put_layer(mesh, "cost", LayerType.F64, navcels.select("cid", cost.alias("value")), description="signed cost", unit="s")
    return mesh


def terrain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every event, above the terrain."""
    hmax, e = terrain_height(spark, sf_dir), F.col("event_id").cast("long")
    return table(spark, sf_dir, "events").select(e.alias("pid"), (F.pmod(e * 37, F.lit(2496)) / 64.0 + 1 / 128).alias("x"), (F.pmod(e * 101, F.lit(64 * hmax)) / 64.0 + 3 / 256).alias("y"), F.lit(10.0).alias("z"))


def floors(spark: SparkSession, sf_dir: str, most: int = 5) -> MeshMap:
    """A flat grid for each region, one above the other; each is a surface named for its region."""
    n = SIDE + 1
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), "r_name").where(F.col("k") < most)
    corner = region.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long"))).alias("c"))
    vertices = corner.select((F.col("k") * n * n + F.col("c")).alias("vid"), (F.pmod("c", F.lit(n)) * CELL).cast("double").alias("x"), (F.floor(F.col("c") / n) * CELL).cast("double").alias("y"), (F.col("k") * STOREY).cast("double").alias("z"))
    cell = region.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE * SIDE - 1).cast("long"))).alias("c"))
    base = F.col("k") * n * n + F.floor(F.col("c") / SIDE) * n + F.pmod("c", F.lit(SIDE))
    navcels = cell.select("k", "c", _two(base, n, n, F.col("k") * SIDE * SIDE + F.col("c")).alias("t")).select("k", "c", "t.*")
    mesh = MeshMap.of(vertices, navcels)
    listed = navcels.select(F.col("k").cast("int").alias("surface_idx"), F.pmod("cid", F.lit(2 * SIDE * SIDE)).cast("int").alias("pos"), "cid")
    return replace(mesh, surfaces=region.select(F.col("k").cast("int").alias("surface_idx"), F.col("r_name").alias("frame_id")), surface_navcels=listed)


def floor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every event, between or below the floors, never as near to one as to another."""
    e = F.col("event_id").cast("long")
    return table(spark, sf_dir, "events").select(e.alias("pid"), (F.pmod(e * 37, F.lit(2560)) / 64.0 + 1 / 128).alias("x"), (F.pmod(e * 101, F.lit(2560)) / 64.0 + 3 / 256).alias("y"), (F.pmod(e, F.lit(15)) - 1 + 1 / 16).alias("z"))


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridInfo]:
    """An occupancy grid over part, 40 cells wide."""
    part = table(spark, sf_dir, "part")
    n = part.count()
    occ = F.when(F.col("p_size") % 7 == 0, -1).otherwise(2 * F.col("p_size")).cast("smallint")
    cells = part.select(F.pmod("p_partkey", F.lit(WIDTH)).cast("int").alias("i"), F.floor(F.col("p_partkey") / WIDTH).cast("int").alias("j"), occ.alias("occ"))
    return cells, GridInfo("map", WIDTH, n // WIDTH, 0.5)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(*((F.col(c).cast("double") / d).alias(k) for k, c, d in (("x", "l_partkey", 64.0), ("y", "l_suppkey", 64.0), ("z", "l_quantity", 16.0))))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain vertices as points."""
    return terrain(spark, sf_dir).vertices.select(F.col("vid").alias("pid"), "x", "y", "z")
