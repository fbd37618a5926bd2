"""Occupancy grids: cells (i, j, occ) and a row of width, height, resolution and origin, to meshes and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators.layers import layer_size, layer_type, put_layer, values_of
from surfmesh.operators.mesh import MeshMap
from surfmesh.operators.spatial import closest
from surfmesh.types import LayerType


@dataclass(frozen=True)
class GridInfo:
    frame_id: str = "map"
    width: int = 0
    height: int = 0
    resolution: float = 1.0
    ox: float = 0.0
    oy: float = 0.0
    oz: float = 0.0


def grid_vertices(spark: SparkSession, info: GridInfo) -> DataFrame:
    """(vid, x, y, z) of the shared corner grid, coordinates rounded to single precision as they are stored."""
    w = info.width + 1
    rows = spark.range(w * (info.height + 1)).select(F.col("id").alias("vid"), F.pmod("id", F.lit(w)).alias("i"), F.floor(F.col("id") / w).alias("j"))
    step = lambda o, k: (F.lit(o) + (F.col(k) * F.lit(info.resolution)).cast("float")).cast("float").cast("double")
    return rows.select("vid", step(info.ox, "i").alias("x"), step(info.oy, "j").alias("y"), F.lit(info.oz).cast("float").cast("double").alias("z"))


def grid_triangles(spark: SparkSession, info: GridInfo) -> DataFrame:
    """(cid, v0, v1, v2): two triangles a cell, along the diagonal from its low corner."""
    w = info.width + 1
    base = F.floor(F.col("id") / info.width) * w + F.pmod("id", F.lit(info.width)) if info.width else F.col("id")
    two = F.explode(F.array(F.struct((F.col("id") * 2).alias("cid"), base.alias("v0"), (base + 1).alias("v1"), (base + w + 1).alias("v2")), F.struct((F.col("id") * 2 + 1).alias("cid"), base.alias("v0"), (base + w + 1).alias("v1"), (base + w).alias("v2"))))
    return spark.range(info.width * info.height).select(two.alias("t")).select("t.*")


def from_occupancy_grid(cells: DataFrame, info: GridInfo) -> MeshMap:
    """A mesh of one surface with the U8 layer `occupancy`: both triangles of a cell have its cost."""
    spark = cells.sparkSession
    mesh = MeshMap.of(grid_vertices(spark, info), grid_triangles(spark, info), info.frame_id)
    first = geom.tri_index_for_cell(F.col("i"), F.col("j"), info.width)
    both = cells.select(F.explode(F.array(first, first + 1)).alias("cid"), geom.occ_to_u8(F.col("occ")).alias("value"))
    return put_layer(mesh, "occupancy", LayerType.U8, both)


def grid_shape(mesh: MeshMap) -> GridInfo | None:
    """The grid that the vertices' distinct x and y span: the resolution is the mean of the first gaps; None for fewer than two of either."""
    ends = {}
    for k in "xy":
        values = mesh.vertices.select(F.col(k).alias("v")).distinct()
        n = values.count()
        if n < 2:
            return None
        a, b = (r[0] for r in values.orderBy("v").limit(2).collect())
        ends[k] = (n - 1, a, b - a)
    z = mesh.vertices.orderBy("vid").select("z").first()[0]
    frame = mesh.surfaces.orderBy("surface_idx").select("frame_id").first()
    return GridInfo(frame[0] if frame else "", ends["x"][0], ends["y"][0], (ends["x"][2] + ends["y"][2]) / 2, ends["x"][1], ends["y"][1], z)


def to_occupancy_grid(mesh: MeshMap, *, generic: bool = False) -> tuple[DataFrame, GridInfo]:
    """(cells (i, j, occ), info). Without a U8 layer `occupancy` the grid is 0 by 0.

    A map of one surface with two triangles for every cell is read by triangle number; of any other, or with generic, every cell takes the
    value of the triangle that is closest to its centre.
    """
    spark = mesh.spark
    blank = spark.createDataFrame([], "i int, j int, occ smallint")
    if layer_type(mesh, "occupancy") != LayerType.U8 or (info := grid_shape(mesh)) is None:
        return blank, GridInfo()
    values = values_of(mesh, "occupancy").select("cid", geom.u8_to_occ(F.col("value")).alias("occ"))
    n, w = info.width * info.height, info.width
    if not generic and mesh.surfaces.count() == 1 and layer_size(mesh, "occupancy") == 2 * n:
        at = F.col("cid") / 2
        return values.where("cid % 2 = 0").select(F.pmod(at, F.lit(w)).cast("int").alias("i"), F.floor(at / w).cast("int").alias("j"), "occ"), info
    centre = spark.range(n).select(F.col("id").alias("pid"), ((F.pmod("id", F.lit(w)) + 0.5) * info.resolution + info.ox).alias("x"), ((F.floor(F.col("id") / w) + 0.5) * info.resolution + info.oy).alias("y"), F.lit(info.oz).alias("z"))
    found = closest(mesh, centre).select("pid", "cid").join(values, "cid", "left")
    return found.select(F.pmod("pid", F.lit(w)).cast("int").alias("i"), F.floor(F.col("pid") / w).cast("int").alias("j"), F.coalesce("occ", F.lit(-1).cast("smallint")).alias("occ")), info


def elevation(mesh: MeshMap) -> DataFrame:
    """(cid, value): the mean height of each triangle."""
    return mesh.geometry().select("cid", ((F.col("az") + F.col("bz") + F.col("cz")) / 3.0).alias("value"))


def from_mesh(points: DataFrame, triangles: DataFrame, frame_id: str) -> MeshMap | None:
    """A map of points (pid, x, y, z) and triangles (cid, v0, v1, v2) with one surface and the F32 layer `elevation`; None where a corner
    isn't there."""
    corners = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    vertices = points.select(F.col("pid").alias("vid"), "x", "y", "z")
    if corners.join(vertices, "vid", "left_anti").limit(1).count():
        return None
    mesh = MeshMap.of(vertices, triangles, frame_id)
    return put_layer(mesh, "elevation", LayerType.F32, elevation(mesh), description="mean height", unit="m")
