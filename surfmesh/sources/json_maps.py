"""Maps as JSON: {x, y, z, tris, occupancy}, one document a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.operators.layers import layer_type, put_layer, values_of
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import LayerType

SCHEMA = "x array<double>, y array<double>, z array<double>, tris array<array<bigint>>, occupancy array<smallint>"


def to_json(mesh: MeshMap) -> DataFrame:
    """One row with a column json; occupancy is left out where the map has no such U8 layer."""
    v = mesh.vertices.agg(F.sort_array(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("v"))
    t = mesh.navcels.agg(F.sort_array(F.collect_list(F.struct("cid", "v0", "v1", "v2"))).alias("t"))
    parts = [_column(k) for k in "xyz"] + [F.transform("t", lambda c: F.array(c["v0"], c["v1"], c["v2"])).alias("tris")]
    one = v.crossJoin(t)  # one row each
    if layer_type(mesh, "occupancy") == LayerType.U8:
        one = one.crossJoin(values_of(mesh, "occupancy").agg(F.sort_array(F.collect_list(F.struct("cid", "value"))).alias("o")))
        parts.append(F.transform("o", lambda c: c["value"].cast("int")).alias("occupancy"))
    return one.select(F.to_json(F.struct(*parts)).alias("json"))


def _column(k: str):
    return F.transform("v", lambda p: p[k]).alias(k)


def from_json(rows: DataFrame) -> MeshMap:
    """The map of a one-row table with a column json: one surface `map` lists all triangles."""
    m = rows.select(F.from_json("json", SCHEMA).alias("m")).select("m.*")
    vertices = m.select(F.posexplode(F.arrays_zip("x", "y", "z")).alias("vid", "p")).select(F.col("vid").cast("long").alias("vid"), "p.x", "p.y", "p.z")
    navcels = m.select(F.posexplode("tris").alias("cid", "t")).select(F.col("cid").cast("long").alias("cid"), *(F.get("t", F.lit(k)).alias(f"v{k}") for k in range(3)))
    mesh = MeshMap.of(vertices, navcels, "map")
    occupancy = m.where("occupancy is not null").select(F.posexplode("occupancy").alias("cid", "value"))
    return put_layer(mesh, "occupancy", LayerType.U8, occupancy) if m.where("occupancy is not null").limit(1).count() else mesh
