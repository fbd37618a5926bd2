"""What a viewer draws: colours of layers and vertices, normals as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.functions.color import Rgb, color_heat, color_rainbow, color_u8
from surfmesh.operators.layers import layer_type, list_layers, values_of
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import LayerType

# Fixed value: what a triangle without a value is drawn in.
NEUTRAL = 0.7


def _round(rgb: Rgb, n: int | None) -> list[Column]:
    return [(F.round(v, n) if n else v).alias(k) for v, k in zip(rgb, "rgb", strict=True)]


def layer_colors(mesh: MeshMap, layer: str, scheme: str = "heat", digits: int | None = None) -> DataFrame:
    """(cid, r, g, b) of every triangle: a U8 layer by cost, others by share of the layer's maximum (at least 0, NaN passed over), as heat or
    rainbow; all neutral if the layer doesn't fit the mesh."""
    kind = layer_type(mesh, layer)
    values = values_of(mesh, layer)
    cells = mesh.navcels.select("cid")
    if kind is None or values.join(cells, "cid", "left_semi").count() != cells.count():
        return cells.select("cid", *(F.lit(NEUTRAL).alias(k) for k in "rgb"))
    if kind == LayerType.U8:
        return values.select("cid", *_round(color_u8(F.col("value")), digits))
    top = values.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0))).alias("top"))
    paint = color_rainbow if scheme == "rainbow" else color_heat
    return values.crossJoin(F.broadcast(top)).select("cid", *_round(paint(F.col("value"), F.col("top")), digits))  # one row


def vertex_colors(mesh: MeshMap, alpha: float = 1.0) -> DataFrame:
    """(vid, r, g, b, a) from 0 to 1, of vertices that have colours."""
    part = lambda k: F.col(k) / F.lit(255.0)
    return mesh.vertices.where("r is not null and g is not null and b is not null and a is not null").select("vid", *(part(k).alias(k) for k in "rgb"), (part("a") * alpha).alias("a"))


def normal_segments(mesh: MeshMap, length: float) -> DataFrame:
    """(cid, x0..z0, x1..z1): from each centroid along the normal."""
    a, b, c = map(geom.point, "abc")
    start = geom.centroid(a, b, c)
    end = geom.add(start, geom.scale(geom.raw_normal(a, b, c), F.lit(float(length))))
    return mesh.geometry().select("cid", *(v.alias(f"{k}0") for v, k in zip(start, "xyz", strict=True)), *(v.alias(f"{k}1") for v, k in zip(end, "xyz", strict=True)))


def schemes(mesh: MeshMap, layer: str) -> list[str]:
    """The colour schemes that a layer's type has."""
    kind = layer_type(mesh, layer)
    return [] if kind is None else ["cost"] if kind == LayerType.U8 else ["heat", "rainbow"]


def options(mesh: MeshMap) -> list[str]:
    """What can be selected: the layers, and vertex colours where there are any."""
    return list_layers(mesh) + (["vertex RGBA"] if mesh.vertices.where("r is not null").limit(1).count() else [])


def selected(mesh: MeshMap, before: str | None) -> str | None:
    """What is selected when a map comes: what was selected before if the map still has it, else the first option (None where there is none)."""
    offered = options(mesh)
    return before if before in offered else offered[0] if offered else None


def info_line(mesh: MeshMap) -> str:
    return f"Surfaces: {mesh.surfaces.count()} | Triangles: {mesh.navcels.count()}"
