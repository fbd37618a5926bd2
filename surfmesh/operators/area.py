"""Writing a layer over the part of a surface around a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators.layers import has_layer, layer_set, layer_type
from surfmesh.operators.mesh import MeshMap
from surfmesh.operators.spatial import BROADCAST_ROWS, locate
from surfmesh.plans.lineage import connected_components, cut
from surfmesh.types import AreaShape, LayerType


def _reached(links: DataFrame, seed: int) -> DataFrame:
    """(cid) of what can be reached from seed over links (a, b). Where every link goes both ways that is seed's component; else step by step."""
    oneway = links.join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    if not oneway.limit(1).count():
        found = connected_components(links)
        root = found.where(F.col("node") == seed).select("root").first()
        return found.where(F.col("root") == (root[0] if root else seed)).select(F.col("node").alias("cid"))
    front = seen = cut(links.sparkSession.createDataFrame([(seed,)], "cid long"))
    while True:
        front = cut(links.join(front.withColumnRenamed("cid", "a"), "a").select(F.col("b").alias("cid")).distinct().join(seen, "cid", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def area_cells(mesh: MeshMap, p: tuple[float, float, float], shape: AreaShape, size: float) -> DataFrame | None:
    """(cid) of the triangles whose centroid lies in the area around p (size: radius or side) and that are reached from p's triangle over
    triangles whose box meets the area's; None where p isn't located or size isn't above 0."""
    if size <= 0:
        return None
    spot = locate(mesh, mesh.spark.createDataFrame([(0, *map(float, p))], "pid long, x double, y double, z double")).where("found").select("cid", "hx", "hy").first()
    if spot is None:
        return None
    seed, cx, cy = spot
    half = size if shape == AreaShape.CIRCULAR else size / 2
    low, high = (lambda k: F.least(*(c + k for c in "abc"))), (lambda k: F.greatest(*(c + k for c in "abc")))
    meets = (low("x") <= cx + half) & (high("x") >= cx - half) & (low("y") <= cy + half) & (high("y") >= cy - half)
    near = cut(mesh.geometry().where(meets | (F.col("cid") == seed)))
    ids = near.select("cid")
    # Neighbours as the whole mesh has them, looked up for the edges of the triangles at hand: a few are sent to where the edges are.
    at_hand = F.broadcast(ids) if near.count() <= BROADCAST_ROWS else ids
    links = mesh.adjacency(of=at_hand).where("neighbor is not null").select(F.col("cid").alias("a"), F.col("neighbor").alias("b"))
    links = cut(links.join(at_hand.withColumnRenamed("cid", "b"), "b", "left_semi").select("a", "b").distinct())
    reached = _reached(links, seed).unionByName(mesh.spark.createDataFrame([(seed,)], "cid long")).distinct()
    mx, my, _ = geom.centroid(*map(geom.point, "abc"))
    dx, dy = mx - cx, my - cy
    inside = dx * dx + dy * dy <= half * half if shape == AreaShape.CIRCULAR else (F.abs(dx) <= half) & (F.abs(dy) <= half)
    return near.where(inside).select("cid").join(reached, "cid", "left_semi")


def set_area(mesh: MeshMap, p: tuple[float, float, float], value: float, layer: str, kind: LayerType, shape: AreaShape, size: float) -> tuple[MeshMap, bool]:
    """The map with value written to a layer over an area; created if missing. False and no change where the point isn't located, size isn't
    above 0 or the layer has another type."""
    if has_layer(mesh, layer) and layer_type(mesh, layer) != kind:
        return mesh, False
    cells = area_cells(mesh, p, shape, size)
    if cells is None:
        return mesh, False
    return layer_set(mesh, layer, kind, cells.withColumn("value", F.lit(float(value)))), True
