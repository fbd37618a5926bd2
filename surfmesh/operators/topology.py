"""Connected surfaces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.operators.mesh import MeshMap
from surfmesh.plans.lineage import connected_components, cut, numbered


def components(mesh: MeshMap) -> DataFrame:
    """(cid, root): triangles that share edges have one root, their component's least triangle. Of the triangles that surfaces list, or of all
    where none is listed. An edge's owners are tied to the first of them, so that an edge of many owners makes no pairs."""
    listed = mesh.surface_navcels.select("cid").distinct()
    edges = mesh.edges()
    nodes = mesh.navcels.select("cid")
    if listed.limit(1).count():
        edges, nodes = edges.join(listed, "cid", "left_semi"), nodes.join(listed, "cid", "left_semi")
    tied = edges.withColumn("b", F.min("cid").over(Window.partitionBy("lo", "hi"))).select(F.col("cid").alias("a"), "b")
    roots = connected_components(tied)
    return nodes.join(roots, nodes["cid"] == roots["node"], "left").select("cid", F.coalesce("root", "cid").alias("root"))


def ranked(found: DataFrame) -> DataFrame:
    """(root, n, surface_idx) of components (cid, root): the largest first, the least root on ties. Numbered part by part: there may be as many
    components as triangles."""
    sizes = found.groupBy("root").agg(F.count("*").alias("n")).withColumn("_less", -F.col("n"))
    return numbered(sizes, "surface_idx", "_less", "root").select("root", "n", F.col("surface_idx").cast("int").alias("surface_idx"))


def surfaces_by_connectivity(mesh: MeshMap, frame_id: str = "map") -> MeshMap:
    """The map with a surface for each component, the largest first."""
    found = cut(components(mesh))
    order = ranked(found)
    # One surface may hold nearly all triangles, so positions are counted through and moved down by each surface's first.
    listed = numbered(found.join(order, "root").select("surface_idx", "cid"), "_n", "surface_idx", "cid")
    first = listed.groupBy("surface_idx").agg(F.min("_n").alias("_first"))
    listed = listed.join(first, "surface_idx").select("surface_idx", (F.col("_n") - F.col("_first")).cast("int").alias("pos"), "cid")
    return replace(mesh, surfaces=order.select("surface_idx", F.lit(frame_id).alias("frame_id")), surface_navcels=cut(listed))


def keep_top_surfaces(mesh: MeshMap, n: int) -> MeshMap:
    """The map with its n largest surfaces, in order of size (the lower index on ties); as it was for n of 0 or less. Triangles stay."""
    if n <= 0:
        return mesh
    sizes = mesh.surfaces.join(mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n")), "surface_idx", "left")
    order = [F.desc(F.coalesce("n", F.lit(0))), F.col("surface_idx")]
    rank = sizes.orderBy(*order).limit(n).select("surface_idx", (F.row_number().over(Window.orderBy(*order)) - 1).alias("new"))  # n rows
    moved = lambda df: df.join(rank, "surface_idx").select(F.col("new").alias("surface_idx"), *(c for c in df.columns if c != "surface_idx"))
    return replace(mesh, surfaces=moved(mesh.surfaces), surface_navcels=moved(mesh.surface_navcels))
