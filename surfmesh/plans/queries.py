"""The registered queries: each applies one operator to a mesh that is made from the tables. Each has its DuckDB form in oracle.py."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators import area, cloud, grid, layers, spatial, style, topology
from surfmesh.plans import fixtures as fx
from surfmesh.plans.lineage import cut
from surfmesh.sources import json_maps, messages
from surfmesh.streaming import maps
from surfmesh.types import AreaShape, BuildParams, LayerType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def six(*names: str) -> list[Column]:
    """Columns rounded to six digits, without negative zeros."""
    return [(geom.rounded(n, 6) + F.lit(0.0)).alias(n) for n in names]


def whole(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- geometry ------------------------------------------------------------------------------------------------------------------


@query
def tri_area(spark, d):
    return fx.terrain(spark, d).derived().select("cid", *six("area"))


@query
def tri_normal(spark, d):
    return fx.terrain(spark, d).derived().select("cid", *six("nx", "ny", "nz"))


@query
def centroid(spark, d):
    return fx.terrain(spark, d).centroids().select("cid", *six("x", "y", "z"))


@query
def surface_aabb(spark, d):
    return fx.floors(spark, d).surface_aabb().select(*whole("surface_idx"), "frame_id", "minx", "miny", "minz", "maxx", "maxy", "maxz")


@query
def mesh_stats(spark, d):
    return fx.terrain(spark, d, layers=True).stats().select(*whole("n_vertices", "n_navcels", "n_surfaces", "n_layers"))


@query
def adjacency(spark, d):
    return fx.terrain(spark, d).adjacency().select(*whole("cid", "e", "neighbor"))


@query
def boundary_edges(spark, d):
    return fx.terrain(spark, d).adjacency().where("neighbor is null").select(*whole("cid", "e"))


@query
def neighbors_list(spark, d):
    return fx.terrain(spark, d).neighbors().select("cid", F.concat_ws(",", F.transform("neighbors", lambda n: n.cast("string"))).alias("neighbors"))


@query
def triangle_angles(spark, d):
    angles = geom.triangle_angles_deg(*map(geom.point, "abc"))
    return fx.terrain(spark, d).geometry().select("cid", *(v.alias(f"angle_{k}") for k, v in zip("abc", angles, strict=True))).select("cid", *six("angle_a", "angle_b", "angle_c"))


@query
def triangle_filters(spark, d):
    found = cloud.triangle_filters(fx.terrain(spark, d).geometry(), BuildParams(max_edge_len=1.5, max_dz=0.3, min_angle_deg=40.0))
    return found.select("cid", *(F.col(c).cast("int").cast("long").alias(c) for c in ("edges_ok", "dz_ok", "area_ok", "slope_ok", "angle_ok", "accepted")))


# --- occupancy grids -----------------------------------------------------------------------------------------------------------


@query
def occ_to_u8(spark, d):
    cells, info = fx.grid(spark, d)
    return cells.select(*whole("i", "j", "occ"), geom.occ_to_u8(F.col("occ")).cast("long").alias("u8"))


@query
def u8_to_occ(spark, d):
    values = fx.table(spark, d, "part").select(F.pmod("p_partkey", F.lit(256)).alias("u8")).distinct()
    return values.select(*whole("u8"), geom.u8_to_occ(F.col("u8")).cast("long").alias("occ"))


@query
def grid_vertices(spark, d):
    return grid.grid_vertices(spark, fx.grid(spark, d)[1])


@query
def grid_triangles(spark, d):
    return grid.grid_triangles(spark, fx.grid(spark, d)[1])


@query
def grid_occupancy_layer(spark, d):
    mesh = grid.from_occupancy_grid(*fx.grid(spark, d))
    return layers.values_of(mesh, "occupancy").select("cid", F.col("value").cast("long").alias("value"))


@query
def grid_roundtrip(spark, d):
    cells, _ = grid.to_occupancy_grid(grid.from_occupancy_grid(*fx.grid(spark, d)))
    return cells.select(*whole("i", "j", "occ"))


@query
def to_grid_generic(spark, d):
    cells, _ = grid.to_occupancy_grid(grid.from_occupancy_grid(*fx.grid(spark, d)), generic=True)
    return cells.select(*whole("i", "j", "occ"))


@query
def elevation_layer(spark, d):
    mesh = fx.terrain(spark, d)
    mesh = grid.from_mesh(mesh.vertices.select(F.col("vid").alias("pid"), "x", "y", "z"), mesh.navcels, "map")
    return layers.values_of(mesh, "elevation").select("cid", geom.rounded("value", 5).alias("value"))


# --- layers --------------------------------------------------------------------------------------------------------------------


@query
def layer_add_default(spark, d):
    mesh = layers.add_layer(fx.terrain(spark, d), "risk", LayerType.F32, default=7.5)
    return layers.values_of(mesh, "risk")


@query
def layer_add_from_layer(spark, d):
    mesh = layers.add_layer_from(fx.terrain(spark, d, layers=True), "cost8", LayerType.U8, "cost")
    return layers.values_of(mesh, "cost8").select("cid", F.col("value").cast("long").alias("value"))


@query
def layer_get_cast(spark, d):
    mesh = fx.terrain(spark, d, layers=True)
    asked = fx.table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), F.pmod(F.col("event_id") * 7, F.lit(4000)).cast("long").alias("cid"))
    return layers.layer_get(mesh, "cost", LayerType.U8, asked, default=9).select("event_id", "cid", F.col("value").cast("long").alias("value"))


@query
def layer_set_bulk(spark, d):
    events = fx.table(spark, d, "events").select(F.pmod(F.col("event_id") * 13, F.lit(5000)).cast("long").alias("cid"), F.pmod("event_id", F.lit(300)).alias("value"))
    mesh = layers.layer_set(fx.terrain(spark, d, layers=True), "occ", LayerType.U8, events)
    return layers.values_of(mesh, "occ").select("cid", F.col("value").cast("long").alias("value"))


@query
def layer_copy(spark, d):
    mesh, _ = layers.layer_copy(fx.terrain(spark, d, layers=True), "occ", "occ2", LayerType.U8)
    return mesh.layer_values.where("layer in ('occ', 'occ2')").select("layer", "cid", *whole("u8"))


@query
def layer_clear(spark, d):
    mesh = layers.layer_clear(fx.terrain(spark, d, layers=True), "occ", LayerType.U8, 254)
    return layers.values_of(mesh, "occ").select("cid", F.col("value").cast("long").alias("value"))


@query
def layer_catalog(spark, d):
    return layers.catalog(fx.terrain(spark, d, layers=True)).select("name", "type", *whole("n"), "description", "unit")


@query
def layer_sync(spark, d):
    source = fx.terrain(spark, d, layers=True)
    target = layers.layer_clear(layers.add_layer(source, "old", LayerType.U8), "occ", LayerType.U8, 1)
    mesh = layers.sync_layers(source, target)
    return mesh.layer_values.groupBy("layer").agg(F.count("*").alias("n"), F.sum("u8").alias("total"))


@query
def geometry_same(spark, d):
    one, other = fx.terrain(spark, d), fx.terrain(spark, d)
    moved = one.transformed(((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0, 0, 1))
    return spark.createDataFrame([("same", int(one.has_same_geometry(other))), ("moved", int(one.has_same_geometry(moved)))], "which string, same long")


# --- rays and points -----------------------------------------------------------------------------------------------------------


def _rays(spark, d) -> DataFrame:
    p = fx.floor_points(spark, d)
    return p.select(F.col("pid").alias("ray_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.when(F.col("pid") % 2 == 0, -1.0).otherwise(1.0).alias("dz"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("ray_id", F.col("hit").cast("int").cast("long").alias("hit"), *whole("surface", "cid"), *six("t"))


@query
def raycast_nearest(spark, d):
    return _hits(spatial.raycast(fx.floors(spark, d), _rays(spark, d)))


@query
def raycast_first_surface(spark, d):
    return _hits(spatial.raycast(fx.floors(spark, d), _rays(spark, d), first_hit_only=True))


@query
def raycast_oblique(spark, d):
    e = F.col("ray_id")
    slant = _rays(spark, d).withColumns({"dx": (F.pmod(e * 7, F.lit(11)) - 5) / 8.0 + 1 / 32, "dy": (F.pmod(e * 5, F.lit(13)) - 6) / 8.0 + 1 / 64})
    return _hits(spatial.raycast(fx.floors(spark, d), slant))


@query
def locate_terrain(spark, d):
    return spatial.locate(fx.terrain(spark, d), fx.terrain_points(spark, d)).select("pid", "cid", *six("hz", "b0", "b1", "b2"))


def _located(found: DataFrame) -> DataFrame:
    return found.select("pid", F.col("found").cast("int").cast("long").alias("found"), *whole("surface", "cid"), *six("hz"))


@query
def locate_floors(spark, d):
    return _located(spatial.locate(fx.floors(spark, d), fx.floor_points(spark, d)))


@query
def locate_fallback_height(spark, d):
    """On one floor: points at its very height are found by the fallback alone."""
    p = fx.floor_points(spark, d).withColumn("z", F.when(F.col("pid") % 2 == 0, 0.0).otherwise(F.col("z")))
    return _located(spatial.locate(fx.floors(spark, d, most=1), p))


@query
def locate_hint(spark, d):
    p = fx.floor_points(spark, d)
    at = F.floor(F.col("y") / fx.CELL) * fx.SIDE + F.floor(F.col("x") / fx.CELL)
    right = F.pmod("pid", F.lit(5)) * fx.SIDE * fx.SIDE + at
    p = p.withColumn("hint_cid", F.when(F.col("pid") % 3 < 2, (right * 2 + F.pmod("pid", F.lit(2))).cast("long")))
    near = F.pmod("pid", F.lit(5)) * fx.STOREY + F.when(F.col("pid") % 4 == 0, 0.25).otherwise(0.75)
    return _located(spatial.locate(fx.floors(spark, d), p.withColumn("z", near)))


@query
def locate_walking(spark, d):
    """From the neighbouring cell's triangle to the point's own."""
    p = fx.floor_points(spark, d).withColumn("z", F.lit(0.25))
    i, j = F.floor(F.col("x") / fx.CELL), F.floor(F.col("y") / fx.CELL)
    p = p.withColumn("hint_cid", ((j * fx.SIDE + F.when(i > 0, i - 1).otherwise(i + 1)) * 2).cast("long"))
    return spatial.locate_by_walking(fx.floors(spark, d), p).select("pid", F.col("found").cast("int").cast("long").alias("found"), "cid")


@query
def sample_layer(spark, d):
    mesh = fx.terrain(spark, d, layers=True)
    return spatial.sample_layer(mesh, "cost", fx.terrain_points(spark, d), default=-1.0).select("pid", "cid", *six("value"))


def _closest(found: DataFrame) -> DataFrame:
    return found.select("pid", *whole("surface"), *six("sqdist", "qx", "qy", "qz"))


@query
def closest_navcel(spark, d):
    p = fx.floor_points(spark, d)
    return _closest(spatial.closest(fx.floors(spark, d), p.withColumns({"x": F.col("x") * 1.5 - 10.0, "y": F.col("y") * 1.25 - 5.0})))


@query
def closest_restricted(spark, d):
    return _closest(spatial.closest(fx.floors(spark, d), fx.floor_points(spark, d), restrict_surface=2))


@query
def radius_neighbors(spark, d):
    return spatial.radius_neighbors(fx.part_points(spark, d), 1.5).select("pid", "nid", *six("dist"))


@query
def knn_neighbors(spark, d):
    return spatial.knn(fx.part_points(spark, d), 5).select("pid", "nid", *whole("rank"), *six("dist"))


@query
def pick_pose(spark, d):
    rays = _rays(spark, d).withColumns({"ox": F.col("ox") * 2, "oz": F.lit(20.0), "dz": F.lit(-1.0), "dx": F.lit(0.25)})
    found = spatial.pick(fx.floors(spark, d), rays)
    return found.select("ray_id", F.col("hit").cast("int").cast("long").alias("hit"), *six("px", "py", "pz"))


# --- areas and surfaces --------------------------------------------------------------------------------------------------------

#: Where areas are written; sf0.001 has four rows of cells.
SPOT = (20.3, 2.6, 5.0)


def _painted(mesh, shape, size):
    mesh, _ = area.set_area(mesh, SPOT, 254, "occ", LayerType.U8, shape, size)
    return layers.values_of(mesh, "occ").select("cid", F.col("value").cast("long").alias("value"))


@query
def set_area_circle(spark, d):
    return _painted(fx.terrain(spark, d, layers=True), AreaShape.CIRCULAR, 5.0)


@query
def set_area_rect(spark, d):
    return _painted(fx.terrain(spark, d, layers=True), AreaShape.RECTANGULAR, 7.0)


@query
def set_area_blocked(spark, d):
    """A missing column of cells keeps the circle on one side."""
    return _painted(fx.terrain(spark, d, without=(22,), layers=True), AreaShape.CIRCULAR, 5.0)


@query
def components(spark, d):
    return topology.components(fx.terrain(spark, d, without=(9, 19, 29)))


@query
def top_surfaces(spark, d):
    mesh = topology.keep_top_surfaces(topology.surfaces_by_connectivity(fx.terrain(spark, d, without=(4, 15))), 2)
    return mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n"), F.min("cid").alias("first")).select(*whole("surface_idx", "n", "first"))


@query
def remove_surface(spark, d):
    mesh, _ = fx.floors(spark, d).remove_surface(2)
    sizes = mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n"), F.min("cid").alias("first"))
    return mesh.surfaces.join(sizes, "surface_idx").select(*whole("surface_idx"), "frame_id", "n", "first")


# --- clouds --------------------------------------------------------------------------------------------------------------------


@query
def voxel_topz(spark, d):
    return cloud.voxel_top(fx.cloud(spark, d), 1.0, 0.3).select(*whole("vx", "vy", "k"), *six("x", "y", "z"))


@query
def mesh_from_points(spark, d):
    """Greedy, so SQL has no form of it; tests check what it must hold."""
    mesh = cloud.from_points(fx.part_points(spark, d), BuildParams(resolution=0.5, max_dz=1.0, max_slope_deg=60.0))
    return mesh.geometry().join(mesh.surface_navcels.select("cid", "surface_idx"), "cid", "left")


# --- styles --------------------------------------------------------------------------------------------------------------------


def _colors(spark, d, layer, scheme="heat"):
    return style.layer_colors(fx.terrain(spark, d, layers=True), layer, scheme).select("cid", *six("r", "g", "b"))


@query
def color_u8(spark, d):
    return _colors(spark, d, "occ")


@query
def color_heat(spark, d):
    return _colors(spark, d, "cost")


@query
def color_rainbow(spark, d):
    return _colors(spark, d, "cost", "rainbow")


@query
def normal_segments(spark, d):
    return style.normal_segments(fx.terrain(spark, d), 0.5).select("cid", *six("x0", "y0", "z0", "x1", "y1", "z1"))


@query
def vertex_colors(spark, d):
    mesh = fx.terrain(spark, d)
    level = lambda n: F.pmod(F.col("vid") * n, F.lit(256)).cast("smallint")
    mesh = replace(mesh, vertices=mesh.vertices.withColumns({"r": level(1), "g": level(3), "b": level(7), "a": F.lit(255).cast("smallint")}))
    return style.vertex_colors(mesh, 0.5).select("vid", *six("r", "g", "b", "a"))


# --- message forms and streams -------------------------------------------------------------------------------------------------


@query
def json_roundtrip(spark, d):
    mesh = json_maps.from_json(cut(json_maps.to_json(grid.from_occupancy_grid(*fx.grid(spark, d)))))
    both = mesh.geometry().join(layers.values_of(mesh, "occupancy"), "cid")
    return both.select("cid", "v0", "v1", "v2", "ax", "ay", "az", F.col("value").cast("long").alias("value"))


@query
def message_roundtrip(spark, d):
    mesh = messages.from_message(cut(messages.to_message(fx.terrain(spark, d, layers=True))))
    cost = layers.values_of(mesh, "cost").select("cid", F.when(~F.isnan("value"), F.col("value")).alias("cost"))
    both = mesh.geometry().join(layers.values_of(mesh, "occ"), "cid").join(cost, "cid")
    return both.select("cid", "v0", "v1", "v2", "ax", "ay", "az", F.col("value").cast("long").alias("occ"), "cost")


def _updates(spark, d) -> DataFrame:
    e = F.col("event_id").cast("long")
    return fx.table(spark, d, "events").select(F.col("event_type").alias("layer"), F.pmod(e, F.lit(307)).alias("cid"), F.col("value").cast("double").alias("value"), F.col("ts").alias("stamp"), e.alias("seq"))


@query
def layer_update_latest(spark, d):
    return maps.latest_values(_updates(spark, d)).select("layer", "cid", *six("value"))


@query
def layer_update_rejects(spark, d):
    """Updates of one to three values for a map of two triangles; every fifth has two arrays."""
    e = F.col("event_id").cast("long")
    n = F.pmod(e, F.lit(3)) + 1
    f32 = F.array_repeat(F.lit(1.0).cast("float"), n.cast("int"))
    u8 = F.when(e % 5 == 0, F.array(F.lit(1).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))
    seen = maps.checked(fx.table(spark, d, "events").select(e.alias("event_id"), u8.alias("data_u8"), f32.alias("data_f32"), F.array().cast("array<double>").alias("data_f64")), 2)
    return seen.select("event_id", F.coalesce("why", F.lit("")).alias("why"))


@query
def update_counters(spark, d):
    found = maps.counters(_updates(spark, d).withColumnRenamed("layer", "name"))
    return found.select("name", "n_messages", F.date_format("last_stamp", "yyyy-MM-dd HH:mm:ss").alias("last_stamp"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: locate every event's point on the terrain and sample a layer there."""
    return QUERIES["sample_layer"](spark, sf_dir)
