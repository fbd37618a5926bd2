"""Registered queries of the data model: editing, files, messages, streams, and the geometry functions one by one. SQL in model_oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators import cloud, grid, layers, style
from surfmesh.plans import fixtures as fx
from surfmesh.plans.lineage import cut, shared_dir
from surfmesh.plans.queries import six, whole
from surfmesh.sources import binary, messages, tables
from surfmesh.streaming import maps
from surfmesh.types import BuildParams, LayerType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def folder(spark: SparkSession) -> str:
    """A folder of this call's own in the shared one."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").cast("long")


# --- editing -------------------------------------------------------------------------------------------------------------------


@query
def create_surface(spark, d):
    mesh, _ = fx.floors(spark, d).create_surface("extra")
    return mesh.surfaces.select(*whole("surface_idx"), "frame_id")


@query
def add_surface(spark, d):
    mesh, k = fx.floors(spark, d).add_surface("pair", [7, 3])
    return mesh.surface_navcels.where(F.col("surface_idx") == k).select(*whole("surface_idx", "pos", "cid"))


@query
def add_vertices(spark, d):
    mesh, _ = fx.floors(spark, d).add_vertices([(1.0, 2.0, 3.0), (4.0, 5.0, 6.5)])
    return mesh.vertices.select("vid", *six("x", "y", "z"))


@query
def add_navcels(spark, d):
    mesh, _ = fx.floors(spark, d).add_navcels([(0, 1, 2), (2, 1, 13)], surface=1)
    return mesh.navcels.select(*whole("cid", "v0", "v1", "v2"))


@query
def add_to_surface(spark, d):
    mesh = fx.floors(spark, d).add_to_surface(1, [5, 5]).add_to_surface(99, [1])
    return mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last")).select(*whole("surface_idx"), "n", "last")


@query
def transformed(spark, d):
    """A quarter turn about +z, then a shift."""
    mesh = fx.terrain(spark, d).transformed(((0, -1, 0), (1, 0, 0), (0, 0, 1)), (10, -2, 0.5))
    return mesh.vertices.select("vid", *six("x", "y", "z"))


@query
def assigned_layers(spark, d):
    """A map of the same geometry takes over the other's layers; colours and surfaces stay its own."""
    source = fx.terrain(spark, d, layers=True)
    target = layers.layer_clear(layers.add_layer(source, "old", LayerType.U8), "occ", LayerType.U8, 1)
    mesh = layers.assigned(source, target)
    return mesh.layer_values.where("layer <> 'cost'").select("layer", *whole("cid"), F.col("u8").cast("long").alias("value"))


# --- layers --------------------------------------------------------------------------------------------------------------------


@query
def layer_remove(spark, d):
    return layers.catalog(layers.remove_layer(fx.terrain(spark, d, layers=True), "occ")).select("name", "type", *whole("n"))


@query
def layers_resized(spark, d):
    mesh = fx.terrain(spark, d)
    mesh = layers.put_layer(mesh, "half", LayerType.U8, mesh.navcels.where("cid % 2 = 0").select("cid", F.pmod("cid", F.lit(200)).alias("value")))
    return layers.values_of(layers.resize_all(mesh), "half").select("cid", F.col("value").cast("long").alias("value"))


@query
def layer_hash_fnv(spark, d):
    """The byte-wise hash of a layer, as text (it has no sign)."""
    return spark.createDataFrame([("occ", str(layers.content_hash_fnv1a(fx.terrain(spark, d, layers=True), "occ")))], "layer string, hash string")


@query
def layer_wide(spark, d):
    """Layers as columns beside each other, changed by an expression over them."""
    wide = layers.wide(fx.terrain(spark, d, layers=True))
    return wide.select("cid", F.when(~F.isnan("cost"), F.col("cost") + F.col("occ") * 2).alias("mixed"))


@query
def style_options(spark, d):
    mesh = fx.terrain(spark, d, layers=True)
    rows = [("option", x) for x in style.options(mesh)] + [("scheme of occ", x) for x in style.schemes(mesh, "occ")] + [("scheme of cost", x) for x in style.schemes(mesh, "cost")]
    rows += [("info", style.info_line(mesh)), ("selected", style.selected(mesh, "occ")), ("selected of none", style.selected(mesh, "gone"))]
    return spark.createDataFrame(rows, "kind string, value string")


# --- geometry functions --------------------------------------------------------------------------------------------------------


def _terrain(spark, d) -> DataFrame:
    return fx.terrain(spark, d).geometry()


BOX = ("minx", "miny", "minz", "maxx", "maxy", "maxz")


def _box(df: DataFrame) -> DataFrame:
    return df.withColumn("box", geom.triangle_aabb(*map(geom.point, "abc")))


def _fields(box: Column) -> list[Column]:
    return [box[k].alias(k) for k in BOX]


@query
def triangle_boxes(spark, d):
    return _box(_terrain(spark, d)).select("cid", *_fields(F.col("box")))


@query
def box_expand(spark, d):
    """Each triangle's box grown to a point, and to the box of the point above its first corner."""
    p = (F.lit(20.5), F.lit(1.5), F.lit(-1.0))
    above = geom.triangle_aabb(*[(F.col("ax"), F.col("ay"), F.col("az") + 2.0)] * 3)
    return _box(_terrain(spark, d)).select("cid", *_fields(geom.aabb_union(geom.aabb_expand(F.col("box"), p), above)))


@query
def box_longest_axis(spark, d):
    return _box(_terrain(spark, d)).select("cid", geom.longest_axis(F.col("box")).cast("long").alias("axis"))


@query
def box_ray(spark, d):
    """One ray a triangle, some along an axis, against its box."""
    o = (F.lit(20.25), F.lit(2.125), F.lit(8.0))
    ray = ((F.pmod("cid", F.lit(5)) - 2) * 0.25, (F.pmod("cid", F.lit(3)) - 1) * 0.5, F.lit(-1.0))
    return _box(_terrain(spark, d)).select("cid", flag(geom.aabb_intersects_ray(F.col("box"), o, ray)).alias("hit"))


@query
def box_contains(spark, d):
    p = (F.pmod("cid", F.lit(40)) + 0.5, F.lit(1.25), F.lit(0.3))
    return _box(_terrain(spark, d)).select("cid", flag(geom.aabb_contains_xy(F.col("box"), p)).alias("in_xy"), flag(geom.aabb_contains_xy(F.col("box"), p, 0.1)).alias("in_band"))


@query
def geometry_keys(spark, d):
    e = geom.edge_key(F.col("v2"), F.col("v0"))
    return _terrain(spark, d).select("cid", e["lo"].alias("lo"), e["hi"].alias("hi"), F.concat_ws("-", F.transform(geom.triangle_key(F.col("v2"), F.col("v0"), F.col("v1")), lambda v: v.cast("string"))).alias("key"))


@query
def orientation(spark, d):
    theta = geom.angle_of(F.col("x") + 1.0, F.col("y") - 3.5)
    turn = dict(zip(("qx", "qy", "qz", "qw"), geom.orientation_around_z(theta), strict=True))
    return fx.terrain(spark, d).vertices.select("vid", theta.alias("theta"), *(v.alias(k) for k, v in turn.items())).select("vid", *six("theta", "qx", "qy", "qz", "qw"))


@query
def ray_triangle(spark, d):
    """A slanted ray over each triangle: where it meets it, if it does."""
    m = geom.centroid(*map(geom.point, "abc"))
    shift = F.pmod("cid", F.lit(7)) * 0.0625
    o = (m[0] + shift, m[1] - shift * 0.5, F.lit(9.0))
    met = _terrain(spark, d).select("cid", geom.ray_triangle(o, (F.lit(0.0), F.lit(0.015625), F.lit(-1.0)), *map(geom.point, "abc")).alias("m"))
    return met.select("cid", F.col("m.t").alias("t"), F.col("m.u").alias("u"), F.col("m.v").alias("v")).select("cid", *six("t", "u", "v"))


@query
def closest_point(spark, d):
    """The nearest point of each triangle to a point beside and above it."""
    k = F.pmod("cid", F.lit(9))
    p = (F.col("ax") + (k - 4) * 0.375 + 1 / 32, F.col("ay") + (F.pmod("cid", F.lit(4)) - 1) * 0.5 + 1 / 64, F.col("az") + 1.5)
    q = geom.closest_point_on_triangle(p, *map(geom.point, "abc"))
    return _terrain(spark, d).select("cid", *(v.alias(f"q{x}") for v, x in zip(q, "xyz", strict=True))).select("cid", *six("qx", "qy", "qz"))


# --- files and messages --------------------------------------------------------------------------------------------------------


def _both(mesh) -> DataFrame:
    cost = layers.values_of(mesh, "cost").select("cid", F.when(~F.isnan("value"), F.col("value")).alias("cost"))
    both = mesh.geometry().join(layers.values_of(mesh, "occ"), "cid").join(cost, "cid")
    return both.select("cid", "v0", "v1", "v2", "ax", "ay", "az", F.col("value").cast("long").alias("occ"), "cost")


@query
def file_message(spark, d):
    """A message written to a file and read again."""
    path = f"{folder(spark)}/a.map"
    binary.save_message(messages.to_message(fx.terrain(spark, d, layers=True)), path, spark=spark)
    return _both(messages.from_message(binary.load_message(spark, path)))


@query
def file_map(spark, d):
    """A map written to a file and read again."""
    path = f"{folder(spark)}/a.map"
    binary.save(fx.terrain(spark, d, layers=True), path)
    return _both(binary.load(spark, path))


@query
def file_many(spark, d):
    """Files of a folder, decoded by the executors."""
    at = folder(spark)
    mesh = fx.floors(spark, d)
    for k in range(3):
        binary.save(mesh.remove_surface(k)[0], f"{at}/m{k}.map")
    found = binary.load_all(spark, f"{at}/*.map")
    return found.select(F.regexp_extract("path", r"(m\d)\.map", 1).alias("name"), F.size("message.surfaces").cast("long").alias("n_surfaces"), F.size("message.navcels_v0").cast("long").alias("n_navcels"))


@query
def parquet_map(spark, d):
    """A map as a Parquet folder; one layer of it read alone."""
    at = folder(spark)
    tables.save(fx.terrain(spark, d, layers=True), at)
    return _both(tables.load(spark, at))


@query
def layer_message(spark, d):
    """A layer as a message, and back into a map that lacks it."""
    mesh = fx.terrain(spark, d, layers=True)
    back = messages.layer_from_message(cut(messages.layer_to_message(mesh, "cost")), layers.remove_layer(mesh, "cost"))
    return layers.values_of(back, "cost").select("cid", F.when(~F.isnan("value"), F.col("value")).alias("cost"))


# --- streams -------------------------------------------------------------------------------------------------------------------


@query
def stream_grid(spark, d):
    """Two grid messages through a stream; the store then has the mesh of the newer one."""
    at = folder(spark)
    cells, info = fx.grid(spark, d)
    held = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", "occ"))), lambda c: c["occ"]).alias("data"))
    # The last row of cells may not be whole.
    held = held.select(F.slice("data", 1, info.width * info.height).alias("data"))
    fixed = [F.lit("x").alias("frame_id"), F.lit(info.width).alias("width"), F.lit(info.height).alias("height"), F.lit(0.5).alias("resolution"), *(F.lit(0.0).alias(f"o{k}") for k in "xyz")]
    newer = held.select(F.lit("2024-01-02").cast("timestamp").alias("stamp"), *fixed, "data")
    older = held.select(F.lit("2024-01-01").cast("timestamp").alias("stamp"), *fixed, F.transform("data", lambda v: F.lit(0).cast("smallint")).alias("data"))
    older.unionByName(newer).write.parquet(f"{at}/in")
    store = maps.MapStore(f"{at}/store")
    maps.grids_to_map(spark.readStream.schema(maps.GRID).parquet(f"{at}/in"), store, f"{at}/c").awaitTermination()
    return layers.values_of(store.load(spark), "occupancy").select("cid", F.col("value").cast("long").alias("value"))


@query
def stream_updates(spark, d):
    """Layer updates through a stream into the current map; the newest wins, wrong ones are set aside."""
    at = folder(spark)
    store = maps.MapStore(f"{at}/store")
    mesh = fx.floors(spark, d)
    store.publish(mesh, "first")
    n = mesh.navcels.count()
    update = lambda day, name, k, size: (F.lit(f"2024-01-0{day}").cast("timestamp").alias("stamp"), F.lit("x").alias("frame_id"), F.lit(name).alias("name"), F.lit(1).cast("smallint").alias("type"), F.lit(None).cast("array<smallint>").alias("data_u8"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i * k).cast("float")).alias("data_f32"), F.lit(None).cast("array<double>").alias("data_f64"))
    one = spark.range(1)
    one.select(*update(1, "cost", 1, n)).unionByName(one.select(*update(2, "cost", 3, n))).unionByName(one.select(*update(3, "cost", 5, n - 1))).write.parquet(f"{at}/in")
    maps.layer_updates(spark.readStream.schema(maps.UPDATE).parquet(f"{at}/in"), store, f"{at}/c", f"{at}/rejects").awaitTermination()
    return layers.values_of(store.load(spark), "cost")


@query
def lost_messages(spark, d):
    """Of events taken as messages of their type, numbered by their id: how many numbers each type misses."""
    return maps.lost(fx.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").cast("long").alias("seq")))


@query
def goal_poses(spark, d):
    e = F.col("event_id")
    picks = fx.table(spark, d, "events").select(e.cast("long").alias("pid"), F.when(e % 5 > 0, F.pmod(e, F.lit(64)) / 8.0).alias("px"), F.lit(1.5).alias("py"), F.lit(0.25).alias("pz"), (F.pmod(e, F.lit(6)) / 2.0).alias("theta"))
    return maps.goals(picks).select("pid", "frame_id", *six("x", "y", "z", "qx", "qy", "qz", "qw"))


@query
def cloud_guards(spark, d):
    """What gives no mesh: too few points, too few voxels, points in a line."""
    make = lambda rows: spark.createDataFrame(rows, "x double, y double, z double")
    cases = {"two points": make([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]), "one voxel": make([(0.1, 0.1, 0.0), (0.2, 0.1, 0.0), (0.1, 0.2, 0.0)]), "a line": make([(float(k), 0.0, 0.0) for k in range(6)])}
    return spark.createDataFrame([(name, cloud.from_points(points, BuildParams()).navcels.count()) for name, points in cases.items()], "name string, n long")


@query
def mesh_elevation(spark, d):
    """A mesh from points and triangles in one call, with its elevation as heights from the grid function."""
    mesh = fx.terrain(spark, d)
    made = grid.from_mesh(mesh.vertices.select(F.col("vid").alias("pid"), "x", "y", "z"), mesh.navcels, "made")
    return made.surfaces.join(made.surface_navcels, "surface_idx").groupBy("frame_id").agg(F.count("*").alias("n"), F.min("cid").alias("first"))


@query
def copied_map(spark, d):
    """A copy is a value: what is done to it leaves the other as it was."""
    mesh = fx.terrain(spark, d, layers=True)
    copy = layers.layer_clear(replace(mesh), "occ", LayerType.U8, 7)
    both = layers.values_of(mesh, "occ").withColumnRenamed("value", "own").join(layers.values_of(copy, "occ"), "cid")
    return both.select("cid", F.col("own").cast("long").alias("own"), F.col("value").cast("long").alias("copy"))
