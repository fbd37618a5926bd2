"""Message forms: a whole map, or one layer, as one nested row."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmesh import types as T
from surfmesh.operators.layers import long_values, remove_layer
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import LayerType

LAYER = "frame_id string, stamp timestamp, name string, type smallint, data_u8 array<smallint>, data_f32 array<float>, data_f64 array<double>"
MAP = (
    "frame_id string, stamp timestamp, positions_x array<float>, positions_y array<float>, positions_z array<float>, has_vertex_rgba boolean, "
    "colors_r array<smallint>, colors_g array<smallint>, colors_b array<smallint>, colors_a array<smallint>, "
    "navcels_v0 array<bigint>, navcels_v1 array<bigint>, navcels_v2 array<bigint>, "
    f"surfaces array<struct<frame_id: string, navcels: array<bigint>>>, layers array<struct<{LAYER.replace(' string', ': string').replace(' timestamp', ': timestamp').replace(' smallint', ': smallint').replace(' array', ': array')}>>"
)
_EPOCH = datetime.datetime(1970, 1, 1)


def _ordered(key: str, *columns: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), *columns)))


def layer_rows(mesh: MeshMap, frame_id: str = "map", stamp: datetime.datetime = _EPOCH) -> DataFrame:
    """A layer message for every layer: exactly one of its arrays has the values, in triangle order."""
    held = mesh.layer_values.groupBy(F.col("layer").alias("name")).agg(_ordered("cid", *(F.col(t.column) for t in LayerType)).alias("rows"))
    both = mesh.layers.select("name", "type").join(held, "name", "left").withColumn("rows", F.coalesce("rows", F.from_json(F.lit("[]"), "array<struct<_k: bigint, u8: smallint, f32: float, f64: double>>")))
    data = [_data(t) for t in LayerType]
    tag = F.coalesce(*(F.when(F.col("type") == t.type_name, F.lit(int(t))) for t in LayerType)).cast("smallint")
    return both.select(F.lit(frame_id).alias("frame_id"), F.lit(stamp).cast("timestamp").alias("stamp"), "name", tag.alias("type"), *data)


def _data(t: LayerType) -> Column:
    values = F.transform("rows", lambda s: s[t.column])
    return F.when(F.col("type") == t.type_name, values).otherwise(F.array().cast(f"array<{t.spark_type}>")).alias(f"data_{t.column}")


def to_message(mesh: MeshMap, frame_id: str = "map", stamp: datetime.datetime = _EPOCH) -> DataFrame:
    """The map as one row of MAP. Descriptions, units and what is derived are left out; colours stand in it only if every vertex has one."""
    v = mesh.vertices.agg(_ordered("vid", *(F.col(k) for k in ("x", "y", "z", "r", "g", "b", "a"))).alias("v"), F.coalesce(F.min(F.when(F.col("r").isNull() | F.col("a").isNull(), 0).otherwise(1)), F.lit(0)).alias("colored"))
    t = mesh.navcels.agg(_ordered("cid", *(F.col(f"v{k}") for k in range(3))).alias("t"))
    listed = mesh.surface_navcels.groupBy("surface_idx").agg(_ordered("pos", F.col("cid")).alias("s"))
    surfaces = mesh.surfaces.join(listed, "surface_idx", "left").select("surface_idx", F.struct("frame_id", F.coalesce(F.transform("s", lambda s: s["cid"]), F.array().cast("array<bigint>")).alias("navcels")).alias("surface"))
    s = surfaces.agg(_ordered("surface_idx", F.col("surface")).alias("s"))
    rows = layer_rows(mesh, frame_id, stamp)
    layers = rows.agg(F.sort_array(F.collect_list(F.struct("name", F.struct(*rows.columns).alias("m")))).alias("l"))
    one = v.crossJoin(t).crossJoin(s).crossJoin(layers)  # one row each
    return one.select(
        F.lit(frame_id).alias("frame_id"),
        F.lit(stamp).cast("timestamp").alias("stamp"),
        *(_position(k) for k in "xyz"),
        (F.col("colored") == 1).alias("has_vertex_rgba"),
        *map(_color, "rgba"),
        *(_corner(k) for k in range(3)),
        F.transform("s", lambda x: x["surface"]).alias("surfaces"),
        F.transform("l", lambda x: x["m"]).alias("layers"),
    )


def _position(k: str) -> Column:
    return F.transform("v", lambda p: p[k].cast("float")).alias(f"positions_{k}")


def _color(k: str) -> Column:
    return F.when(F.col("colored") == 1, F.transform("v", lambda p: p[k])).otherwise(F.array().cast("array<smallint>")).alias(f"colors_{k}")


def _corner(k: int) -> Column:
    return F.transform("t", lambda p: p[f"v{k}"]).alias(f"navcels_v{k}")


def from_message(message: DataFrame) -> MeshMap:
    """The map of a one-row message. If it has triangles but no surface, one surface (with an empty frame) lists them all; layers of an
    unknown type are passed over."""
    p = message.select("has_vertex_rgba", *(f"positions_{k}" for k in "xyz"), *(f"colors_{k}" for k in "rgba"))
    color = lambda k: F.when(F.col("has_vertex_rgba"), F.get(F.col(f"colors_{k}"), F.col("i"))).cast("smallint").alias(k)
    at = p.select("*", F.posexplode("positions_x").alias("i", "x"))
    vertices = at.select(F.col("i").cast("long").alias("vid"), F.col("x").cast("double").alias("x"), *(F.get(F.col(f"positions_{k}"), F.col("i")).cast("double").alias(k) for k in "yz"), *map(color, "rgba"))
    c = message.select("navcels_v0", "navcels_v1", "navcels_v2")
    navcels = c.select(F.posexplode(F.arrays_zip("navcels_v0", "navcels_v1", "navcels_v2")).alias("i", "t")).select(F.col("i").cast("long").alias("cid"), *(F.col(f"t.navcels_v{k}").alias(f"v{k}") for k in range(3)))
    n = F.size("navcels_v0")
    every = F.array(F.struct(F.lit("").alias("frame_id"), F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("navcels")))
    s = message.select(F.posexplode(F.when((F.size("surfaces") == 0) & (n > 0), every).otherwise(F.col("surfaces"))).alias("surface_idx", "s"))
    listed = s.select("surface_idx", F.posexplode("s.navcels").alias("pos", "cid"))
    rows = message.select(F.explode("layers").alias("l")).select("l.*").where(F.col("type").isin(*map(int, LayerType)))
    kind = F.element_at(F.create_map(*(x for t in LayerType for x in (F.lit(int(t)), F.lit(t.type_name)))), F.col("type").cast("int"))
    layers = rows.select("name", kind.alias("type"), F.lit("").alias("description"), F.lit("").alias("unit"), F.lit(True).alias("per_cell"))
    values = None
    for t in LayerType:
        one = rows.where(F.col("type") == int(t)).select("name", F.posexplode(f"data_{t.column}").alias("i", "value"))
        one = one.select(F.col("name").alias("layer"), F.col("i").cast("long").alias("cid"), *((F.col("value") if u == t else F.lit(None)).cast(u.spark_type).alias(u.column) for u in LayerType))
        values = one if values is None else values.unionByName(one)
    return MeshMap(vertices, navcels, s.select("surface_idx", "s.frame_id"), listed, layers, values)


def layer_to_message(mesh: MeshMap, name: str, frame_id: str = "map", stamp: datetime.datetime = _EPOCH) -> DataFrame:
    """One layer as a message; KeyError where there is none."""
    rows = layer_rows(replace(mesh, layers=mesh.layers.where(F.col("name") == name), layer_values=mesh.layer_values.where(F.col("layer") == name)), frame_id, stamp)
    if not rows.limit(1).count():
        raise KeyError(name)
    return rows


def layer_from_message(message: DataFrame, mesh: MeshMap) -> MeshMap:
    """The map with a layer message's layer, sized as the message, in place of one of that name; its description and unit are blank.
    ValueError for an unknown type."""
    name, tag = message.select("name", "type").first()
    if tag not in list(LayerType):
        raise ValueError(f"layer type {tag}")
    kind = LayerType(tag)
    rest = remove_layer(mesh, name)
    values = long_values(message.select(F.posexplode(f"data_{kind.column}").alias("cid", "value")), name, kind, F.col("value"))
    entry = mesh.spark.createDataFrame([(name, kind.type_name, "", "", True)], T.LAYERS)
    return replace(rest, layers=rest.layers.unionByName(entry), layer_values=rest.layer_values.unionByName(values))
