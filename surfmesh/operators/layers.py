"""Layers: named values of one type, one for each triangle. A long table holds the values of all; it is written partitioned by layer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmesh import types as T
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import LayerType


def cast_value(v: Column, to: LayerType) -> Column:
    """A value in another type: U8 is rounded half away from zero and held in 0..255 (NaN is 0), the others are cast. Null stays null."""
    if to == LayerType.U8:
        d = v.cast("double")
        return F.when(F.isnan(d), 0).when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(d)))).cast("smallint")
    return v.cast(to.spark_type)


def long_values(df: DataFrame, name: str, kind: LayerType, value: Column) -> DataFrame:
    """(layer, cid, u8, f32, f64) of a table with cid."""
    columns = [(value if t == kind else F.lit(None)).cast(t.spark_type).alias(t.column) for t in LayerType]
    return df.select(F.lit(name).alias("layer"), F.col("cid").cast("long").alias("cid"), *columns)


def layer_type(mesh: MeshMap, name: str) -> LayerType | None:
    row = mesh.layers.where(F.col("name") == name).select("type").first()
    return None if row is None else next(t for t in LayerType if t.type_name == row[0])


def has_layer(mesh: MeshMap, name: str) -> bool:
    return layer_type(mesh, name) is not None


def layer_type_name(mesh: MeshMap, name: str) -> str:
    kind = layer_type(mesh, name)
    return "unknown" if kind is None else kind.type_name


def layer_size(mesh: MeshMap, name: str) -> int:
    return mesh.layer_values.where(F.col("layer") == name).count()


def list_layers(mesh: MeshMap) -> list[str]:
    return [r[0] for r in mesh.layers.select("name").orderBy("name").collect()]


def layer_meta(mesh: MeshMap, name: str) -> tuple[str, str, bool] | None:
    row = mesh.layers.where(F.col("name") == name).select("description", "unit", "per_cell").first()
    return None if row is None else tuple(row)


def catalog(mesh: MeshMap) -> DataFrame:
    """(name, type, n, description, unit) of every layer."""
    sizes = mesh.layer_values.groupBy(F.col("layer").alias("name")).agg(F.count("*").alias("n"))
    return mesh.layers.join(sizes, "name", "left").select("name", "type", F.coalesce("n", F.lit(0)).alias("n"), "description", "unit")


def remove_layer(mesh: MeshMap, name: str) -> MeshMap:
    return replace(mesh, layers=mesh.layers.where(F.col("name") != name), layer_values=mesh.layer_values.where(F.col("layer") != name))


def put_layer(mesh: MeshMap, name: str, kind: LayerType, values: DataFrame, *, description: str = "", unit: str = "") -> MeshMap:
    """The map with a layer of these values (cid, value), in place of one of that name."""
    rest = remove_layer(mesh, name)
    entry = mesh.spark.createDataFrame([(name, kind.type_name, description, unit, True)], T.LAYERS)
    return replace(rest, layers=rest.layers.unionByName(entry), layer_values=rest.layer_values.unionByName(long_values(values, name, kind, F.col("value"))))


def _checked(mesh: MeshMap, name: str, kind: LayerType) -> bool:
    """Whether there is such a layer; TypeError if it has another type."""
    own = layer_type(mesh, name)
    if own is not None and own != kind:
        raise TypeError(f"layer {name} is {own.type_name}, not {kind.type_name}")
    return own is not None


def add_layer(mesh: MeshMap, name: str, kind: LayerType, *, default: float = 0, description: str = "", unit: str = "") -> MeshMap:
    """The map with a layer, every triangle at the default; a layer of that name and type stays, with the new description and unit."""
    if _checked(mesh, name, kind):
        entry = mesh.spark.createDataFrame([(name, kind.type_name, description, unit, True)], T.LAYERS)
        return replace(mesh, layers=mesh.layers.where(F.col("name") != name).unionByName(entry))
    return put_layer(mesh, name, kind, mesh.navcels.select("cid", cast_value(F.lit(default), kind).alias("value")), description=description, unit=unit)


def add_layer_from(mesh: MeshMap, name: str, kind: LayerType, source: str, *, description: str = "", unit: str = "") -> MeshMap:
    """The map with a layer that starts with another's values in its own type, NaN as 0; without the source it starts at 0."""
    _checked(mesh, name, kind)
    if not has_layer(mesh, source):
        return add_layer(mesh, name, kind, description=description, unit=unit)
    values = values_of(mesh, source).select("cid", cast_value(F.when(F.isnan("value"), 0.0).otherwise(F.col("value")), kind).alias("value"))
    return put_layer(mesh, name, kind, values, description=description, unit=unit)


def values_of(mesh: MeshMap, name: str) -> DataFrame:
    """(cid, value) of a layer as doubles; empty where there is none. The filter prunes partitions of a written map."""
    return mesh.layer_values.where(F.col("layer") == name).select("cid", F.coalesce(F.col("f64"), F.col("f32").cast("double"), F.col("u8").cast("double")).alias("value"))


def resize_all(mesh: MeshMap) -> MeshMap:
    """The map with every layer cut or filled up with zeros to its triangles."""
    wanted = mesh.navcels.select("cid").join(F.broadcast(mesh.layers.select(F.col("name").alias("layer"), "type")))  # a row for each of a few layers
    held = wanted.join(mesh.layer_values, ["layer", "cid"], "left")
    filled = [F.when(F.col("type") == t.type_name, F.coalesce(t.column, F.lit(0).cast(t.spark_type))).alias(t.column) for t in LayerType]
    return replace(mesh, layer_values=held.select("layer", "cid", *filled))


def layer_set(mesh: MeshMap, name: str, kind: LayerType, updates: DataFrame) -> MeshMap:
    """The map with the values of updates (cid, value) written; creates the layer; triangles that aren't there are passed over. Of several
    values for one triangle the largest is taken."""
    mesh = mesh if _checked(mesh, name, kind) else add_layer(mesh, name, kind)
    new = updates.groupBy("cid").agg(F.max("value").alias("new"))
    values = mesh.layer_values.where(F.col("layer") == name).join(new, "cid", "left").select("cid", F.coalesce(cast_value(F.col("new"), kind), kind.column).alias("value"))
    return replace(mesh, layer_values=mesh.layer_values.where(F.col("layer") != name).unionByName(long_values(values, name, kind, F.col("value"))))


def layer_get(mesh: MeshMap, name: str, kind: LayerType, cells: DataFrame, default: float = 0) -> DataFrame:
    """cells (cid, ...) with value: the layer's there, in the type asked for; the default where layer or triangle are missing."""
    found = values_of(mesh, name).select("cid", cast_value(F.col("value"), kind).alias("value"))
    return cells.join(found, "cid", "left").withColumn("value", F.coalesce("value", F.lit(default).cast(kind.spark_type)))


def layer_clear(mesh: MeshMap, name: str, kind: LayerType, value: float) -> MeshMap:
    """The map with the whole layer at one value."""
    mesh = mesh if _checked(mesh, name, kind) else add_layer(mesh, name, kind)
    kept = mesh.layer_values.where(F.col("layer") == name).select("cid")
    return replace(mesh, layer_values=mesh.layer_values.where(F.col("layer") != name).unionByName(long_values(kept, name, kind, cast_value(F.lit(value), kind))))


def layer_copy(mesh: MeshMap, source: str, target: str, kind: LayerType) -> tuple[MeshMap, bool]:
    """The map with target as a copy of source; False, and no change, where the source is missing or either has another type or size."""
    if source == target:
        return mesh, True
    own, other = layer_type(mesh, source), layer_type(mesh, target)
    if own != kind or (other is not None and (other != kind or layer_size(mesh, target) != layer_size(mesh, source))):
        return mesh, False
    values = mesh.layer_values.where(F.col("layer") == source).select("cid", F.col(kind.column).alias("value"))
    meta = layer_meta(mesh, target) or ("", "", True)
    return put_layer(mesh, target, kind, values, description=meta[0], unit=meta[1]), True


def content_hashes(mesh: MeshMap) -> DataFrame:
    """(layer, n, hash): an order-free hash of each layer's values."""
    return mesh.layer_values.groupBy("layer").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid", "u8", "f32", "f64")).alias("hash"))


def content_hash_fnv1a(mesh: MeshMap, name: str) -> int:
    """The 64-bit FNV-1a hash of a layer's size and values in order, byte by byte. FNV-1a can't be put together from parts, so it runs over the
    values as they stream to the driver: a call for comparing with hashes made elsewhere, on maps of a size that one machine holds. To compare
    layers here use content_hashes()."""
    import struct

    kind = layer_type(mesh, name)
    if kind is None:
        raise KeyError(name)
    h, mask = 0xCBF29CE484222325, (1 << 64) - 1
    pack = struct.Struct("<" + "Bfd"[kind]).pack
    values = mesh.layer_values.where(F.col("layer") == name).orderBy("cid").select(kind.column)
    for data in (struct.pack("<Q", layer_size(mesh, name)), *(pack(r[0]) for r in values.toLocalIterator())):
        for byte in data:
            h = (h ^ byte) * 0x100000001B3 & mask
    return h


def sync_layers(source: MeshMap, target: MeshMap) -> MeshMap:
    """target with source's layers: its own others go, those whose size or hash differ are copied, and the catalog is taken over. Geometry,
    surfaces and colours stay target's."""
    same = content_hashes(source).join(content_hashes(target), ["layer", "n", "hash"]).select("layer")
    kept = target.layer_values.join(same, "layer", "left_semi")
    copied = source.layer_values.join(same, "layer", "left_anti")
    return replace(target, layers=source.layers, layer_values=kept.unionByName(copied))


def assigned(source: MeshMap, target: MeshMap) -> MeshMap:
    """What assigning source to target gives: synced layers where the geometry is the same, else source."""
    return sync_layers(source, target) if target.has_same_geometry(source) else source


def wide(mesh: MeshMap) -> DataFrame:
    """(cid, a column for each layer) with values as doubles."""
    value = F.coalesce(F.col("f64"), F.col("f32").cast("double"), F.col("u8").cast("double"))
    return mesh.layer_values.groupBy("cid").pivot("layer", list_layers(mesh)).agg(F.first(value))
