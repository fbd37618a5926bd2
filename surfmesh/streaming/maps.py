"""Structured Streaming pipelines. A store is a folder of map versions and a small table that names the current one: what was published last
is there for readers that come later, and a batch that is run again replaces its own version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surfmesh.functions.geom import orientation_around_z
from surfmesh.operators.cloud import from_points
from surfmesh.operators.grid import GridInfo, from_occupancy_grid
from surfmesh.operators.layers import remove_layer
from surfmesh.operators.mesh import MeshMap
from surfmesh.operators.style import layer_colors
from surfmesh.sources import files, tables
from surfmesh.types import BuildParams, LayerType

GRID = "stamp timestamp, frame_id string, width int, height int, resolution double, ox double, oy double, oz double, data array<smallint>"
CLOUD = "stamp timestamp, frame_id string, x array<float>, y array<float>, z array<float>"
UPDATE = "stamp timestamp, frame_id string, name string, type smallint, data_u8 array<smallint>, data_f32 array<float>, data_f64 array<double>"
#: How clouds that arrive as a stream are meshed.
CLOUD_PARAMS = BuildParams(max_edge_len=5.0, min_angle_deg=25.0, max_slope_deg=30.0, resolution=1.0)


@dataclass(frozen=True)
class MapStore:
    """The current map, in the folder path (shared by all who write or read it).

    A version's folder has what that version wrote; the small file `current` says where each part and each layer's values are, and takes the place
    of the last one in one step. So an update of a layer writes that layer alone, and a reader finds a whole map at any time. What neither
    the current map nor the one before it has any part in is deleted.
    """

    path: str

    def _current(self, spark: SparkSession) -> dict | None:
        data = files.read(spark, f"{self.path}/current")
        return None if data is None else json.loads(data)

    def publish(self, mesh: MeshMap, version: int | str, changed: Iterable[str] | None = None) -> None:
        """Makes mesh the current map. changed: the layers that differ from the current map, if nothing else does."""
        spark, last = mesh.spark, self._current(mesh.spark)
        own = f"versions/{version}"
        names = [r[0] for r in mesh.layers.select("name").collect()]
        keep = last is not None and changed is not None and not any(own in x for x in (*last["parts"].values(), *last["layers"].values()))
        new = [n for n in names if not keep or n in set(changed) or n not in last["layers"]]
        fresh = ["layers"] if keep else [p for p in tables.PARTS if p != "layer_values"]
        for part in fresh:
            getattr(mesh, part).write.mode("overwrite").parquet(f"{self.path}/{own}/{part}")
        if new:
            mesh.layer_values.where(F.col("layer").isin(new)).write.mode("overwrite").partitionBy("layer").parquet(f"{self.path}/{own}/layer_values")
        state = {
            "version": str(version),
            "parts": ((last["parts"] if keep else {}) | {p: f"{own}/{p}" for p in fresh}),
            "layers": {n: f"{own}/layer_values" if n in new else last["layers"][n] for n in names},
        }
        files.write(spark, f"{self.path}/current", json.dumps(state).encode())
        used = {x.split("/")[1] for s in (state, last or state) for x in (*s["parts"].values(), *s["layers"].values())}
        for name in files.listed(spark, f"{self.path}/versions"):
            if name not in used:
                files.remove(spark, f"{self.path}/versions/{name}")

    def version(self, spark: SparkSession) -> str | None:
        state = self._current(spark)
        return state and state["version"]

    def load(self, spark: SparkSession) -> MeshMap | None:
        """The current map; None before the first one."""
        state = self._current(spark)
        if state is None:
            return None
        parts = {p: spark.read.schema(tables.PARTS[p]).parquet(f"{self.path}/{at}") for p, at in state["parts"].items()}
        values = spark.createDataFrame([], tables.PARTS["layer_values"])
        for at in sorted(set(state["layers"].values())):
            held = [n for n, x in state["layers"].items() if x == at]
            values = values.unionByName(spark.read.schema(tables.PARTS["layer_values"]).parquet(f"{self.path}/{at}").where(F.col("layer").isin(held)))
        return MeshMap(**parts, layer_values=values)

    def reset(self, spark: SparkSession) -> None:
        """Forgets the map and its layers."""
        self.publish(MeshMap.empty(spark), "empty")


def newest(batch: DataFrame, *by: str) -> DataFrame:
    """The row of the latest stamp, of each of `by`; of equal stamps that of the greatest hash of all columns, so that a batch that is run again
    gives the same."""
    order = [F.desc_nulls_last("stamp"), F.desc(F.xxhash64(*batch.columns))]
    if not by:
        return batch.orderBy(*order).limit(1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def grid_of(message: DataFrame) -> tuple[DataFrame, GridInfo]:
    """(cells, info) of a one-row grid message."""
    row = message.select("frame_id", "width", "height", "resolution", "ox", "oy", "oz").first()
    info = GridInfo(*row)
    cells = message.select(F.posexplode("data").alias("k", "occ"))
    return cells.select(F.pmod("k", F.lit(max(info.width, 1))).alias("i"), F.floor(F.col("k") / max(info.width, 1)).cast("int").alias("j"), "occ"), info


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def grids_to_map(stream: DataFrame, store: MapStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the store at the mesh of the newest grid (GRID); of a batch only the newest one is built."""

    def each(batch: DataFrame, number: int) -> None:
        latest = newest(batch)
        if latest.limit(1).count():
            cells, info = grid_of(latest)
            store.publish(from_occupancy_grid(cells, replace(info, frame_id="map")), f"grid-{number}")

    return _run(stream, each, checkpoint, trigger)


def clouds_to_map(stream: DataFrame, store: MapStore, checkpoint: str, params: BuildParams = CLOUD_PARAMS, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the store at the mesh of the newest point cloud (CLOUD)."""

    def each(batch: DataFrame, number: int) -> None:
        latest = newest(batch)
        if latest.limit(1).count():
            points = latest.select(F.explode(F.arrays_zip("x", "y", "z")).alias("p")).select("p.x", "p.y", "p.z")
            store.publish(from_points(points, params), f"cloud-{number}")

    return _run(stream, each, checkpoint, trigger)


def checked(updates: DataFrame, n_navcels: int | None) -> DataFrame:
    """updates (UPDATE) with why: null for a good one, else why it is rejected. n_navcels: of the map; None before one came."""
    sizes = [F.coalesce(F.size(f"data_{t.column}"), F.lit(0)) for t in LayerType]
    filled = sum(((s > 0).cast("int") for s in sizes), F.lit(0))
    length = F.greatest(*sizes)
    why = F.when(F.lit(n_navcels is None), "no map yet").when(filled != 1, "not exactly one array has values").when(length != (n_navcels or 0), "its length is not the number of triangles")
    return updates.withColumn("why", why)


def apply_updates(mesh: MeshMap, good: DataFrame) -> MeshMap:
    """The map with the newest update of each layer in place of the layer of that name. The array that has values decides the type."""
    latest = newest(good, "name")
    names = [r[0] for r in latest.select("name").collect()]
    for name in names:
        mesh = remove_layer(mesh, name)
    values = layers = None
    for t in LayerType:
        own = latest.where(F.size(f"data_{t.column}") > 0)
        entry = own.select("name", F.lit(t.type_name).alias("type"), F.lit("").alias("description"), F.lit("").alias("unit"), F.lit(True).alias("per_cell"))
        rows = own.select(F.col("name").alias("layer"), F.posexplode(f"data_{t.column}").alias("i", "v"))
        rows = rows.select("layer", F.col("i").cast("long").alias("cid"), *((F.col("v") if u == t else F.lit(None)).cast(u.spark_type).alias(u.column) for u in LayerType))
        values, layers = (rows, entry) if values is None else (values.unionByName(rows), layers.unionByName(entry))
    return replace(mesh, layers=mesh.layers.unionByName(layers), layer_values=mesh.layer_values.unionByName(values))


def layer_updates(stream: DataFrame, store: MapStore, checkpoint: str, rejects: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes good layer updates into the current map, and the others with their reason to the Parquet folder rejects."""

    def each(batch: DataFrame, number: int) -> None:
        mesh = store.load(batch.sparkSession)
        batch = batch.persist()
        seen = checked(batch, None if mesh is None else mesh.navcels.count())
        seen.where("why is not null").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        good = seen.where("why is null").drop("why")
        if mesh is not None and good.limit(1).count():
            names = [r[0] for r in good.select("name").distinct().collect()]
            store.publish(apply_updates(mesh, good), f"update-{number}", changed=names)
        batch.unpersist()

    return _run(stream, each, checkpoint, trigger)


def republish(spark: SparkSession, store: MapStore, publish: Callable[[MeshMap], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Hands the current map to publish once in each interval."""

    def each(batch: DataFrame, number: int) -> None:
        if (mesh := store.load(spark)) is not None:
            publish(mesh)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return _run(clock, each, checkpoint, {"processingTime": every})


def on_change(spark: SparkSession, store: MapStore, draw: Callable[[DataFrame], None], checkpoint: str, layer: str, scheme: str = "heat", every: str = "1 second") -> StreamingQuery:
    """Hands the layer's colours (style.layer_colors) to draw when the current map has changed since the last look, and only then."""
    seen: list[str | None] = [None]

    def each(batch: DataFrame, number: int) -> None:
        state = files.read(spark, f"{store.path}/current")
        if state is not None and state != seen[0]:
            draw(layer_colors(store.load(spark), layer, scheme))
            seen[0] = state

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return _run(clock, each, checkpoint, {"processingTime": every})


def lost(updates: DataFrame) -> DataFrame:
    """(name, n_messages, n_lost) of messages that carry their publisher's running number seq: how many numbers between each layer's first and last
    are missing. Numbers that come twice count once."""
    found = updates.where("seq is not null").groupBy("name").agg(F.count_distinct("seq").alias("n_messages"), F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    return found.select("name", "n_messages", (F.col("_hi") - F.col("_lo") + 1 - F.col("n_messages")).alias("n_lost"))


def goals(picks: DataFrame, frame_id: str = "map") -> DataFrame:
    """Goal poses (frame_id, x, y, z, qx, qy, qz, qw, ...) of picks (px, py, pz and the angle theta about +z); null points give no goal."""
    turn = orientation_around_z(F.col("theta"))
    rest = [c for c in picks.columns if c not in ("px", "py", "pz", "theta")]
    return picks.where("px is not null and py is not null and pz is not null").select(F.lit(frame_id).alias("frame_id"), *(F.col(f"p{k}").alias(k) for k in "xyz"), *(v.alias(f"q{k}") for v, k in zip(turn, "xyzw", strict=True)), *rest)


def publish_goals(stream: DataFrame, folder: str, checkpoint: str, frame_id: str = "map", trigger: dict | None = None) -> StreamingQuery:
    """Appends the goals of a stream of picks to a Parquet folder, each once."""
    out = goals(stream, frame_id).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def counters(updates: DataFrame) -> DataFrame:
    """Messages and last stamp of each layer, as a streaming aggregation (or one over a table)."""
    return updates.groupBy("name").agg(F.count("*").alias("n_messages"), F.max("stamp").alias("last_stamp"))


def latest_values(updates: DataFrame) -> DataFrame:
    """(layer, cid, value, stamp) of single-triangle updates (layer, cid, value, stamp, seq): the newest wins, the greater seq on ties."""
    newest_one = F.max_by(F.struct("value", "stamp"), F.struct("stamp", "seq")).alias("m")
    return updates.groupBy("layer", "cid").agg(newest_one).select("layer", "cid", "m.value", "m.stamp")


