"""Grids, clouds, files, messages and streams."""

import datetime
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators import cloud, grid, layers, style
from surfmesh.operators.mesh import MeshMap
from surfmesh.sources import binary, json_maps, messages, tables
from surfmesh.streaming import maps
from surfmesh.types import BuildParams, LayerType


@pytest.fixture(scope="module")
def occ40(spark):
    cells = {(i, j): 0 for i in range(40) for j in range(40)}
    cells |= {(i, j): 100 for i, j in cells if i in (0, 39) or j in (0, 39)}
    cells |= {(i, j): 100 for i in range(17, 23) for j in range(17, 23)}
    for k in range(10, 30):
        cells[20, k] = cells[k, 20] = 50
    cells[5, 5] = cells[34, 17] = -1
    df = spark.createDataFrame([(i, j, o) for (i, j), o in cells.items()], "i int, j int, occ smallint")
    return cells, df, grid.GridInfo("map", 40, 40, 0.1)


def test_grid_round_trip(occ40):
    cells, df, info = occ40
    mesh = grid.from_occupancy_grid(df, info)
    assert (mesh.vertices.count(), mesh.navcels.count()) == (1681, 3200)
    v = {r.cid: (r.v0, r.v1, r.v2) for r in mesh.navcels.where("cid in (900, 901)").collect()}
    assert v == {900: (461, 462, 503), 901: (461, 503, 502)}  # cell (10, 11)
    for generic in (False, True):
        back, shape = grid.to_occupancy_grid(mesh, generic=generic)
        assert (shape.width, shape.height) == (40, 40) and shape.resolution == pytest.approx(0.1)
        assert {(r.i, r.j): r.occ for r in back.collect()} == cells
    assert grid.to_occupancy_grid(layers.remove_layer(mesh, "occupancy"))[1].width == 0


def sample(spark):
    mesh, _ = MeshMap.empty(spark).add_vertices([(0, 0, 0), (1, 0, 0), (1, 1, 0.5), (0, 1, 0)])
    mesh, _ = mesh.add_navcels([(0, 1, 2), (0, 2, 3)])
    mesh, _ = mesh.add_surface("odom", [1, 0])
    for name, kind, values in (("occupancy", LayerType.U8, (42, 255)), ("cost", LayerType.F32, (1.5, 7.25)), ("height", LayerType.F64, (0.1, 0.2))):
        mesh = layers.put_layer(mesh, name, kind, spark.createDataFrame(list(enumerate(map(float, values))), "cid long, value double"), description="d", unit="m")
    return mesh


def content(mesh):
    rows = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    return rows(mesh.vertices.select("vid", "x", "y", "z", "r", "g", "b", "a"), "vid"), rows(mesh.navcels.select("cid", "v0", "v1", "v2"), "cid"), rows(mesh.surfaces.select("surface_idx", "frame_id"), "surface_idx"), rows(mesh.surface_navcels.select("surface_idx", "pos", "cid"), "surface_idx", "pos"), rows(mesh.layer_values.select("layer", "cid", "u8", "f32", "f64"), "layer", "cid"), rows(mesh.layers.select("name", "type"), "name")


def test_message_round_trip(spark):
    mesh = sample(spark)
    assert content(messages.from_message(messages.to_message(mesh, "odom"))) == content(mesh)
    assert content(messages.from_message(messages.to_message(MeshMap.empty(spark)))) == content(MeshMap.empty(spark))


def test_message_without_surfaces_gets_one(spark):
    row = messages.to_message(sample(spark)).withColumn("surfaces", F.expr("filter(surfaces, s -> false)"))
    mesh = messages.from_message(row)
    assert [tuple(r) for r in mesh.surfaces.collect()] == [(0, "")] and mesh.surface_navcels.count() == 2


def test_layer_messages(spark):
    mesh = sample(spark)
    for name in ("occupancy", "cost", "height"):
        one = messages.layer_to_message(mesh, name)
        back = messages.layer_from_message(one, layers.remove_layer(mesh, name))
        assert content(back)[4] == content(mesh)[4] and layers.layer_meta(back, name) == ("", "", True)
    with pytest.raises(KeyError):
        messages.layer_to_message(mesh, "gone")
    with pytest.raises(ValueError):
        messages.layer_from_message(one.withColumn("type", F.lit(9).cast("smallint")), mesh)


def test_tables_and_json(spark, tmp_path):
    mesh = sample(spark)
    tables.save(mesh, f"{tmp_path}/m")
    assert content(tables.load(spark, f"{tmp_path}/m")) == content(mesh)
    plan = layers.values_of(tables.load(spark, f"{tmp_path}/m"), "cost")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    row = json_maps.to_json(mesh)
    assert set(json.loads(row.first().json)) == {"x", "y", "z", "tris", "occupancy"}
    back = json_maps.from_json(row)
    assert content(back)[1] == content(mesh)[1] and layers.list_layers(back) == ["occupancy"]


def test_binary_files(spark, tmp_path):
    mesh, path = sample(spark), str(tmp_path / "m.bin")
    colored = mesh.vertices.withColumns({k: F.col("vid").cast("smallint") for k in "rgba"})
    mesh = __import__("dataclasses").replace(mesh, vertices=colored)
    binary.save(mesh, path, "odom")
    assert content(binary.load(spark, path)) == content(mesh)
    raw = open(path, "rb").read()
    assert binary.unpacked(raw) == raw[20:] == binary.unpacked(raw[20:])  # without a header all is payload
    assert binary.encode(messages.to_message(mesh, "odom").first()) == raw[20:]
    row = messages.to_message(mesh, "odom", datetime.datetime(2024, 5, 6, 7, 8, 9, 250_000)).first()
    assert binary.decode(binary.encode(row))["stamp"] == row.stamp
    with pytest.raises(FileNotFoundError):
        binary.load(spark, path + ".gone")
    for bad in (raw[:30], raw[:8] + b"\x02" + raw[9:]):
        with pytest.raises(OSError):
            binary.decode(binary.unpacked(bad))
    assert binary.load_all(spark, f"{tmp_path}/*.bin").select("message.navcels_v0").first()[0] == [0, 0]


def test_elevation_and_missing_corners(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 3.0), (2, 0.0, 1.0, 6.0)], "pid long, x double, y double, z double")
    mesh = grid.from_mesh(pts, spark.createDataFrame([(0, 0, 1, 2)], "cid long, v0 long, v1 long, v2 long"), "map")
    assert layers.values_of(mesh, "elevation").first().value == 3
    assert grid.from_mesh(pts, spark.createDataFrame([(0, 0, 1, 7)], "cid long, v0 long, v1 long, v2 long"), "map") is None


def test_layered_voxels(spark):
    rng = random.Random(5)
    pts = [(rng.uniform(0, 3), rng.uniform(0, 3), rng.choice([0, 0.1, 1.0, 1.2, 5.0]) + rng.random() / 10) for _ in range(300)] + [(float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0)]
    want = {}
    cells = {}
    for x, y, z in pts[:300]:
        cells.setdefault((int(x // 1), int(y // 1)), []).append((z, x, y))
    for key, own in cells.items():
        own.sort()
        groups = [[own[0]]]
        for a, b in zip(own, own[1:]):
            if b[0] - a[0] > 0.3:
                groups.append([])
            groups[-1].append(b)
        for k, g in enumerate(groups):
            want[(*key, k)] = (sum(p[1] for p in g) / len(g), sum(p[2] for p in g) / len(g), g[-1][0])
    got = {(r.vx, r.vy, r.k): (r.x, r.y, r.z) for r in cloud.voxel_top(spark.createDataFrame(pts, "x double, y double, z double"), 1.0, 0.3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("radius", [1.6, 0.0])
def test_meshed_cloud_holds_what_it_must(spark, radius):
    rng = random.Random(6)
    at = lambda i, j, z: (i + rng.uniform(-0.1, 0.1), j + rng.uniform(-0.1, 0.1), z + rng.random() / 20)
    pts = [at(i, j, 0) for i in range(8) for j in range(8)] + [at(i, j, 0) for i in range(20, 24) for j in range(4)]
    params = BuildParams(resolution=0.25, neighbor_radius=radius, k_neighbors=8, max_edge_len=1.8)
    mesh = cloud.from_points(spark.createDataFrame(pts, "x double, y double, z double"), params)
    tri = cloud.triangle_filters(mesh.geometry(), params)
    assert tri.count() > 40 and tri.where("not accepted").count() == 0
    keys = mesh.navcels.select(geom.triangle_key(F.col("v0"), F.col("v1"), F.col("v2")).alias("k"))
    assert keys.distinct().count() == keys.count()
    sizes = [r.n for r in mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n")).orderBy("surface_idx").collect()]
    assert len(sizes) >= 2 and sizes == sorted(sizes, reverse=True)
    assert layers.list_layers(mesh) == ["elevation"]


def test_too_few_points(spark):
    assert cloud.from_points(spark.createDataFrame([(0.0, 0.0, 0.0)] * 2, "x double, y double, z double")).navcels.count() == 0
    assert cloud.from_points(spark.createDataFrame([(0.0, 0.0, float(k)) for k in range(9)], "x double, y double, z double")).navcels.count() == 0


def test_decoded_cloud(spark):
    import struct

    data = b"".join(struct.pack("<fffI", k, 2 * k, 3 * k, 9) for k in range(3))
    df = spark.createDataFrame([(bytearray(data + b"x"), 16, 0, 4, 8)], "data binary, point_step int, x_at int, y_at int, z_at int")
    assert sorted(tuple(r) for r in cloud.decode_xyz(df).collect()) == [(0, 0, 0), (1, 2, 3), (2, 4, 6)]


def stamp(k):
    return datetime.datetime(2024, 1, 1, 0, 0, k)


def test_streamed_grids_and_updates(spark, tmp_path):
    store, src = maps.MapStore(f"{tmp_path}/store"), f"{tmp_path}/grids"
    assert store.load(spark) is None
    rows = [(stamp(k), "x", 2, 1, 0.5, 0.0, 0.0, 0.0, [k, 100]) for k in (3, 1)]
    spark.createDataFrame(rows, maps.GRID).write.parquet(src)
    maps.grids_to_map(spark.readStream.schema(maps.GRID).parquet(src), store, f"{tmp_path}/c1").awaitTermination()
    mesh = store.load(spark)
    assert mesh.navcels.count() == 4
    assert {r.cid: r.value for r in layers.values_of(mesh, "occupancy").collect()} == {0: 8, 1: 8, 2: 254, 3: 254}  # of the newest
    up = [(stamp(1), "x", "cost", 1, None, [1.0] * 4, None), (stamp(2), "x", "cost", 1, None, [2.0] * 4, None), (stamp(3), "x", "bad", 1, None, [1.0], None), (stamp(3), "x", "two", 0, [1] * 4, [1.0] * 4, None), (stamp(4), "x", "occupancy", 0, [9] * 4, [], [])]
    spark.createDataFrame(up, maps.UPDATE).write.parquet(f"{tmp_path}/ups")
    maps.layer_updates(spark.readStream.schema(maps.UPDATE).parquet(f"{tmp_path}/ups"), store, f"{tmp_path}/c2", f"{tmp_path}/rejects").awaitTermination()
    mesh = store.load(spark)
    assert layers.list_layers(mesh) == ["cost", "occupancy"]
    assert {r.value for r in layers.values_of(mesh, "cost").collect()} == {2.0} and {r.value for r in layers.values_of(mesh, "occupancy").collect()} == {9}
    assert {(r.name, r.why) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()} == {("bad", "its length is not the number of triangles"), ("two", "not exactly one array has values")}
    assert {(r.name, r.n_messages) for r in maps.counters(spark.read.parquet(f"{tmp_path}/ups")).collect()} == {("cost", 2), ("bad", 1), ("two", 1), ("occupancy", 1)}
    store.reset(spark)
    assert store.load(spark).navcels.count() == 0


def test_updates_before_a_map_are_rejected(spark, tmp_path):
    spark.createDataFrame([(stamp(1), "x", "a", 1, None, [1.0], None)], maps.UPDATE).write.parquet(f"{tmp_path}/ups")
    store = maps.MapStore(f"{tmp_path}/store")
    maps.layer_updates(spark.readStream.schema(maps.UPDATE).parquet(f"{tmp_path}/ups"), store, f"{tmp_path}/c", f"{tmp_path}/rejects").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rejects").first().why == "no map yet" and store.load(spark) is None


def test_streamed_clouds(spark, tmp_path):
    xs, ys = zip(*((float(i), float(j)) for i in range(4) for j in range(4)))
    spark.createDataFrame([(stamp(1), "x", list(xs), list(ys), [0.0] * 16)], maps.CLOUD).write.parquet(f"{tmp_path}/clouds")
    store = maps.MapStore(f"{tmp_path}/store")
    maps.clouds_to_map(spark.readStream.schema(maps.CLOUD).parquet(f"{tmp_path}/clouds"), store, f"{tmp_path}/c").awaitTermination()
    assert store.load(spark).navcels.count() > 8


def test_republishing(spark, tmp_path):
    store, seen = maps.MapStore(f"{tmp_path}/store"), []
    store.publish(sample(spark), 1)
    query = maps.republish(spark, store, lambda m: seen.append(m.navcels.count()), f"{tmp_path}/c", "200 milliseconds")
    try:
        for _ in range(100):
            if seen:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert seen and seen[0] == 2


def test_an_update_writes_its_layer_alone(spark, tmp_path):
    store = maps.MapStore(f"{tmp_path}/store")
    mesh = layers.add_layer(sample(spark), "a", LayerType.F32, default=1.0)
    mesh = layers.add_layer(mesh, "b", LayerType.F32, default=2.0)
    store.publish(mesh, "one")
    current = store.load(spark)
    store.publish(layers.layer_clear(current, "a", LayerType.F32, 5.0), "two", changed=["a"])
    assert sorted(os.listdir(tmp_path / "store" / "versions")) == ["one", "two"]
    assert sorted(x for x in os.listdir(tmp_path / "store" / "versions" / "two")) == ["layer_values", "layers"]
    assert [x for x in os.listdir(tmp_path / "store" / "versions" / "two" / "layer_values") if x.startswith("layer=")] == ["layer=a"]
    again = store.load(spark)
    assert {r.value for r in layers.values_of(again, "a").collect()} == {5.0} and {r.value for r in layers.values_of(again, "b").collect()} == {2.0}
    # A map that was loaded before the update is still whole; two versions later what it alone uses is gone.
    assert {r.value for r in layers.values_of(current, "a").collect()} == {1.0}
    store.publish(sample(spark), "three")
    store.publish(sample(spark), "four")
    assert sorted(os.listdir(tmp_path / "store" / "versions")) == ["four", "three"]
    assert store.version(spark) == "four"


def test_equal_stamps_have_one_newest(spark):
    rows = [(stamp(1), "x", f"n{k}", 1, None, [float(k)], None) for k in range(20)] + [(None, "x", "none", 1, None, [0.0], None)]
    df = spark.createDataFrame(rows, maps.UPDATE)
    assert len({maps.newest(df.repartition(n)).first().name for n in (1, 3, 7)}) == 1
    assert maps.newest(df.limit(0)).count() == 0


def test_colours_are_drawn_when_the_map_changes(spark, tmp_path):
    store, seen = maps.MapStore(f"{tmp_path}/store"), []
    store.publish(layers.add_layer(sample(spark), "a", LayerType.F32, default=1.0), "one")
    query = maps.on_change(spark, store, lambda df: seen.append(df.count()), f"{tmp_path}/c", "a", every="100 milliseconds")
    try:
        for wanted in (1, 2):
            for _ in range(200):
                if len(seen) >= wanted:
                    break
                query.awaitTermination(0.1)
            if wanted == 1:
                query.awaitTermination(1)  # nothing changes, nothing is drawn
                assert len(seen) == 1
                store.publish(layers.add_layer(sample(spark), "a", LayerType.F32, default=2.0), "two")
    finally:
        query.stop()
    assert seen == [2, 2]


def test_lost_messages_and_goals(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 7), ("b", None)], "name string, seq long")
    assert {tuple(r) for r in maps.lost(rows).collect()} == {("a", 3, 2), ("b", 1, 0)}
    picks = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.0), (2, None, None, None, 0.0), (3, 0.0, 0.0, 0.0, 1.0)], "pid long, px double, py double, pz double, theta double")
    picks.write.parquet(f"{tmp_path}/picks")
    maps.publish_goals(spark.readStream.schema(picks.schema).parquet(f"{tmp_path}/picks"), f"{tmp_path}/goals", f"{tmp_path}/c").awaitTermination()
    got = {r.pid: r for r in spark.read.parquet(f"{tmp_path}/goals").collect()}
    assert set(got) == {1, 3} and (got[1].x, got[1].y, got[1].z, got[1].qz, got[1].qw) == (1.0, 2.0, 3.0, 0.0, 1.0)


def test_a_selection_outlives_a_map_that_has_it(spark):
    mesh = layers.add_layer(layers.add_layer(sample(spark), "a", LayerType.F32), "b", LayerType.F32)
    assert style.selected(mesh, "b") == "b" and style.selected(mesh, "gone") == "a" and style.selected(mesh, None) == "a"
    assert style.selected(sample(spark), "b") != "b"


def test_files_at_hadoop_paths(spark, tmp_path):
    mesh = layers.add_layer(sample(spark), "a", LayerType.F32, default=1.0)
    binary.save(mesh, f"file://{tmp_path}/deep/er/m.map")
    assert os.listdir(tmp_path / "deep" / "er") and binary.load(spark, f"file://{tmp_path}/deep/er/m.map").navcels.count() == 2
    binary.save(mesh, f"{tmp_path}/deep/er/m2.map")
    found = binary.load_all(spark, f"file://{tmp_path}/deep/er/*.map")
    assert sorted(r.path.split("/")[-1] for r in found.collect()) == ["m.map", "m2.map"] and found.first().message.positions_x == [v for v in messages.to_message(mesh).first().positions_x]
    with pytest.raises(OSError):
        (tmp_path / "file").write_text("x")
        binary.save(mesh, f"{tmp_path}/file/below.map")
    with pytest.raises(FileNotFoundError):
        binary.load(spark, f"{tmp_path}/none.map")


def test_large_files_go_in_pieces_and_are_decoded_by_executors(spark, tmp_path, monkeypatch):
    mesh, path = sample(spark), str(tmp_path / "l[1].bin")
    message = messages.to_message(mesh, "odom", datetime.datetime(2024, 5, 6, 7, 8, 9, 250_000))
    monkeypatch.setattr(binary, "SMALL_FILE", 0)
    monkeypatch.setattr(binary, "PIECE", 7)
    binary.save_message(message, path)
    raw = open(path, "rb").read()
    assert raw == binary.packed(binary.encode(message.first()))
    found = binary.load_message(spark, path)
    assert found.schema == spark.createDataFrame([], messages.MAP).schema and found.first() == message.first()
    (tmp_path / "short.bin").write_bytes(raw[:-3])
    with pytest.raises(OSError, match="ends early"):
        binary.load_message(spark, f"{tmp_path}/short.bin")
    for wrong in ([300], [-1], [None], [0.5], ["1"]):
        with pytest.raises(struct.error):
            binary._Writer().array("B", wrong)
