"""The mesh, its layers and its spatial queries on small maps with known answers."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from surfmesh.operators import area, layers, spatial, style, topology
from surfmesh.operators.mesh import MeshMap
from surfmesh.types import AreaShape, LayerType, LocateOpts


def build(spark, vertices, triangles, surfaces=None):
    """A mesh from lists; surfaces: (frame, triangles); one that lists all by default."""
    mesh, _ = MeshMap.empty(spark).add_vertices(vertices)
    mesh, _ = mesh.add_navcels(triangles)
    for frame, cids in surfaces or [("map", range(len(triangles)))]:
        mesh, _ = mesh.add_surface(frame, cids)
    return mesh


def square(z=0.0):
    return [(0, 0, z), (1, 0, z), (0, 1, z), (1, 1, z)]


TWO = [(0, 1, 2), (2, 1, 3)]


@pytest.fixture(scope="module")
def flat(spark):
    return build(spark, square(), TWO)


@pytest.fixture(scope="module")
def storeys(spark):
    return build(spark, square(0) + square(3), TWO + [(4, 5, 6), (6, 5, 7)], [("floor_0", [0, 1]), ("floor_1", [2, 3])])


@pytest.fixture(scope="module")
def slope(spark):
    return build(spark, [(0, 0, 0), (1, 0, 0.2), (0, 1, 0.4), (1, 1, 0.6)], TWO, [("terrain", [0, 1])])


def ngrid(spark, n):
    v = [(i / n, j / n, 0.0) for j in range(n + 1) for i in range(n + 1)]
    t = []
    for j in range(n):
        for i in range(n):
            a = j * (n + 1) + i
            t += [(a, a + 1, a + n + 2), (a, a + n + 2, a + n + 1)]
    return build(spark, v, t)


def points(spark, *ps, hint=None):
    rows = [(k, *map(float, p)) for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    return df if hint is None else df.withColumn("hint_cid", F.lit(hint).cast("long"))


def rays(spark, *rs):
    return spark.createDataFrame([(k, *map(float, o), *map(float, d)) for k, (o, d) in enumerate(rs)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")


def cast(mesh, *rs, **options):
    return spatial.raycast(mesh, rays(mesh.spark, *rs), **options).orderBy("ray_id").collect()


def where(mesh, *ps, hint=None, **options):
    return spatial.locate(mesh, points(mesh.spark, *ps, hint=hint), LocateOpts(**options)).orderBy("pid").collect()


def test_raycast(flat):
    r = cast(flat, ((0.5, 0.5, 1), (0, 0, -1)), ((0.5, 0.5, 1), (0, 0, 1)), ((0.5, 0.5, -1), (0, 0, -1)), ((2, 2, 1), (0, 0, -1)), ((-1, 0.3, 1), (1, 0, -0.9)), ((0.3, 5, 0.5), (0, -1, -0.1)))
    assert r[0].hit and r[0].cid == 0 and r[0].pz == 0 and r[0].t == 1
    assert not r[1].hit and r[1].cid is None and not r[2].hit and not r[3].hit
    assert r[4].hit and r[4].pz == pytest.approx(0) and r[4].px == pytest.approx(1 / 0.9 - 1)
    assert r[5].hit and r[5].py == pytest.approx(0)


def test_lowest_surface_or_nearest(spark):
    mesh = build(spark, square(0) + square(3), TWO + [(4, 5, 6), (6, 5, 7)], [("low", [0, 1]), ("high", [2, 3])])
    down = ((0.3, 0.3, 5), (0, 0, -1))
    assert (cast(mesh, down)[0].surface, cast(mesh, down, first_hit_only=True)[0].surface) == (1, 0)


def test_oblique_rays_like_brute_force(spark):
    rng = random.Random(2)
    v = [(i, j, rng.random()) for j in range(9) for i in range(9)]
    t = []
    for j in range(8):
        for i in range(8):
            a = j * 9 + i
            t += [(a, a + 1, a + 10), (a, a + 10, a + 9)]
    mesh = build(spark, v, t)
    rs = [((rng.uniform(-3, 11), rng.uniform(-3, 11), rng.uniform(-1, 3)), (rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 0.5))) for _ in range(150)]
    rs += [((4.3, -2, 0.4), (0, 1, 0)), ((-2, 4.3, 0.4), (1, 0, 0)), ((20, 20, 5), (-1, -1, -0.25))]
    df = rays(spark, *rs)
    h = __import__("surfmesh.functions.geom", fromlist=["x"])
    every = df.crossJoin(mesh.geometry()).withColumn("h", h.ray_triangle(h.point("o"), h.point("d"), *spatial.corners())).where("h is not null")
    want = {r.ray_id: r.t for r in every.groupBy("ray_id").agg(F.min("h.t").alias("t")).collect()}
    got = {r.ray_id: r.t for r in spatial.raycast(mesh, df).where("hit").collect()}
    assert got == pytest.approx(want) and len(want) > 15


def test_locate(flat, storeys, slope):
    r = where(flat, (0.25, 0.25, 0.4), (5, 5, 0.4), (0.75, 0.75, 0.3), height_eps=0.7)
    assert r[0].surface == 0 and r[0].hz == 0 and min(r[0].b0, r[0].b1, r[0].b2) >= -1e-4
    assert not r[1].found and r[1].cid is None and r[2].cid == 1
    r = where(storeys, (0.5, 0.5, 2.7), (0.3, 0.3, 2.9), (0.3, 0.3, 5), (0.3, 0.3, 0.1))
    assert [(x.surface, x.hz) for x in r] == [(1, 3), (1, 3), (0, 0), (0, 0)]  # above all floors the lowest surface is taken
    assert 0.15 < where(slope, (0.5, 0.5, 2))[0].hz < 0.65


def test_locate_falls_back_at_its_own_height(flat, storeys):
    assert where(flat, (0.3, 0.3, 0.0))[0].hz == 0
    assert where(storeys, (0.3, 0.3, 3.0))[0].hz == 0  # a floor at the point's own height is passed by


def test_locate_with_hint(flat, storeys):
    r = where(flat, (0.75, 0.75, 0.3), hint=1)
    assert (r[0].cid, r[0].hz) == (1, 0)
    assert where(flat, (0.75, 0.75, 0.3), hint=0)[0].cid == 1  # a hint that doesn't hold
    assert where(storeys, (0.3, 0.3, 2.9), hint=0)[0].surface == 1  # too far off
    assert where(storeys, (0.3, 0.3, 0.4), hint=99)[0].surface == 0


def test_walking(spark):
    mesh = ngrid(spark, 4)
    ps = points(spark, (0.9, 0.1, 0), (0.1, 0.9, 0), (0.4, 0.45, 0.2), (3, 3, 0)).withColumn("hint_cid", F.lit(0).cast("long"))
    walked = {r.pid: r.cid for r in spatial.locate_by_walking(mesh, ps).collect()}
    found = {r.pid: r.cid for r in spatial.locate(mesh, ps.drop("hint_cid").withColumn("z", F.col("z") + 0.1)).collect()}
    assert walked == found and walked[3] is None


def test_closest_like_brute_force(spark, slope, storeys):
    rng = random.Random(3)
    v = [(i + rng.random() / 3, j + rng.random() / 3, rng.random()) for j in range(7) for i in range(7)]
    t = []
    for j in range(6):
        for i in range(6):
            a = j * 7 + i
            t += [(a, a + 1, a + 8), (a, a + 8, a + 7)]
    mesh = build(spark, v, t)
    ps = [(rng.uniform(-9, 15), rng.uniform(-9, 15), rng.uniform(-3, 4)) for _ in range(80)]
    geom = __import__("surfmesh.functions.geom", fromlist=["x"])
    df = points(spark, *ps)
    at = tuple(F.col(k) for k in "xyz")
    every = df.crossJoin(mesh.geometry()).withColumn("d", geom.squared_distance(at, geom.closest_point_on_triangle(at, *spatial.corners())))
    want = {r.pid: r.d for r in every.groupBy("pid").agg(F.min("d").alias("d")).collect()}
    got = spatial.closest(mesh, df).collect()
    assert {r.pid: r.sqdist for r in got} == pytest.approx(want)
    assert all(math.dist((r.px, r.py, r.pz), (r.qx, r.qy, r.qz)) ** 2 == pytest.approx(r.sqdist, abs=1e-9) for r in got)
    a, b = spatial.closest(slope, points(spark, (0.25, 0.25, 10), (0.25, 0.25, 1))).orderBy("pid").collect()
    assert a.sqdist > 1 and a.sqdist > b.sqdist
    near = spatial.closest(storeys, points(spark, (0.3, 0.3, 1.7))).first()
    assert (near.surface, near.sqdist) == (1, pytest.approx(1.69))
    assert spatial.closest(storeys, points(spark, (0.3, 0.3, 1.7)), restrict_surface=0).first().surface == 0
    assert not spatial.closest(storeys, points(spark, (0, 0, 0)), restrict_surface=9).first().found


def test_pick_falls_back_on_the_ground(flat):
    got = spatial.pick(flat, rays(flat.spark, ((0.3, 0.3, 2), (0, 0, -1)), ((5, 5, 2), (0.5, 0, -1)), ((5, 5, 2), (0, 0, 1)))).orderBy("ray_id").collect()
    assert [(r.px, r.pz) for r in got] == [(0.3, 0.0), (6.0, 0.0), (None, None)]


def test_knn_and_radius(spark):
    rng = random.Random(4)
    ps = [(rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 1)) for _ in range(60)] + [(500.0, 500.0, 0.0)]
    df = points(spark, *ps)
    dist = lambda a, b: math.dist(ps[a], ps[b])
    got = {(r.pid, r["rank"]): r.nid for r in spatial.knn(df, 4).collect()}
    for a in range(len(ps)):
        want = sorted((b for b in range(len(ps)) if b != a), key=lambda b: (dist(a, b), b))[:4]
        assert [got[a, k] for k in range(1, 5)] == want
    pairs = {(r.pid, r.nid) for r in spatial.radius_neighbors(df, 1.5).collect()}
    assert pairs == {(a, b) for a in range(len(ps)) for b in range(len(ps)) if a != b and dist(a, b) <= 1.5}
    assert spatial.knn(points(spark, (0, 0, 0)), 3).count() == 0


def test_adjacency(spark, flat):
    got = {(r.cid, r.e): r.neighbor for r in flat.adjacency().collect()}
    assert got == {(0, 0): None, (0, 1): 1, (0, 2): None, (1, 0): 0, (1, 1): None, (1, 2): None}
    # Three owners of one edge: the first points at the last, the others at the first.
    fan = build(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1)], [(0, 1, 2), (1, 0, 3), (0, 1, 4)])
    got = {(r.cid, r.e): r.neighbor for r in fan.adjacency().collect()}
    assert (got[0, 0], got[1, 0], got[2, 0]) == (2, 0, 0)


def test_surfaces(spark, storeys):
    grown, k = storeys.create_surface("roof")
    assert k == 2 and grown.stats().first().n_surfaces == 3
    less, ok = grown.remove_surface(0)
    assert ok and [(r.surface_idx, r.frame_id) for r in less.surfaces.orderBy("surface_idx").collect()] == [(0, "floor_1"), (1, "roof")]
    assert less.navcels.count() == 4 and cast(less, ((0.3, 0.3, 5), (0, 0, -1)))[0].surface == 0
    assert less.remove_surface(7) == (less, False)
    assert grown.add_to_surface(9, [0]) is grown
    box = {r.surface_idx: (r.minz, r.maxx) for r in grown.surface_aabb().collect()}
    assert box == {0: (0, 1), 1: (3, 1), 2: (None, None)}


def test_layers(flat):
    m = layers.add_layer(flat, "cost", LayerType.F32, default=1.5, description="d", unit="u")
    assert [r.value for r in layers.values_of(m, "cost").collect()] == [1.5, 1.5]
    assert layers.layer_meta(m, "cost") == ("d", "u", True) and layers.list_layers(m) == ["cost"]
    assert (layers.layer_type_name(m, "cost"), layers.layer_type_name(m, "no"), layers.layer_size(m, "no")) == ("float", "unknown", 0)
    with pytest.raises(TypeError):
        layers.add_layer(m, "cost", LayerType.U8)
    up = flat.spark.createDataFrame([(0, 300.7), (9, 1.0)], "cid long, value double")
    m = layers.layer_set(m, "occ", LayerType.U8, up)
    assert {r.cid: r.value for r in layers.values_of(m, "occ").collect()} == {0: 255, 1: 0}
    m = layers.layer_set(m, "f", LayerType.F32, up.withColumn("value", F.lit(3.14)))
    got = layers.layer_get(m, "f", LayerType.F64, flat.spark.createDataFrame([(0,), (5,)], "cid long"), default=-1).orderBy("cid").collect()
    assert got[0].value == pytest.approx(3.14, abs=1e-6) and got[1].value == -1
    m, ok = layers.layer_copy(m, "occ", "copy", LayerType.U8)
    assert ok and layers.layer_size(m, "copy") == 2
    assert not layers.layer_copy(m, "occ", "cost", LayerType.U8)[1] and not layers.layer_copy(m, "gone", "x", LayerType.U8)[1] and layers.layer_copy(m, "a", "a", LayerType.U8)[1]
    m = layers.remove_layer(m, "copy")
    assert not layers.has_layer(m, "copy")
    nan = layers.put_layer(m, "nan", LayerType.F64, flat.navcels.select("cid", F.when(F.col("cid") == 0, float("nan")).otherwise(-7.5).alias("value")))
    made = layers.add_layer_from(nan, "u", LayerType.U8, "nan")
    assert {r.value for r in layers.values_of(made, "u").collect()} == {0}
    assert {r.value for r in layers.values_of(layers.layer_clear(made, "u", LayerType.U8, 9), "u").collect()} == {9}
    grown, _ = made.add_navcels([(0, 1, 3)])
    assert layers.layer_size(layers.resize_all(grown), "u") == 3
    assert layers.wide(m).columns == ["cid", "cost", "f", "occ"]


def test_hash_follows_the_bytes(flat):
    m = layers.put_layer(flat, "u", LayerType.U8, flat.navcels.select("cid", F.lit(7).alias("value")))
    h = 0xCBF29CE484222325
    for b in (2).to_bytes(8, "little") + b"\x07\x07":
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert layers.content_hash_fnv1a(m, "u") == h


def test_assignment(spark, flat):
    src = layers.add_layer(layers.add_layer(flat, "occ", LayerType.U8, default=254), "cost", LayerType.F32, default=10)
    dst = layers.add_layer(layers.add_layer(layers.add_layer(flat, "occ", LayerType.U8), "cost", LayerType.F32, default=5), "extra", LayerType.F64)
    got = layers.assigned(src, dst)
    assert layers.list_layers(got) == ["cost", "occ"] and {r.value for r in layers.values_of(got, "occ").collect()} == {254}
    other = build(spark, square(1), TWO)
    assert not other.has_same_geometry(src) and layers.assigned(src, other) is src


def test_sample(spark, flat):
    m = layers.put_layer(flat, "cost", LayerType.F32, flat.navcels.select("cid", (F.col("cid") * 4 + 1).alias("value")))
    ps = points(spark, (0.2, 0.2, 1), (0.8, 0.9, 1), (9, 9, 1))
    value = lambda name, default: [r.value for r in spatial.sample_layer(m, name, ps, default).orderBy("pid").collect()]
    assert value("cost", -1) == [1, 5, -1] and value("gone", -42) == [-42] * 3
    assert math.isnan(value("cost", math.nan)[2])


@pytest.mark.parametrize("n,shape,p,size", [(20, AreaShape.CIRCULAR, (0.5, 0.5, 1), 0.22), (24, AreaShape.RECTANGULAR, (0.35, 0.7, -2), 0.18), (30, AreaShape.CIRCULAR, (0.05, 0.10, 0), 0.12)])
def test_set_area_is_the_centroid_test(spark, n, shape, p, size):
    mesh, ok = area.set_area(ngrid(spark, n), p, 200, "occ", LayerType.U8, shape, size)
    assert ok
    half = size if shape == AreaShape.CIRCULAR else size / 2
    inside = lambda r: math.hypot(r.x - p[0], r.y - p[1]) <= half if shape == AreaShape.CIRCULAR else max(abs(r.x - p[0]), abs(r.y - p[1])) <= half
    want = {r.cid: 200 if inside(r) else 0 for r in mesh.centroids().collect()}
    assert {r.cid: r.value for r in layers.values_of(mesh, "occ").collect()} == want


def test_set_area_refuses(flat, storeys):
    m = layers.add_layer(flat, "cost", LayerType.F32)
    assert area.set_area(m, (0.3, 0.3, 1), 9, "cost", LayerType.U8, AreaShape.CIRCULAR, 1) == (m, False)
    assert area.set_area(m, (5, 5, 0), 9, "cost", LayerType.F32, AreaShape.CIRCULAR, 1) == (m, False)
    assert area.set_area(m, (0.3, 0.3, 1), 9, "cost", LayerType.F32, AreaShape.CIRCULAR, 0) == (m, False)
    painted, _ = area.set_area(storeys, (0.3, 0.3, 2.9), 7, "occ", LayerType.U8, AreaShape.RECTANGULAR, 4)
    assert {r.cid: r.value for r in layers.values_of(painted, "occ").collect()} == {0: 0, 1: 0, 2: 7, 3: 7}  # not through the ceiling


def test_components(spark, storeys):
    one = build(spark, square(0) + square(3) + [(9, 9, 9), (9, 8, 9), (8, 8, 9)], TWO + [(4, 5, 6), (6, 5, 7), (8, 9, 10)])
    mesh = topology.surfaces_by_connectivity(one)
    sizes = {r.surface_idx: r.n for r in mesh.surface_navcels.groupBy("surface_idx").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 1: 2, 2: 1}
    top = topology.keep_top_surfaces(mesh, 1)
    assert {r.cid for r in top.surface_navcels.collect()} == {0, 1} and top.navcels.count() == 5
    assert topology.keep_top_surfaces(mesh, 0) is mesh


def test_styles(flat):
    m = layers.put_layer(flat, "v", LayerType.F64, flat.navcels.select("cid", F.when(F.col("cid") == 0, float("nan")).otherwise(4.0).alias("value")))
    heat = {r.cid: (r.r, r.g, r.b) for r in style.layer_colors(m, "v").collect()}
    assert heat == {0: (1, 0, 0), 1: (1, 0, 0)}
    assert {(r.r, r.g, r.b) for r in style.layer_colors(m, "gone").collect()} == {(0.7, 0.7, 0.7)}
    assert style.schemes(m, "v") == ["heat", "rainbow"] and style.options(m) == ["v"] and style.info_line(m) == "Surfaces: 1 | Triangles: 2"
    seg = style.normal_segments(flat, 2).where("cid = 0").first()
    assert (seg.z0, seg.z1) == (0, 2)


def test_empty_map(spark):
    mesh = MeshMap.empty(spark)
    assert not cast(mesh, ((0, 0, 1), (0, 0, -1)))[0].hit and not where(mesh, (0, 0, 0))[0].found
    assert not spatial.closest(mesh, points(spark, (0, 0, 0))).first().found
    assert topology.components(mesh).count() == 0 and mesh.adjacency().count() == 0


def test_an_indexed_map_answers_like_its_own(spark):
    from surfmesh.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    mesh, points = fx.floors(spark, d), fx.floor_points(spark, d).limit(200)
    held = spatial.indexed(mesh)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert spatial.bucket_size(held) == spatial.bucket_size(mesh)
    for ask in (spatial.locate, spatial.closest):
        assert rows(ask(held, points).select("pid", "cid")) == rows(ask(mesh, points).select("pid", "cid"))
    # An edited one doesn't answer from what was kept.
    moved = held.transformed(((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0, 0, 1))
    assert moved.geometry().agg(F.max("az")).first()[0] == mesh.geometry().agg(F.max("az")).first()[0] + 1
    fewer, _ = held.remove_surface(0)
    assert fewer.visible().count() == mesh.remove_surface(0)[0].visible().count()


def test_knn_of_uneven_points_makes_few_pairs(spark):
    """A dense spot, one far from it, many points in one place and one that isn't finite."""
    rng = random.Random(5)
    at = [(rng.random(), rng.random(), rng.random() / 4) for _ in range(300)] + [(1e5 + rng.random() * 9, 3e5, 0.0) for _ in range(60)] + [(5.0, 5.0, 0.5)] * 40
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(900, math.nan, 0.0, 0.0)], "pid long, x double, y double, z double")
    want = {(i, rank + 1, j) for i, p in enumerate(at) for rank, (_, j) in enumerate(sorted((math.sqrt((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2), j) for j, q in enumerate(at) if j != i)[:4])}
    assert {(r.pid, r["rank"], r.nid) for r in spatial.knn(df, 4).collect()} == want
    p = df.where("pid < 900").withColumn("_other", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("pid")) <= 5)
    size = spatial._first_radius(p, len(at), 4, [0.0, 1e5 + 9, 0.0, 3e5, 0.0, 0.5])
    pairs = p.alias("a").join(p.where("_other").alias("b"), F.expr(" and ".join(f"floor(a.{c} / {size!r}) = floor(b.{c} / {size!r})" for c in "xyz")))
    assert size < 1 and pairs.count() <= 4 * 5 * len(at)
