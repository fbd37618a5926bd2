"""The mesher against a plain emulation that goes through all points in one sequence."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surfmesh.operators import cloud
from surfmesh.types import BuildParams


def emulated(points, params):
    """Triangles (as numbers of the sorted points) grown over the whole cloud: brute-force neighbours, one seed after another."""
    pts = np.array(sorted(points))
    gap = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    flat = np.hypot(*(pts[:, None, :2] - pts[None, :, :2]).transpose(2, 0, 1))
    window = max(params.max_dz, 0.35)
    r = params.neighbor_radius

    def neighbours(i):
        order = sorted(range(len(pts)), key=lambda j: (gap[i, j], j != i, j))
        return [j for j in order if gap[i, j] <= r and j != i] if r > 0 else [j for j in order[: max(8, params.k_neighbors)] if j != i]

    made, uses = {}, Counter()

    def grow(i, j, k):
        """Whether the triangle is new and good; then it is made."""
        if frozenset((i, j, k)) in made or len({i, j, k}) < 3:
            return False
        a, b, c = pts[[i, j, k]]
        if params.max_edge_len > 0 and max(gap[i, j], gap[j, k], gap[k, i]) > params.max_edge_len:
            return False
        if params.max_dz > 0 and np.ptp(pts[[i, j, k], 2]) > params.max_dz:
            return False
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        if size / 2 < max(params.min_area, 1e-9) or normal[2] / size < math.cos(math.radians(params.max_slope_deg)):
            return False
        for p, q, s in ((a, b, c), (b, c, a), (c, a, b)):
            u, v = q - p, s - p
            if math.degrees(math.acos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))) < params.min_angle_deg:
                return False
        made[frozenset((i, j, k))] = (i, j, k) if normal[2] >= 0 else (i, k, j)
        uses.update(frozenset(e) for e in ((i, j), (j, k), (k, i)))
        return True

    reached = set()
    for seed in sorted(range(len(pts)), key=lambda i: (pts[i, 2], i)):
        if seed in reached:
            continue
        around = [j for j in neighbours(seed) if (params.max_edge_len <= 0 or gap[seed, j] <= params.max_edge_len) and abs(pts[j, 2] - pts[seed, 2]) <= window]
        around.sort(key=lambda j: (math.atan2(pts[j, 1] - pts[seed, 1], pts[j, 0] - pts[seed, 0]), j))
        wedges = list(zip(around, around[1:]))
        if len(around) >= 3:
            wedges.append((around[-1], around[0]))
        line = []
        for j, k in wedges:
            if (r <= 0 or max(flat[seed, j], flat[seed, k]) <= r) and grow(seed, j, k):
                reached |= {seed, j, k}
                line += [e for e in ((seed, j), (j, k), (k, seed)) if uses[frozenset(e)] == 1 and tuple(sorted(e)) not in line and e not in line]
                line = [tuple(sorted(e)) for e in line]
        while line:
            i, j = line.pop(0)
            if uses[frozenset((i, j))] != 1:
                continue
            for c in neighbours(i):
                if c == j or abs(pts[c, 2] - (pts[i, 2] + pts[j, 2]) / 2) > window:
                    continue
                if r > 0 and max(flat[i, j], flat[j, c], flat[i, c]) > r:
                    continue
                if grow(i, j, c):
                    reached |= {i, j, c}
                    for e in ((i, c), (c, j)):
                        e = tuple(sorted(e))
                        if uses[frozenset(e)] == 1 and e not in line:
                            line.append(e)
    return {tuple(map(tuple, turned(pts[list(t)].tolist()))) for t in made.values()}


def turned(corners):
    """The same triangle, starting at its least corner."""
    k = corners.index(min(corners))
    return corners[k:] + corners[:k]


def meshed(spark, points, params):
    mesh = cloud.from_points(spark.createDataFrame(points, "x double, y double, z double"), params)
    rows = mesh.geometry().collect()
    return {tuple(map(tuple, turned([[r[p + c] for c in "xyz"] for p in "abc"]))) for r in rows}


def jittered(seed, n, step=1.0, rise=0.2, holes=0.0):
    rng = random.Random(seed)
    return [(i * step + rng.uniform(-0.2, 0.2), j * step + rng.uniform(-0.2, 0.2), rng.uniform(0, rise) + 0.1 * i) for i in range(n) for j in range(n) if rng.random() >= holes]


@pytest.mark.parametrize(
    ("points", "params"),
    [
        (jittered(1, 9), BuildParams(resolution=0.0, neighbor_radius=1.6)),
        (jittered(2, 9, rise=0.6), BuildParams(resolution=0.0, neighbor_radius=1.8, max_dz=0.3, min_angle_deg=10.0)),
        (jittered(3, 8, rise=0.5), BuildParams(resolution=0.0, neighbor_radius=0.0, k_neighbors=6, max_dz=0.25)),
        (jittered(4, 8, holes=0.3), BuildParams(resolution=0.0, neighbor_radius=2.0, max_edge_len=0.0, max_dz=0.0, max_slope_deg=60.0)),
        (jittered(5, 7, rise=2.0), BuildParams(resolution=0.0, neighbor_radius=1.7, max_dz=0.0, max_slope_deg=80.0)),
        (jittered(6, 7) + [(x + 30, y, z + 3) for x, y, z in jittered(7, 7)], BuildParams(resolution=0.0, neighbor_radius=1.6)),
    ],
)
def test_meshes_are_those_of_the_emulation(spark, points, params):
    want = emulated(points, params)
    assert len(want) > 20 and meshed(spark, points, params) == want


def test_steps_above_max_dz_are_rejected(spark):
    """A step of 0.3 is within the seeds' window of 0.35, and still too high for a triangle at the default max_dz of 0.25."""
    points = [(float(i), float(j), 0.3 * (i > 1)) for i in range(4) for j in range(4)]
    params = BuildParams(resolution=0.0, neighbor_radius=1.6)
    heights = {len({c[2] for c in t}) for t in meshed(spark, points, params)}
    assert heights == {1}
    assert len({len({c[2] for c in t}) for t in meshed(spark, points, BuildParams(resolution=0.0, neighbor_radius=1.6, max_dz=0.31))}) == 2


def test_tests_that_are_switched_off(spark):
    tri = spark.createDataFrame([(0.0, 0.0, 0.0, 9.0, 0.0, 5.0, 0.0, 9.0, 0.0)], ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    for edge, dz, ok in ((0.0, 0.0, True), (20.0, 6.0, True), (20.0, 4.0, False), (5.0, 0.0, False), (-1.0, -1.0, True)):
        found = cloud.triangle_filters(tri, BuildParams(max_edge_len=edge, max_dz=dz, max_slope_deg=60.0)).first()
        assert (found.edges_ok and found.dz_ok) == ok


def test_message_to_mesh_in_one_call(spark):
    points = np.array(jittered(8, 8), dtype="<f4")
    rows = spark.createDataFrame([(points.tobytes(), 12, 0, 4, 8)], "data binary, point_step int, x_at int, y_at int, z_at int")
    params = BuildParams(resolution=0.0, neighbor_radius=1.6)
    mesh = cloud.from_pointcloud2(rows, params)
    assert mesh.navcels.count() == len(emulated([tuple(map(float, p)) for p in points], params))
    assert mesh.layers.where(F.col("name") == "elevation").count() == 1


def test_the_mesher_holds_flat_arrays():
    """Pairs are counted as a dict would, in at most 60 bytes each; a group's batches become neighbour lists by place."""
    rng = random.Random(9)
    pairs = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(40_000)] + [(7, 7)] * 300
    table, want = cloud._Table(), Counter(pairs)
    for p in pairs:
        table.add(*p)
    assert all(table.get(*p) == min(255, n) for p, n in want.items()) and table.get(3000, 1) == 0
    assert 17 * len(table.one) <= 60 * len(want)
    rows = [(50, 1.0, 2.0, 3.0, [10, 30]), (10, 4.0, 5.0, 6.0, [50]), (30, 7.0, 8.0, 9.0, []), (40, 0.0, 0.0, 0.0, [10, 50, 30])]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("pid", "x", "y", "z", "near"), r, strict=True)) for r in part]) for part in (rows[:2], rows[2:][::-1])]
    ids, x, y, z, starts, near = cloud._group(iter(batches))
    assert ids.tolist() == [10, 30, 40, 50] and x.tolist() == [4, 7, 0, 1] and z.tolist() == [6, 9, 0, 3]
    assert [near[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [[3], [], [0, 3, 1], [0, 1]]
