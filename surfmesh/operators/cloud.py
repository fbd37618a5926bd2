"""Meshes from point clouds."""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators.grid import from_mesh
from surfmesh.operators.mesh import MeshMap
from surfmesh.operators.spatial import knn, radius_neighbors
from surfmesh.operators.topology import keep_top_surfaces, surfaces_by_connectivity
from surfmesh.plans.lineage import connected_components, cut, numbered
from surfmesh.types import BuildParams

#: The height that seeds and open edges look up and down at least (triangles themselves keep to max_dz), and the height gap between layers where
#: max_dz is 0.
LEAST_DZ, LAYER_GAP = 0.35, 0.30


def voxel_top(points: DataFrame, resolution: float, gap: float) -> DataFrame:
    """(vx, vy, k, x, y, z): points binned in x and y; in each bin, layers of points without a height gap above `gap`, numbered upwards, with
    their mean x and y and their greatest z. Points that aren't finite are left out."""
    ok = " and ".join(f"not isnan({k}) and abs({k}) < double('Infinity')" for k in "xyz")
    bins = points.where(ok).select(*(F.floor((F.col(k).cast("double") / resolution).cast("float")).alias(f"v{k}") for k in "xy"), *(F.col(k).cast("double").alias(k) for k in "xyz"))
    column = Window.partitionBy("vx", "vy").orderBy("z")
    steps = bins.withColumn("new", F.when(F.col("z") - F.lag("z").over(column) > gap, 1).otherwise(0))
    layered = steps.withColumn("k", F.sum("new").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    return layered.groupBy("vx", "vy", "k").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("z").alias("z"))


def triangle_filters(triangles: DataFrame, params: BuildParams) -> DataFrame:
    """Triangles (ax..cz) with the tests of the mesher: edges_ok, dz_ok, area_ok, slope_ok, angle_ok, and accepted. max_edge_len and max_dz of 0 and
    less switch their tests off."""
    a, b, c = map(geom.point, "abc")
    most = F.greatest(geom.dist3(a, b), geom.dist3(b, c), geom.dist3(a, c))
    dz = F.greatest(*(F.abs(p[2] - q[2]) for p, q in ((a, b), (b, c), (a, c))))
    up = geom.triangle_normal(a, b, c)[2]
    tests = {
        "edges_ok": most <= params.max_edge_len if params.max_edge_len > 0 else F.lit(True),
        "dz_ok": dz <= params.max_dz if params.max_dz > 0 else F.lit(True),
        "area_ok": geom.triangle_area(a, b, c) >= max(params.min_area, 1e-9),
        "slope_ok": up >= math.cos(math.radians(params.max_slope_deg)),
        "angle_ok": F.least(*geom.triangle_angles_deg(a, b, c)) >= params.min_angle_deg,
    }
    out = triangles.withColumns(tests)
    return out.withColumn("accepted", F.expr(" and ".join(tests)))


class _Table:
    """Counts by pairs of whole numbers, from 0 up, in flat arrays: some 30 bytes a pair where a dict of tuples has 200."""

    def __init__(self, size: int = 1 << 10):
        self.n, self.mask = 0, size - 1
        self.one, self.other, self.count = array("q", [-1]) * size, array("q", [-1]) * size, bytearray(size)

    def at(self, a: int, b: int) -> int:
        """The place of a pair, or the free one for it."""
        i, one, other = hash((a, b)) & self.mask, self.one, self.other
        while (k := one[i]) != -1 and (k != a or other[i] != b):
            i = (i + 1) & self.mask
        return i

    def get(self, a: int, b: int) -> int:
        return self.count[self.at(a, b)]

    def add(self, a: int, b: int) -> None:
        """One more, up to 255."""
        i = self.at(a, b)
        if self.count[i]:
            self.count[i] = min(255, self.count[i] + 1)
            return
        self.one[i], self.other[i], self.count[i] = a, b, 1
        self.n += 1
        if self.n * 3 > self.mask * 2:
            old = self.one, self.other, self.count
            n = self.n
            self.__init__(2 * len(self.one))
            self.n = n
            for a, b, c in zip(*old, strict=True):
                if c:
                    i = self.at(a, b)
                    self.one[i], self.other[i], self.count[i] = a, b, c


class _Mesher:
    """Grows triangles over one connected group of points, from the lowest point up: a fan around each seed, then outwards over open edges.

    Points are 0 to n - 1; those near a are near[starts[a]:starts[a + 1]], nearest first.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, starts: np.ndarray, near: np.ndarray, params: BuildParams):
        self.n, self.x, self.y, self.z, self.params = len(x), *map(memoryview, (x, y, z)), params
        self.seeds, self.starts, self.near = np.argsort(z, kind="stable"), memoryview(starts), memoryview(near)
        self.dz = max(params.max_dz, LEAST_DZ)
        self.least_area, self.least_up = max(params.min_area, 1e-9), math.cos(math.radians(params.max_slope_deg))
        self.known, self.uses = _Table(), _Table()
        self.out = array("q")

    def at(self, a: int) -> tuple[float, float, float]:
        return self.x[a], self.y[a], self.z[a]

    def around(self, a: int) -> list[int]:
        return self.near[self.starts[a] : self.starts[a + 1]].tolist()

    def reach(self, a: int, b: int) -> float:
        return math.dist((self.x[a], self.y[a]), (self.x[b], self.y[b]))

    def accept(self, a: int, b: int, c: int) -> bool:
        """Adds the triangle if it is new and passes every test."""
        low, middle, high = sorted((a, b, c))
        if low == middle or middle == high or self.known.get(low * self.n + middle, high):
            return False
        pa, pb, pc = self.at(a), self.at(b), self.at(c)
        sides = math.dist(pb, pc), math.dist(pa, pc), math.dist(pa, pb)
        most, rise = self.params.max_edge_len, self.params.max_dz
        if most > 0 and max(sides) > most or rise > 0 and max(pa[2], pb[2], pc[2]) - min(pa[2], pb[2], pc[2]) > rise:
            return False
        u, v = [y - x for x, y in zip(pa, pb, strict=True)], [y - x for x, y in zip(pa, pc, strict=True)]
        n = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        size = math.hypot(*n)
        if size / 2 < self.least_area or n[2] < self.least_up * size:
            return False
        s = [max(x, 1e-12) for x in sides]
        for i in range(3):
            x, y, z = s[i], s[i - 1], s[i - 2]
            if math.degrees(math.acos(max(-1.0, min(1.0, (y * y + z * z - x * x) / (2 * y * z))))) < self.params.min_angle_deg:
                return False
        self.known.add(low * self.n + middle, high)
        self.out.extend((a, b, c) if n[2] >= 0 else (a, c, b))
        for e in ((low, middle), (middle, high), (low, high)):
            self.uses.add(*e)
        return True

    def close(self, a: int, b: int) -> bool:
        radius = self.params.neighbor_radius
        return radius <= 0 or self.reach(a, b) <= radius

    def push(self, front: deque[tuple[int, int]], queued: set[tuple[int, int]], a: int, b: int) -> None:
        """Queues an edge, from its lower point, if it is open and not queued yet."""
        e = min(a, b), max(a, b)
        if self.uses.get(*e) == 1 and e not in queued:
            queued.add(e)
            front.append(e)

    def run(self) -> np.ndarray:
        """The corners of each triangle, in the order in which they were made."""
        used = bytearray(self.n)
        for seed in memoryview(self.seeds):
            if used[seed]:
                continue
            used[seed] = 1
            (x, y, z), most = self.at(seed), self.params.max_edge_len
            around = [v for v in self.around(seed) if (most <= 0 or math.dist((x, y, z), self.at(v)) <= most) and abs(self.z[v] - z) <= self.dz]
            if len(around) < 2:
                continue
            around.sort(key=lambda v: (math.atan2(self.y[v] - y, self.x[v] - x), v))  # noqa: B023
            pairs = list(zip(around, around[1:], strict=False)) + ([(around[-1], around[0])] if len(around) >= 3 else [])
            front: deque[tuple[int, int]] = deque()
            queued: set[tuple[int, int]] = set()
            for v, w in pairs:
                if self.close(seed, v) and self.close(seed, w) and self.accept(seed, v, w):
                    used[v] = used[w] = 1
                    for e in ((seed, v), (v, w), (w, seed)):
                        self.push(front, queued, *e)
            while front:
                a, b = front.popleft()
                queued.discard((a, b))
                if self.uses.get(a, b) != 1:
                    continue
                middle = (self.z[a] + self.z[b]) / 2
                for c in self.around(a):
                    if c in (a, b) or abs(self.z[c] - middle) > self.dz or not (self.close(a, b) and self.close(b, c) and self.close(a, c)):
                        continue
                    if self.accept(a, b, c):
                        used[a] = used[b] = used[c] = 1
                        self.push(front, queued, a, c)
                        self.push(front, queued, c, b)
        return np.frombuffer(self.out, np.int64).reshape(-1, 3)


def _group(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Of rows (pid, x, y, z, near): ids in order, and x, y, z, starts and near for _Mesher, where points are their places in that order."""
    held = []
    for b in batches:
        near, sizes = b.column("near").flatten().to_numpy(), pc.list_value_length(b.column("near")).to_numpy()
        held.append([*(b.column(c).to_numpy() for c in ("pid", "x", "y", "z")), sizes, near.astype(np.int32) if len(near) and near.max() < 2**31 else near])
    ids = np.concatenate([h[0] for h in held])
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    xyz = [np.ascontiguousarray(np.concatenate([h[k] for h in held])[order]) for k in (1, 2, 3)]
    starts = np.concatenate([[0], np.cumsum(np.concatenate([h[4] for h in held])[order], dtype=np.int64)])
    near = np.empty(starts[-1], np.int32)
    for k, h in enumerate(held):
        first = np.cumsum(h[4], dtype=np.int64) - h[4]
        near[np.repeat(starts[np.searchsorted(ids, h[0])] - first, h[4]) + np.arange(len(h[5]))] = np.searchsorted(ids, h[5])
        held[k] = None
    return ids, *xyz, starts, near


def from_points(points: DataFrame, params: BuildParams = BuildParams(), frame_id: str = "map") -> MeshMap:
    """A mesh over points (x, y, z): layered voxels, greedy triangles, surfaces by connectivity (the max_surfaces largest), F32 `elevation`.

    Points are numbered by voxel and layer; neighbours are those within neighbor_radius, or, if that is 0, the points that are with
    it the max(8, k_neighbors) nearest. Greedy growth depends on what was grown before, so it can't be split without other results; but it
    only looks at neighbours, so groups of points that neighbour links don't connect are grown apart, one task each. A group's voxels,
    with their neighbours, must fit one task: flat arrays of some 30 bytes a neighbour. Fewer than three points, before or after voxels, or no
    triangle, give an empty map.
    """
    spark = points.sparkSession
    if points.limit(3).count() < 3:
        return MeshMap.empty(spark)
    if params.resolution > 0:
        cloud = voxel_top(points, params.resolution, params.max_dz if params.max_dz > 0 else LAYER_GAP)
    else:
        cloud = points.select(F.lit(0).alias("vx"), F.lit(0).alias("vy"), F.lit(0).alias("k"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    cloud = numbered(cloud, "pid", "vx", "vy", "k", "x", "y", "z").select("pid", "x", "y", "z")
    if cloud.limit(3).count() < 3:
        return MeshMap.empty(spark)
    near = radius_neighbors(cloud, params.neighbor_radius) if params.neighbor_radius > 0 else knn(cloud, max(8, params.k_neighbors) - 1)
    near = cut(near.select("pid", "nid", "dist"))
    roots = connected_components(near.select(F.col("pid").alias("a"), F.col("nid").alias("b")))
    listed = near.groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "nid"))), lambda s: s["nid"]).alias("near"))
    rows = cloud.join(listed, "pid").join(roots, F.col("pid") == F.col("node")).select("root", "pid", "x", "y", "z", "near")

    def grow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *points = _group(batches)
        made = _Mesher(*points, params).run()
        for at in range(0, len(made), 100_000):
            part = ids[made[at : at + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key[0].as_py())), pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, k]) for k in range(3))], ["root", "n", "v0", "v1", "v2"])

    grown = rows.groupBy("root").applyInArrow(grow, "root long, n long, v0 long, v1 long, v2 long")
    triangles = numbered(grown, "cid", "root", "n").select("cid", "v0", "v1", "v2")
    if not triangles.limit(1).count():
        return MeshMap.empty(spark)
    mesh = from_mesh(cloud, triangles, frame_id)
    return keep_top_surfaces(surfaces_by_connectivity(mesh, frame_id), params.max_surfaces)


def decode_xyz(clouds: DataFrame) -> DataFrame:
    """(x, y, z) of point-cloud messages (data: packed little-endian points; point_step; x_at, y_at, z_at: byte places of the float fields)."""
    def stage(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                raw = np.frombuffer(row.data, np.uint8)
                raw = raw[: len(raw) // row.point_step * row.point_step].reshape(-1, row.point_step)
                yield pd.DataFrame({k: np.ascontiguousarray(raw[:, at : at + 4]).view("<f4").reshape(-1) for k, at in zip("xyz", (row.x_at, row.y_at, row.z_at), strict=True)})

    return clouds.mapInPandas(stage, "x float, y float, z float")


def from_pointcloud2(clouds: DataFrame, params: BuildParams = BuildParams(), frame_id: str = "map") -> MeshMap:
    """The mesh of the points of point-cloud messages, decoded as by decode_xyz()."""
    return from_points(decode_xyz(clouds), params, frame_id)
