"""The mesh: tables of vertices, triangles, surfaces and layers, and what is derived from them. All values are immutable; an edit returns a
new mesh whose tables are plans over the old ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfmesh import types as T
from surfmesh.functions import geom


@dataclass(frozen=True)
class MeshMap:
    """A map. vertices, navcels (triangles), surfaces, surface_navcels (which triangles a surface lists), layers (the catalog) and
    layer_values have the schemas of surfmesh.types. Only triangles that a surface lists are seen by spatial queries; layers cover all."""

    vertices: DataFrame
    navcels: DataFrame
    surfaces: DataFrame
    surface_navcels: DataFrame
    layers: DataFrame
    layer_values: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # --- construction and editing ---

    @staticmethod
    def empty(spark: SparkSession) -> MeshMap:
        return MeshMap(*(spark.createDataFrame([], s) for s in (T.VERTICES, T.NAVCELS, T.SURFACES, T.SURFACE_NAVCELS, T.LAYERS, T.LAYER_VALUES)))

    @staticmethod
    def of(vertices: DataFrame, navcels: DataFrame, frame_id: str = "map") -> MeshMap:
        """A map with one surface that lists all triangles."""
        spark = vertices.sparkSession
        blank = MeshMap.empty(spark)
        vertices = blank.vertices.unionByName(vertices, allowMissingColumns=True)
        listed = navcels.select(F.lit(0).alias("surface_idx"), F.col("cid").cast("int").alias("pos"), "cid")
        return replace(blank, vertices=vertices, navcels=navcels.select("cid", "v0", "v1", "v2"), surfaces=spark.createDataFrame([(0, frame_id)], T.SURFACES), surface_navcels=listed)

    def create_surface(self, frame_id: str) -> tuple[MeshMap, int]:
        """The map with an empty surface appended, and its index."""
        k = self.surfaces.count()
        return replace(self, surfaces=self.surfaces.unionByName(self.spark.createDataFrame([(k, frame_id)], T.SURFACES))), k

    def add_surface(self, frame_id: str, cids: Iterable[int]) -> tuple[MeshMap, int]:
        """The map with a surface appended that lists these triangles, and its index."""
        grown, k = self.create_surface(frame_id)
        listed = self.spark.createDataFrame([(k, i, c) for i, c in enumerate(cids)], T.SURFACE_NAVCELS)
        return replace(grown, surface_navcels=grown.surface_navcels.unionByName(listed)), k

    def remove_surface(self, k: int) -> tuple[MeshMap, bool]:
        """The map without surface k, later ones moved down; False where there is none. Vertices, triangles and layers stay."""
        if not self.surfaces.where(F.col("surface_idx") == k).limit(1).count():
            return self, False
        moved = F.when(F.col("surface_idx") > k, F.col("surface_idx") - 1).otherwise(F.col("surface_idx")).alias("surface_idx")
        without = lambda df: df.where(F.col("surface_idx") != k).select(moved, *(c for c in df.columns if c != "surface_idx"))
        return replace(self, surfaces=without(self.surfaces), surface_navcels=without(self.surface_navcels)), True

    def add_vertices(self, points: Iterable[tuple[float, float, float]]) -> tuple[MeshMap, int]:
        """The map with vertices appended, and the id of the first."""
        k = self.vertices.count()
        new = self.spark.createDataFrame([(k + i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(points)], "vid long, x double, y double, z double")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True)), k

    def add_navcels(self, corners: Iterable[tuple[int, int, int]], surface: int | None = None) -> tuple[MeshMap, int]:
        """The map with triangles appended, listed by a surface if it exists, and the id of the first. Corners aren't checked."""
        corners = list(corners)
        k = self.navcels.count()
        new = self.spark.createDataFrame([(k + i, *map(int, c)) for i, c in enumerate(corners)], T.NAVCELS)
        grown = replace(self, navcels=self.navcels.unionByName(new))
        return (grown if surface is None else grown.add_to_surface(surface, range(k, k + len(corners)))), k

    def add_to_surface(self, k: int, cids: Iterable[int]) -> MeshMap:
        """The map with triangles listed by surface k; unchanged where there is none. A triangle may be listed again."""
        if not self.surfaces.where(F.col("surface_idx") == k).limit(1).count():
            return self
        at = self.surface_navcels.where(F.col("surface_idx") == k).count()
        listed = self.spark.createDataFrame([(k, at + i, int(c)) for i, c in enumerate(cids)], T.SURFACE_NAVCELS)
        return replace(self, surface_navcels=self.surface_navcels.unionByName(listed))

    # --- derived tables ---

    def geometry(self) -> DataFrame:
        """(cid, v0, v1, v2, ax..cz): triangles with their corners."""
        out = self.navcels.select("cid", "v0", "v1", "v2")
        for k, p in enumerate("abc"):
            out = out.join(self.vertices.select(F.col("vid").alias(f"v{k}"), *(F.col(c).cast("double").alias(p + c) for c in "xyz")), f"v{k}")
        return out.select("cid", "v0", "v1", "v2", *(p + c for p in "abc" for c in "xyz"))

    def visible(self) -> DataFrame:
        """geometry() of the triangles that surfaces list, with surface_idx; one row for each surface that lists a triangle."""
        listed = self.surface_navcels.select("surface_idx", "cid").distinct()
        return self.geometry().join(listed, "cid")

    def derived(self) -> DataFrame:
        """(cid, nx, ny, nz, area): unit normals and areas."""
        a, b, c = map(geom.point, "abc")
        n = geom.triangle_normal(a, b, c)
        return self.geometry().select("cid", *(v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)), geom.triangle_area(a, b, c).alias("area"))

    def centroids(self) -> DataFrame:
        """(cid, x, y, z)."""
        return self.geometry().select("cid", *(v.alias(k) for v, k in zip(geom.centroid(*map(geom.point, "abc")), "xyz", strict=True)))

    def surface_aabb(self) -> DataFrame:
        """(surface_idx, frame_id, minx..maxz); nulls for a surface without triangles."""
        flat = self.visible().select("surface_idx", F.explode(F.array(*(geom.xyz(geom.point(p)) for p in "abc"))).alias("p"))
        box = flat.groupBy("surface_idx").agg(*(f(f"p.{k}").alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in "xyz"))
        return self.surfaces.join(box, "surface_idx", "left")

    def edges(self) -> DataFrame:
        """(cid, e, lo, hi): the three edges of each triangle, edge e from corner e to the next."""
        ends = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
        each = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for e, (a, b) in enumerate(ends)))).alias("s")
        return self.navcels.select("cid", each).select("cid", "s.e", "s.lo", "s.hi")

    def adjacency(self, of: DataFrame | None = None) -> DataFrame:
        """(cid, e, neighbor): who lies across each edge, null at a boundary; of: only for these triangles (cid), which are looked up by their edges.

        Of an edge's owners in order, the first one's neighbour is the last one, and every later one's is the first. An owner twice over isn't
        its own neighbour.
        """
        by = Window.partitionBy("lo", "hi")
        order = by.orderBy("cid", "e")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        edges = self.edges()
        if of is not None:
            ends = edges.join(of, "cid", "left_semi").select("lo", "hi").distinct()
            edges = edges.join(ends, ["lo", "hi"], "left_semi")
        owned = edges.select("cid", "e", F.row_number().over(order).alias("k"), F.first("cid").over(whole).alias("first"), F.last("cid").over(whole).alias("last"), F.count("*").over(by).alias("n"))
        across = F.when(F.col("k") > 1, F.col("first")).when(F.col("n") > 1, F.col("last"))
        found = owned.select("cid", "e", F.when(across != F.col("cid"), across).alias("neighbor"))
        return found if of is None else found.join(of, "cid", "left_semi")

    def neighbors(self) -> DataFrame:
        """(cid, neighbors): the triangles across the edges of each, in edge order, boundaries left out."""
        listed = F.sort_array(F.collect_list(F.struct("e", "neighbor")))
        found = self.adjacency().groupBy("cid").agg(listed.alias("s"))
        return found.select("cid", F.transform(F.filter("s", lambda x: x["neighbor"].isNotNull()), lambda x: x["neighbor"]).alias("neighbors"))

    def stats(self) -> DataFrame:
        """One row: n_vertices, n_navcels, n_surfaces, n_layers."""
        out = None
        for name, df in (("n_vertices", self.vertices), ("n_navcels", self.navcels), ("n_surfaces", self.surfaces), ("n_layers", self.layers)):
            one = df.agg(F.count("*").alias(name))
            out = one if out is None else out.crossJoin(one)  # one row each
        return out

    # --- comparing ---

    def fingerprint(self) -> DataFrame:
        """One row that names the geometry: counts, and order-free hashes of vertices and triangles."""
        v = self.vertices.agg(F.count("*").alias("n_vertices"), F.bit_xor(F.xxhash64("vid", *(F.col(k).cast("float") for k in "xyz"))).alias("vertex_hash"))
        t = self.navcels.agg(F.count("*").alias("n_navcels"), F.bit_xor(F.xxhash64("cid", "v0", "v1", "v2")).alias("navcel_hash"))
        return v.crossJoin(t)  # one row each

    def has_same_geometry(self, other: MeshMap) -> bool:
        return self.fingerprint().first() == other.fingerprint().first()

    def transformed(self, rotation: tuple[tuple[float, float, float], ...], shift: tuple[float, float, float]) -> MeshMap:
        """The map in another frame: rotation (by rows), then shift."""
        moved = [sum((F.col(k) * F.lit(float(r)) for k, r in zip("xyz", row, strict=True)), F.lit(float(t))).alias(k) for k, row, t in zip("xyz", rotation, shift, strict=True)]
        return replace(self, vertices=self.vertices.select("vid", *moved, "r", "g", "b", "a"))
