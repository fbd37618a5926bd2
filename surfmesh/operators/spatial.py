"""Spatial queries, for whole tables of rays or points at once. Triangles and queries meet by equi-joins on the cells of a square grid in x
and y; the exact test is applied to what shares a cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.functions import geom
from surfmesh.operators.layers import values_of
from surfmesh.operators.mesh import MeshMap
from surfmesh.plans.lineage import cut
from surfmesh.types import LocateOpts

#: Bytes by the optimizer's estimate below which a part is too small to be worth a task of its own.
SMALL_PART = 16 << 20
#: Rows of a table of triangles by cell that are broadcast, after they are counted; a larger table is joined by shuffle.
BROADCAST_ROWS = 100_000


def corners() -> tuple[geom.Point, geom.Point, geom.Point]:
    """The corner columns of a triangle, ax to cz."""
    return geom.point("a"), geom.point("b"), geom.point("c")


@dataclass(frozen=True)
class IndexedMap(MeshMap):
    """A map whose triangles, with their corners, and whose cell side are kept: see indexed(). An edit gives a map that works them out anew."""

    kept: tuple | None = None

    def _sound(self) -> bool:
        return self.kept is not None and all(x is y for x, y in zip(self.kept[0], (self.vertices, self.navcels, self.surface_navcels), strict=True))

    def geometry(self) -> DataFrame:
        return self.kept[1] if self._sound() else super().geometry()

    def visible(self) -> DataFrame:
        return self.kept[2] if self._sound() else super().visible()


def indexed(mesh: MeshMap) -> IndexedMap:
    """The map with its triangles and their corners written to the shared folder once, for queries that come again and again: each would join
    triangles and vertices three times and measure them for the cell side."""
    plain = MeshMap(mesh.vertices, mesh.navcels, mesh.surfaces, mesh.surface_navcels, mesh.layers, mesh.layer_values)
    triangles = cut(plain.geometry())
    listed = cut(triangles.join(mesh.surface_navcels.select("surface_idx", "cid").distinct(), "cid"))
    size = bucket_size(plain)
    return IndexedMap(mesh.vertices, mesh.navcels, mesh.surfaces, mesh.surface_navcels, mesh.layers, mesh.layer_values, kept=((mesh.vertices, mesh.navcels, mesh.surface_navcels), triangles, listed, size))


def bucket_size(mesh: MeshMap) -> float:
    """A cell side of the mean extent of the triangles in x and y; 1 for an empty map."""
    if isinstance(mesh, IndexedMap) and mesh._sound():
        return mesh.kept[3]
    extent = (F.greatest("ax", "bx", "cx") - F.least("ax", "bx", "cx") + F.greatest("ay", "by", "cy") - F.least("ay", "by", "cy")) / 2
    mean = mesh.geometry().agg(F.avg(extent)).first()[0]
    return mean if mean and math.isfinite(mean) else 1.0


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size))


def _span(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(cell(low, size), cell(high, size)))


def bucketed(triangles: DataFrame, size: float) -> DataFrame:
    """Triangles, once for each cell (gx, gy) that their box meets."""
    low, high = (lambda k: F.least(*(p + k for p in "abc"))), (lambda k: F.greatest(*(p + k for p in "abc")))
    return triangles.withColumn("gx", _span(low("x"), high("x"), size)).withColumn("gy", _span(low("y"), high("y"), size))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over all cores if it is too small to come in as many parts by itself; the later aggregation by key then needs no
    exchange. Larger tables stay as they are."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n, key) if size < n * SMALL_PART else df


# --- rays ----------------------------------------------------------------------------------------------------------------------


def ray_cells(rays: DataFrame, box: tuple[float, ...], size: float) -> DataFrame:
    """rays, once for each cell that they pass over inside the box (low and high of x, y and z): one for a vertical ray, else the cells of
    each column on the way."""
    ox, oy, oz, dx, dy, dz = (F.col(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz"))
    near, far, inside = F.lit(0.0), F.lit(1e30), F.lit(True)
    slack = size * 1e-9
    for o, d, low, high in ((ox, dx, box[0], box[1]), (oy, dy, box[2], box[3]), (oz, dz, box[4] - slack, box[5] + slack)):
        still = F.abs(d) < 1e-12
        t1, t2 = geom.ratio(F.lit(low) - o, d, ~still), geom.ratio(F.lit(high) - o, d, ~still)
        near, far = F.greatest(near, F.least(t1, t2)), F.least(far, F.greatest(t1, t2))
        inside = inside & (~still | ((o >= low) & (o <= high)))
    upright = (F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12)
    cut_in = rays.withColumn("_t0", F.when(upright, 0.0).otherwise(near)).withColumn("_t1", F.when(upright, 0.0).otherwise(far)).where(inside & (F.col("_t0") <= F.col("_t1")))
    x0, x1 = ox + dx * F.col("_t0"), ox + dx * F.col("_t1")
    columns = cut_in.withColumn("gx", _span(F.least(x0, x1) - slack, F.greatest(x0, x1) + slack, size))
    # The part of the way over this column, and the rows that it crosses.
    still = F.abs(dx) < 1e-12
    ta, tb = geom.ratio(F.col("gx") * size - slack - ox, dx, ~still), geom.ratio((F.col("gx") + 1) * size + slack - ox, dx, ~still)
    enter = F.when(still, F.col("_t0")).otherwise(F.greatest(F.col("_t0"), F.least(ta, tb)))
    leave = F.when(still, F.col("_t1")).otherwise(F.least(F.col("_t1"), F.greatest(ta, tb)))
    y0, y1 = oy + dy * enter, oy + dy * F.greatest(enter, leave)
    return columns.withColumn("gy", _span(F.least(y0, y1) - slack, F.greatest(y0, y1) + slack, size)).drop("_t0", "_t1")


def _box(mesh: MeshMap) -> tuple[float, ...] | None:
    row = mesh.vertices.agg(*(f(k) for k in "xyz" for f in (F.min, F.max))).first()
    return None if row[0] is None else tuple(map(float, row))


def raycast(mesh: MeshMap, rays: DataFrame, *, first_hit_only: bool = False, size: float | None = None) -> DataFrame:
    """rays (ray_id, ox..dz) with hit, surface, cid, t, px, py, pz.

    The nearest hit; of equally near ones that of the lowest surface, then triangle. first_hit_only: the nearest hit on the lowest surface that
    is hit at all. A miss has hit false and nulls.
    """
    size, box = size or bucket_size(mesh), _box(mesh)
    rays = rays.select("ray_id", *(F.col(c).cast("double").alias(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz")))
    if box is None:
        return rays.select("*", F.lit(False).alias("hit"), *(F.lit(None).cast(t).alias(n) for n, t in (("surface", "int"), ("cid", "long"), *((k, "double") for k in ("t", "px", "py", "pz")))))
    met = _met(ray_cells(spread(rays, "ray_id"), box, size).join(bucketed(mesh.visible().drop("v0", "v1", "v2"), size), ["gx", "gy"]))
    key = ("surface_idx", "t", "cid") if first_hit_only else ("t", "surface_idx", "cid")
    best = met.groupBy("ray_id").agg(F.min(F.when(F.col("t").isNotNull(), F.struct(*key))).alias("m"))
    out = rays.join(best, "ray_id", "left")
    t = F.col("m.t")
    return out.select(*rays.columns, F.col("m").isNotNull().alias("hit"), F.col("m.surface_idx").alias("surface"), F.col("m.cid").alias("cid"), t.alias("t"), *((F.col(f"o{k}") + t * F.col(f"d{k}")).alias(f"p{k}") for k in "xyz"))


def _met(pairs: DataFrame) -> DataFrame:
    """pairs of rays and triangles with t, null for a miss: geom.ray_triangle() step by step, so that no value is worked out twice."""
    o, d, (a, b, c) = geom.point("o"), geom.point("d"), corners()
    sides = {f"_{n}{k}": v for n, side in (("e", geom.sub(b, a)), ("f", geom.sub(c, a)), ("s", geom.sub(o, a))) for k, v in zip("xyz", side, strict=True)}
    pairs = pairs.select("ray_id", "surface_idx", "cid", "dx", "dy", "dz", *(v.alias(k) for k, v in sides.items()))
    e, f, s = map(geom.point, ("_e", "_f", "_s"))
    pairs = pairs.withColumns({f"_{n}{k}": v for n, x in (("h", geom.cross(d, f)), ("q", geom.cross(s, e))) for k, v in zip("xyz", x, strict=True)})
    h, q = geom.point("_h"), geom.point("_q")
    det = geom.dot(e, h)
    pairs = pairs.withColumn("_i", geom.ratio(F.lit(1.0), det, F.abs(det) >= geom.RAY_EPS))
    pairs = pairs.withColumns({"_u": geom.dot(s, h) * F.col("_i"), "_v": geom.dot(d, q) * F.col("_i"), "_t": geom.dot(f, q) * F.col("_i")})
    eps = geom.RAY_EPS
    hit = f"_u >= -{eps} and _u <= 1 + {eps} and _v >= -{eps} and _u + _v <= 1 + {eps} and _t > {eps}"
    return pairs.select("ray_id", "surface_idx", "cid", F.when(F.expr(hit), F.col("_t")).alias("t"))


def pick(mesh: MeshMap, rays: DataFrame) -> DataFrame:
    """rays with px, py, pz: where they hit the mesh, or else the plane z = 0 ahead of them (null where neither)."""
    found = raycast(mesh, rays)
    t = geom.ratio(-F.col("oz"), F.col("dz"), F.abs(F.col("dz")) > 1e-12)
    plane = lambda k: F.when(t > 0, F.col(f"o{k}") + t * F.col(f"d{k}"))
    return found.select("ray_id", "hit", *(F.coalesce(F.col(f"p{k}"), plane(k)).alias(f"p{k}") for k in "xyz"))


# --- points --------------------------------------------------------------------------------------------------------------------


def _points(points: DataFrame) -> DataFrame:
    return points.select("pid", *(F.col(c).cast("double").alias(f"p{c}") for c in "xyz"), *(["hint_cid"] if "hint_cid" in points.columns else []))


def locate(mesh: MeshMap, points: DataFrame, opts: LocateOpts = LocateOpts(), *, size: float | None = None) -> DataFrame:
    """points (pid, x, y, z, maybe hint_cid) with found, surface, cid, hx, hy, hz, b0, b1, b2.

    A hint that the point lies on (within planar_eps, at most height_eps off) is taken. Else, in each direction of the vertical line, the lowest
    surface that is hit has its nearest hit; of both directions the nearer one wins, down on ties, whatever its distance. Where neither
    counts, the highest and the lowest triangle of the column are looked at, if they are within height_eps; the nearer wins, the highest
    on ties. Hits at the point's own height count for the latter alone. Nulls where nothing is found.
    """
    size = size or bucket_size(mesh)
    p, (A, B, C) = _points(points), corners()
    at = tuple(F.col(f"p{k}") for k in "xyz")
    tri = mesh.visible().drop("v0", "v1", "v2")
    met = spread(p, "pid").withColumn("gx", cell(at[0], size)).withColumn("gy", cell(at[1], size)).join(bucketed(tri, size), ["gx", "gy"])
    met = met.withColumn("_z", geom.vertical_z(at[0], at[1], A, B, C)).where(F.col("_z").isNotNull())
    on = (at[0], at[1], F.col("_z"))
    sound = geom.point_in_triangle(on, A, B, C, opts.planar_eps)
    met = met.withColumn("_dz", F.col("_z") - at[2]).withColumn("_ok", sound)
    # Per direction the lowest surface's nearest hit, which then must be sound.
    one = F.struct("surface_idx", F.abs("_dz").alias("dz"), "cid", F.col("_z").alias("z"), F.col("_ok").alias("ok"))
    ends = lambda z: F.struct(z.alias("key"), "surface_idx", "cid", F.col("_z").alias("z"))
    best = met.groupBy("pid").agg(
        F.min(F.when(F.col("_dz") < -1e-8, one)).alias("down"),
        F.min(F.when(F.col("_dz") > 1e-8, one)).alias("up"),
        F.min(ends(-F.col("_z"))).alias("top"),
        F.min(ends(F.col("_z"))).alias("bottom"),
    )
    out = p.join(best, "pid", "left")

    def option(name: str, dz: Column, order: int, ok: Column) -> Column:
        return F.when(ok, F.struct(dz.alias("dz"), F.lit(order).alias("order"), F.col(f"{name}.surface_idx").alias("surface"), F.col(f"{name}.cid").alias("cid"), F.col(f"{name}.z").alias("z")))

    vertical = F.least(option("down", F.col("down.dz"), 0, F.col("down.ok")), option("up", F.col("up.dz"), 1, F.col("up.ok")))
    off = lambda n: F.abs(F.col(f"{n}.z") - at[2])
    ranged = F.least(*(option(n, off(n), k, off(n) <= opts.height_eps) for k, n in enumerate(("top", "bottom"))))
    out = out.withColumn("m", F.coalesce(vertical, ranged)).select(*p.columns, "m")
    names = [*at[:2], F.col("m.z")]
    if "hint_cid" in points.columns:
        owner = mesh.surface_navcels.groupBy("cid").agg(F.min("surface_idx").alias("_s"))
        plane = mesh.geometry().join(owner, "cid").withColumnRenamed("cid", "hint_cid")
        plane = plane.withColumns({f"_n{k}": v for k, v in zip("xyz", geom.triangle_normal(A, B, C), strict=True)})
        hinted = out.where("hint_cid is not null").join(plane, "hint_cid").withColumn("_off", geom.dot(geom.sub(at, A), geom.point("_n")))
        hinted = hinted.where(F.abs("_off") <= opts.height_eps)
        hinted = _barycentric(hinted.withColumns({f"_f{k}": v - F.col(f"_n{k}") * F.col("_off") for k, v in zip("xyz", at, strict=True)}), geom.point("_f"))
        hinted = hinted.where(" and ".join(f"_b{k} >= -{opts.planar_eps!r}" for k in range(3)))
        hinted = hinted.select("pid", F.struct(F.col("_s").alias("s"), F.col("hint_cid").alias("c"), *(F.col(f"_f{k}").alias(k) for k in "xyz")).alias("h"))
        out = out.join(hinted, "pid", "left")
        names = [F.coalesce(F.col(f"h.{k}"), v) for k, v in zip("xyz", names, strict=True)]
        surface, cid = F.coalesce("h.s", "m.surface"), F.coalesce("h.c", "m.cid")
    else:
        surface, cid = F.col("m.surface"), F.col("m.cid")
    out = out.select("pid", "px", "py", "pz", cid.isNotNull().alias("found"), surface.alias("surface"), cid.alias("cid"), *(F.when(cid.isNotNull(), v).alias(f"h{k}") for v, k in zip(names, "xyz", strict=True)))
    own = mesh.geometry().select("cid", *(q + k for q in "abc" for k in "xyz"))
    out = _barycentric(out.join(own, "cid", "left"), geom.point("h"))
    return out.select("pid", "px", "py", "pz", "found", "surface", "cid", "hx", "hy", "hz", *(F.when(F.col("found"), F.coalesce(F.col(f"_b{k}"), F.lit(w))).alias(f"b{k}") for k, w in enumerate((1.0, 0.0, 0.0))))


def _barycentric(df: DataFrame, p: geom.Point) -> DataFrame:
    """df (triangles ax..cz) with the barycentric coordinates _b0.._b2 of p: geom.barycentric() step by step, so that no value is worked out twice."""
    a, b, c = corners()
    e0, e1, e2 = geom.sub(b, a), geom.sub(c, a), geom.sub(p, a)
    df = df.withColumns({"_d00": geom.dot(e0, e0), "_d01": geom.dot(e0, e1), "_d11": geom.dot(e1, e1), "_d20": geom.dot(e2, e0), "_d21": geom.dot(e2, e1)})
    d00, d01, d11, d20, d21 = map(F.col, ("_d00", "_d01", "_d11", "_d20", "_d21"))
    df = df.withColumn("_d", d00 * d11 - d01 * d01).withColumn("_d", F.when(F.abs("_d") >= geom.BARY_EPS, F.col("_d")))
    df = df.withColumns({"_b1": (d11 * d20 - d01 * d21) / F.col("_d"), "_b2": (d00 * d21 - d01 * d20) / F.col("_d")})
    return df.withColumn("_b0", 1.0 - F.col("_b1") - F.col("_b2"))


def locate_by_walking(mesh: MeshMap, points: DataFrame, opts: LocateOpts = LocateOpts(), *, steps: int = 16) -> DataFrame:
    """points (pid, x, y, z, hint_cid) with found and cid: from the hint over the edge that the point lies beyond, up to `steps` times.

    Each step is a join by triangle; points that have arrived or left the mesh aren't carried on.
    """
    p, (A, B, C) = _points(points).withColumn("cid", F.col("hint_cid")), corners()
    across = mesh.adjacency().groupBy("cid").agg(*(F.max(F.when(F.col("e") == e, F.col("neighbor"))).alias(f"n{e}") for e in range(3)))
    tri = cut(mesh.geometry().join(across, "cid"))
    at = tuple(F.col(f"p{k}") for k in "xyz")
    done = None
    for _ in range(steps):
        b = [F.col(f"_b{k}") for k in range(3)]
        arrived = F.coalesce((b[0] >= -opts.planar_eps) & (b[1] >= -opts.planar_eps) & (b[2] >= -opts.planar_eps), F.lit(False))
        # The edge across from the corner of the least coordinate: 1 across from a, 2 from b, 0 from c.
        least = F.least(*b)
        onward = F.when(b[0].isNull(), None).when(b[0] == least, F.col("n1")).when(b[1] == least, F.col("n2")).otherwise(F.col("n0"))
        off = F.abs(geom.dot(geom.sub(at, A), geom.triangle_normal(A, B, C))) <= opts.height_eps
        here = cut(_barycentric(p.join(tri, "cid"), at).select("pid", "px", "py", "pz", "cid", (arrived & off).alias("found"), onward.alias("next")))
        home = here.where("found").select("pid", "cid")
        done = home if done is None else done.unionByName(home)
        p = here.where("not found and next is not null").select("pid", "px", "py", "pz", F.col("next").alias("cid"))
        if not p.limit(1).count():
            break
    return _points(points).select("pid", "hint_cid").join(done, "pid", "left").select("pid", "hint_cid", F.col("cid").isNotNull().alias("found"), "cid")


def sample_layer(mesh: MeshMap, name: str, points: DataFrame, default: float = math.nan, opts: LocateOpts = LocateOpts()) -> DataFrame:
    """points' pid with cid, hz and value: the layer's at the located triangle; the default where there is none, or it is NaN."""
    found = locate(mesh, points, opts).select("pid", "cid", "hz")
    value = F.when(~F.isnan("value"), F.col("value"))
    return found.join(values_of(mesh, name), "cid", "left").select("pid", "cid", "hz", F.coalesce(value, F.lit(float(default))).alias("value"))


def closest(mesh: MeshMap, points: DataFrame, *, restrict_surface: int = -1, size: float | None = None) -> DataFrame:
    """points (pid, x, y, z) with found, surface, cid, qx, qy, qz, sqdist: the nearest triangle, of one surface if restrict_surface is 0 or
    more; of equally near ones that of the lowest surface, then triangle.

    Points look in the mesh's cell that is nearest to them, then in ever wider squares around it, until they have found a triangle at all; it
    bounds the distance. Those for which that bound reaches beyond their cell look once more, in all cells that it touches; there only
    triangles whose box is within the bound, in height too, are measured.
    """
    size = size or bucket_size(mesh)
    tri = mesh.visible()
    if restrict_surface >= 0:
        tri = tri.where(F.col("surface_idx") == restrict_surface)
    box = {f"{name}{k}": f(*(F.col(p + k) for p in "abc")) for name, f in (("low", F.least), ("high", F.greatest)) for k in "xyz"}
    cells = cut(bucketed(prepared(tri.drop("v0", "v1", "v2")).withColumns(box), size))
    # Columns that are known to hold no nulls make for much less code.
    cells = cells.where(" and ".join(f"{c} is not null" for c in cells.columns))
    n, x0, x1, y0, y1 = cells.agg(F.count("*"), F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy")).first()
    cells = F.broadcast(cells) if n <= BROADCAST_ROWS else cells
    p = _points(points)
    at = tuple(F.col(f"p{k}") for k in "xyz")
    if x0 is None:
        names = {"surface": "int", "cid": "long", "qx": "double", "qy": "double", "qz": "double", "sqdist": "double"}
        return p.select("pid", "px", "py", "pz", *(F.lit(None).cast(t).alias(n) for n, t in names.items()), F.lit(False).alias("found"))
    gx, gy = cell(at[0], size), cell(at[1], size)
    clip = lambda g, low, high: F.greatest(F.lit(low), F.least(F.lit(high), g))
    side = lambda low, high, least, most: F.explode(F.sequence(clip(low, least, most), clip(high, least, most)))

    def nearest(spread_out: DataFrame, within: Column | None = None) -> DataFrame:
        met = spread_out.where("px is not null and py is not null and pz is not null").join(cells, ["gx", "gy"])
        if within is not None:
            off = [F.greatest(F.lit(0.0), F.col(f"low{k}") - v, v - F.col(f"high{k}")) for v, k in zip(at, "xyz", strict=True)]
            met = met.where(geom.dot(off, off) <= within)
        met = _squared(met, at)
        return met.groupBy("pid").agg(F.min(F.struct("_sq", "surface_idx", "cid")).alias("m"))

    home_x, home_y = clip(gx, x0, x1), clip(gy, y0, y1)
    border = F.least(at[0] - gx * size, (gx + 1) * size - at[0], at[1] - gy * size, (gy + 1) * size - at[1])
    now, ring, done, wide = spread(p, "pid"), 0, None, None
    while True:
        best = nearest(now.withColumn("gx", side(home_x - ring, home_x + ring, x0, x1)).withColumn("gy", side(home_y - ring, home_y + ring, y0, y1)))
        inside = (home_x == gx) & (home_y == gy) & (F.col("m._sq") <= border * border)
        state = now.join(best, "pid", "left").withColumn("_closed", F.coalesce(inside, F.lit(False))).withColumn("_r", F.sqrt("m._sq") * (1 + 1e-12))
        reach = F.col("_r")
        ends = {"_x0": clip(cell(at[0] - reach, size), x0, x1), "_x1": clip(cell(at[0] + reach, size), x0, x1), "_y0": clip(cell(at[1] - reach, size), y0, y1), "_y1": clip(cell(at[1] + reach, size), y0, y1)}
        state = cut(state.withColumns(ends).withColumn("_bound", reach * reach))
        closed, beyond = state.where("_closed").select("pid", "m"), state.where("not _closed and m is not null")
        done, wide = (closed, beyond) if done is None else (done.unionByName(closed), wide.unionByName(beyond))
        left = state.where("m is null").select(*p.columns)
        if ring > x1 - x0 + y1 - y0 or not left.limit(1).count():
            break
        now, ring = left, max(1, 2 * ring)
    touched = wide.select("pid", "px", "py", "pz", "_bound", "_y0", "_y1", F.explode(F.sequence("_x0", "_x1")).alias("gx"))
    touched = touched.select("pid", "px", "py", "pz", "_bound", "gx", F.explode(F.sequence("_y0", "_y1")).alias("gy"))
    off = lambda g, v: F.greatest(F.lit(0.0), F.col(g) * size - v, v - (F.col(g) + 1) * size)
    touched = touched.where(off("gx", at[0]) * off("gx", at[0]) + off("gy", at[1]) * off("gy", at[1]) <= F.col("_bound"))
    done = done.unionByName(nearest(touched, F.col("_bound"))).select("pid", F.col("m.surface_idx").alias("surface"), F.col("m.cid").alias("cid"), F.col("m._sq").alias("sqdist"))
    # Of the nearest triangle the point that _squared measured to.
    found = _squared(p.join(done, "pid", "left").join(prepared(mesh.geometry().drop("v0", "v1", "v2")), "cid", "left"), at)
    side = F.when(F.col("_inside"), 3).when((F.col("_d0") <= F.col("_d1")) & (F.col("_d0") <= F.col("_d2")), 0).when(F.col("_d1") <= F.col("_d2"), 1).otherwise(2)
    found = found.withColumn("_side", side).withColumn("_k", F.when(F.col("_side") == 3, _off(at)).otherwise(F.element_at(F.array("_t0", "_t1", "_t2"), F.least(F.col("_side"), F.lit(2)) + 1)))
    pick = lambda *options: F.element_at(F.array(*options), F.col("_side") + 1)
    start, along = ([pick(*(F.col(f"{n}{k}") for n in names)) for k in "xyz"] for names in (("a", "b", "c", "p"), ("_e0", "_e1", "_e2", "_n")))
    q = [F.when(F.col("cid").isNotNull(), s + e * F.col("_k")).alias(f"q{k}") for s, e, k in zip(start, along, "xyz", strict=True)]
    return found.select("pid", "px", "py", "pz", "surface", "cid", *q, "sqdist", F.col("cid").isNotNull().alias("found"))


def prepared(triangles: DataFrame) -> DataFrame:
    """triangles (ax..cz) with what measuring needs of each: the sides (_e0x..), one over their squared lengths (_l0.., 0 for none), the normal (_nx..)
    and one over its square (_l3), and the vectors in its plane that point inside from each side (_m0x..). So that little is worked out
    for each pair: more code than HotSpot compiles would run many times slower."""
    a, b, c = corners()
    over = lambda v, least: F.coalesce(geom.ratio(F.lit(1.0), v, v > least), F.lit(0.0))
    for k, (s, e) in enumerate(((a, b), (b, c), (c, a))):
        triangles = triangles.withColumns({f"_e{k}{x}": v for x, v in zip("xyz", geom.sub(e, s), strict=True)})
    sides = [geom.point(f"_e{k}") for k in range(3)]
    triangles = triangles.withColumns({f"_n{x}": v for x, v in zip("xyz", geom.cross(sides[0], geom.sub(c, a)), strict=True)})
    n = geom.point("_n")
    lengths = {f"_l{k}": over(geom.dot(e, e), 0.0) for k, e in enumerate(sides)} | {"_l3": over(geom.dot(n, n), 1e-20)}
    return triangles.withColumns(lengths | {f"_m{k}{x}": v for k, e in enumerate(sides) for x, v in zip("xyz", geom.cross(n, e), strict=True)})


def _off(at: geom.Point) -> Column:
    """How many normals the foot of the perpendicular is away from a point."""
    return -geom.dot(geom.sub(at, geom.point("a")), geom.point("_n")) * F.col("_l3")


def _squared(met: DataFrame, at: geom.Point) -> DataFrame:
    """met (points and prepared triangles) with _sq, the squared distance: by the foot of the perpendicular where that lies inside (_inside), else by
    the nearest of the sides (_d0.._d2, at _t0.._t2 of their length). Step by step, so that no value is worked out twice."""
    starts = corners()
    for k in range(3):
        to, e = geom.sub(at, starts[k]), geom.point(f"_e{k}")
        met = met.withColumn(f"_t{k}", geom.clamp01(geom.dot(to, e) * F.col(f"_l{k}")))
        off = geom.sub(to, geom.scale(e, F.col(f"_t{k}")))
        met = met.withColumn(f"_d{k}", geom.dot(off, off))
    left = [geom.dot(geom.sub(at, starts[k]), geom.point(f"_m{k}")) >= 0 for k in range(3)]
    met = met.withColumn("_inside", F.coalesce(left[0] & left[1] & left[2] & (F.col("_l3") > 0), F.lit(False)))
    high = geom.dot(geom.sub(at, starts[0]), geom.point("_n"))
    return met.withColumn("_sq", F.when(F.col("_inside"), high * high * F.col("_l3")).otherwise(F.least("_d0", "_d1", "_d2")))


# --- neighbourhoods of points --------------------------------------------------------------------------------------------------


def radius_neighbors(points: DataFrame, radius: float) -> DataFrame:
    """(pid, nid, dist) of all pairs of different points within the radius, each both ways: cells as wide as the radius, nine to look in."""
    p = points.select("pid", *(F.col(k).cast("double").alias(k) for k in "xyz"))
    near = F.explode(F.array(*(F.struct((cell(F.col("x"), radius) + i).alias("gx"), (cell(F.col("y"), radius) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("g")
    spread = p.select("*", near).select("pid", "x", "y", "z", "g.gx", "g.gy")
    other = p.select(F.col("pid").alias("nid"), *(F.col(k).alias(f"n{k}") for k in "xyz"), cell(F.col("x"), radius).alias("gx"), cell(F.col("y"), radius).alias("gy"))
    dist = geom.dist3(tuple(F.col(k) for k in "xyz"), geom.point("n"))
    return spread.join(other, ["gx", "gy"]).where("pid <> nid").select("pid", "nid", dist.alias("dist")).where(F.col("dist") <= radius)


def knn(points: DataFrame, k: int, *, start: float | None = None) -> DataFrame:
    """(pid, nid, dist, rank) of the k nearest other points, nearest first, lower ids on ties. Points that aren't finite have no neighbours and are none.

    Points look in cells as wide as a radius and in those around; the radius doubles for points that have too few. The first one is made so small,
    before anything is joined, that pairs stay in proportion to points, however unevenly they lie (_first_radius). Of points in one place only the
    k + 1 of the lowest ids can be anyone's neighbours.
    """
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in "xyz")
    p = cut(points.select("pid", *(F.col(c).cast("double").alias(c) for c in "xyz")).where(ok))
    n, *ends = p.agg(F.count("*"), *(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    want = min(k, n - 1)
    if want < 1:
        return mesh_empty(points, "pid long, nid long, dist double, rank int")
    place = Window.partitionBy("x", "y", "z").orderBy("pid")
    p = cut(p.withColumn("_other", F.row_number().over(place) <= want + 1))
    radius = start or _first_radius(p, n, want, ends)
    g = ["gx", "gy", "gz"]
    dist = geom.dist3(geom.point(""), geom.point("n"))
    first, todo, done = True, p, None
    while True:
        others = p.where("_other").select(F.col("pid").alias("nid"), *(F.col(c).alias(f"n{c}") for c in "xyz"))
        home = lambda df, pre: df.select("*", *(cell(F.col(pre + c), radius).alias(f"g{c}") for c in "xyz"))  # noqa: B023, E731
        # At first the others come to the cells around, so that each point meets all of them in its own; later, fewer points go to the others.
        q, o = (home(todo, ""), _around(others, "n", radius, ends)) if first else (_around(todo, "", radius, ends), home(others, "n"))
        met = q.join(o, g).where("pid <> nid").select(*(g if first else ()), "pid", "nid", dist.alias("dist")).where(F.col("dist") <= radius)
        by = [*g, "pid"] if first else ["pid"]
        ranked = met.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("dist", "nid"))).where(F.col("_rank") <= want)
        full = cut(ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dist", "nid"))).alias("near")).where(F.size("near") == want).select("pid", "near"))
        done = full if done is None else done.unionByName(full)
        todo = cut(todo.join(full.select("pid"), "pid", "left_anti"))
        if not todo.limit(1).count():
            return done.select("pid", F.posexplode("near").alias("rank", "s")).select("pid", "s.nid", "s.dist", (F.col("rank") + 1).cast("int").alias("rank"))
        first, radius = False, radius * 2


def _around(df: DataFrame, pre: str, size: float, ends: list[float]) -> DataFrame:
    """df, once for each of the cells around its own (gx, gy, gz) and that one, inside the box of ends (low and high of x, y and z)."""
    for c, low, high in zip("xyz", ends[::2], ends[1::2], strict=True):
        at, least, most = cell(F.col(pre + c), size), cell(F.lit(low), size), cell(F.lit(high), size)
        df = df.withColumn(f"g{c}", F.explode(F.sequence(F.greatest(at - 1, least), F.least(at + 1, most))))
    return df


def _first_radius(p: DataFrame, n: int, want: int, ends: list[float]) -> float:
    """A cell side that gives cells want + 1 points if the n points of p lie evenly over their box, halved until cells make no more pairs than four
    times those."""
    reach = math.dist(ends[::2], ends[1::2]) or 1.0
    *_, shorter, longer = sorted(high - low for low, high in zip(ends[::2], ends[1::2], strict=True))
    size = min(reach, max(math.sqrt(shorter * longer * (want + 1) / n), longer * (want + 1) / n, reach * 2.0**-30))
    while size > reach * 2.0**-30:
        cells = p.groupBy(*(cell(F.col(c), size) for c in "xyz")).agg((F.count("*").cast("double") * F.count_if("_other")).alias("_pairs"))
        if cells.agg(F.sum("_pairs")).first()[0] <= 4.0 * (want + 1) * n:
            break
        size /= 2
    return size


def mesh_empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)
