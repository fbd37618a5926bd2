"""Geometry of points, boxes, rays and triangles as Column expressions. A point is a tuple of three Columns (or numbers)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]
# Tolerances.
RAY_EPS, BARY_EPS, NORMAL_EPS, CLOSEST_EPS = 1e-8, 1e-12, 1e-12, 1e-20


def point(prefix: str) -> Point:
    """The columns prefix + x, y, z as doubles."""
    return tuple(F.col(prefix + k).cast("double") for k in "xyz")


def lit(x: float, y: float, z: float) -> Point:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def sub(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def add(a: Point, b: Point) -> Point:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a: Point, k: Column) -> Point:
    return tuple(x * k for x in a)


def dot(a: Point, b: Point) -> Column:
    return reduce(Column.__add__, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def xyz(a: Point) -> Column:
    return F.struct(*(v.alias(k) for v, k in zip(a, "xyz", strict=True)))


def ratio(n: Column, d: Column, ok: Column) -> Column:
    """n / d where ok, else null: nothing is ever divided by zero."""
    return n / F.when(ok, d)


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many digits as SQL engines that scale, round and divide have it: Spark's round() goes by the shortest decimal form instead, so that
    0.5046875, which lies a little below as a double, becomes 0.504688 there and 0.504687 here."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


# --- triangles -----------------------------------------------------------------------------------------------------------------


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) * 0.5


def triangle_normal(a: Point, b: Point, c: Point) -> Point:
    """The unit normal; +z for a degenerate triangle."""
    n = cross(sub(b, a), sub(c, a))
    size = norm(n)
    ok = size > NORMAL_EPS
    return tuple(F.coalesce(ratio(v, size, ok), F.lit(default)) for v, default in zip(n, (0.0, 0.0, 1.0), strict=True))


def raw_normal(a: Point, b: Point, c: Point) -> Point:
    """The unit normal; the cross product itself for a degenerate triangle."""
    n = cross(sub(b, a), sub(c, a))
    size = norm(n)
    return tuple(F.coalesce(ratio(v, size, size > 0), v) for v in n)


def centroid(a: Point, b: Point, c: Point) -> Point:
    return tuple((x + y + z) / 3.0 for x, y, z in zip(a, b, c, strict=True))


def triangle_aabb(a: Point, b: Point, c: Point) -> Column:
    """The box of a triangle: minx..maxz."""
    low = [F.least(*v).alias(f"min{k}") for v, k in zip(zip(a, b, c, strict=True), "xyz", strict=True)]
    high = [F.greatest(*v).alias(f"max{k}") for v, k in zip(zip(a, b, c, strict=True), "xyz", strict=True)]
    return F.struct(*low, *high)


def triangle_angles_deg(a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """Inner angles at a, b and c by the law of cosines; sides count as 1e-12 at least."""
    la, lb, lc = (F.greatest(norm(sub(p, q)), F.lit(1e-12)) for p, q in ((b, c), (a, c), (a, b)))

    def at(opposite: Column, one: Column, other: Column) -> Column:
        cos = (one * one + other * other - opposite * opposite) / (2.0 * one * other)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    return at(la, lb, lc), at(lb, la, lc), at(lc, la, lb)


def barycentric(p: Point, a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """Barycentric coordinates of p's projection; null for a degenerate triangle."""
    e0, e1, e2 = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(e0, e0), dot(e0, e1), dot(e1, e1), dot(e2, e0), dot(e2, e1)
    denominator = d00 * d11 - d01 * d01
    ok = F.abs(denominator) >= BARY_EPS
    v = ratio(d11 * d20 - d01 * d21, denominator, ok)
    w = ratio(d00 * d21 - d01 * d20, denominator, ok)
    return 1.0 - v - w, v, w


def point_in_triangle(p: Point, a: Point, b: Point, c: Point, eps: float) -> Column:
    """Whether all barycentric coordinates of p are at least -eps; false for a degenerate triangle."""
    return F.coalesce(reduce(Column.__and__, (x >= -eps for x in barycentric(p, a, b, c))), F.lit(False))


def _on_side(p: Point, start: Point, end: Point) -> Point:
    """The point of a side that is nearest to p; its start where the side has no length."""
    along = sub(end, start)
    size = dot(along, along)
    return add(start, scale(along, clamp01(F.coalesce(ratio(dot(sub(p, start), along), size, size > 0), F.lit(0.0)))))


def closest_point_on_triangle(p: Point, a: Point, b: Point, c: Point) -> Point:
    """The point of a triangle that is nearest to p: the foot of the perpendicular if that lies inside, else the nearest point of the sides, of equally
    near ones that of the earlier side (ab, bc, ca). Fields of one struct that is worked out once."""
    n = cross(sub(b, a), sub(c, a))
    size = dot(n, n)
    inside = reduce(Column.__and__, (dot(cross(sub(e, s), sub(p, s)), n) >= 0 for s, e in ((a, b), (b, c), (c, a)))) & (size > CLOSEST_EPS)
    foot = sub(p, scale(n, F.coalesce(ratio(dot(sub(p, a), n), size, size > CLOSEST_EPS), F.lit(0.0))))
    on = lambda k, q: F.struct(squared_distance(p, q).alias("d"), F.lit(k).alias("k"), *(v.alias(x) for v, x in zip(q, "xyz", strict=True)))
    best = F.when(inside, on(0, foot)).otherwise(F.array_min(F.array(*(on(k, _on_side(p, s, e)) for k, (s, e) in enumerate(((a, b), (b, c), (c, a)))))))
    return tuple(best[k] for k in "xyz")


def squared_distance(p: Point, q: Point) -> Column:
    return dot(sub(p, q), sub(p, q))


def dist3(p: Point, q: Point) -> Column:
    return norm(sub(p, q))


# --- rays and boxes ------------------------------------------------------------------------------------------------------------


def ray_triangle(o: Point, d: Point, a: Point, b: Point, c: Point) -> Column:
    """t, u, v of a ray through a triangle from either side, t above 1e-8; null for a miss."""
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    ok = F.abs(det) >= RAY_EPS
    s = sub(o, a)
    q = cross(s, e1)
    u, v, t = ratio(dot(s, h), det, ok), ratio(dot(d, q), det, ok), ratio(dot(e2, q), det, ok)
    hit = (u >= -RAY_EPS) & (u <= 1 + RAY_EPS) & (v >= -RAY_EPS) & (u + v <= 1 + RAY_EPS) & (t > RAY_EPS)
    return F.when(hit, F.struct(t.alias("t"), u.alias("u"), v.alias("v")))


def vertical_z(x: Column, y: Column, a: Point, b: Point, c: Point) -> Column:
    """The height at which the vertical line through (x, y) meets a triangle; null where it doesn't."""
    det = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    ok = F.abs(det) >= RAY_EPS
    u = ratio((x - a[0]) * (c[1] - a[1]) - (y - a[1]) * (c[0] - a[0]), det, ok)
    v = ratio((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]), det, ok)
    return F.when((u >= -RAY_EPS) & (v >= -RAY_EPS) & (u + v <= 1 + RAY_EPS), a[2] + u * (b[2] - a[2]) + v * (c[2] - a[2]))


def aabb_expand(box: Column, p: Point) -> Column:
    """The box grown to hold a point."""
    low = [F.least(box[f"min{k}"], v).alias(f"min{k}") for v, k in zip(p, "xyz", strict=True)]
    high = [F.greatest(box[f"max{k}"], v).alias(f"max{k}") for v, k in zip(p, "xyz", strict=True)]
    return F.struct(*low, *high)


def aabb_union(box: Column, other: Column) -> Column:
    low = [F.least(box[f"min{k}"], other[f"min{k}"]).alias(f"min{k}") for k in "xyz"]
    high = [F.greatest(box[f"max{k}"], other[f"max{k}"]).alias(f"max{k}") for k in "xyz"]
    return F.struct(*low, *high)


def longest_axis(box: Column) -> Column:
    """0, 1 or 2; the earlier axis on ties."""
    x, y, z = (box[f"max{k}"] - box[f"min{k}"] for k in "xyz")
    return F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)


def aabb_intersects_ray(box: Column, o: Point, d: Point, t_max: float = 1e30) -> Column:
    """Slab test: the ray leaves after it enters, ahead of its origin. Along an axis it doesn't move on it must start inside."""
    enter, leave, inside = F.lit(0.0), F.lit(t_max), F.lit(True)
    for k, name in enumerate("xyz"):
        low, high = box[f"min{name}"], box[f"max{name}"]
        still = F.abs(d[k]) < 1e-12
        t1, t2 = ratio(low - o[k], d[k], ~still), ratio(high - o[k], d[k], ~still)
        inside = inside & (~still | ((o[k] >= low) & (o[k] <= high)))
        enter = F.greatest(enter, F.least(t1, t2))
        leave = F.least(leave, F.greatest(t1, t2))
    return inside & (leave >= enter) & (leave > 0)


def aabb_contains_xy(box: Column, p: Point, z_eps: float | None = None) -> Column:
    """Whether the box holds p in x and y, and with z_eps in the height band that it widens."""
    inside = p[0].between(box["minx"], box["maxx"]) & p[1].between(box["miny"], box["maxy"])
    return inside if z_eps is None else inside & (p[2] >= box["minz"] - z_eps) & (p[2] <= box["maxz"] + z_eps)


# --- keys, occupancy, angles ---------------------------------------------------------------------------------------------------


def edge_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def triangle_key(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))


def occ_to_u8(occ: Column) -> Column:
    """Occupancy -1..100 as a cost: unknown 255, 100 and above 254, else in proportion, halves away from zero."""
    return F.when(occ < 0, 255).when(occ >= 100, 254).otherwise(F.round(occ / F.lit(100.0) * 254.0)).cast("smallint")


def u8_to_occ(u8: Column) -> Column:
    return F.when(u8 == 255, -1).otherwise(F.round(u8 / F.lit(254.0) * 100.0)).cast("smallint")


def tri_index_for_cell(i: Column, j: Column, width: Column | int) -> Column:
    """The first of the two triangles of a grid cell."""
    return ((j * width + i) * 2).cast("long")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def angle_of(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def orientation_around_z(theta: Column) -> tuple[Column, Column, Column, Column]:
    """The quaternion (x, y, z, w) of a turn about +z."""
    return F.lit(0.0), F.lit(0.0), F.sin(theta) / (2.0 * F.cos(theta / 2.0)), F.cos(theta / 2.0)
