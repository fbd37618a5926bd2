"""Scalar geometry against known values and random brute force."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from surfmesh.functions import color, geom


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


P = geom.lit


def test_area_and_normal(spark):
    a, b, c = P(0, 0, 0), P(1, 0, 0), P(0, 1, 0)
    r = one(spark, geom.triangle_area(a, b, c), geom.triangle_area(P(0, 0, 0), P(2, 0, 0), P(0, 3, 0)), geom.triangle_area(a, P(1, 1, 1), P(2, 2, 2)), *geom.triangle_normal(a, b, c), *geom.triangle_normal(a, a, b))
    assert list(r) == pytest.approx([0.5, 3.0, 0.0, 0, 0, 1, 0, 0, 1])


def test_rounding_is_that_of_scaled_doubles(spark):
    """A mean of ten multiples of 1/64 can lie next to a tie at the seventh digit: as a double 323/640 is just below it."""
    values = [323 / 640, k := 0.5 / 1e6, -k, 1 / 3, -2.0, 1e12 + 0.25, math.inf] + [n / 640 for n in range(1, 4000, 2)]
    want = [row[0] for row in duckdb.sql(f"select round(unnest({[str(v) for v in values]}::double[]), 6)").fetchall()]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.r for r in df.select("i", geom.rounded("v", 6).alias("r")).orderBy("i").collect()] == want
    assert any(r.r != w for r, w in zip(df.select("i", F.round("v", 6).alias("r")).orderBy("i").collect(), want, strict=True))


def test_ray_triangle(spark):
    t = P(0, 0, 0), P(1, 0, 0), P(0, 1, 0)
    cast = lambda o, d: geom.ray_triangle(P(*o), P(*d), *t)
    r = one(spark, cast((0.2, 0.2, 1), (0, 0, -1)), cast((2, 2, 1), (0, 0, -1)), cast((0.2, 0.2, 1), (0, 0, 1)), cast((0.2, 0.2, -1), (0, 0, 1)), cast((0.5, 0.5, 1), (0, 0, -1)), cast((0.2, 0.2, 1), (1, 0, 0)))
    assert r[0].t == pytest.approx(1) and r[1] is None and r[2] is None
    assert r[3].t == pytest.approx(1)  # from behind
    assert r[4].t == pytest.approx(1)  # on an edge
    assert r[5] is None


def box(*v):
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("minx", "miny", "minz", "maxx", "maxy", "maxz"))))


def test_boxes(spark):
    b = box(0, 0, 0, 1, 1, 1)
    hit = lambda o, d: geom.aabb_intersects_ray(b, P(*o), P(*d))
    r = one(
        spark, hit((-1, 0.5, 0.5), (1, 0, 0)), hit((-1, 2, 0.5), (1, 0, 0)), hit((0.5, 0.5, 0.5), (0, 0, 1)), hit((2, 0.5, 0.5), (1, 0, 0)), hit((-1, -1, -1), (1, 1, 1)),
        geom.longest_axis(box(0, 0, 0, 1, 1, 1)), geom.longest_axis(box(0, 0, 0, 1, 2, 2)), geom.longest_axis(box(0, 0, 0, 1, 2, 3)),
        geom.aabb_contains_xy(b, P(1, 1, 5)), geom.aabb_contains_xy(b, P(1, 1, 1.2), 0.3), geom.aabb_contains_xy(b, P(1, 1, 1.4), 0.3),
        geom.aabb_expand(b, P(2, -1, 0.5)), geom.aabb_union(b, box(-1, 0, 0, 0, 0, 5)), geom.triangle_aabb(P(0, 5, 2), P(3, 1, 0), P(1, 1, 9)),
    )
    assert list(r[:11]) == [True, False, True, False, True, 0, 1, 2, True, True, False]
    assert tuple(r[11]) == (0, -1, 0, 2, 1, 1) and tuple(r[12]) == (-1, 0, 0, 1, 1, 5) and tuple(r[13]) == (0, 1, 0, 3, 5, 9)


def nearest(p, t, steps=200):
    best = 1e300
    for i in range(steps + 1):
        for j in range(steps + 1 - i):
            u, v = i / steps, j / steps
            q = [t[0][k] + u * (t[1][k] - t[0][k]) + v * (t[2][k] - t[0][k]) for k in range(3)]
            best = min(best, math.dist(p, q))
    return best


def test_closest_point(spark):
    rng = random.Random(1)
    rows = [(k, *(float(rng.uniform(-2, 2)) for _ in range(12))) for k in range(60)]
    names = [f"{p}{k}" for p in "pabc" for k in "xyz"]
    df = spark.createDataFrame(rows, ["k", *names])
    p, a, b, c = (geom.point(n) for n in "pabc")
    q = geom.closest_point_on_triangle(p, a, b, c)
    for r, row in zip(df.select("k", geom.squared_distance(p, q).alias("d"), *(v.alias(f"q{n}") for v, n in zip(q, "xyz"))).orderBy("k").collect(), rows):
        pts = [row[1 + 3 * i : 4 + 3 * i] for i in range(4)]
        want = nearest(pts[0], pts[1:])
        assert math.sqrt(r.d) <= want + 1e-9 and math.sqrt(r.d) >= want - 0.05
    flat = one(spark, *geom.closest_point_on_triangle(P(0, 1, 0), P(0, 0, 0), P(0, 0, 0), P(0, 0, 0)))
    assert list(flat) == [0, 0, 0]


def test_angles_and_barycentric(spark):
    a, b, c = P(0, 0, 0), P(1, 0, 0), P(0, 1, 0)
    r = one(spark, *geom.triangle_angles_deg(a, b, c), *geom.barycentric(P(0.25, 0.5, 3), a, b, c), geom.point_in_triangle(P(0.25, 0.5, 3), a, b, c, 1e-4), geom.point_in_triangle(P(1, 1, 0), a, b, c, 1e-4), geom.point_in_triangle(P(0, 0, 0), a, a, a, 1e-4))
    assert list(r[:6]) == pytest.approx([90, 45, 45, 0.25, 0.25, 0.5]) and list(r[6:]) == [True, False, False]


def test_occupancy_codes_are_inverse(spark):
    rows = spark.range(-1, 101).select(F.col("id").alias("o"), geom.u8_to_occ(geom.occ_to_u8(F.col("id"))).alias("back"), geom.occ_to_u8(F.col("id")).alias("u")).collect()
    assert all(r.o == r.back for r in rows)
    assert {r.o: r.u for r in rows if r.o in (-1, 0, 25, 75, 100)} == {-1: 255, 0: 0, 25: 64, 75: 191, 100: 254}


def test_colors(spark):
    f = lambda x: F.lit(float(x))
    r = one(spark, *color.hsv2rgb(f(0), f(1), f(1)), *color.hsv2rgb(f(120), f(1), f(1)), *color.hsv2rgb(f(240), f(1), f(0.5)), *color.color_heat(f(5), f(10)), *color.color_heat(f("nan"), f(10)), *color.color_rainbow(f(0), f(10)), *color.color_rainbow(f(1), f(0)))
    assert list(r) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 0.5, 0.5, 0.5, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0])


def test_turns(spark):
    x, y, z, w = one(spark, *geom.orientation_around_z(geom.angle_of(F.lit(0.0), F.lit(2.0))))
    assert (x, y) == (0, 0) and (z, w) == pytest.approx((math.sin(math.pi / 4), math.cos(math.pi / 4)))
