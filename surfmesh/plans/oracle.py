"""DuckDB SQL for the registered queries, written from what the operators mean: brute force where Spark uses cells."""

from __future__ import annotations


def _six(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) + 0.0 as {k}" for k, v in columns.items())


def _terrain(without: tuple[int, ...] = ()) -> str:
    out = f" and i not in ({', '.join(map(str, without))})" if without else ""
    return f"""
hm as (select max(p_partkey) // 40 as hmax from part),
vertices as (select p_partkey as vid, (p_partkey % 40)::double as x, (p_partkey // 40)::double as y, p_size / 64.0::double as z from part),
cells as (select p_partkey % 40 as i, p_partkey // 40 as j, p_partkey as v from part, hm where p_partkey % 40 < 39 and p_partkey // 40 < hmax{out}),
navcels as (
  select (j * 39 + i) * 2 as cid, v as v0, v + 1 as v1, v + 41 as v2 from cells
  union all select (j * 39 + i) * 2 + 1, v, v + 41, v + 40 from cells),
{_G},
occ as (select cid, cid % 256 as value from navcels),
cost as (select cid, case when cid % 101 = 0 then 'nan'::double else (cid % 97) * 3.25 - 20.0 end::double as value from navcels)"""


_G = """
g as (select cid, v0, v1, v2, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, c.x as cx, c.y as cy, c.z as cz
  from navcels join vertices a on a.vid = v0 join vertices b on b.vid = v1 join vertices c on c.vid = v2),
n as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as ny,
  (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as nz from g)"""

_POINTS = """
points as (select event_id as pid, ((event_id * 37) % 2496) / 64.0::double + 1 / 128.0::double as x,
  ((event_id * 101) % (64 * hmax)) / 64.0::double + 3 / 256.0::double as y, 10.0::double as z from events, hm)"""


def _floors(most: int = 5) -> str:
    return f"""
region_ as (select r_regionkey as k, r_name from region where r_regionkey < {most}),
vertices as (select k * 121 + c as vid, ((c % 11) * 4)::double as x, ((c // 11) * 4)::double as y, (k * 3)::double as z from region_, range(121) t(c)),
cells as (select k, c, k * 121 + (c // 10) * 11 + c % 10 as v from region_, range(100) t(c)),
navcels as (
  select (k * 100 + c) * 2 as cid, v as v0, v + 1 as v1, v + 12 as v2, k as surface from cells
  union all select (k * 100 + c) * 2 + 1, v, v + 12, v + 11, k from cells),
surface as (select cid, surface from navcels),
{_G},
fpoints as (select event_id as pid, ((event_id * 37) % 2560) / 64.0::double + 1 / 128.0::double as x,
  ((event_id * 101) % 2560) / 64.0::double + 3 / 256.0::double as y, (event_id % 15 - 1 + 0.0625)::double as z from events)"""


_OCC = "occupancy as (select p_partkey % 40 as i, p_partkey // 40 as j, case when p_size % 7 = 0 then -1 else 2 * p_size end as occ from part)"
_TO_U8 = "case when occ < 0 then 255 when occ >= 100 then 254 else round(occ / 100.0::double * 254.0::double) end::bigint"
_TO_OCC = "case when u8 = 255 then -1 else round(u8 / 254.0::double * 100.0::double) end::bigint"

#: Where the vertical line of a point p meets a triangle t: at z, if hit.
_VERTICAL = """
vert as (select p.pid, p.x as px, p.y as py, p.z as pz, t.cid, {surface} as surface,
    (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as det,
    (p.x - ax) * (cy - ay) - (p.y - ay) * (cx - ax) as un, (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) as vn, az, bz, cz
  from {points} p join {mesh} on p.x between least(ax, bx, cx) and greatest(ax, bx, cx) and p.y between least(ay, by_, cy) and greatest(ay, by_, cy)),
hits as (select pid, px, py, pz, cid, surface, un / det as u, vn / det as v, az + un / det * (bz - az) + vn / det * (cz - az) as z from vert
  where abs(det) >= 1e-8 and un / det >= -1e-8 and vn / det >= -1e-8 and (un + vn) / det <= 1 + 1e-8)"""


def _vertical(points: str, floors: bool = False) -> str:
    return _VERTICAL.format(points=points, surface="surface" if floors else "0", mesh="(select * from g join surface using (cid)) t" if floors else "g t")


#: Of both directions the lowest surface's nearest hit; the nearer one wins, down on ties; else the ends of the column within 0.5.
_LOCATE = """
dirs as (select *, case when z < pz then 0 else 1 end as dir, abs(z - pz) as dz from hits where abs(z - pz) > 1e-8),
per as (select * from dirs qualify row_number() over (partition by pid, dir order by surface, dz, cid) = 1),
vbest as (select * from per qualify row_number() over (partition by pid order by dz, dir) = 1),
ends_ as (select * from (select *, 0 as dir, abs(z - pz) as dz from hits qualify row_number() over (partition by pid order by z desc, surface, cid) = 1)
  union all select * from (select *, 1 as dir, abs(z - pz) as dz from hits qualify row_number() over (partition by pid order by z, surface, cid) = 1)),
fbest as (select * from ends_ where dz <= 0.5 qualify row_number() over (partition by pid order by dz, dir) = 1),
located as (select p.pid, coalesce(v.surface, f.surface) as surface, coalesce(v.cid, f.cid) as cid, coalesce(v.z, f.z) as hz, coalesce(v.u, f.u) as u, coalesce(v.v, f.v) as v
  from {points} p left join vbest v using (pid) left join fbest f using (pid))"""


def _locate(points: str, floors: bool = False) -> str:
    return _vertical(points, floors) + "," + _LOCATE.format(points=points)


_LOCATED = f"select pid, (cid is not null)::int::bigint as found, surface::bigint as surface, cid, {_six(hz='hz')} from located"

#: Möller-Trumbore of every ray with every triangle.
_RAYS = """
pre as (select r.*, t.cid, t.surface, ax, ay, az, bx - ax as e1x, by_ - ay as e1y, bz - az as e1z, cx - ax as e2x, cy - ay as e2y, cz - az as e2z
  from rays r, (select * from g join surface using (cid)) t),
det as (select *, dy * e2z - dz * e2y as hx, dz * e2x - dx * e2z as hy, dx * e2y - dy * e2x as hz, ox - ax as sx, oy - ay as sy, oz - az as sz from pre),
uv as (select *, e1x * hx + e1y * hy + e1z * hz as d, sy * e1z - sz * e1y as qx, sz * e1x - sx * e1z as qy, sx * e1y - sy * e1x as qz from det),
met as (select ray_id, cid, surface, (sx * hx + sy * hy + sz * hz) / d as u, (dx * qx + dy * qy + dz * qz) / d as v, (e2x * qx + e2y * qy + e2z * qz) / d as t from uv where abs(d) >= 1e-8),
hit as (select * from met where u >= -1e-8 and u <= 1 + 1e-8 and v >= -1e-8 and u + v <= 1 + 1e-8 and t > 1e-8)"""
_UPRIGHT = "rays as (select pid as ray_id, x as ox, y as oy, z as oz, 0.0::double as dx, 0.0::double as dy, case when pid % 2 = 0 then -1.0 else 1.0 end::double as dz from fpoints)"
_SLANT = """rays as (select pid as ray_id, x as ox, y as oy, z as oz, ((pid * 7) % 11 - 5) / 8.0::double + 1 / 32.0::double as dx,
  ((pid * 5) % 13 - 6) / 8.0::double + 1 / 64.0::double as dy, case when pid % 2 = 0 then -1.0 else 1.0 end::double as dz from fpoints)"""


def _raycast(rays: str, order: str) -> str:
    return f"""with {_floors()}, {rays}, {_RAYS},
best as (select * from hit qualify row_number() over (partition by ray_id order by {order}) = 1)
select ray_id, (b.cid is not null)::int::bigint as hit, b.surface::bigint as surface, b.cid, {_six(t='b.t')} from rays left join best b using (ray_id)"""


#: The nearest point of a triangle: the foot of the perpendicular if it lies inside, else the nearest point of the three sides.
_CLOSEST = """
pt as (select p.pid, p.x as px, p.y as py, p.z as pz, t.* from {points} p, (select * from g join surface using (cid){where}) t),
sides as (select pid, cid, surface, px, py, pz, unnest([
    {{'sx': ax, 'sy': ay, 'sz': az, 'dx': bx - ax, 'dy': by_ - ay, 'dz': bz - az}},
    {{'sx': bx, 'sy': by_, 'sz': bz, 'dx': cx - bx, 'dy': cy - by_, 'dz': cz - bz}},
    {{'sx': cx, 'sy': cy, 'sz': cz, 'dx': ax - cx, 'dy': ay - cy, 'dz': az - cz}}]) as s from pt),
along as (select *, greatest(0.0, least(1.0, ((px - s.sx) * s.dx + (py - s.sy) * s.dy + (pz - s.sz) * s.dz) / (s.dx * s.dx + s.dy * s.dy + s.dz * s.dz))) as k from sides),
cand as (
  select pid, cid, surface, px, py, pz, s.sx + k * s.dx as qx, s.sy + k * s.dy as qy, s.sz + k * s.dz as qz from along
  union all
  select pid, cid, surface, px, py, pz, px, py, az from pt
  where (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) >= 0 and (cx - bx) * (py - by_) - (cy - by_) * (px - bx) >= 0 and (ax - cx) * (py - cy) - (ay - cy) * (px - cx) >= 0),
far as (select *, (px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2 as sq from cand),
best as (select * from far qualify row_number() over (partition by pid order by round(sq, 9), surface, cid) = 1)"""


def _closest(points: str, where: str = "") -> str:
    return f"with {_floors()}, {points}, {_CLOSEST.format(points='cpoints', where=where)} select pid, surface::bigint as surface, {_six(sqdist='sq', qx='qx', qy='qy', qz='qz')} from best"


def _area(inside: str, half: float, without: tuple[int, ...] = ()) -> str:
    return f"""with recursive {_terrain(without)},
spot as (select 0 as pid, 20.3::double as x, 2.6::double as y, 5.0::double as z), {_locate('spot')},
centre as (select 20.3::double as x, 2.6::double as y, cid as seed from located),
near as (select g.* from g, centre s where least(ax, bx, cx) <= s.x + {half} and greatest(ax, bx, cx) >= s.x - {half} and least(ay, by_, cy) <= s.y + {half} and greatest(ay, by_, cy) >= s.y - {half}),
side as (select cid, least(v0, v1) as lo, greatest(v0, v1) as hi from near union all select cid, least(v1, v2), greatest(v1, v2) from near union all select cid, least(v2, v0), greatest(v2, v0) from near),
link as (select a.cid as a, b.cid as b from side a join side b using (lo, hi) where a.cid <> b.cid),
reach as (select seed as cid from centre union select link.b from reach join link on link.a = reach.cid),
inside as (select n.cid from near n join reach using (cid), centre s where {inside})
select cid, case when cid in (select cid from inside) then 254 else value end::bigint as value from occ"""


_MX, _MY = "((ax + bx + cx) / 3.0 - s.x)", "((ay + by_ + cy) / 3.0 - s.y)"
_CIRCLE = f"{_MX} * {_MX} + {_MY} * {_MY} <= 25.0"


def _components(without: tuple[int, ...]) -> str:
    """Missing columns of cells cut the terrain in strips: a strip is a component, whose least triangle is in its first column."""
    starts = [0, *(w + 1 for w in without)]
    strip = " ".join(f"when i < {w} then {s}" for w, s in zip(without, starts, strict=False))
    return f"select cid, 2 * (case {strip} else {starts[-1]} end) as root from (select cid, (cid // 2) % 39 as i from navcels)"


_EDGES = """edge as (select cid, 0 as e, least(v0, v1) as lo, greatest(v0, v1) as hi from navcels union all select cid, 1, least(v1, v2), greatest(v1, v2) from navcels
  union all select cid, 2, least(v2, v0), greatest(v2, v0) from navcels),
adj as (select a.cid, a.e, b.cid as neighbor from edge a left join edge b on a.lo = b.lo and a.hi = b.hi and a.cid <> b.cid)"""

_LENGTHS = """side as (select *, sqrt((bx - cx) ** 2 + (by_ - cy) ** 2 + (bz - cz) ** 2) as la, sqrt((ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2) as lb,
  sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) as lc from n),
angle as (select *, degrees(acos((lb * lb + lc * lc - la * la) / (2 * lb * lc))) as angle_a, degrees(acos((la * la + lc * lc - lb * lb) / (2 * la * lc))) as angle_b,
  degrees(acos((la * la + lb * lb - lc * lc) / (2 * la * lb))) as angle_c from side)"""

_PAIRS = f"""with {_terrain()}, pair as (select a.vid as pid, b.vid as nid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as dist from vertices a join vertices b
  on b.x between a.x - 6 and a.x + 6 and b.y between a.y - 6 and a.y + 6 and a.vid <> b.vid)"""

_TOP = "(select greatest(0.0, max(value)) from cost where not isnan(value))"
_SHARE = f"case when isnan(value) then 1.0 else greatest(0.0, least(1.0, value / {_TOP})) end"

T = _terrain()
F = _floors()

SQL: dict[str, str] = {
    "tri_area": f"with {T} select cid, {_six(area='sqrt(nx * nx + ny * ny + nz * nz) / 2')} from n",
    "tri_normal": f"with {T}, u as (select *, sqrt(nx * nx + ny * ny + nz * nz) as len from n) select cid, {_six(nx='nx / len', ny='ny / len', nz='nz / len')} from u",
    "centroid": f"with {T} select cid, {_six(x='(ax + bx + cx) / 3.0', y='(ay + by_ + cy) / 3.0', z='(az + bz + cz) / 3.0')} from g",
    "surface_aabb": f"with {F} select k::bigint as surface_idx, r_name as frame_id, min(x) as minx, min(y) as miny, min(z) as minz, max(x) as maxx, max(y) as maxy, max(z) as maxz from region_ join vertices on vid // 121 = k group by k, r_name",
    "mesh_stats": f"with {T} select (select count(*) from vertices) as n_vertices, (select count(*) from navcels) as n_navcels, 1::bigint as n_surfaces, 2::bigint as n_layers",
    "adjacency": f"with {T}, {_EDGES} select cid, e::bigint as e, neighbor from adj",
    "boundary_edges": f"with {T}, {_EDGES} select cid, e::bigint as e from adj where neighbor is null",
    "neighbors_list": f"with {T}, {_EDGES} select cid, coalesce(string_agg(neighbor::varchar, ',' order by e) filter (neighbor is not null), '') as neighbors from adj group by cid",
    "triangle_angles": f"with {T}, {_LENGTHS} select cid, {_six(angle_a='angle_a', angle_b='angle_b', angle_c='angle_c')} from angle",
    "triangle_filters": f"""with {T}, {_LENGTHS}, test as (select cid, greatest(la, lb, lc) <= 1.5 as edges_ok, greatest(abs(az - bz), abs(bz - cz), abs(az - cz)) <= 0.3 as dz_ok,
  sqrt(nx * nx + ny * ny + nz * nz) / 2 >= 1e-6 as area_ok, nz / sqrt(nx * nx + ny * ny + nz * nz) >= cos(radians(30)) as slope_ok, least(angle_a, angle_b, angle_c) >= 40 as angle_ok from angle)
select cid, edges_ok::int::bigint as edges_ok, dz_ok::int::bigint as dz_ok, area_ok::int::bigint as area_ok, slope_ok::int::bigint as slope_ok, angle_ok::int::bigint as angle_ok,
  (edges_ok and dz_ok and area_ok and slope_ok and angle_ok)::int::bigint as accepted from test""",
    "occ_to_u8": f"with {_OCC} select i::bigint as i, j::bigint as j, occ::bigint as occ, {_TO_U8} as u8 from occupancy",
    "u8_to_occ": f"with v as (select distinct p_partkey % 256 as u8 from part) select u8::bigint as u8, {_TO_OCC} as occ from v",
    "grid_vertices": "with s as (select count(*) // 40 as h from part) select k as vid, (k % 41) * 0.5::double as x, (k // 41) * 0.5::double as y, 0.0::double as z from s, range(41 * (h + 1)) t(k)",
    "grid_triangles": """with s as (select count(*) // 40 as h from part), c as (select k, (k // 40) * 41 + k % 40 as v from s, range(40 * h) t(k))
select 2 * k as cid, v as v0, v + 1 as v1, v + 42 as v2 from c union all select 2 * k + 1, v, v + 42, v + 41 from c""",
    "grid_occupancy_layer": f"with {_OCC}, u as (select (j * 40 + i) * 2 as cid, {_TO_U8} as value from occupancy) select cid, value from u union all select cid + 1, value from u",
    "grid_roundtrip": f"with {_OCC} select i::bigint as i, j::bigint as j, occ::bigint as occ from occupancy",
    "to_grid_generic": f"with {_OCC} select i::bigint as i, j::bigint as j, occ::bigint as occ from occupancy",
    "elevation_layer": f"with {T} select cid, round(((az + bz + cz) / 3.0)::float::double, 5) as value from g",
    "layer_add_default": f"with {T} select cid, 7.5::double as value from navcels",
    "layer_add_from_layer": f"with {T} select cid, case when isnan(value) then 0 else greatest(0, least(255, round(value))) end::bigint as value from cost",
    "layer_get_cast": f"""with {T} select event_id::bigint as event_id, (event_id * 7) % 4000 as cid, case when cost.value is null then 9 when isnan(cost.value) then 0 else greatest(0, least(255, round(cost.value))) end::bigint as value
from events left join cost on cost.cid = (event_id * 7) % 4000""",
    "layer_set_bulk": f"with {T}, u as (select (event_id * 13) % 5000 as cid, max(event_id % 300) as value from events group by 1) select cid, case when u.value is null then occ.value else least(255, u.value) end::bigint as value from occ left join u using (cid)",
    "layer_copy": f"with {T} select layer, cid, value::bigint as u8 from occ, (values ('occ'), ('occ2')) t(layer)",
    "layer_clear": f"with {T} select cid, 254::bigint as value from navcels",
    "layer_catalog": f"with {T} select * from (select 'occ' as name, 'uint8' as type, count(*)::bigint as n, 'cost' as description, 'level' as unit from occ union all select 'cost', 'double', count(*), 'signed cost', 's' from cost)",
    "layer_sync": f"with {T} select 'occ' as layer, count(*)::bigint as n, sum(value)::bigint as total from occ union all select 'cost', count(*), null from cost",
    "geometry_same": "select 'same' as which, 1::bigint as same union all select 'moved', 0",
    "raycast_nearest": _raycast(_UPRIGHT, "t, surface, cid"),
    "raycast_first_surface": _raycast(_UPRIGHT, "surface, t, cid"),
    "raycast_oblique": _raycast(_SLANT, "t, surface, cid"),
    "locate_terrain": f"with {T}, {_POINTS}, {_locate('points')} select pid, cid, {_six(hz='hz', b0='1 - u - v', b1='u', b2='v')} from located",
    "locate_floors": f"with {F}, {_locate('fpoints', True)} {_LOCATED}",
    "locate_fallback_height": f"with {_floors(1)}, p0 as (select pid, x, y, case when pid % 2 = 0 then 0.0 else z end::double as z from fpoints), {_locate('p0', True)} {_LOCATED}",
    "locate_hint": f"""with {F}, p0 as (select pid, x, y, ((pid % 5) * 3 + case when pid % 4 = 0 then 0.25 else 0.75 end)::double as z,
  case when pid % 3 < 2 then ((pid % 5) * 100 + floor(y / 4) * 10 + floor(x / 4))::bigint * 2 + pid % 2 end as hint from fpoints), {_locate('p0', True)},
ok as (select p.pid, t.cid, t.surface, az from p0 p join (select * from g join surface using (cid)) t on t.cid = p.hint where abs(p.z - az) <= 0.5
  and ((t.cid % 2 = 0 and p.x - ax >= p.y - ay) or (t.cid % 2 = 1 and p.x - ax <= p.y - ay)))
select pid, (coalesce(ok.cid, l.cid) is not null)::int::bigint as found, coalesce(ok.surface, l.surface)::bigint as surface, coalesce(ok.cid, l.cid) as cid, {_six(hz='coalesce(ok.az, hz)')} from located l left join ok using (pid)""",
    "locate_walking": f"""with {F} select pid, 1::bigint as found, (floor(y / 4) * 10 + floor(x / 4))::bigint * 2 + case when x - floor(x / 4) * 4 >= y - floor(y / 4) * 4 then 0 else 1 end as cid from fpoints""",
    "sample_layer": f"with {T}, {_POINTS}, {_locate('points')} select pid, cid, {_six(value='case when value is null or isnan(value) then -1.0 else value end')} from located left join cost using (cid)",
    "closest_navcel": _closest("cpoints as (select pid, x * 1.5 - 10.0 as x, y * 1.25 - 5.0 as y, z from fpoints)"),
    "closest_restricted": _closest("cpoints as (select * from fpoints)", " where surface = 2"),
    "radius_neighbors": f"{_PAIRS} select pid, nid, {_six(dist='dist')} from pair where dist <= 1.5",
    "knn_neighbors": f"{_PAIRS}, r as (select *, row_number() over (partition by pid order by dist, nid) as rank from pair) select pid, nid, rank::bigint as rank, {_six(dist='dist')} from r where rank <= 5",
    "pick_pose": f"""with {F}, rays as (select pid as ray_id, x * 2 as ox, y as oy, 20.0::double as oz, 0.25::double as dx, 0.0::double as dy, -1.0::double as dz from fpoints), {_RAYS},
best as (select * from hit qualify row_number() over (partition by ray_id order by t, surface, cid) = 1)
select ray_id, (b.cid is not null)::int::bigint as hit, {_six(px='ox + 0.25 * coalesce(b.t, oz)', py='oy', pz='oz - coalesce(b.t, oz)')} from rays left join best b using (ray_id)""",
    "set_area_circle": _area(_CIRCLE, 5.0),
    "set_area_rect": _area(f"abs({_MX}) <= 3.5 and abs({_MY}) <= 3.5", 3.5),
    "set_area_blocked": _area(_CIRCLE, 5.0, (22,)),
    "components": f"with {_terrain((9, 19, 29))} {_components((9, 19, 29))}",
    "top_surfaces": f"""with {_terrain((4, 15))}, c as ({_components((4, 15))}), s as (select root, count(*) as n, min(cid) as first from c group by root)
select (row_number() over (order by n desc, root) - 1)::bigint as surface_idx, n::bigint as n, first::bigint as first from s qualify row_number() over (order by n desc, root) <= 2""",
    "remove_surface": f"with {F} select (case when k > 2 then k - 1 else k end)::bigint as surface_idx, r_name as frame_id, count(*)::bigint as n, min(cid)::bigint as first from region_ join surface on surface = k where k <> 2 group by k, r_name",
    "voxel_topz": f"""with c as (select l_partkey / 64.0::double as x, l_suppkey / 64.0::double as y, l_quantity / 16.0::double as z from lineitem), b as (select *, floor(x)::bigint as vx, floor(y)::bigint as vy from c),
s as (select *, case when z - lag(z) over (partition by vx, vy order by z) > 0.3 then 1 else 0 end as new from b), l as (select *, sum(new) over (partition by vx, vy order by z rows unbounded preceding) as k from s)
select vx, vy, k::bigint as k, {_six(x='avg(x)', y='avg(y)', z='max(z)')} from l group by vx, vy, k""",
    "color_u8": f"with {T}, c as (select cid, case value when 0 then 1.0 when 255 then 0.25 when 254 then 0.0 else 1.0 - value / 253.0::double end::double as grey from occ) select cid, {_six(r='grey', g='grey', b='grey')} from c",
    "color_heat": f"with {T}, c as (select cid, {_SHARE} as s from cost) select cid, {_six(r='s', g='1.0 - s', b='0.0::double')} from c",
    "color_rainbow": f"""with {T}, c as (select cid, (1.0 - ({_SHARE})) * 4.0 as h from cost)
select cid, {_six(r='case when h < 1 then 1.0 when h < 2 then 2.0 - h else 0.0 end::double', g='case when h < 1 then h when h < 3 then 1.0 else 4.0 - h end::double', b='case when h < 2 then 0.0 when h < 3 then h - 2.0 else 1.0 end::double')} from c""",
    "normal_segments": f"""with {T}, u as (select *, sqrt(nx * nx + ny * ny + nz * nz) as len, (ax + bx + cx) / 3.0 as mx, (ay + by_ + cy) / 3.0 as my, (az + bz + cz) / 3.0 as mz from n)
select cid, {_six(x0='mx', y0='my', z0='mz', x1='mx + 0.5 * nx / len', y1='my + 0.5 * ny / len', z1='mz + 0.5 * nz / len')} from u""",
    "vertex_colors": f"with {T} select vid, {_six(r='(vid % 256) / 255.0::double', g='(vid * 3 % 256) / 255.0::double', b='(vid * 7 % 256) / 255.0::double', a='0.5::double')} from vertices",
    "json_roundtrip": f"""with {_OCC}, s as (select count(*) // 40 as h from part), c as (select i, j, (j * 40 + i) * 2 as cid, j * 41 + i as v, {_TO_U8} as value from occupancy)
select cid, v as v0, v + 1 as v1, v + 42 as v2, i * 0.5::double as ax, j * 0.5::double as ay, 0.0::double as az, value from c
union all select cid + 1, v, v + 42, v + 41, i * 0.5::double, j * 0.5::double, 0.0::double, value from c""",
    "message_roundtrip": f"with {T} select cid, v0, v1, v2, ax, ay, az, occ.value::bigint as occ, case when isnan(cost.value) then null else cost.value end as cost from g join occ using (cid) join cost using (cid)",
    "layer_update_latest": f"select layer, cid, {_six(value='value')} from (select event_type as layer, event_id % 307 as cid, value::double as value, row_number() over (partition by event_type, event_id % 307 order by ts desc, event_id desc) as k from events) where k = 1",
    "layer_update_rejects": """select event_id::bigint as event_id, case when event_id % 5 = 0 then 'not exactly one array has values' when event_id % 3 + 1 <> 2 then 'its length is not the number of triangles' else '' end as why from events""",
    "update_counters": "select event_type as name, count(*)::bigint as n_messages, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_stamp from events group by event_type",
}
