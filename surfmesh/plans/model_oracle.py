"""DuckDB SQL for the queries of model_queries.py."""

from __future__ import annotations

from surfmesh.plans.oracle import _OCC, _TO_U8, SQL as _OTHER, F, T, _six

_BOX = "least(ax, bx, cx) as minx, least(ay, by_, cy) as miny, least(az, bz, cz) as minz, greatest(ax, bx, cx) as maxx, greatest(ay, by_, cy) as maxy, greatest(az, bz, cz) as maxz"
_BOXES = f"box as (select *, {_BOX} from g)"


def _slab(axis: str, o: float, d: str) -> str:
    return f"case when abs({d}) < 1e-12 then null else least((min{axis} - {o}) / nullif({d}, 0), (max{axis} - {o}) / nullif({d}, 0)) end as n{axis}, case when abs({d}) < 1e-12 then null else greatest((min{axis} - {o}) / nullif({d}, 0), (max{axis} - {o}) / nullif({d}, 0)) end as f{axis}, abs({d}) >= 1e-12 or ({o} between min{axis} and max{axis}) as i{axis}"


SQL: dict[str, str] = {
    "create_surface": "select r_regionkey::bigint as surface_idx, r_name as frame_id from region where r_regionkey < 5 union all select count(*), 'extra' from region where r_regionkey < 5",
    "add_surface": "with k as (select count(*) as k from region where r_regionkey < 5) select k::bigint as surface_idx, 0::bigint as pos, 7::bigint as cid from k union all select k, 1, 3 from k",
    "add_vertices": f"with {F} select vid, {_six(x='x', y='y', z='z')} from vertices union all select count(*), 1.0, 2.0, 3.0 from vertices union all select count(*) + 1, 4.0, 5.0, 6.5 from vertices",
    "add_navcels": f"with {F} select cid::bigint as cid, v0::bigint as v0, v1::bigint as v1, v2::bigint as v2 from navcels union all select count(*), 0, 1, 2 from navcels union all select count(*) + 1, 2, 1, 13 from navcels",
    "add_to_surface": f"with {F} select surface::bigint as surface_idx, (count(*) + case when surface = 1 then 2 else 0 end)::bigint as n, (count(*) - 1 + case when surface = 1 then 2 else 0 end)::bigint as last from surface group by surface",
    "transformed": f"with {T} select vid, {_six(x='10 - y', y='x - 2', z='z + 0.5')} from vertices",
    "assigned_layers": f"with {T} select 'occ' as layer, cid::bigint as cid, value::bigint as value from occ",
    "layer_remove": f"with {T} select 'cost' as name, 'double' as type, count(*)::bigint as n from cost",
    "layers_resized": f"with {T} select cid, (case when cid % 2 = 0 then cid % 200 else 0 end)::bigint as value from navcels",
    "layer_hash_fnv": f"""with recursive {T},
sized as (select count(*) as n from occ),
bytes as (
  select i as k, ((n >> (8 * i)) & 255)::hugeint as b from sized, range(8) t(i)
  union all select 7 + row_number() over (order by cid), value::hugeint from occ),
h(k, h) as (
  select -1::bigint, 14695981039346656037::hugeint
  union all
  select h.k + 1, (xor(h.h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint from h join bytes on bytes.k = h.k + 1)
select 'occ' as layer, h::varchar as hash from h, sized where k = n + 7""",
    "layer_wide": f"with {T} select cid, case when isnan(cost.value) then null else cost.value + occ.value * 2.0 end as mixed from occ join cost using (cid)",
    "style_options": f"""with {T}
select * from (values ('option', 'cost'), ('option', 'occ'), ('scheme of occ', 'cost'), ('scheme of cost', 'heat'), ('scheme of cost', 'rainbow'), ('selected', 'occ'), ('selected of none', 'cost')) t(kind, value)
union all select 'info', 'Surfaces: 1 | Triangles: ' || count(*) from navcels""",
    "triangle_boxes": f"with {T} select cid, {_BOX} from g",
    "box_expand": f"with {T}, {_BOXES} select cid, least(minx, 20.5) as minx, least(miny, 1.5) as miny, least(minz, -1.0) as minz, greatest(maxx, 20.5) as maxx, greatest(maxy, 1.5) as maxy, greatest(maxz, -1.0, az + 2.0) as maxz from box",
    "box_longest_axis": f"with {T}, {_BOXES} select cid, (case when maxx - minx >= maxy - miny and maxx - minx >= maxz - minz then 0 when maxy - miny >= maxz - minz then 1 else 2 end)::bigint as axis from box",
    "box_ray": f"""with {T}, {_BOXES}, d as (select *, (cid % 5 - 2) * 0.25::double as dx, (cid % 3 - 1) * 0.5::double as dy from box),
s as (select cid, {_slab('x', 20.25, 'dx')}, {_slab('y', 2.125, 'dy')}, {_slab('z', 8.0, '-1.0::double')} from d),
e as (select cid, ix and iy and iz as inside, greatest(0.0, nx, ny, nz) as enter, least(1e30, fx, fy, fz) as leave from s)
select cid, (inside and leave >= enter and leave > 0)::int::bigint as hit from e""",
    "box_contains": f"""with {T}, {_BOXES}, p as (select *, cid % 40 + 0.5::double as px from box), q as (select *, px between minx and maxx and 1.25 between miny and maxy as in_ from p)
select cid, in_::int::bigint as in_xy, (in_ and 0.3 >= minz - 0.1 and 0.3 <= maxz + 0.1)::int::bigint as in_band from q""",
    "geometry_keys": f"with {T} select cid, least(v0, v2) as lo, greatest(v0, v2) as hi, array_to_string(list_sort([v0, v1, v2]), '-') as key from g",
    "orientation": f"""with {T}, a as (select vid, atan2(y - 3.5, x + 1.0) as theta from vertices)
select vid, {_six(theta='theta', qx='0.0::double', qy='0.0::double', qz='sin(theta) / (2 * cos(theta / 2))', qw='cos(theta / 2)')} from a""",
    "ray_triangle": f"""with {T}, r as (select *, (ax + bx + cx) / 3 + (cid % 7) * 0.0625 as ox, (ay + by_ + cy) / 3 - (cid % 7) * 0.03125 as oy, 9.0::double as oz, 0.015625::double as dy from g),
e as (select *, bx - ax as ex, by_ - ay as ey, bz - az as ez, cx - ax as fx, cy - ay as fy, cz - az as fz, ox - ax as sx, oy - ay as sy, oz - az as sz from r),
h as (select *, dy * fz + fy as hx, -fx as hy, -dy * fx as hz, sy * ez - sz * ey as qx, sz * ex - sx * ez as qy, sx * ey - sy * ex as qz from e),
m as (select *, ex * hx + ey * hy + ez * hz as det from h),
w as (select cid, (sx * hx + sy * hy + sz * hz) / det as u, (dy * qy - qz) / det as v, (fx * qx + fy * qy + fz * qz) / det as t from m where abs(det) >= 1e-8),
ok as (select * from w where u >= -1e-8 and u <= 1 + 1e-8 and v >= -1e-8 and u + v <= 1 + 1e-8 and t > 1e-8)
select cid, {_six(t='t', u='u', v='v')} from g left join ok using (cid)""",
    "closest_point": f"""with {T}, p as (select *, ax + (cid % 9 - 4) * 0.375 + 1 / 32.0::double as px, ay + (cid % 4 - 1) * 0.5 + 1 / 64.0::double as py, az + 1.5 as pz from n),
side as (select cid, px, py, pz, k, unnest([
    {{'x': ax, 'y': ay, 'z': az, 'dx': bx - ax, 'dy': by_ - ay, 'dz': bz - az}}, {{'x': bx, 'y': by_, 'z': bz, 'dx': cx - bx, 'dy': cy - by_, 'dz': cz - bz}},
    {{'x': cx, 'y': cy, 'z': cz, 'dx': ax - cx, 'dy': ay - cy, 'dz': az - cz}}]) as s from (select *, 0 as k from p)),
along as (select *, greatest(0.0, least(1.0, ((px - s.x) * s.dx + (py - s.y) * s.dy + (pz - s.z) * s.dz) / (s.dx ** 2 + s.dy ** 2 + s.dz ** 2))) as t from side),
cand as (
  select cid, px, py, pz, s.x + t * s.dx as qx, s.y + t * s.dy as qy, s.z + t * s.dz as qz from along
  union all
  select cid, px, py, pz, px - nx * w, py - ny * w, pz - nz * w from (
    select *, ((px - ax) * nx + (py - ay) * ny + (pz - az) * nz) / (nx * nx + ny * ny + nz * nz) as w from p)
  where ((by_ - ay) * (pz - az) - (bz - az) * (py - ay)) * nx + ((bz - az) * (px - ax) - (bx - ax) * (pz - az)) * ny + ((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) * nz >= 0
    and ((cy - by_) * (pz - bz) - (cz - bz) * (py - by_)) * nx + ((cz - bz) * (px - bx) - (cx - bx) * (pz - bz)) * ny + ((cx - bx) * (py - by_) - (cy - by_) * (px - bx)) * nz >= 0
    and ((ay - cy) * (pz - cz) - (az - cz) * (py - cy)) * nx + ((az - cz) * (px - cx) - (ax - cx) * (pz - cz)) * ny + ((ax - cx) * (py - cy) - (ay - cy) * (px - cx)) * nz >= 0),
best as (select *, (px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2 as d from cand qualify row_number() over (partition by cid order by round(d, 9)) = 1)
select cid, {_six(qx='qx', qy='qy', qz='qz')} from best""",
    "file_message": _OTHER["message_roundtrip"],
    "file_map": _OTHER["message_roundtrip"],
    "parquet_map": _OTHER["message_roundtrip"],
    "file_many": f"with {F}, sizes as (select count(*) as s from region_), t as (select surface, count(*) as c from surface group by surface), a as (select sum(c) as c from t) select 'm' || surface as name, (s - 1)::bigint as n_surfaces, a.c::bigint as n_navcels from t, sizes, a where surface < 3",
    "layer_message": f"with {T} select cid, case when isnan(value) then null else value end as cost from cost",
    "stream_grid": f"with {_OCC}, s as (select count(*) // 40 as h from part), u as (select (j * 40 + i) * 2 as cid, {_TO_U8} as value from occupancy, s where j < h) select cid::bigint as cid, value from u union all select cid + 1, value from u",
    "stream_updates": f"with {F} select cid::bigint as cid, (cid * 3)::double as value from navcels",
    "lost_messages": "select event_type as name, count(distinct event_id)::bigint as n_messages, (max(event_id) - min(event_id) + 1 - count(distinct event_id))::bigint as n_lost from events group by event_type",
    "goal_poses": f"""with p as (select event_id as pid, event_id % 64 / 8.0::double as x, (event_id % 6) / 2.0::double as theta from events where event_id % 5 > 0)
select pid::bigint as pid, 'map' as frame_id, {_six(x='x', y='1.5::double', z='0.25::double', qx='0.0::double', qy='0.0::double', qz='sin(theta) / (2 * cos(theta / 2))', qw='cos(theta / 2)')} from p""",
    "cloud_guards": "select * from (values ('two points', 0::bigint), ('one voxel', 0), ('a line', 0)) t(name, n)",
    "mesh_elevation": f"with {T} select 'made' as frame_id, count(*)::bigint as n, min(cid)::bigint as first from navcels",
    "copied_map": f"with {T} select cid, value::bigint as own, 7::bigint as copy from occ",
}
