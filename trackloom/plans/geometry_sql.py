"""Geometry in SQL for the checks: numbers, corners and edges out of WKB, and the cells that hold points."""

from __future__ import annotations


def double(h: str) -> str:
    """The double whose little-endian bytes stand in 16 hexadecimal digits."""
    u = "('0x' || " + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")::ubigint"
    return f"(case when ({u} >> 63) = 1 then -1.0 else 1.0 end) * pow(2.0, (({u} >> 52) & 2047)::int - 1023) * (1 + ({u} & 4503599627370495)::double / 4503599627370496.0)"


#: The corners and edges of the cells, read from their WKB (polygons of one ring).
EDGES = f"""wkb as (select hex_id, hex(geometry) as h from cells where geometry is not null),
corner as (select hex_id, i, {double("substr(h, 27 + 32 * i, 16)")} as x, {double("substr(h, 43 + 32 * i, 16)")} as y from (select *, unnest(range(0, ((length(h) - 26) / 32)::int)) as i from wkb)),
edge as (select a.hex_id, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from corner a join corner b on a.hex_id = b.hex_id and b.i = a.i + 1),
box as (select hex_id, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax from corner group by 1)"""


def holding(points: str) -> str:
    """`held`: the cells that hold the rows of a table (point, lon, lat)."""
    return f"""near as (select p.point, p.lon, p.lat, b.hex_id from {points} p join box b on p.lon between b.xmin and b.xmax and p.lat between b.ymin and b.ymax),
held as (select point, hex_id from near join edge using (hex_id) where (y0 <= lat) <> (y1 <= lat) and x0 + (x1 - x0) * (lat - y0) / (y1 - y0) <= lon group by 1, 2 having count(*) % 2 = 1)"""
