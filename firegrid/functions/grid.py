"""Hexagonal grid and geography as Spark columns.

Cells are pointy-top axial hexagons on the ETRS89 equal-area plane. An id packs
``resolution << 52 | (q + 2**25) << 26 | (r + 2**25)``; ids are this grid's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread_out

HALF, ROW, LEVEL = 1 << 25, 1 << 26, 1 << 52
EARTH_M = 6_371_008.8

#: Mean hexagon area in m2 at resolution 8; every finer level has a seventh of it.
AREA_8 = 737_327.6

# --- ellipsoid and projection (fixed values of EPSG:3035) -------------------

_A, _F = 6_378_137.0, 1 / 298.257222101
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_LAT0, _LON0, _X0, _Y0 = math.radians(52.0), math.radians(10.0), 4_321_000.0, 3_210_000.0


def _q_of(sin_lat: float) -> float:
    return (1 - _E2) * (sin_lat / (1 - _E2 * sin_lat**2) - math.log((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E))


_QP, _Q0 = _q_of(1.0), _q_of(math.sin(_LAT0))
_BETA0, _RQ = math.asin(_Q0 / _QP), _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_BETA0))


def laea_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a latitude and longitude in degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    beta = F.asin(q / _QP)
    lam = F.radians(lon) - _LON0
    b = _RQ * F.sqrt(F.lit(2.0) / (1 + math.sin(_BETA0) * F.sin(beta) + math.cos(_BETA0) * F.cos(beta) * F.cos(lam)))
    x = _X0 + b * _D * F.cos(beta) * F.sin(lam)
    y = _Y0 + b / _D * (math.cos(_BETA0) * F.sin(beta) - math.sin(_BETA0) * F.cos(beta) * F.cos(lam))
    return x, y


def laea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees, by the closed series in e squared."""
    dx, dy = (x - _X0) / _D, (y - _Y0) * _D
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(rho / (2 * _RQ))
    beta = F.when(rho == 0, F.lit(_BETA0)).otherwise(F.asin(F.cos(c) * math.sin(_BETA0) + dy * F.sin(c) * math.cos(_BETA0) / rho))
    lat = beta + (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040) * F.sin(2 * beta) + (23 * _E2**2 / 360 + 251 * _E2**3 / 3780) * F.sin(4 * beta) + 761 * _E2**3 / 45360 * F.sin(6 * beta)
    lam = F.atan2(dx * F.sin(c), rho * math.cos(_BETA0) * F.cos(c) - dy * math.sin(_BETA0) * F.sin(c))
    return F.degrees(lat), F.degrees(F.when(rho == 0, F.lit(_LON0)).otherwise(_LON0 + lam))


# --- cells ------------------------------------------------------------------


def edge_m(resolution: int) -> float:
    """Hexagon edge in metres."""
    return math.sqrt(AREA_8 * 7.0 ** (8 - resolution) * 2 / (3 * math.sqrt(3)))


def cell_id(q: Column, r: Column, resolution: Column | int) -> Column:
    return F.lit(resolution).cast("long") * LEVEL + (q.cast("long") + HALF) * ROW + (r.cast("long") + HALF)


def cell_level(cell: Column) -> Column:
    return F.shiftright(cell, 52).cast("int")


def cell_q(cell: Column) -> Column:
    return F.shiftright(cell, 26) % ROW - HALF


def cell_r(cell: Column) -> Column:
    return cell % ROW - HALF


def _rounded(x: Column, y: Column, edge: Column) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon that holds a plane point."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / edge, (2 / 3 * y) / edge
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q, fix_r = (dq > dr) & (dq > ds), dr > ds
    return F.when(fix_q, -rr - rs).otherwise(rq), F.when(~fix_q & fix_r, -rq - rs).otherwise(rr)


def _edge(resolution: Column) -> Column:
    return F.lit(edge_m(8)) * F.pow(F.lit(math.sqrt(7.0)), 8 - resolution)


def cell_of_xy(x: Column, y: Column, resolution: int) -> Column:
    q, r = _rounded(x, y, F.lit(edge_m(resolution)))
    return cell_id(q, r, resolution)


def cell_of(lat: Column, lon: Column, resolution: int) -> Column:
    """The cell of a point."""
    return cell_of_xy(*laea_forward(lat, lon), resolution)


def cell_xy(cell: Column) -> tuple[Column, Column]:
    """Plane coordinates of a cell's centre."""
    edge = _edge(cell_level(cell))
    q, r = cell_q(cell).cast("double"), cell_r(cell).cast("double")
    return edge * math.sqrt(3) * (q + r / 2), edge * 1.5 * r


def cell_center(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    return laea_inverse(*cell_xy(cell))


def cell_ring(cell: Column) -> Column:
    """A cell's outline as a closed array of ``(lon, lat)``, counter-clockwise from the corner to the north-east."""
    x, y = cell_xy(cell)
    edge = _edge(cell_level(cell))
    corners = F.array(*(F.struct((x + edge * math.cos(math.radians(30 + 60 * k))).alias("x"), (y + edge * math.sin(math.radians(30 + 60 * k))).alias("y")) for k in (0, 1, 2, 3, 4, 5, 0)))

    def degrees(p: Column) -> Column:
        lat, lon = laea_inverse(p["x"], p["y"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(corners, degrees)


def cells_for_bbox(df: DataFrame, resolution: int, steps: int = 16) -> DataFrame:
    """The rows of boxes ``west, south, east, north`` in degrees, once for each ``cell`` that touches the box.

    Candidates come from the plane around the box's outline, whose meridians and
    parallels bend there, with a margin. A cell touches the box if its centre or a
    corner lies in it, or if it holds one of the outline's points (``steps`` to a
    side, so this finds cells that only an edge crosses for boxes up to as many
    cells wide).
    """
    edge = edge_m(resolution)
    west, south, east, north = (F.col(c) for c in ("west", "south", "east", "north"))

    def outline(k: Column) -> Column:
        part = (k % steps) / F.lit(float(steps))
        lon = F.when(k < steps, west + (east - west) * part).when(k < 2 * steps, east).when(k < 3 * steps, east - (east - west) * part).otherwise(west)
        lat = F.when(k < steps, south).when(k < 2 * steps, south + (north - south) * part).when(k < 3 * steps, north).otherwise(north - (north - south) * part)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    def plane(p: Column) -> Column:
        x, y = laea_forward(p["lat"], p["lon"])
        return F.struct(x.alias("x"), y.alias("y"))

    t = spread_out(df).withColumn("_p", F.transform(F.sequence(F.lit(0), F.lit(4 * steps - 1)), outline)).withColumn("_p", F.transform("_p", plane))
    for c in "xy":
        t = t.withColumn(f"_{c}0", F.array_min(F.transform("_p", lambda p: p[c]))).withColumn(f"_{c}1", F.array_max(F.transform("_p", lambda p: p[c])))  # noqa: B023
    bend = (F.col("_x1") - F.col("_x0") + F.col("_y1") - F.col("_y0")) / (2 * steps) + 2 * edge  # what lies between two points of the outline, and a cell's own size
    t = t.withColumn("_b", bend).withColumn("_r0", F.floor((F.col("_y0") - F.col("_b")) / (edge * 1.5))).withColumn("_r1", F.ceil((F.col("_y1") + F.col("_b")) / (edge * 1.5)))
    wide = edge * math.sqrt(3)
    q0, q1 = F.floor((F.col("_x0") - F.col("_b")) / wide - F.col("_r1") / 2), F.ceil((F.col("_x1") + F.col("_b")) / wide - F.col("_r0") / 2)
    near = t.select(*df.columns, F.explode(cells_between(q0, q1, F.col("_r0"), F.col("_r1"), resolution)).alias("cell"))
    near = near.withColumn("_ring", cell_ring(F.col("cell"))).withColumn("_c", F.struct(*(c.alias(n) for c, n in zip(cell_center(F.col("cell")), ("lat", "lon"), strict=True))))
    inside = lambda p: p["lon"].between(west, east) & p["lat"].between(south, north)
    touching = near.where(inside(F.col("_c")) | F.exists("_ring", inside)).select(*df.columns, "cell")
    crossed = t.select(*df.columns, F.explode("_p").alias("_p")).select(*df.columns, cell_of_xy(F.col("_p.x"), F.col("_p.y"), resolution).alias("cell"))
    return touching.unionByName(crossed).distinct()


def cell_parent(cell: Column, resolution: int) -> Column:
    """The coarser cell that holds the cell's centre."""
    return F.when(cell_level(cell) <= resolution, cell).otherwise(cell_of_xy(*cell_xy(cell), resolution))


def common_resolution(a: Column, b: Column, levels: range = range(0, 16)) -> tuple[Column, Column]:
    """Both cells at the coarser one's resolution."""
    level = F.least(cell_level(a), cell_level(b))

    def at(c: Column) -> Column:
        q, r = _rounded(*cell_xy(c), _edge(level))
        return F.when(cell_level(c) == level, c).otherwise(cell_id(q, r, level))

    return at(a), at(b)


def disk_offsets(k: int) -> list[tuple[int, int, int]]:
    """Axial offsets within ``k`` rings, with the ring."""
    out = []
    for dq in range(-k, k + 1):
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1):
            out.append((dq, dr, max(abs(dq), abs(dr), abs(dq + dr))))
    return sorted(out, key=lambda t: (t[2], t[0], t[1]))


def cell_disk(cell: Column, k: int) -> Column:
    """Array of ``(cell, ring)`` within ``k`` rings. Neighbours differ from the id by a constant."""
    return F.array(*(F.struct((cell + (dq * ROW + dr)).alias("cell"), F.lit(ring).alias("ring")) for dq, dr, ring in disk_offsets(k)))


def cell_distance(a: Column, b: Column) -> Column:
    """Grid distance of two cells of one resolution; null otherwise."""
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return F.when(cell_level(a) == cell_level(b), F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)))


def cells_between(lo_q: Column, hi_q: Column, lo_r: Column, hi_r: Column, resolution: int) -> Column:
    """Array of all cells in an axial rectangle: the candidates for covering a box or filling a ring."""
    return F.flatten(F.transform(F.sequence(lo_q, hi_q), lambda q: F.transform(F.sequence(lo_r, hi_r), lambda r: cell_id(q, r, resolution))))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring of ``(x, y)`` structs, by counting crossings."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(edges, crosses), F.lit(0), lambda n, c: n + c) % 2 == 1


# --- points -----------------------------------------------------------------


def in_bbox(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Within ``(min lon, min lat, max lon, max lat)``, edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def parse_bbox(text: Column) -> Column:
    """``minLon,minLat,maxLon,maxLat`` as a struct; null if it is malformed, out of range or reversed."""
    parts = F.split(text, ",", -1)
    v = [F.trim(F.try_element_at(parts, F.lit(k))).try_cast("double") for k in (1, 2, 3, 4)]
    ok = (F.size(parts) == 4) & (v[0] >= -180) & (v[2] <= 180) & (v[1] >= -90) & (v[3] <= 90) & (v[0] < v[2]) & (v[1] < v[3])
    return F.when(ok, F.struct(v[0].alias("west"), v[1].alias("south"), v[2].alias("east"), v[3].alias("north")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def decimal_precision(value: Column) -> Column:
    """Digits after the point of a number's shortest form, 0 for whole numbers (at most 15)."""
    text = F.format_string("%.15f", value)
    return F.length(F.regexp_replace(F.split(text, r"\.")[1], "0+$", ""))


def segment(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Midpoint and length of a segment."""
    return F.struct(((lat1 + lat2) / 2).alias("lat"), ((lon1 + lon2) / 2).alias("lon"), haversine_m(lat1, lon1, lat2, lon2).alias("length_m"))


def centroid(points: Column) -> Column:
    """Mean of an array of ``(lat, lon)`` structs; null if it is empty."""
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), lambda s, p: F.struct((s["lat"] + p["lat"]).alias("lat"), (s["lon"] + p["lon"]).alias("lon")))
    n = F.size(points)
    return F.when(n > 0, F.struct((total["lat"] / n).alias("lat"), (total["lon"] / n).alias("lon")))


def lattice(low: Column, high: Column, step: float) -> Column:
    """Array of coordinates from ``low`` in steps, with ``high`` itself as the last."""
    n = F.ceil((high - low) / step - 1e-9).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.least(low + k * step, high))
