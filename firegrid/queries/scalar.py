"""Queries of the scalar functions: grid (x), fire weather (p), dates (d), text (c)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views
from ..functions import dates, fwi, grid, text
from ..views import table, with_views
from .registry import query

# --- SQL building blocks ----------------------------------------------------

_LAT, _LON = "(42.0 + c_custkey % 97 / 12.0::DOUBLE)", "(-2.0 + c_custkey % 89 / 9.0::DOUBLE)"
_D = grid  # projection constants


def _sql_forward(src: str) -> str:
    """Adds x, y to a relation with lat, lon."""
    g = grid
    return f"""(SELECT *, {g._X0}::DOUBLE + b * {g._D!r}::DOUBLE * cos(beta) * sin(lam) AS x,
      {g._Y0}::DOUBLE + b / {g._D!r}::DOUBLE * ({math.cos(g._BETA0)!r}::DOUBLE * sin(beta) - {math.sin(g._BETA0)!r}::DOUBLE * cos(beta) * cos(lam)) AS y FROM
      (SELECT *, {g._RQ!r}::DOUBLE * sqrt(2.0::DOUBLE / (1 + {math.sin(g._BETA0)!r}::DOUBLE * sin(beta) + {math.cos(g._BETA0)!r}::DOUBLE * cos(beta) * cos(lam))) AS b FROM
      (SELECT *, asin({1 - g._E2!r}::DOUBLE * (s / (1 - {g._E2!r}::DOUBLE * s * s) - ln((1 - {g._E!r}::DOUBLE * s) / (1 + {g._E!r}::DOUBLE * s)) / (2 * {g._E!r}::DOUBLE)) / {g._QP!r}::DOUBLE) AS beta, radians(lon) - {g._LON0!r}::DOUBLE AS lam FROM
      (SELECT *, sin(radians(lat)) AS s FROM {src}))))"""


def _sql_hex(src: str, edge: float, level: int, name: str = "cell") -> str:
    """Adds a cell to a relation with x, y."""
    return f"""(SELECT * EXCLUDE (hq, hr, rq, rr, rs), {level} * 4503599627370496 + (CASE WHEN abs(rq - hq) > abs(rr - hr) AND abs(rq - hq) > abs(rs + hq + hr) THEN -rr - rs ELSE rq END + 33554432)::BIGINT * 67108864
      + (CASE WHEN NOT (abs(rq - hq) > abs(rr - hr) AND abs(rq - hq) > abs(rs + hq + hr)) AND abs(rr - hr) > abs(rs + hq + hr) THEN -rq - rs ELSE rr END + 33554432)::BIGINT AS {name} FROM
      (SELECT *, floor(hq + 0.5) AS rq, floor(hr + 0.5) AS rr, floor(-hq - hr + 0.5) AS rs FROM
      (SELECT *, ({math.sqrt(3) / 3!r}::DOUBLE * x - y / 3) / {edge!r}::DOUBLE AS hq, ({2 / 3!r}::DOUBLE * y) / {edge!r}::DOUBLE AS hr FROM {src})))"""


def sql_fingerprint(rows: str) -> str:
    """Digest and number of rows of a relation with ``k`` and ``c``, as text."""
    words = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT), 0)::VARCHAR" for k in range(4))
    return f"SELECT sha256(concat_ws(':', {words}, count(*)::VARCHAR)) AS fingerprint, count(*) AS rows FROM (SELECT sha256(k || ':' || c) AS h FROM {rows})"


def _sql_inverse(src: str) -> str:
    """Adds lat, lon to a relation with x, y."""
    g = grid
    e = g._E2
    return f"""(SELECT *, degrees(be + {e / 3 + 31 * e**2 / 180 + 517 * e**3 / 5040!r}::DOUBLE * sin(2 * be) + {23 * e**2 / 360 + 251 * e**3 / 3780!r}::DOUBLE * sin(4 * be) + {761 * e**3 / 45360!r}::DOUBLE * sin(6 * be)) AS lat,
      degrees({g._LON0!r}::DOUBLE + atan2(dx * sin(cc), rho * {math.cos(g._BETA0)!r}::DOUBLE * cos(cc) - dy * {math.sin(g._BETA0)!r}::DOUBLE * sin(cc))) AS lon FROM
      (SELECT *, asin(cos(cc) * {math.sin(g._BETA0)!r}::DOUBLE + dy * sin(cc) * {math.cos(g._BETA0)!r}::DOUBLE / rho) AS be FROM
      (SELECT *, 2 * asin(rho / {2 * g._RQ!r}::DOUBLE) AS cc FROM
      (SELECT *, sqrt(dx * dx + dy * dy) AS rho FROM
      (SELECT *, (x - {g._X0}::DOUBLE) / {g._D!r}::DOUBLE AS dx, (y - {g._Y0}::DOUBLE) * {g._D!r}::DOUBLE AS dy FROM {src})))))"""


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), (42.0 + k % 97 / 12.0).alias("lat"), (-2.0 + k % 89 / 9.0).alias("lon"))


_POINTS = f"(SELECT c_custkey AS key, {_LAT} AS lat, {_LON} AS lon FROM customer)"


@query(f"SELECT key, lon BETWEEN -1 AND 4 AND lat BETWEEN 43 AND 46 AS inside FROM {_POINTS}")
def x1_in_bbox(spark, d):
    return _points(spark, d).select("key", grid.in_bbox(F.col("lat"), F.col("lon"), (-1, 43, 4, 46)).alias("inside"))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 5 < 4 AND c_custkey % 40 < 30 THEN CAST(c_custkey % 40 AS DOUBLE) END AS west FROM customer""")
def x1_parse_bbox(spark, d):
    k = F.col("c_custkey")
    west, east = (k % 40).cast("string"), F.when(k % 40 < 30, F.lit("30")).otherwise(F.lit("0"))
    box = F.concat_ws(",", west, F.lit("40"), east, F.when(k % 5 < 4, F.lit("50")).otherwise(F.lit("north")))
    return table(spark, d, "customer").select(k.alias("key"), grid.parse_bbox(box)["west"].alias("west"))


@query(f"SELECT key, round(x, 3) AS x, round(y, 3) AS y FROM {_sql_forward(_POINTS)}")
def x8_laea_forward(spark, d):
    x, y = grid.laea_forward(F.col("lat"), F.col("lon"))
    return _points(spark, d).select("key", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"SELECT key, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {_POINTS}")
def x8_laea_round_trip(spark, d):
    lat, lon = grid.laea_inverse(*grid.laea_forward(F.col("lat"), F.col("lon")))
    return _points(spark, d).select("key", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"SELECT key, cell FROM {_sql_hex(_sql_forward(_POINTS), grid.edge_m(8), 8)}")
def x2_cell_of(spark, d):
    return _points(spark, d).select("key", grid.cell_of(F.col("lat"), F.col("lon"), 8).alias("cell"))


_E8 = grid.edge_m(8)
_CENTRE = f"(SELECT key, q, r, {_E8!r}::DOUBLE * {math.sqrt(3)!r}::DOUBLE * (q + r / 2.0::DOUBLE) AS x, {_E8!r}::DOUBLE * 1.5 * r AS y FROM v_cells)"


@query(with_views("v_cells") + f" SELECT key, round(x, 3) AS x, round(y, 3) AS y FROM {_CENTRE}")
def x3_cell_centre(spark, d):
    x, y = grid.cell_xy(F.col("cell"))
    return views.cells(spark, d).select("key", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(with_views("v_cells") + f" SELECT key, cell AS parent FROM {_sql_hex(_CENTRE, grid.edge_m(7), 7)}")
def x4_cell_parent(spark, d):
    return views.cells(spark, d).select("key", grid.cell_parent(F.col("cell"), 7).alias("parent"))


@query(with_views("v_cells") + f" SELECT key, cell AS a, cell AS b FROM {_sql_hex(_CENTRE, grid.edge_m(7), 7)}")
def x4_common_resolution(spark, d):
    a, b = grid.common_resolution(F.col("cell"), F.col("parent"))
    c = views.cells(spark, d).withColumn("parent", grid.cell_parent(F.col("cell"), 7))
    return c.select("key", a.alias("a"), b.alias("b"))


@query(
    with_views("v_cells")
    + """ SELECT key, cell + dq * 67108864 + dr AS near, greatest(abs(dq), abs(dr), abs(dq + dr))::INTEGER AS ring
    FROM v_cells, (SELECT unnest(range(-2, 3)) AS dq) a, (SELECT unnest(range(-2, 3)) AS dr) b WHERE abs(dq + dr) <= 2"""
)
def x5_cell_disk(spark, d):
    return views.cells(spark, d).select("key", F.explode(grid.cell_disk(F.col("cell"), 2)).alias("n")).select("key", F.col("n.cell").alias("near"), "n.ring")


@query(
    with_views("v_cells")
    + """ SELECT a.key, greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r)) AS distance FROM v_cells a JOIN v_cells b ON b.key = a.key // 3"""
)
def x6_cell_distance(spark, d):
    c = views.cells(spark, d)
    b = c.select(F.col("key").alias("k"), F.col("cell").alias("other"))
    return c.join(b, F.floor(F.col("key") / 3) == F.col("k")).select("key", grid.cell_distance(F.col("cell"), F.col("other")).alias("distance"))


@query(with_views("v_cells") + f" SELECT key, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {_sql_inverse(_CENTRE)}")
def x3_cell_centre_degrees(spark, d):
    lat, lon = grid.cell_center(F.col("cell"))
    return views.cells(spark, d).select("key", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(
    with_views("v_stations")
    + """ SELECT station, count(*) AS cells FROM v_stations, (SELECT unnest(range(-1, 3)) AS dq) a, (SELECT unnest(range(-2, 2)) AS dr) b GROUP BY station"""
)
def x7_cover_box(spark, d):
    q, r = F.col("q"), F.col("r")
    return views.stations(spark, d).select("station", F.explode(grid.cells_between(q - 1, q + 2, r - 2, r + 1, 8)).alias("c")).groupBy("station").agg(F.count("*").alias("cells"))


_BOX = (0.03, 0.02)  # half the boxes' width and height in degrees
_TOUCHED = f"""
WITH p AS (SELECT s_suppkey AS station, 42.0 + s_suppkey % 97 / 12.0::DOUBLE AS lat, -2.0 + s_suppkey % 89 / 9.0::DOUBLE AS lon FROM supplier),
home AS (SELECT station, lat AS lat0, lon AS lon0, cell, (cell // 67108864) % 67108864 - 33554432 AS q, cell % 67108864 - 33554432 AS r FROM {_sql_hex(_sql_forward("p"), _E8, 8)}),
near AS (SELECT station, lat0, lon0, cell + dq * 67108864 + dr AS cell, {_E8!r}::DOUBLE * {math.sqrt(3)!r}::DOUBLE * (q + dq + (r + dr) / 2.0::DOUBLE) AS x0, {_E8!r}::DOUBLE * 1.5 * (r + dr) AS y0 FROM home, range(-7, 8) a(dq), range(-7, 8) b(dr) WHERE abs(dq + dr) <= 7),
points AS (SELECT station, lat0, lon0, cell, x0 AS x, y0 AS y FROM near UNION ALL SELECT station, lat0, lon0, cell, x0 + {_E8!r}::DOUBLE * cos(radians(30 + 60 * k)), y0 + {_E8!r}::DOUBLE * sin(radians(30 + 60 * k)) FROM near, range(6) t(k)),
inside AS (SELECT station, cell FROM {_sql_inverse("points")} WHERE lon BETWEEN lon0 - {_BOX[0]} AND lon0 + {_BOX[0]} AND lat BETWEEN lat0 - {_BOX[1]} AND lat0 + {_BOX[1]}),
outline AS (SELECT station, CASE WHEN k < 16 THEN lon - {_BOX[0]} + {2 * _BOX[0]}::DOUBLE * (k % 16) / 16 WHEN k < 32 THEN lon + {_BOX[0]} WHEN k < 48 THEN lon + {_BOX[0]} - {2 * _BOX[0]}::DOUBLE * (k % 16) / 16 ELSE lon - {_BOX[0]} END AS lon,
  CASE WHEN k < 16 THEN lat - {_BOX[1]} WHEN k < 32 THEN lat - {_BOX[1]} + {2 * _BOX[1]}::DOUBLE * (k % 16) / 16 WHEN k < 48 THEN lat + {_BOX[1]} ELSE lat + {_BOX[1]} - {2 * _BOX[1]}::DOUBLE * (k % 16) / 16 END AS lat FROM p, range(64) t(k))
SELECT station, cell FROM inside UNION SELECT station, cell FROM {_sql_hex(_sql_forward("outline"), _E8, 8)}"""


@query(_TOUCHED)
def x7_cells_for_bbox(spark, d):
    k = F.col("s_suppkey")
    lat, lon = 42.0 + k % 97 / 12.0, -2.0 + k % 89 / 9.0
    boxes = table(spark, d, "supplier").select(k.alias("station"), (lon - _BOX[0]).alias("west"), (lat - _BOX[1]).alias("south"), (lon + _BOX[0]).alias("east"), (lat + _BOX[1]).alias("north"))
    return grid.cells_for_bbox(boxes, 8).select("station", "cell")


_CORNERS = [(10.3, 5.2), (80.7, 8.1), (95.9, 30.3), (50.2, 50.4), (15.1, 35.7)]  # counter-clockwise, in edges


@query(
    with_views("v_cells")
    + f" SELECT key FROM {_CENTRE} WHERE "
    + " AND ".join(f"({b[0] - a[0]!r}::DOUBLE * (y / {_E8!r} - {a[1]}) - {b[1] - a[1]!r}::DOUBLE * (x / {_E8!r} - {a[0]})) > 0" for a, b in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True))
)
def x7_fill_plane(spark, d):
    ring = F.array(*(F.struct(F.lit(x * _E8).alias("x"), F.lit(y * _E8).alias("y")) for x, y in [*_CORNERS, _CORNERS[0]]))
    return views.cells(spark, d).where(grid.in_ring(*grid.cell_xy(F.col("cell")), ring)).select("key")


@query(with_views("v_cells") + " SELECT key FROM v_cells WHERE (q > 5 AND q < 25 AND r > 3 AND r < 18) AND NOT (q + r > 38)")
def x7_fill_polygon(spark, d):
    corners = [(5.0, 3.0), (25.0, 3.0), (25.0, 13.5), (20.5, 18.0), (5.0, 18.0), (5.0, 3.0)]
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners))
    return views.cells(spark, d).where(grid.in_ring(F.col("q") + 0.0001, F.col("r") + 0.0001, ring)).where("q > 5 and r > 3").select("key")


@query(
    f"""SELECT key, round(2 * 6371008.8 * asin(sqrt(least(pow(sin((radians(45) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * pow(sin((radians(3) - radians(lon)) / 2), 2), 1))), 3) AS metres FROM {_POINTS}"""
)
def x9_great_circle(spark, d):
    return _points(spark, d).select("key", F.round(grid.haversine_m(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(3.0)), 3).alias("metres"))


@query(
    f"""SELECT key, round((lat + 44.5) / 2, 6) AS lat, round((lon + 1.25) / 2, 6) AS lon FROM {_POINTS}"""
)
def x10_segment_midpoint(spark, d):
    s = grid.segment(F.col("lat"), F.col("lon"), F.lit(44.5), F.lit(1.25))
    return _points(spark, d).select("key", F.round(s["lat"], 6).alias("lat"), F.round(s["lon"], 6).alias("lon"))


@query(f"""SELECT key % 50 AS way, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM {_POINTS} GROUP BY 1""")
def x10_way_centroid(spark, d):
    w = _points(spark, d).groupBy((F.col("key") % 50).alias("way")).agg(F.collect_list(F.struct("lat", "lon")).alias("p")).withColumn("c", grid.centroid(F.col("p")))
    return w.select("way", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query(
    """WITH b AS (SELECT s_suppkey AS region, s_suppkey % 7 + CAST(0.1 AS DOUBLE) AS lo, s_suppkey % 7 + 1 + s_suppkey % 3 * CAST(0.13 AS DOUBLE) AS hi FROM supplier),
    n AS (SELECT *, unnest(range(0, CAST(ceil((hi - lo) / CAST(0.2 AS DOUBLE) - 1e-9) AS BIGINT) + 1)) AS k FROM b) SELECT region, round(least(lo + k * CAST(0.2 AS DOUBLE), hi), 6) AS lat FROM n"""
)
def x11_anchor_lattice(spark, d):
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(k.alias("region"), (k % 7 + F.lit(0.1)).alias("lo"), (k % 7 + 1 + k % 3 * F.lit(0.13)).alias("hi"))
    return b.select("region", F.explode(grid.lattice(F.col("lo"), F.col("hi"), 0.2)).alias("lat")).select("region", F.round("lat", 6).alias("lat"))


@query(f"SELECT round(min(lon) - 0.25, 6) AS west, round(min(lat) - 0.25, 6) AS south, round(max(lon) + 0.25, 6) AS east, round(max(lat) + 0.25, 6) AS north FROM {_POINTS}")
def x12_combined_bbox(spark, d):
    a = _points(spark, d).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return a.select(F.round(F.col("w") - 0.25, 6).alias("west"), F.round(F.col("s") - 0.25, 6).alias("south"), F.round(F.col("e") + 0.25, 6).alias("east"), F.round(F.col("n") + 0.25, 6).alias("north"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS digits FROM customer")
def x13_decimal_precision(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), grid.decimal_precision(k / 8.0).alias("digits"))


# --- fire weather -----------------------------------------------------------


def sql_ffmc(p: str, t: str, h: str, w: str, r: str) -> str:
    k = "(250.0::DOUBLE * 59.5 / 101.0)"
    hh = f"least({h}, 99.9999::DOUBLE)"
    m = f"({k} * (101 - {p}) / (59.5 + {p}))"
    n = f"greatest({r} - 0.5, 1e-9)"
    wet = f"least({m} + 42.5 * {n} * exp(-100 / (251 - {m})) * (1 - exp(-6.93 / {n})) + CASE WHEN {m} > 150 THEN 0.0015 * pow({m} - 150, 2) * sqrt({n}) ELSE 0 END, 250::DOUBLE)"
    mo = f"(CASE WHEN {r} > 0.5 THEN {wet} ELSE {m} END)"
    c = f"0.18 * (21.1 - {t}) * (1 - exp(-0.115 * {hh}))"
    ed, ew = f"(0.942 * pow({hh}, 0.679) + 11 * exp(({hh} - 100) / 10) + {c})", f"(0.618 * pow({hh}, 0.753) + 10 * exp(({hh} - 100) / 10) + {c})"
    rate = lambda x: f"pow(10::DOUBLE, (0.424 * (1 - pow({x}, 1.7)) + 0.0694 * sqrt({w}) * (1 - pow({x}, 8))) * 0.581 * exp(0.0365 * {t}))"
    lo, hi = rate(f"((100 - {hh}) / 100)"), rate(f"({hh} / 100)")
    f = f"(CASE WHEN {mo} < {ed} AND {mo} < {ew} THEN {ew} - ({ew} - {mo}) / {lo} WHEN {mo} > {ed} THEN {ed} + ({mo} - {ed}) / {hi} ELSE {mo} END)"
    return f"greatest(least(59.5 * (250 - {f}) / ({k} + {f}), 101::DOUBLE), 0::DOUBLE)"


def sql_dmc(p: str, t: str, h: str, r: str, month: str) -> str:
    days = f"{fwi.DMC_DAYS}[{month}]::DOUBLE"
    n = f"(0.92 * {r} - 1.27)"
    b = f"(CASE WHEN {p} <= 33 THEN 100 / (0.5 + 0.3 * {p}) WHEN {p} <= 65 THEN 14 - 1.3 * ln({p}) ELSE 6.2 * ln({p}) - 17.2 END)"
    wet = f"greatest(43.43 * (5.6348 - ln(280.0::DOUBLE / exp(0.023 * {p}) + 1000 * {n} / (48.77 + {b} * {n}))), 0::DOUBLE)"
    return f"greatest((CASE WHEN {r} > 1.5 THEN {wet} ELSE {p} END) + 1.894 * (greatest({t}, -1.1::DOUBLE) + 1.1) * (100 - {h}) * {days} * 1e-4, 0::DOUBLE)"


def sql_dc(p: str, t: str, r: str, month: str) -> str:
    v = f"greatest(0.5 * (0.36 * (greatest({t}, -2.8::DOUBLE) + 2.8) + {fwi.DC_DAYS}[{month}]::DOUBLE), 0::DOUBLE)"
    wet = f"greatest({p} - 400 * ln(1 + 3.937 * (0.83 * {r} - 1.27) / (800 * exp(-{p} / 400))), 0::DOUBLE)"
    return f"greatest((CASE WHEN {r} > 2.8 THEN {wet} ELSE {p} END) + {v}, 0::DOUBLE)"


def sql_isi(f: str, w: str) -> str:
    m = f"((250.0::DOUBLE * 59.5 / 101.0) * (101 - {f}) / (59.5 + {f}))"
    return f"0.208 * exp(0.05039 * {w}) * 91.9 * exp(-0.1386 * {m}) * (1 + pow({m}, 5.31) / 49300000)"


def sql_bui(p: str, c: str) -> str:
    u = f"(0.8 * {c} * {p} / nullif({p} + 0.4 * {c}, 0))"
    return f"(CASE WHEN {p} = 0 AND {c} = 0 THEN 0::DOUBLE WHEN {u} < {p} THEN greatest({p} - (0.92 + pow(0.0114 * {p}, 1.7)) * ({p} - {u}) / {p}, 0::DOUBLE) ELSE {u} END)"


def sql_fwi(i: str, u: str) -> str:
    b = f"(0.1 * {i} * CASE WHEN {u} > 80 THEN 1000 / (25 + 108.64 / exp(0.023 * {u})) ELSE 0.626 * pow({u}, 0.809) + 2 END)"
    return f"(CASE WHEN {b} <= 1 THEN {b} ELSE exp(2.72 * pow(0.434 * ln(greatest({b}, 1::DOUBLE)), 0.647)) END)"


_W = with_views("v_weather") + ", w AS (SELECT *, 60 + (day(date) * 3 + month) % 40::DOUBLE AS f0, (day(date) * 5 % 90)::DOUBLE AS p0, (day(date) * 17 % 500)::DOUBLE AS c0 FROM v_weather) "


def _weather(spark, d):
    day = F.dayofmonth("date")
    return views.weather_daily(spark, d).withColumn("f0", (60 + (day * 3 + F.col("month")) % 40).cast("double")).withColumn("p0", (day * 5 % 90).cast("double")).withColumn("c0", (day * 17 % 500).cast("double"))


_c = F.col


@query(_W + f"SELECT cell, date, round({sql_ffmc('f0', 'temp', 'rh', 'wind', 'rain')}, 5) AS ffmc FROM w")
def p1_ffmc(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.ffmc(_c("f0"), _c("temp"), _c("rh"), _c("wind"), _c("rain")), 5).alias("ffmc"))


@query(_W + f"SELECT cell, date, round({sql_dmc('p0', 'temp', 'rh', 'rain', 'month')}, 5) AS dmc FROM w")
def p2_dmc(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.dmc(_c("p0"), _c("temp"), _c("rh"), _c("rain"), _c("month")), 5).alias("dmc"))


@query(_W + f"SELECT cell, date, round({sql_dc('c0', 'temp', 'rain', 'month')}, 5) AS dc FROM w")
def p3_dc(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.dc(_c("c0"), _c("temp"), _c("rain"), _c("month")), 5).alias("dc"))


@query(_W + f"SELECT cell, date, round({sql_isi('f0', 'wind')}, 5) AS isi FROM w")
def p4_isi(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.isi(_c("f0"), _c("wind")), 5).alias("isi"))


@query(_W + f"SELECT cell, date, round({sql_bui('p0', 'c0')}, 5) AS bui FROM w")
def p5_bui(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.bui(_c("p0"), _c("c0")), 5).alias("bui"))


@query(_W + f"SELECT cell, date, round({sql_fwi('rain * 3', 'c0')}, 5) AS fwi FROM w")
def p6_fwi(spark, d):
    return _weather(spark, d).select("cell", "date", F.round(fwi.fwi(_c("rain") * 3, _c("c0")), 5).alias("fwi"))


@query(
    with_views("v_weather")
    + """ SELECT cell, date, concat_ws(',', CASE WHEN rh + 25 > 100 THEN 'humidity_out_of_range' END, CASE WHEN wind - 5 < 0 THEN 'wind_negative' END, CASE WHEN month + 1 > 12 THEN 'month_out_of_range' END) AS errors FROM v_weather"""
)
def p7_validate_weather(spark, d):
    errors = fwi.weather_errors(_c("temp"), _c("rh") + 25, _c("wind") - 5, _c("rain"), _c("month") + 1)
    return views.weather_daily(spark, d).select("cell", "date", F.array_join(errors, ",").alias("errors"))


@query(_W + f"SELECT cell, date, round({sql_isi('f0', '(wind + 7)')}, 5) AS isi, round({sql_fwi('(' + sql_isi('f0', '(wind + 7)') + ')', 'c0')}, 5) AS fwi FROM w")
def p9_intraday(spark, d):
    spread = fwi.isi(_c("f0"), _c("wind") + 7)
    return _weather(spark, d).select("cell", "date", F.round(spread, 5).alias("isi"), F.round(fwi.fwi(spread, _c("c0")), 5).alias("fwi"))


@query(
    with_views("v_weather")
    + " SELECT cell, date, round(greatest(0::DOUBLE, least(100::DOUBLE, 100 * exp(17.625 * (temp - rain * 2) / (243.04 + temp - rain * 2)) / exp(17.625 * temp / (243.04 + temp)))), 5) AS rh FROM v_weather"
)
def p10_relative_humidity(spark, d):
    return views.weather_daily(spark, d).select("cell", "date", F.round(fwi.relative_humidity(_c("temp"), _c("temp") - _c("rain") * 2), 5).alias("rh"))


# --- dates ------------------------------------------------------------------

_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


def _days(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query(f"SELECT day, (isodow(day) - 1)::INTEGER AS dow, isodow(day) >= 6 AS weekend FROM {_DAYS}")
def d1_weekday(spark, d):
    return _days(spark, d).select("day", dates.iso_dow(_c("day")).alias("dow"), dates.is_weekend(_c("day")).alias("weekend"))


@query(f"SELECT day, CASE WHEN month(day) IN (12, 1, 2) THEN 0 WHEN month(day) < 6 THEN 1 WHEN month(day) < 9 THEN 2 ELSE 3 END AS season FROM {_DAYS}")
def d2_season(spark, d):
    return _days(spark, d).select("day", dates.season(_c("day")).alias("season"))


@query(f"SELECT day, round(sin(2 * pi() * (dayofyear(day) - 1) / 365.25), 6) AS s, round(cos(2 * pi() * (dayofyear(day) - 1) / 365.25), 6) AS c FROM {_DAYS}")
def d3_season_angle(spark, d):
    a = dates.season_angle(_c("day"))
    return _days(spark, d).select("day", F.round(F.sin(a), 6).alias("s"), F.round(F.cos(a), 6).alias("c"))


_EASTER = """y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3), easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS e FROM e4)"""


@query(f"WITH {_EASTER} SELECT y::INTEGER AS year, e AS easter FROM easter")
def d4_easter(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct().select("year", dates.easter(_c("year")).alias("easter"))


_HOLIDAYS = (
    _EASTER
    + ", holidays AS ("
    + " UNION ALL ".join([f"SELECT y::INTEGER AS year, make_date(y, {m}, {dd}) AS date, '{n}' AS label FROM easter" for m, dd, n in dates.FIXED_HOLIDAYS] + [f"SELECT y::INTEGER, e + {k}, '{n}' FROM easter" for k, n in dates.MOVABLE_HOLIDAYS])
    + ")"
)


@query(f"WITH {_HOLIDAYS} SELECT * FROM holidays")
def d5_public_holidays(spark, d):
    return dates.public_holidays(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())


@query(
    f"""WITH {_HOLIDAYS}, h AS (SELECT date, min(label) AS label FROM holidays GROUP BY 1), x AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY))::DATE AS date FROM orders)
    SELECT x.date, (isodow(x.date) - 1)::INTEGER AS weekday, h.label IS NOT NULL AS public_holiday, n.label IS NOT NULL AND year(n.date) = year(x.date) AS holiday_eve, p.label IS NOT NULL AND year(p.date) = year(x.date) AS holiday_after
    FROM x LEFT JOIN h USING (date) LEFT JOIN h n ON n.date = x.date + 1 LEFT JOIN h p ON p.date = x.date - 1"""
)
def d6_calendar(spark, d):
    a, b = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).cast("string"), F.to_date(F.max("o_orderdate")).cast("string")).first()
    return dates.build_calendar(spark, a, b).select("date", "weekday", "public_holiday", "holiday_eve", "holiday_after")


@query(
    f"""SELECT day, CASE WHEN (isodow(day) >= 6 OR day(day) % 10 = 0) AND month(day) BETWEEN 7 AND 8 THEN 1.4::DOUBLE WHEN isodow(day) >= 6 OR day(day) % 10 = 0 THEN 1.2::DOUBLE WHEN month(day) IN (12, 1, 2) THEN 0.6::DOUBLE ELSE 1::DOUBLE END AS multiplier FROM {_DAYS}"""
)
def d7_calendar_multiplier(spark, d):
    day = _c("day")
    return _days(spark, d).select("day", dates.calendar_multiplier(day, F.month(day).between(7, 8), F.dayofmonth(day) % 10 == 0).alias("multiplier"))


@query(f"SELECT day, CASE WHEN year(day) BETWEEN 1995 AND 1998 THEN 'train' WHEN year(day) = 1999 THEN 'validation' WHEN year(day) = 2000 THEN 'test' WHEN year(day) = 2001 THEN 'prospective' END AS split FROM {_DAYS}")
def d8_split_for_year(spark, d):
    return _days(spark, d).select("day", dates.split_for_year(F.year("day"), (1995, 1998), 1999, 2000, 2001).alias("split"))


@query("SELECT event_id, CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 12 HOUR THEN date_trunc('day', ts) + INTERVAL 12 HOUR ELSE date_trunc('day', ts) - INTERVAL 12 HOUR END AS noon FROM events")
def d9_latest_noon(spark, d):
    return table(spark, d, "events").select("event_id", dates.latest_noon(_c("ts")).alias("noon"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def d10_capture_window(spark, d):
    return table(spark, d, "events").select("event_id", dates.capture_window(_c("ts"), "hour").alias("hour"), dates.capture_window(_c("ts"), "day").alias("day"))


@query("SELECT event_id, CAST(ts + INTERVAL 1 HOUR AS DATE) AS day FROM events")  # the events lie in winter time
def d11_local_date(spark, d):
    return table(spark, d, "events").select("event_id", dates.local_date(_c("ts")).alias("day"))


@query("SELECT event_id, h.name AS horizon, ts + to_hours(h.hours) AS valid_at FROM events, (VALUES ('nowcast', 0), ('hours_6', 6), ('hours_24', 24), ('hours_48', 48)) h(name, hours)")
def d12_horizons(spark, d):
    return dates.with_horizons(table(spark, d, "events").select("event_id", F.col("ts").alias("base"))).select("event_id", "horizon", "valid_at")


@query(
    """WITH e AS (SELECT event_id, ts, CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 12 HOUR THEN date_trunc('day', ts) + INTERVAL 12 HOUR ELSE date_trunc('day', ts) - INTERVAL 12 HOUR END AS noon FROM events)
    SELECT event_id, ts + to_hours(unnest([0, 6, 24, 48])) AS t FROM e UNION SELECT event_id, noon FROM e UNION SELECT event_id, noon + to_days(unnest([1, 2])) FROM e"""
)
def s7_sample_times(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(dates.forecast_sample_times(_c("ts"))).alias("t"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 17 AS INTEGER) AS b FROM orders),
    p AS (SELECT *, unnest(range(0, date_diff('day', a, b) + 1, 5)) AS k FROM r) SELECT id, a + CAST(k AS INTEGER) AS first_day, least(a + CAST(k AS INTEGER) + 4, b) AS last_day FROM p"""
)
def s2_split_ranges(spark, d):
    from ..sources.readers import split_ranges

    r = table(spark, d, "orders").select(_c("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (_c("o_orderkey") % 17).cast("int")).alias("b"))
    return split_ranges(r, "a", "b", 5).select("id", "first_day", "last_day")


# --- text -------------------------------------------------------------------


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS missing FROM events")
def c1_json_number(spark, d):
    return table(spark, d, "events").select("event_id", text.json_number(_c("props"), "k").alias("k"), text.json_number(_c("props"), "nothing").alias("missing"))


_FOLD = "trim(regexp_replace(translate(lower({t}), '" + text.ACCENTED + "', '" + text.PLAIN + "'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FOLD.format(t='text')}) AS folded FROM documents")
def c2_fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_text(_c("text"))).alias("folded"))


@query(f"SELECT doc_id, contains(' ' || {_FOLD.format(t='text')} || ' ', ' the ') AS has_the FROM documents")
def c2_contains_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.contains_words(_c("text"), F.lit("Thé!")).alias("has_the"))


@query(
    """WITH k AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN lpad((c_custkey % 99999)::VARCHAR, 5, '0') WHEN 1 THEN '2A' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '97' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE 'x' || c_custkey END AS code FROM customer)
    SELECT key, regexp_full_match(code, '[0-9]{5}|2[AB][0-9]{3}') AS valid, CASE WHEN regexp_full_match(code, '[0-9]{5}|2[AB][0-9]{3}') THEN CASE WHEN code LIKE '97%' THEN substr(code, 1, 3) ELSE substr(code, 1, 2) END END AS department FROM k"""
)
def c3_commune_code(spark, d):
    k = _c("c_custkey")
    code = F.when(k % 4 == 0, F.lpad((k % 99999).cast("string"), 5, "0")).when(k % 4 == 1, F.concat(F.lit("2A"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 2, F.concat(F.lit("97"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return table(spark, d, "customer").select(k.alias("key"), text.valid_commune_code(code).alias("valid"), text.department_code(code).alias("department"))


@query("SELECT o_orderkey AS key, sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderpriority, '~')) AS checksum FROM orders")
def c4_row_checksum(spark, d):
    return table(spark, d, "orders").select(_c("o_orderkey").alias("key"), text.row_checksum(_c("o_orderkey"), _c("o_custkey"), _c("o_orderpriority"), F.lit(None)).alias("checksum"))


@query(sql_fingerprint("(SELECT o_orderkey::VARCHAR AS k, sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR)) AS c FROM orders)"))
def c4_fingerprint(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", text.row_checksum(_c("o_orderkey"), _c("o_custkey")).alias("checksum"))
    return text.fingerprint(rows, "o_orderkey", "checksum")


@query(with_views("v_ignitions") + " SELECT id, sha256(concat_ws('|', cell::VARCHAR, CAST(CAST(occurred_at AS DATE) AS VARCHAR), 'v1')) AS row_key FROM v_ignitions")
def c5_row_key(spark, d):
    return views.ignitions(spark, d).select("id", text.row_checksum(_c("cell"), F.to_date("occurred_at"), F.lit("v1")).alias("row_key"))


@query(with_views("v_cells") + " SELECT cell, row_number() OVER (PARTITION BY department ORDER BY md5('7|' || cell::VARCHAR), cell) AS place FROM v_cells")
def c6_hash_order(spark, d):
    from pyspark.sql import Window

    return views.cells(spark, d).select("cell", F.row_number().over(Window.partitionBy("department").orderBy(text.hash_order("7", _c("cell")), "cell")).cast("long").alias("place"))


@query("SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)(example\\.com|example\\.org)$') THEN 'authority' WHEN regexp_matches(h, '(^|\\.)(example\\.net)$') THEN 'press' ELSE 'other' END AS class FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)")
def c7_domain_class(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain_class(_c("url"), ["example.com", "example.org"], ["example.net"]).alias("class"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/:?#]+)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS url FROM pages")
def c7_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(_c("url")).alias("url"))


@query(
    with_views("v_ignitions")
    + """ SELECT id, CASE WHEN cause = 'naturelle' THEN 'natural_known' WHEN cause = 'inconnue' THEN 'unknown' ELSE 'human_known' END AS category,
    CASE cause WHEN 'accidentelle' THEN 'accident_unspecified' WHEN 'malveillance' THEN 'malicious' WHEN 'involontaire (travaux)' THEN 'work_activity' WHEN 'naturelle' THEN 'natural_unspecified' ELSE 'unknown_unspecified' END AS subcategory FROM v_ignitions"""
)
def s10_map_cause(spark, d):
    m = text.map_cause(F.concat(F.lit("  "), F.upper("cause")))
    return views.ignitions(spark, d).select("id", m["category"].alias("category"), m["subcategory"].alias("subcategory"))
