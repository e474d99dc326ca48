"""Queries of joins, kernels and windows over the domain views (j, a1-a5, w1, w2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import dates
from ..operators import spatial
from ..views import table, with_views
from .registry import query

_c = F.col
_DISK = "(SELECT dq, dr, greatest(abs(dq), abs(dr), abs(dq + dr)) AS ring FROM (SELECT unnest(range(-{k}, {k} + 1)) AS dq) a, (SELECT unnest(range(-{k}, {k} + 1)) AS dr) b WHERE abs(dq + dr) <= {k})"


def disk(k: int) -> str:
    return _DISK.format(k=k)


_KM = "sqrt(((c.q - s.q) * (c.q - s.q) + (c.q - s.q) * (c.r - s.r) + (c.r - s.r) * (c.r - s.r))::DOUBLE)"


def _stations(spark, d):
    return views.stations(spark, d).withColumnsRenamed({"q": "sq", "r": "sr"})


def _idw_sql(top: str) -> str:
    return (
        with_views("v_cells", "v_stations")
        + f""", p AS (SELECT c.cell, s.station, {_KM} AS km, s.temp, s.rh, s.wind, s.rain FROM v_cells c, v_stations s),
    n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY km, station) AS k, min(km) OVER (PARTITION BY cell) AS near FROM p),
    w AS (SELECT *, CASE WHEN near <= 1e-9 THEN CASE WHEN km <= 1e-9 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE pow(km, -2) END AS w FROM n {top})
    SELECT cell, round(sum(w * temp) / sum(w), 8) AS temp, round(sum(w * rain) / sum(w), 8) AS rain FROM w GROUP BY cell"""
    )


@query(_idw_sql("WHERE k <= 4"))
def j6_idw_nearest(spark, d):
    pairs = spatial.nearest(views.cells(spark, d).select("cell", "q", "r"), _stations(spark, d), 4)
    return spatial.idw(pairs, "cell", ["temp", "rain"]).select("cell", F.round("temp", 8).alias("temp"), F.round("rain", 8).alias("rain"))


@query(_idw_sql(""))
def j7_idw_all(spark, d):
    return spatial.idw_all(views.cells(spark, d).select("cell", "q", "r"), _stations(spark, d), ["temp", "rain"]).select("cell", F.round("temp", 8).alias("temp"), F.round("rain", 8).alias("rain"))


@query(
    with_views("v_scores")
    + """, inc AS (SELECT DISTINCT computed_at FROM v_scores WHERE month(computed_at) % 2 = 1), vis AS (SELECT * FROM v_scores WHERE computed_at NOT IN (SELECT computed_at FROM inc)),
    m AS (SELECT horizon, max(computed_at) AS computed_at FROM vis GROUP BY 1) SELECT cell, commune, horizon, computed_at, k1, k2 FROM vis JOIN m USING (horizon, computed_at)"""
)
def j2_latest_visible(spark, d):
    s = views.scores(spark, d)
    inc = s.where(F.month("computed_at") % 2 == 1).select("computed_at").distinct()
    return spatial.latest_visible(s, inc).select("cell", "commune", "horizon", "computed_at", "k1", "k2")


@query(
    with_views("v_ignitions")
    + """, s AS (SELECT DISTINCT date_trunc('month', occurred_at) AS f, CASE WHEN month(occurred_at) % 3 <> 0 THEN date_trunc('month', occurred_at) + INTERVAL 45 DAY END AS u FROM v_ignitions),
    j AS (SELECT id, max(f) AS available_from FROM v_ignitions JOIN s ON occurred_at >= f + INTERVAL 10 DAY AND (u IS NULL OR occurred_at < u) AND month(occurred_at) < 9 GROUP BY id)
    SELECT i.id, CAST(available_from + INTERVAL 10 DAY AS TIMESTAMP) AS available_from FROM v_ignitions i LEFT JOIN j USING (id)"""
)
def j3_asof_snapshot(spark, d):
    i = views.ignitions(spark, d)
    f = F.date_trunc("month", "occurred_at")
    s = i.select((f + F.expr("interval 10 days")).alias("available_from"), F.when(F.month("occurred_at") % 3 != 0, f + F.expr("interval 45 days")).alias("available_until")).distinct()
    facts = i.select("id", F.when(F.month("occurred_at") < 9, _c("occurred_at")).alias("at"))
    return spatial.asof_snapshot(facts, s, "at", "id").select("id", "available_from")


@query(
    with_views("v_weather")
    + """, e AS (SELECT event_id, user_id % 8 AS cell, ts - INTERVAL 29 YEAR AS t FROM events), n AS (SELECT *, CASE WHEN t >= date_trunc('day', t) + INTERVAL 12 HOUR THEN CAST(t AS DATE) ELSE CAST(t - INTERVAL 1 DAY AS DATE) END AS noon FROM e)
    SELECT event_id, temp, rain FROM n JOIN v_weather w ON w.cell = n.cell AND w.date = n.noon"""
)
def j4_asof_noon(spark, d):
    e = views.observations(spark, d).select("event_id", (_c("user_id") % 8).alias("cell"), (_c("observed_at") - F.expr("interval 29 years")).alias("valid_at"))
    w = views.weather_daily(spark, d).withColumn("noon", _c("date").cast("timestamp") + F.expr("interval 12 hours"))
    return spatial.asof_noon(e, w).select("event_id", "temp", "rain")


@query("SELECT user_id, max(ts) AS valid_at, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15 07:30:00' GROUP BY user_id")
def j5_latest_hour(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").alias("valid_at"), "value")
    return spatial.latest_hour(e, F.lit("2024-01-15 07:30:00").cast("timestamp"), ["user_id"])


_EV = with_views("v_cells", "v_ignitions") + """, ev AS (SELECT id AS event, cell, CAST(occurred_at AS DATE) AS date, ['precision_undocumented', 'rounded_coordinate_probable', 'municipality_centroid_probable', 'other'][id % 4 + 1] AS category, cause FROM v_ignitions),
  cand AS (SELECT cell, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) + CAST(key * 37 % 2400 AS INTEGER) AS date, key FROM v_cells UNION ALL SELECT cell + 67108864, date + CAST(event % 5 AS INTEGER), event + 1000000 FROM ev) """


def _events(spark, d):
    names = F.array(*map(F.lit, ["precision_undocumented", "rounded_coordinate_probable", "municipality_centroid_probable", "other"]))
    return views.ignitions(spark, d).select(_c("id").alias("event"), "cell", F.to_date("occurred_at").alias("date"), F.element_at(names, (_c("id") % 4 + 1).cast("int")).alias("category"), "cause")


def _candidates(spark, d):
    first = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("f"))
    c = views.cells(spark, d).crossJoin(F.broadcast(first)).select("cell", F.date_add("f", (_c("key") * 37 % 2400).cast("int")).alias("date"), "key")
    return c.unionByName(_events(spark, d).select((_c("cell") + 67108864).alias("cell"), F.date_add("date", (_c("event") % 5).cast("int")).alias("date"), (_c("event") + 1000000).alias("key")))


_Q = "((e.cell // 67108864) % 67108864 - (c.cell // 67108864) % 67108864)"
_R = "(e.cell % 67108864 - c.cell % 67108864)"
_DIST = f"greatest(abs({_Q}), abs({_R}), abs({_Q} + {_R}))"


def _exclusion(k: str, days: str) -> str:
    # pairs by day offset, an equi-join
    near = f", hit AS (SELECT DISTINCT c.key FROM cand c, (SELECT unnest(range(-3, 4)) AS o) JOIN ev e ON e.date = c.date + CAST(o AS INTEGER) WHERE abs(o) <= {days} AND {_DIST} <= {k}) "
    return _EV + near + f"SELECT key, cell, date FROM cand ANTI JOIN hit USING (key)"


_K3 = "CASE e.category WHEN 'precision_undocumented' THEN 1 WHEN 'rounded_coordinate_probable' THEN 3 ELSE 5 END"
_D3 = "CASE e.category WHEN 'precision_undocumented' THEN 1 WHEN 'rounded_coordinate_probable' THEN 2 WHEN 'municipality_centroid_probable' THEN 2 ELSE 3 END"


@query(_exclusion("0", "0"))
def j8_exclude_n0(spark, d):
    return spatial.exclude_near(_candidates(spark, d), _events(spark, d), "N0").select("key", "cell", "date")


@query(_exclusion("1", "1"))
def j8_exclude_n1(spark, d):
    return spatial.exclude_near(_candidates(spark, d), _events(spark, d), "N1").select("key", "cell", "date")


@query(_exclusion("2", "3"))
def j8_exclude_n2(spark, d):
    return spatial.exclude_near(_candidates(spark, d), _events(spark, d), "N2").select("key", "cell", "date")


@query(_exclusion(_K3, _D3))
def j8_exclude_n3(spark, d):
    return spatial.exclude_near(_candidates(spark, d), _events(spark, d), "N3").select("key", "cell", "date")


@query(
    _EV
    + f"""SELECT cause, count(DISTINCT key) FILTER ({_DIST} <= 0 AND gap = 0) AS n0, count(DISTINCT key) FILTER ({_DIST} <= 1 AND gap <= 1) AS n1, count(DISTINCT key) FILTER ({_DIST} <= 2 AND gap <= 3) AS n2, count(DISTINCT key) FILTER ({_DIST} <= {_K3} AND gap <= {_D3}) AS n3
    FROM (SELECT c.*, e AS e, abs(o) AS gap, e.cause AS cause FROM cand c, (SELECT unnest(range(-3, 4)) AS o) JOIN ev e ON e.date = c.date + CAST(o AS INTEGER)) c GROUP BY cause""".replace("e.cell", "c.e.cell").replace("e.category", "c.e.category")
)
def a24_exclusion_census(spark, d):
    from ..operators.dataset import exclusion_census

    return exclusion_census(_candidates(spark, d), _events(spark, d))


@query(with_views("v_cells") + f" SELECT c.cell, CAST(coalesce(sum(v.buildings), 0) AS BIGINT) AS buildings FROM v_cells c, {disk(1)} n LEFT JOIN v_cells v ON v.cell = c.cell + n.dq * 67108864 + n.dr GROUP BY 1")
def a1_ring_sum(spark, d):
    c = views.cells(spark, d)
    return spatial.ring_sum(c, c, "buildings")


@query(
    with_views("v_cells", "v_ignitions")
    + f""" SELECT c.cell, round(coalesce(sum(pow(0.5, n.ring)) FILTER (i.id IS NOT NULL), 0), 6) AS hist FROM v_cells c, {disk(2)} n LEFT JOIN v_ignitions i ON i.cell = c.cell + n.dq * 67108864 + n.dr GROUP BY 1"""
)
def a2_history_kernel(spark, d):
    return spatial.history_kernel(views.cells(spark, d), views.ignitions(spark, d)).select("cell", F.round("hist", 6).alias("hist"))


@query(with_views("v_cells") + " SELECT cell, round(CASE WHEN max(buildings) OVER (PARTITION BY department) > 0 THEN buildings::DOUBLE / max(buildings) OVER (PARTITION BY department) ELSE 0 END, 6) AS buildings FROM v_cells")
def a3_max_normalize(spark, d):
    return spatial.max_normalize(views.cells(spark, d), "buildings", ["department"]).select("cell", F.round("buildings", 6).alias("buildings"))


_PLACES = """, b AS (SELECT cell, (key * 31 % 200)::DOUBLE AS x, (key * 17 % 200)::DOUBLE AS y FROM v_cells), p AS (SELECT cell, (key * 29 % 200)::DOUBLE AS x, (key * 13 % 200)::DOUBLE AS y FROM v_cells WHERE combustible) """


def _places(spark, d):
    c = views.cells(spark, d)
    b = c.select("cell", (_c("key") * 31 % 200).cast("double").alias("x"), (_c("key") * 17 % 200).cast("double").alias("y"))
    p = c.where("combustible").select("cell", (_c("key") * 29 % 200).cast("double").alias("x"), (_c("key") * 13 % 200).cast("double").alias("y"))
    return b, p, c


@query(
    with_views("v_cells") + _PLACES + f""" SELECT b.cell FROM b, {disk(1)} n JOIN p ON p.cell = b.cell + n.dq * 67108864 + n.dr WHERE pow(b.x - p.x, 2) + pow(b.y - p.y, 2) <= 2500
    UNION SELECT b.cell FROM b JOIN v_cells c ON c.cell = b.cell AND c.combustible AND c.agri"""
)
def j12_wui_cells(spark, d):
    b, p, c = _places(spark, d)
    return spatial.wui_cells(b, p, c.withColumn("combustible", _c("combustible") & _c("agri")))


@query(
    with_views("v_cells", "v_ignitions")
    + f""", n AS (SELECT i.id AS event, n.ring, c.cell FROM v_ignitions i, {disk(2)} n JOIN v_cells c ON c.cell = i.cell + n.dq * 67108864 + n.dr AND c.combustible),
    k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ring, cell) AS k FROM n)
    SELECT event, count(*) FILTER (ring = 0) AS ring_0, count(*) FILTER (ring = 1) AS ring_1, count(*) FILTER (ring = 2) AS ring_2, string_agg(cell::VARCHAR, ',' ORDER BY k) FILTER (k <= 5) AS nearest FROM k GROUP BY event"""
)
def j13_nearest_combustible(spark, d):
    e = views.ignitions(spark, d).select(_c("id").alias("event"), "cell")
    out = spatial.nearest_combustible(e, views.cells(spark, d))
    return out.select("event", "ring_0", "ring_1", "ring_2", F.array_join(F.transform("nearest", lambda x: x.cast("string")), ",").alias("nearest"))


_PAIR = """ AS left, b.id AS right FROM v_ignitions a JOIN v_ignitions b ON CAST(a.occurred_at AS DATE) = CAST(b.occurred_at AS DATE) AND a.id < b.id
  WHERE a.commune = b.commune OR greatest(abs((a.cell // 67108864) % 67108864 - (b.cell // 67108864) % 67108864), abs(a.cell % 67108864 - b.cell % 67108864), abs((a.cell // 67108864) % 67108864 - (b.cell // 67108864) % 67108864 + a.cell % 67108864 - b.cell % 67108864)) <= 1"""


@query(with_views("v_ignitions") + " SELECT a.id" + _PAIR.replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def j14_duplicate_pairs(spark, d):
    return spatial.duplicate_pairs(views.ignitions(spark, d))


@query(with_views("v_cells", "v_weather") + " SELECT key, CASE WHEN w.cell IS NULL THEN 'missing' ELSE 'observed' END AS status, coalesce(w.n, 0) AS n FROM v_cells c LEFT JOIN (SELECT cell * 3 AS cell, count(*) AS n FROM v_weather GROUP BY 1) w ON w.cell = c.key")
def j15_fill_missing(spark, d):
    w = views.weather_daily(spark, d).groupBy((_c("cell") * 3).alias("key")).agg(F.count("*").alias("n"))
    return spatial.fill_missing(views.cells(spark, d).select("key"), w, "key").select("key", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_views("v_cells", "v_ignitions") + " SELECT key FROM v_cells c WHERE EXISTS (SELECT 1 FROM v_ignitions i WHERE i.cell = c.cell) AND NOT EXISTS (SELECT 1 FROM v_ignitions i WHERE i.cell = c.cell AND i.cause = 'naturelle')")
def j16_semi_anti(spark, d):
    c, i = views.cells(spark, d), views.ignitions(spark, d)
    return c.join(i, "cell", "left_semi").join(i.where("cause = 'naturelle'"), "cell", "left_anti").select("key")


@query(with_views("v_observations") + " SELECT event_id, round(sum(greatest(coalesce(frp - 20, 0), 0)) OVER (PARTITION BY user_id ORDER BY observed_at, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS rain_24 FROM v_observations")
def w1_rolling_precip(spark, d):
    o = views.observations(spark, d).withColumn("rain", _c("frp") - 20).withColumn("at", F.struct("observed_at", "event_id"))
    return o.select("event_id", F.round(spatial.rolling_precip(o, ["user_id"], "at"), 4).alias("rain_24"))


@query(
    with_views("v_observations")
    + """, g AS (SELECT *, abs(floor(epoch(observed_at))::BIGINT - epoch(TIMESTAMP '2024-01-10 12:00:00')::BIGINT) AS gap FROM v_observations)
    SELECT user_id AS station, arg_min(event_id, (gap, observed_at, event_id)) AS event_id, max(observed_at) AS latest FROM g GROUP BY user_id"""
)
def w2_station_selection(spark, d):
    o = views.observations(spark, d).withColumnRenamed("user_id", "station")
    return spatial.station_selection(o, F.lit("2024-01-10 12:00:00").cast("timestamp")).select("station", "event_id", "latest")


@query(
    """WITH c AS (SELECT c_custkey AS key, 43 + c_custkey % 50 * 0.031::DOUBLE AS lat, 1 + c_custkey % 37 * 0.037::DOUBLE AS lon FROM customer),
    a AS (SELECT x * 100 + y AS anchor, 42.6 + x * 0.2::DOUBLE AS alat, 0.6 + y * 0.2::DOUBLE AS alon FROM (SELECT unnest(range(0, 13)) AS x) p, (SELECT unnest(range(0, 13)) AS y) q),
    n AS (SELECT key, anchor, row_number() OVER (PARTITION BY key ORDER BY round(pow(lat - alat, 2) + pow(lon - alon, 2), 9), anchor) AS k FROM c, a) SELECT key, anchor FROM n WHERE k <= 4"""
)
def j6_lattice_nearest(spark, d):
    k = _c("c_custkey")
    c = table(spark, d, "customer").select(k.alias("key"), (43 + k % 50 * F.lit(0.031)).alias("lat"), (1 + k % 37 * F.lit(0.037)).alias("lon"))
    i = spark.range(13)
    a = i.select(_c("id").alias("x")).crossJoin(i.select(_c("id").alias("y"))).select((_c("x") * 100 + _c("y")).alias("anchor"), (42.6 + _c("x") * F.lit(0.2)).alias("alat"), (0.6 + _c("y") * F.lit(0.2)).alias("alon"))
    return spatial.nearest_on_lattice(c, a, 0.2, 4, "key").select("key", "anchor")


@query(with_views("v_observations") + """, h AS (SELECT user_id AS loc, list(observed_at ORDER BY event_id) AS t, list(frp ORDER BY event_id) AS v FROM v_observations GROUP BY 1) SELECT loc, unnest(t) AS time, unnest(v) AS temp FROM h""")
def s5_hourly_forecast(spark, d):
    from ..sources.readers import normalize_hourly_forecast

    h = views.observations(spark, d).groupBy(_c("user_id").alias("loc")).agg(F.array_sort(F.collect_list(F.struct("event_id", "observed_at", "frp"))).alias("h"))
    of = lambda n: F.transform("h", lambda x: x[n])
    v = of("frp")
    rows = h.select("loc", of("observed_at").alias("time"), v.alias("temp"), v.alias("rh"), v.alias("wind"), v.alias("rain"), F.lit("°C").alias("temp_unit"))
    return normalize_hourly_forecast(rows, {"temp": "°C"}).select("loc", "time", "temp")
