"""Queries of readers, versioned writes, snapshots and streams (s, k, n, w9, w10, a4, a26, j10, c8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import grid
from ..operators import spatial
from ..plans import weather_index
from ..sources import readers, sinks
from ..sources.staging import scratch
from ..streaming import jobs
from ..views import table, with_views
from .joins import disk
from .registry import query
from .scalar import _CENTRE, _sql_forward, _sql_hex, _sql_inverse, sql_fingerprint

_c = F.col


# --- readers ----------------------------------------------------------------


def _detections(spark, d):
    e, i = table(spark, d, "events"), _c("event_id")
    path = scratch(spark, "firms")
    e.select(
        F.when(i % 50 == 0, F.lit("95.5")).otherwise((42 + i % 97 / 12.0).cast("string")).alias("latitude"), (-2 + i % 89 / 9.0).cast("string").alias("longitude"), F.lit(300.0).alias("bright_ti4"), F.lit(0.4).alias("scan"), F.lit(0.4).alias("track"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.when(i % 60 == 0, F.lit("9999")).otherwise((F.hour("ts") * 100 + F.minute("ts")).cast("string")).alias("acq_time"), F.lit("N").alias("satellite"), F.lit("VIIRS").alias("instrument"), F.lit("n").alias("confidence"),
        F.lit("2.0").alias("version"), F.lit(290.0).alias("bright_ti5"), _c("value").alias("frp"), F.lit("D").alias("daynight"),
    ).write.option("header", True).csv(path)
    return readers.read_firms(spark, path)


_DETECTED = "(SELECT event_id, date_trunc('minute', ts) AS observed_at, value AS frp, 42 + event_id % 97 / 12.0::DOUBLE AS lat, -2 + event_id % 89 / 9.0::DOUBLE AS lon FROM events WHERE event_id % 50 <> 0 AND event_id % 60 <> 0)"


@query(f"SELECT observed_at, cell, frp, round(lat * 100000)::BIGINT || ':' || round(lon * 100000)::BIGINT || ':' || epoch(observed_at)::BIGINT || ':N' AS dedupe_key FROM {_sql_hex(_sql_forward(_DETECTED), grid.edge_m(8), 8)}")
def s1_read_firms(spark, d):
    return _detections(spark, d)[0].select("observed_at", "cell", "frp", "dedupe_key")


@query("SELECT CASE WHEN event_id % 60 = 0 THEN 'invalid_time' ELSE 'invalid_latitude' END AS error, count(*) AS n FROM events WHERE event_id % 50 = 0 OR event_id % 60 = 0 GROUP BY 1")
def s1_rejected_detections(spark, d):
    return _detections(spark, d)[1].groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT user_id AS station, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value + 280 - 273.15), 4) AS temp FROM events WHERE event_id % 9 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2")
def s3_read_synop(spark, d):
    i, path = _c("event_id"), scratch(spark, "synop")
    rows = table(spark, d, "events").select(F.lit(43.0).alias("lat"), F.lit(2.0).alias("lon"), _c("user_id").alias("geo_id_wmo"), F.lit("x").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("validity_time"), (i % 10).alias("ff"), (_c("value") + 280).alias("t"), (i % 100).alias("u"), F.when(i % 9 != 0, i % 4).alias("rr24"))
    rows.write.options(header=True, sep=";").csv(path)
    t = readers.read_synop(spark, path, "2024-01-05", "2024-01-20")
    return t.groupBy(_c("station").cast("long").alias("station"), F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("temp"), 4).alias("temp"))


@query("SELECT user_id AS station, CAST(ts AS DATE) AS date, arg_min(event_id, event_id) AS row FROM events WHERE user_id % 3 = 0 AND hour(ts) = 12 AND minute(ts) = 0 GROUP BY 1, 2")
def s4_noon_archive(spark, d):
    e = table(spark, d, "events").select(_c("user_id").alias("station"), _c("ts").alias("observed_at"), _c("event_id").alias("row"))
    return readers.noon_archive(e, e.where("station % 3 = 0").select("station").distinct()).select("station", "date", "row")


@query(
    """WITH f AS (SELECT user_id, CAST(ts AS DATE) AS date, hour(ts) % 3 AS slot, min(event_id) AS e FROM events GROUP BY 1, 2, 3)
    SELECT user_id::VARCHAR AS station, date, round(280 + e % 30 - 273.15::DOUBLE, 4) AS temp, (e % 100)::DOUBLE AS rh, round(e % 10 * 3.6::DOUBLE, 4) AS wind, (CASE WHEN e % 5 = 1 THEN 0 ELSE e % 4 END)::DOUBLE AS rain FROM f WHERE slot = 1 AND user_id % 3 = 0 AND e % 9 <> 0"""
)
def s4_read_synop_archive(spark, d):
    e, path = _c("e"), scratch(spark, "archive")
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), (F.hour("ts") % 3).alias("slot")).agg(F.min("event_id").alias("e"))
    hour = F.element_at(F.array(F.lit("09"), F.lit("12"), F.lit("15")), (_c("slot") + 1).cast("int"))
    rain = F.when(e % 9 == 0, "mq").when(e % 5 == 1, "-0.1").otherwise((e % 4).cast("string"))
    rows = days.select(_c("user_id").cast("string").alias("numer_sta"), F.concat(F.date_format("day", "yyyyMMdd"), hour, F.lit("0000")).alias("date"), (e % 10).alias("ff"), (e % 30 + 280).alias("t"), (e % 100).alias("u"), rain.alias("rr24"))
    rows.write.options(header=True, sep=";", compression="gzip").csv(path)
    known = days.where("user_id % 3 = 0").select(_c("user_id").cast("string").alias("station")).distinct()
    t = readers.read_synop_archive(spark, path, known)
    return t.select("station", "date", F.round("temp", 4).alias("temp"), "rh", F.round("wind", 4).alias("wind"), "rain")


@query("SELECT DATE '2024-01-01' + CAST(k AS INTEGER) AS date FROM (SELECT unnest(range(0, 40)) AS k) WHERE DATE '2024-01-01' + CAST(k AS INTEGER) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE day(ts) % 4 <> 0)")
def s4_missing_days(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("date")).where(F.dayofmonth("date") % 4 != 0)
    return readers.missing_days(e, "2024-01-01", "2024-02-09")


@query(
    """WITH a AS (SELECT s_suppkey AS anchor, 43 + s_suppkey % 40 * 0.071::DOUBLE AS lat, 1 + s_suppkey % 37 * 0.083::DOUBLE AS lon FROM supplier), f AS (SELECT qlat, qlon FROM (SELECT unnest(range(168, 190)) AS qlat), (SELECT unnest(range(0, 22)) AS qlon)),
    n AS (SELECT anchor, qlat, qlon, row_number() OVER (PARTITION BY anchor ORDER BY round(pow(qlat / 4.0::DOUBLE - lat, 2) + pow(qlon / 4.0::DOUBLE - lon, 2), 9), qlat, qlon) AS k FROM a, f)
    SELECT anchor, round((280 + (qlat * 7 + qlon) % 30)::DOUBLE - 273.15, 4)::DOUBLE AS temp, round(sqrt(pow(qlat % 7, 2) + pow(qlon % 5, 2)) * 3.6, 4) AS wind, round(greatest((qlat + qlon) % 9 - (qlat * qlon) % 6, 0)::DOUBLE, 4) AS rain FROM n WHERE k = 1"""
)
def s6_gridded_weather(spark, d):
    k = _c("s_suppkey")
    a = table(spark, d, "supplier").select(k.alias("anchor"), (43 + k % 40 * F.lit(0.071)).alias("lat"), (1 + k % 37 * F.lit(0.083)).alias("lon"))
    g = spark.range(168, 190).select(_c("id").alias("qlat")).crossJoin(spark.range(22).select(_c("id").alias("qlon")))
    x, y = _c("qlat"), _c("qlon")
    values = {"t2m": 280 + (x * 7 + y) % 30, "d2m": 278 + (x + y) % 3, "u10": x % 7, "v10": y % 5, "tp": (x + y) % 9 / 1000.0, "tp24": (x * y) % 6 / 1000.0}
    f = g.select("qlat", "qlon", F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), v.cast("double").alias("value")) for n, v in values.items()))).alias("v")).select("qlat", "qlon", "v.*")
    return readers.combine_gridded_weather(f, a).select("anchor", *(F.round(c, 4).alias(c) for c in ("temp", "wind", "rain")))


@query(with_views("v_ignitions") + " SELECT id, concat_ws(',', CASE WHEN id % 13 = 0 THEN 'invalid_timestamp' END, CASE WHEN id % 11 = 0 THEN 'invalid_latitude' END, CASE WHEN id % 7 = 0 THEN 'missing_cause' END) AS errors, round(surface_ha, 3) AS surface_ha FROM v_ignitions")
def s9_normalize_records(spark, d):
    return _records(spark, d).select(_c("external_id").cast("long").alias("id"), F.array_join("errors", ",").alias("errors"), F.round("surface_ha", 3).alias("surface_ha"))


def _records(spark, d):
    i = _c("id")
    raw = views.ignitions(spark, d).select(i.cast("string").alias("external_id"), F.when(i % 13 == 0, "yesterday").otherwise(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss")).alias("occurred_at"), F.lit("Somewhere").alias("municipality"), F.when(i % 11 == 0, "91").otherwise("43,5").alias("latitude"), F.lit("2,25").alias("longitude"), F.regexp_replace(_c("surface_ha").cast("string"), r"\.", ",").alias("surface_ha"), F.when(i % 7 != 0, _c("cause")).alias("cause"))
    return readers.normalize_fire_records(raw)


@query(with_views("v_ignitions") + " SELECT CASE commune % 3 WHEN 0 THEN 43.0::DOUBLE WHEN 1 THEN 44.0::DOUBLE ELSE 45.0::DOUBLE END AS lat, count(*) AS n, round(sum(surface_ha * 1000), 2) AS ha FROM v_ignitions GROUP BY 1")
def s11_national_export(spark, d):
    i = views.ignitions(spark, d)
    p = _c("commune") % 3
    raw = i.select(F.date_format("occurred_at", "dd/MM/yyyy HH:mm").alias("Date de première alerte"), F.when(p == 0, "A").when(p == 1, "B").otherwise("Ç-d").alias("Nom de la commune"), F.when(p == 0, "11001").otherwise("99999").alias("Code INSEE"), F.when(p == 1, "11").otherwise("??").alias("Département"), (_c("surface_ha") * 10_000_000).cast("string").alias("Surface parcourue (m2)"), _c("cause").alias("Nature"))
    centres = spark.createDataFrame([("11001", "11", "A", 43.0, 2.0), ("11002", "11", "b", 44.0, 2.0), ("12003", "12", "b", 40.0, 2.0), ("13004", "13", "c d", 45.0, 2.0)], "code string, department string, name string, lat double, lon double")
    return readers.normalize_national_export(raw, centres).groupBy("lat").agg(F.count("*").alias("n"), F.round(F.sum("surface_ha"), 2).alias("ha"))


@query(with_views("v_ignitions") + " SELECT id::VARCHAR AS external_id, 43 + lat_m / 1000 AS latitude, cause FROM v_ignitions WHERE (id % 2 = 0 OR id % 5 = 1) AND lat_m / 1000 BETWEEN 0.2 AND 0.6 AND lon_m / 1000 BETWEEN 0.1 AND 0.9")
def s12_fire_history(spark, d):
    i = views.ignitions(spark, d)
    rows = i.select("id", _c("id").cast("string").alias("external_id"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.lit("x").alias("municipality"), (43 + _c("lat_m") / 1000).alias("latitude"), (2 + _c("lon_m") / 1000).alias("longitude"), "surface_ha", "cause")
    paths = []
    for name, which in (("bdiff", "id % 2 = 0"), ("promethee", "id % 2 = 1 and id % 5 = 1")):
        paths.append(scratch(spark, name))
        rows.where(which).drop("id").write.option("header", True).csv(paths[-1])
    return readers.read_fire_history(spark, paths, (2.1, 43.2, 2.9, 43.6)).select("external_id", "latitude", "cause")


@query(with_views("v_cells") + ", t AS (SELECT key % 6 AS k, key FROM v_cells) SELECT key, CASE k WHEN 0 THEN 'road' WHEN 1 THEN 'power_line' WHEN 2 THEN 'building' WHEN 3 THEN 'poi' WHEN 4 THEN 'poi' END AS kind FROM t")
def s14_classify_tags(spark, d):
    k = _c("key") % 6
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    tags = F.when(k == 0, pair("highway", "track")).when(k == 1, pair("power", "line")).when(k == 2, pair("building", "yes")).when(k == 3, pair("amenity", "parking")).when(k == 4, pair("tourism", "camp_site")).otherwise(pair("power", "tower"))
    return views.cells(spark, d).select("key", readers.classify_tags(tags).alias("kind"))


_NODE = "(SELECT DISTINCT o_custkey AS node, o_custkey % 50 AS way, ['road', 'power_line', 'building', 'poi'][o_custkey % 50 % 4 + 1] AS kind, 43 + o_custkey % 100 / 1000.0::DOUBLE AS nlat, 2 + o_custkey / 100000.0::DOUBLE AS nlon FROM orders)"
_METRES = "2 * 6371008.8::DOUBLE * asin(sqrt(least(pow(sin((radians(lat2) - radians(nlat)) / 2), 2) + cos(radians(nlat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(nlon)) / 2), 2), 1)))"


@query(
    f"""WITH n AS {_NODE}, sg AS (SELECT *, (nlat + lat2) / 2 AS lat, (nlon + lon2) / 2 AS lon, {_METRES} AS m FROM (SELECT *, lead(nlat) OVER w AS lat2, lead(nlon) OVER w AS lon2 FROM n WHERE kind IN ('road', 'power_line') WINDOW w AS (PARTITION BY way ORDER BY node)) WHERE lat2 IS NOT NULL),
    li AS (SELECT cell, round(coalesce(sum(m) FILTER (kind = 'road'), 0), 3) AS road_m, round(coalesce(sum(m) FILTER (kind = 'power_line'), 0), 3) AS power_line_m FROM {_sql_hex(_sql_forward('sg'), grid.edge_m(8), 8)} GROUP BY 1),
    sp AS (SELECT way, kind, avg(nlat) AS lat, avg(nlon) AS lon FROM n WHERE kind IN ('building', 'poi') GROUP BY 1, 2), sc AS (SELECT cell, count(DISTINCT sub) FILTER (kind = 'building') AS buildings, count(*) FILTER (kind = 'poi') AS poi FROM {_sql_hex(_sql_hex(_sql_forward('sp'), grid.edge_m(11), 11, 'sub'), grid.edge_m(8), 8)} GROUP BY 1)
    SELECT cell, coalesce(road_m, 0) AS road_m, coalesce(power_line_m, 0) AS power_line_m, coalesce(buildings, 0) AS buildings, coalesce(poi, 0) AS poi FROM li FULL JOIN sc USING (cell)"""
)
def s15_aggregate_osm(spark, d):
    node = _c("o_custkey")
    o = table(spark, d, "orders").select("o_custkey").distinct()
    nodes = o.select(node.alias("node"), (43 + node % 100 / 1000.0).alias("lat"), (2 + node / 100_000.0).alias("lon"))
    kind = F.element_at(F.array(*map(F.lit, ["road", "power_line", "building", "poi"])), (_c("way") % 4 + 1).cast("int"))
    ways = o.groupBy((node % 50).alias("way")).agg(F.array_sort(F.collect_list("o_custkey")).alias("refs")).withColumn("kind", kind)
    a = readers.aggregate_osm(nodes, ways)
    return a.select("cell", "road_m", "power_line_m", F.coalesce(F.size("building_cells"), F.lit(0)).cast("long").alias("buildings"), "poi")


@query("SELECT p_partkey AS key, p_partkey % 400 BETWEEN 211 AND 244 AS agricultural, p_partkey % 400 BETWEEN 211 AND 244 OR p_partkey % 400 IN (311, 312, 313, 321, 322, 323, 324, 333, 334) AS combustible FROM part")
def s17_classify_land_cover(spark, d):
    a, b = readers.classify_land_cover(_c("p_partkey") % 400)
    return table(spark, d, "part").select(_c("p_partkey").alias("key"), a.alias("agricultural"), b.alias("combustible"))


@query(with_views("v_cells") + " SELECT cell, bool_or(key % 10 < 3) AS agricultural, bool_or(key % 10 < 5) AS combustible FROM v_cells WHERE key % 10 <> 9 GROUP BY cell")
def s18_land_cover_cells(spark, d):
    x, y = grid.cell_xy(_c("cell"))
    code = F.when(_c("key") % 10 < 3, 221).when(_c("key") % 10 < 5, 311).when(_c("key") % 10 == 9, 0).otherwise(112)
    return readers.aggregate_land_cover(views.cells(spark, d).select(x.alias("x"), y.alias("y"), code.alias("code")))


_SQUARES = "(SELECT (3700000 + id % 300 * 200 + 100)::DOUBLE AS x, (2300000 + id % 500 * 200 + 100)::DOUBLE AS y, surface_ha - 100 AS ind, (id % 2)::INTEGER AS imputed FROM v_ignitions)"


@query(with_views("v_ignitions") + f" SELECT cell, round(sum(greatest(ind, 0)), 3) AS population, max(imputed) AS imputed FROM {_sql_hex(_SQUARES, grid.edge_m(8), 8)} GROUP BY 1")
def s19_population(spark, d):
    rows = views.ignitions(spark, d).select(F.format_string("CRS3035RES200mN%dE%d", 2300000 + _c("id") % 500 * 200, 3700000 + _c("id") % 300 * 200).alias("id"), (_c("surface_ha") - 100).alias("ind"), (_c("id") % 2).cast("int").alias("imputed"))
    return readers.aggregate_population(rows).select("cell", F.round("population", 3).alias("population"), "imputed")


# --- versioned writes -------------------------------------------------------

_OBS = with_views("v_observations")


@query(_OBS + ", t AS (SELECT DISTINCT user_id, minute FROM v_observations WHERE event_id % 3 = 0) SELECT user_id, minute, min(event_id) AS event_id FROM v_observations o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = o.user_id AND t.minute = o.minute) GROUP BY 1, 2")
def k1_insert_new(spark, d):
    o = views.observations(spark, d)
    return sinks.new_rows(o, o.where("event_id % 3 = 0"), ["user_id", "minute"], ["event_id"]).select("user_id", "minute", "event_id")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM customer UNION ALL SELECT c_custkey + 1000000, 2 FROM customer WHERE c_custkey % 100 = 0")
def k2_upsert(spark, d):
    c = table(spark, d, "customer").select(_c("c_custkey").alias("key"), F.lit(1).alias("version"))
    new = c.where("key % 4 = 0").unionByName(c.where("key % 100 = 0").withColumn("key", _c("key") + 1000000)).withColumn("version", F.lit(2))
    return sinks.upsert(new, c, ["key"], "version")


@query("SELECT c_custkey AS key, 'p' || c_custkey % 20 AS batch, CASE WHEN c_custkey % 20 IN (4, 7) AND c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer UNION ALL SELECT c_custkey + 1000000, 'p4', 2 FROM customer WHERE c_custkey % 20 = 4 AND c_custkey % 3 = 0")
def k2_upsert_published(spark, d):
    path, manifest = scratch(spark, "upserts"), scratch(spark, "upserts-manifest")
    c = table(spark, d, "customer").select(_c("c_custkey").alias("key"), F.concat(F.lit("p"), _c("c_custkey") % 20).alias("batch"), F.lit(1).alias("version"))
    new = c.where("key % 20 in (4, 7) and key % 3 = 0").withColumn("version", F.lit(2))
    new = new.unionByName(new.where("batch = 'p4'").withColumn("key", _c("key") + 1000000))
    for rows in (c, new, new):  # the last one is a retry
        sinks.upsert_published(rows, path, manifest, ["key"], "version")
    return sinks.read_published(spark, path, manifest)


@query(with_views("v_cells") + " SELECT key, CASE WHEN key % 3 = 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS hist FROM v_cells")
def k3_update_history(spark, d):
    c = views.cells(spark, d).withColumn("hist", F.lit(0.5))
    return sinks.update_history(c, c.where("key % 3 = 0").select("cell", F.lit(1.0).alias("hist"))).select("key", "hist")


@query(with_views("v_scores") + " SELECT horizon, count(*) AS n FROM v_scores WHERE month(computed_at) = 3 GROUP BY 1")
def k4_publish_batch(spark, d):
    s, path, manifest = views.scores(spark, d), scratch(spark, "batches"), scratch(spark, "manifest")
    sinks.publish_batch(s.where(F.month("computed_at") == 2), path, manifest, "m03")
    s.where(F.month("computed_at") == 4).withColumn("batch", F.lit("m04")).write.partitionBy("batch").parquet(f"{path}/attempt=unfinished")  # no manifest row
    sinks.publish_batch(s.where(F.month("computed_at") == 3), path, manifest, "m03")  # published again, with other rows
    return sinks.read_published(spark, path, manifest).groupBy("horizon").agg(F.count("*").alias("n"))


@query(with_views("v_scores") + " SELECT DISTINCT computed_at FROM v_scores WHERE month(computed_at) NOT IN (1, 2, 3) AND year(computed_at) <> 1997")
def k5_retire_batches(spark, d):
    b = views.scores(spark, d).select("computed_at").distinct()
    return sinks.retire_batches(b, b.where(F.month("computed_at") < 4), b.where(F.year("computed_at") == 1997))


@query(with_views("v_ignitions") + ", r AS (SELECT id % 20 AS batch, id % 7 = 0 OR (id % 20 = 3) AS bad, id % 2 = 0 AS fresh FROM v_ignitions) SELECT batch, count(*) AS received, count(*) FILTER (NOT bad AND fresh) AS inserted, count(*) FILTER (NOT bad AND NOT fresh) AS ignored, count(*) FILTER (bad) AS rejected, CASE WHEN count(*) FILTER (bad) = 0 THEN 'succeeded' WHEN count(*) FILTER (bad) < count(*) THEN 'partial' ELSE 'failed' END AS state FROM r GROUP BY 1")
def k6_import_summary(spark, d):
    r = views.ignitions(spark, d).select("id", (_c("id") % 20).alias("batch"), F.when((_c("id") % 7 == 0) | (_c("id") % 20 == 3), "bad").alias("error"))
    return sinks.import_summary(r, r.where("error is null and id % 2 = 0"), "batch", "id")


@query(with_views("v_ignitions") + " SELECT id % 1000 AS external_id, min(id) AS line FROM v_ignitions WHERE NOT (id % 13 = 0 OR id % 11 = 0 OR id % 7 = 0) GROUP BY 1")
def k7_load_fire_events(spark, d):
    r = _records(spark, d).withColumn("line", _c("external_id").cast("long")).withColumn("source", F.lit("s")).withColumn("external_id", _c("line") % 1000)
    return sinks.load_fire_events(r)[0].select("external_id", "line")


_RUNS = _OBS + ", runs AS (SELECT event_id AS run, source, observed_at AS started_at, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id % 3 END AS error FROM v_observations) "


def _runs(spark, d):
    e = _c("event_id")
    return views.observations(spark, d).select(e.alias("run"), "source", _c("observed_at").alias("started_at"), (e % 4 != 0).alias("ok"), F.when(e % 4 == 0, F.concat(F.lit("e"), (e % 3).cast("string"))).alias("error"))


@query(_RUNS + "SELECT source, max(started_at) AS last_run, max(started_at) FILTER (ok) AS last_success, count(*) AS runs, CASE WHEN NOT arg_max(ok, (started_at, run)) THEN first(error ORDER BY started_at DESC, run DESC) END AS error FROM runs GROUP BY source")
def k8_source_status(spark, d):
    return sinks.source_status(_runs(spark, d))


_CORNERS = f"(SELECT key, k AS place, x + {grid.edge_m(8)!r}::DOUBLE * cos(radians(30 + 60 * (k % 6))) AS x, y + {grid.edge_m(8)!r}::DOUBLE * sin(radians(30 + 60 * (k % 6))) AS y FROM {_CENTRE}, (SELECT unnest(range(0, 7)) AS k))"


@query(with_views("v_cells") + f" SELECT key, place::INTEGER AS place, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_sql_inverse(_CORNERS)}")
def k9_geojson(spark, d):
    shape = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<key:long,road:double>"
    f = sinks.to_geojson(views.cells(spark, d), ["key", "road"]).select(F.from_json("value", shape).alias("f")).where("f.type = 'Feature' and f.geometry.type = 'Polygon'")
    return f.select("f.properties.key", F.posexplode(F.col("f.geometry.coordinates")[0]).alias("place", "p")).select("key", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


_VERSIONS = "WITH m AS (SELECT 'fire-v' || s_suppkey AS logical_id, sha256('d' || s_suppkey) AS h, ['finalized', 'building', 'draft'][s_suppkey % 3 + 1] AS status FROM supplier) "


def _manifest(spark, d):
    k = _c("s_suppkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("fire-v"), k).alias("logical_id"), F.sha2(F.concat(F.lit("d"), k), 256).alias("definition_hash"), F.element_at(F.array(F.lit("finalized"), F.lit("building"), F.lit("draft")), (k % 3 + 1).cast("int")).alias("status"))


@query(_VERSIONS + ", a AS (SELECT 'fire-v' || c_custkey % 3000 AS logical_id, sha256('d' || (c_custkey % 3000 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)) AS d FROM customer) SELECT logical_id, d AS definition_hash, coalesce(status, 'draft') AS status, CASE WHEN h IS NULL THEN 'created' WHEN h <> d THEN 'changed' WHEN status = 'finalized' THEN 'finalized' ELSE 'reused' END AS outcome FROM a LEFT JOIN m USING (logical_id)")
def k10_dataset_version(spark, d):
    v = _c("c_custkey") % 3000
    asked = table(spark, d, "customer").select(F.concat(F.lit("fire-v"), v).alias("logical_id"), F.concat(F.lit("d"), v + F.when(_c("c_custkey") % 7 == 0, 1).otherwise(0)).alias("definition"))
    return sinks.version_outcomes(asked, _manifest(spark, d))


@query(
    _VERSIONS
    + """, r AS (SELECT 'fire-v' || l_suppkey AS logical_id, count(*) AS rows, count(*) FILTER (l_linenumber % 2 = 1) AS positives, sha256(sum(('0x' || substr(sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 15))::BIGINT)::VARCHAR) AS checksum FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1),
    x AS (SELECT 'fire-v' || l_suppkey AS logical_id, count(*) AS exclusions FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT logical_id, CASE WHEN ready THEN 'finalized' ELSE status END AS status, CASE WHEN ready THEN rows END AS rows, CASE WHEN ready THEN positives END AS positives, CASE WHEN ready THEN rows - positives END AS negatives, CASE WHEN ready THEN checksum END AS checksum, CASE WHEN ready THEN coalesce(exclusions, 0) END AS exclusions
    FROM (SELECT *, status = 'building' AND rows IS NOT NULL AS ready FROM m LEFT JOIN r USING (logical_id) LEFT JOIN x USING (logical_id))"""
)
def k10_finalize_versions(spark, d):
    li = table(spark, d, "lineitem").withColumn("logical_id", F.concat(F.lit("fire-v"), "l_suppkey"))
    rows = li.where("l_suppkey % 4 <> 0").select("logical_id", (_c("l_linenumber") % 2).alias("label"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("row_key"))
    return sinks.finalize_versions(_manifest(spark, d), rows, li.where("l_returnflag = 'R'"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 20 = (SELECT o_custkey % 20 FROM orders WHERE o_orderkey = 5) THEN CASE WHEN o_orderkey = 5 THEN 'active' WHEN o_orderkey % 3 = 0 THEN 'superseded' ELSE 'registered' END WHEN o_orderkey % 3 = 0 THEN 'active' ELSE 'registered' END AS status FROM orders")
def k11_activate_snapshot(spark, d):
    m = table(spark, d, "orders").select(_c("o_orderkey").alias("id"), (_c("o_custkey") % 20).alias("family"), F.when(_c("o_orderkey") % 3 == 0, "active").otherwise("registered").alias("status"))
    return sinks.activate_snapshot(m, _c("id") == 5).select("id", "status")


@query(with_views("v_cells") + ", f AS (" + sql_fingerprint("(SELECT DISTINCT cell::VARCHAR AS k, sha256(cell::VARCHAR) AS c FROM v_cells WHERE combustible)") + ") SELECT 'operational_aoi-' || substr(fingerprint, 1, 16) AS mask, fingerprint, rows AS cells FROM f")
def k12_publish_mask(spark, d):
    return sinks.publish_mask(views.cells(spark, d).where("combustible"), "operational_aoi")


@query(with_views("v_ignitions") + " SELECT 'r1' AS rule, id AS entity FROM v_ignitions WHERE id % 5 <> 0")
def k14_write_assessments(spark, d):
    i = views.ignitions(spark, d).select(_c("id").alias("entity"))
    old = i.where("entity % 5 = 0").select(F.lit("r1").alias("rule"), "entity", F.lit("c").alias("checksum"))
    return sinks.write_assessments(i, old, "r1", "c").select("rule", "entity")


@query(
    with_views("v_cells") + ", s AS (SELECT cell, buildings, key FROM v_cells WHERE key % 10 <> 0), f AS (" + sql_fingerprint("(SELECT cell::VARCHAR AS k, sha256(concat_ws('|', buildings::VARCHAR, cell::VARCHAR)) AS c FROM s)")
    + ") SELECT rows AS n, fingerprint, concat_ws(',', CASE WHEN rows <> 10 THEN 'row_count' END, 'checksum', CASE WHEN EXISTS (SELECT 1 FROM s WHERE key % 7 = 0) THEN 'cells_outside_mask' END) AS errors, CASE WHEN EXISTS (SELECT 1 FROM v_cells WHERE key % 7 <> 0 AND key % 10 = 0) THEN 'cells_missing' ELSE '' END AS warnings FROM f"
)
def q8_verify_snapshot(spark, d):
    c = views.cells(spark, d)
    t = sinks.verify_snapshot(c.where("key % 10 <> 0").select("cell", "buildings"), "cell", 10, "", c.where("key % 7 <> 0").select("cell"))
    return t.select("n", "fingerprint", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


_SHARE = lambda name, c: f"round(CASE WHEN max({c}) OVER (PARTITION BY department) > 0 THEN {c} / (max({c}) OVER (PARTITION BY department))::DOUBLE ELSE 0 END, 6) AS {name}"


@query(
    with_views("v_cells", "v_ignitions")
    + f""", l AS (SELECT c.cell, coalesce(sum(v.buildings), 0) AS road, coalesce(sum(v.poi::INT), 0) AS poi FROM v_cells c, {disk(1)} n LEFT JOIN v_cells v ON v.cell = c.cell + n.dq * 67108864 + n.dr GROUP BY 1),
    h AS (SELECT c.cell, coalesce(sum(pow(0.5, n.ring)) FILTER (i.id IS NOT NULL), 0) AS hist FROM v_cells c, {disk(2)} n LEFT JOIN v_ignitions i ON i.cell = c.cell + n.dq * 67108864 + n.dr GROUP BY 1), t AS (SELECT * FROM v_cells JOIN (SELECT cell, road AS near_road, poi AS near_poi FROM l) USING (cell) JOIN h USING (cell))
    SELECT cell, {_SHARE('road', 'near_road')}, {_SHARE('power_line', 'near_road')}, {_SHARE('poi', 'near_poi')}, {_SHARE('population', 'population')}, {_SHARE('hist', 'hist')}, combustible, (key % 4 = 0)::INT::DOUBLE AS wui, agri::INT::DOUBLE AS agri FROM t"""
)
def a4_static_features(spark, d):
    c = views.cells(spark, d)
    lines = c.select("cell", _c("buildings").alias("road"), _c("buildings").alias("power_line"))
    poi = c.select("cell", _c("poi").cast("long").alias("poi"))
    t = weather_index.static_features(c, lines, poi, c, views.ignitions(spark, d), c.where("key % 4 = 0"), c.select("cell", "combustible", _c("agri").alias("agricultural")), ["department"])
    return t.select("cell", *(F.round(n, 6).alias(n) for n in ("road", "power_line", "poi", "population", "hist")), "combustible", "wui", "agri")


# --- snapshots and streams --------------------------------------------------


@query(_OBS + ", h AS (SELECT DISTINCT user_id, date_trunc('hour', observed_at) AS h FROM v_observations), s AS (SELECT user_id, min(h) AS first, max(h) AS last, count(*) AS present FROM h GROUP BY 1) SELECT user_id, first, last, present, (epoch(last) - epoch(first))::BIGINT // 3600 + 1 AS expected, (epoch(last) - epoch(first))::BIGINT // 3600 + 1 - present AS missing FROM s")
def w10_slot_summary(spark, d):
    return jobs.slot_summary(views.observations(spark, d), ["user_id"])


@query(_OBS + ", m AS (SELECT source AS metric, CAST(observed_at AS DATE) AS date, count(*) AS value FROM v_observations GROUP BY 1, 2) SELECT a.metric, a.date, a.value - b.value AS delta, CASE WHEN b.value IS NULL THEN 'no_reference' WHEN a.value = b.value THEN 'stable' WHEN a.value > b.value THEN 'up' ELSE 'down' END AS status FROM m a LEFT JOIN m b ON b.metric = a.metric AND b.date = a.date - 7 WHERE b.value IS NOT NULL")
def w9_compare_snapshots(spark, d):
    m = views.observations(spark, d).groupBy(_c("source").alias("metric"), F.to_date("observed_at").alias("date")).agg(F.count("*").alias("value"))
    return jobs.compare_snapshots(m, 7).where("before is not null").select("metric", "date", "delta", "status")


@query(_RUNS + "SELECT count(*) AS runs, count(*) FILTER (started_at > TIMESTAMP '2024-01-19 06:00:00') AS recent, count(*) FILTER (ok AND started_at > TIMESTAMP '2024-01-19 06:00:00') AS recent_ok, count(*) FILTER (NOT ok AND started_at > TIMESTAMP '2024-01-19 06:00:00') AS recent_failed FROM runs WHERE started_at <= TIMESTAMP '2024-01-20 06:00:00'")
def a26_volume_counts(spark, d):
    return jobs.volume_counts(_runs(spark, d), F.lit("2024-01-20 06:00:00").cast("timestamp"))


@query(with_views("v_ignitions", "v_weather") + ", s AS (SELECT id AS snapshot, cell, CAST(occurred_at - INTERVAL 20 HOUR AS TIMESTAMP) AS valid_at FROM v_ignitions WHERE id % 9 = 0), e AS (SELECT cell, occurred_at FROM v_ignitions WHERE id % 2 = 1) SELECT snapshot, count(e.cell) AS events, (count(e.cell) > 0)::INTEGER AS label FROM s LEFT JOIN e ON e.cell = s.cell AND occurred_at >= valid_at AND occurred_at < valid_at + INTERVAL 7 DAY GROUP BY 1")
def j10_link_labels(spark, d):
    i = views.ignitions(spark, d)
    s = i.where("id % 9 = 0").select(_c("id").alias("snapshot"), "cell", (_c("occurred_at") - F.expr("interval 20 hours")).alias("valid_at"))
    e = i.select("cell", "occurred_at", F.when(_c("id") % 2 == 1, _c("occurred_at")).otherwise(F.lit("2099-01-01").cast("timestamp")).alias("updated_at"))
    return jobs.link_labels(s, e, F.lit("2020-01-01").cast("timestamp"), 7).select("snapshot", "events", "label")


@query("SELECT c_custkey AS snapshot, (c_custkey % 2)::INTEGER AS label, c_custkey % 3 <> 0 AS current FROM customer UNION ALL SELECT c_custkey, (1 - c_custkey % 2)::INTEGER, true FROM customer WHERE c_custkey % 3 = 0")
def j10_supersede(spark, d):
    c = table(spark, d, "customer").select(_c("c_custkey").alias("snapshot"), (_c("c_custkey") % 2).cast("int").alias("label"), F.lit(True).alias("current"))
    new = c.select("snapshot", F.when(_c("snapshot") % 3 == 0, 1 - _c("label")).otherwise(_c("label")).alias("label"))
    return jobs.supersede(c, new)


@query(_RUNS + """, st AS (SELECT source, max(started_at) FILTER (ok) AS s, CASE WHEN NOT arg_max(ok, (started_at, run)) THEN first(error ORDER BY started_at DESC, run DESC) END AS error FROM runs GROUP BY 1), b AS (SELECT source, error, CASE WHEN (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(s))) / 3600 <= 3 THEN 'normal' WHEN (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(s))) / 3600 <= 6 THEN 'transient' WHEN (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(s))) / 3600 <= 24 THEN 'degraded' WHEN (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(s))) / 3600 <= 72 THEN 'stale' ELSE 'unavailable' END AS band FROM st)
 SELECT source, 'freshness_' || band AS rule FROM b WHERE band IN ('degraded', 'stale', 'unavailable') UNION ALL SELECT source, 'last_run_failed' FROM b WHERE error IS NOT NULL""")
def n6_freshness_alerts(spark, d):
    return jobs.freshness_alerts(sinks.source_status(_runs(spark, d)), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("source", "rule")


@query(_OBS + " SELECT source, date_trunc('hour', observed_at) AS window, count(*) AS n, max(observed_at) AS latest FROM v_observations GROUP BY 1, 2".replace(" AS window", ' AS "window"'))
def n7_operational_snapshot(spark, d):
    return jobs.operational_snapshot(views.observations(spark, d), "hour")


@query(with_views("v_cells") + " SELECT cell, CASE WHEN key % 150 = 7 THEN 'missing' ELSE 'observed' END AS status FROM v_cells")
def n8_daily_archive(spark, d):
    c = views.cells(spark, d)
    return jobs.daily_archive(c.select("cell"), c.where("key % 150 <> 7").select("cell", "road"), 0.9).select("cell", "status")


@query(with_views("v_cells") + " SELECT count(*) AS cells, count(*) FILTER (key % 10 <> 0) AS observed, count(*) FILTER (key % 20 = 0) AS missing_expected, count(*) FILTER (key % 20 = 10) AS missing_unexpected FROM v_cells")
def n9_weekly_snapshot(spark, d):
    c = views.cells(spark, d)
    return jobs.weekly_snapshot(c.select("cell"), c.where("key % 10 <> 0").select("cell"), c.where("key % 20 = 0"))


def _run_stream(df, name: str, mode: str = "append"):
    """Process all that is there and return what the stream wrote."""
    spark = df.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    else:
        df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("_n", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _obs_files(spark, d):
    o = views.observations(spark, d).withColumn("dedupe_key", F.concat_ws(":", _c("user_id").cast("string"), F.unix_timestamp("minute").cast("string")))
    path = scratch(spark, "arrivals")
    o.repartition(4).write.parquet(path)
    return path, o.schema


@query(_OBS + " SELECT source, count(DISTINCT (user_id, minute)) AS n FROM v_observations GROUP BY 1")
def n1_stream_observations(spark, d):
    path, schema = _obs_files(spark, d)
    return _run_stream(jobs.stream_observations(spark, path, schema, "60 days"), "observations").groupBy("source").agg(F.count("*").alias("n"))


@query(_OBS + " SELECT commune, time_bucket(INTERVAL 6 HOUR, observed_at, TIMESTAMP '2000-01-01') AS window_start, count(*) AS signals, max(frp) AS max_frp FROM v_observations GROUP BY 1, 2")
def n2_stream_signal_windows(spark, d):
    path, schema = _obs_files(spark, d)
    out = _run_stream(jobs.stream_signal_windows(spark.readStream.schema(schema).parquet(path), "60 days"), "windows", "update")
    return spatial.latest_per(out, ["commune", "window_start"], [F.desc("_n"), F.desc("signals")]).select("commune", "window_start", "signals", "max_frp")


@query(with_views("v_cells") + f" SELECT key FROM {_sql_inverse(_CENTRE)} WHERE lat BETWEEN 13.02 AND 13.3 AND lon BETWEEN -29.01 AND -28.8")
def n5_stream_updates(spark, d):
    path = scratch(spark, "updates")
    box = views.cells(spark, d).select("cell", "key")
    box.write.parquet(path)
    s = spark.readStream.schema(box.schema).parquet(path)
    return _run_stream(jobs.stream_updates(s, (-29.01, 13.02, -28.8, 13.3)), "updates-out").select("key")
