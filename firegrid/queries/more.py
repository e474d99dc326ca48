"""Queries of file round trips, territories, reviews and the remaining streams (s13, s16, s20-s22, c8, n3, n4, n10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import grid
from ..operators import evidence
from ..operators.scoring import score_heuristic
from ..plans import weather_index
from ..sources import readers, sinks
from ..sources.staging import scratch
from ..streaming import jobs
from ..views import table, with_views
from .pipelines import _obs_files
from .forecasts import _CELL_SERIES, _CODES_SQL, _SERIES
from .registry import SQL, query
from .scalar import _sql_forward, _sql_hex

_c = F.col


_FEATURES = "(SELECT c_custkey AS osm_id, c_custkey % 3 = 0 AS line, CASE WHEN c_custkey % 3 = 0 THEN (43 + c_custkey % 90 / 100.0::DOUBLE + (43.01::DOUBLE + c_custkey % 90 / 100.0::DOUBLE)) / 2 ELSE 43 + c_custkey % 90 / 100.0::DOUBLE END AS lat, CASE WHEN c_custkey % 3 = 0 THEN (2 + c_custkey % 70 / 100.0::DOUBLE + (2.01::DOUBLE + c_custkey % 70 / 100.0::DOUBLE)) / 2 ELSE 2 + c_custkey % 70 / 100.0::DOUBLE END AS lon FROM customer)"


@query(f"SELECT osm_id, CASE WHEN line THEN 'road' ELSE 'building' END AS feature_type, cell FROM {_sql_hex(_sql_forward(_FEATURES), grid.edge_m(8), 8)}")
def s13_osm_features(spark, d):
    k, path = _c("c_custkey"), scratch(spark, "osm")
    end = lambda x: F.when(k % 3 == 0, x)
    rows = table(spark, d, "customer").select(k.cast("string").alias("osm_id"), F.when(k % 3 == 0, "road").otherwise("building").alias("feature_type"), (43 + k % 90 / 100.0).alias("latitude"), (2 + k % 70 / 100.0).alias("longitude"), end(43.01 + k % 90 / 100.0).alias("end_latitude"), end(2.01 + k % 70 / 100.0).alias("end_longitude"), F.lit("x").alias("name"))
    rows.write.option("header", True).csv(path)
    return readers.read_osm_features(spark, path).select(_c("osm_id").cast("long").alias("osm_id"), "feature_type", "cell")


@query(with_views("v_cells") + " SELECT cell, buildings FROM v_cells")
def s16_cell_cache(spark, d):
    c, path = views.cells(spark, d).select("cell", "buildings"), scratch(spark, "cells")
    sinks.write_cells(c, path)
    return sinks.read_cells(spark, path, c.schema, 8)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, day(o_orderdate) % 5 = 0 AS school_holiday, day(o_orderdate) = 1 AS public_holiday FROM orders")
def s20_read_calendar(spark, d):
    day, path = F.to_date("o_orderdate"), scratch(spark, "calendar")
    table(spark, d, "orders").select(day.alias("date"), (F.dayofmonth(day) % 5 == 0).alias("school_holiday"), (F.dayofmonth(day) == 1).alias("public_holiday"), F.lit("x").alias("label")).distinct().write.option("header", True).csv(path)
    return readers.read_calendar(spark, path).select("date", "school_holiday", "public_holiday")


def _squares(spark, d, step: float, code):
    k = _c("s_suppkey")
    x, y, side = k % 20 * F.lit(step), F.floor(k / 20) * F.lit(step), F.lit(5000.0)
    ring = F.array(*(F.struct((x + a * side).alias("x"), (y + b * side).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return table(spark, d, "supplier").select(code(k).alias("code"), ring.alias("ring"))


_EDGE, _W = grid.edge_m(8), grid.edge_m(8) * 3**0.5


def _square_sql(step: float, code: str, pick: str) -> str:
    return f"""WITH sq AS (SELECT {code} AS code, s_suppkey % 20 * {step}::DOUBLE AS x0, s_suppkey // 20 * {step}::DOUBLE AS y0 FROM supplier),
    gr AS (SELECT *, unnest(range(floor(y0 / ({_EDGE!r}::DOUBLE * 1.5))::BIGINT - 1, ceil((y0 + 5000) / ({_EDGE!r}::DOUBLE * 1.5))::BIGINT + 2)) AS r FROM sq),
    gq AS (SELECT *, unnest(range(floor(x0 / {_W!r}::DOUBLE - r / 2.0::DOUBLE)::BIGINT - 1, ceil((x0 + 5000) / {_W!r}::DOUBLE - r / 2.0::DOUBLE)::BIGINT + 2)) AS q FROM gr),
    g AS (SELECT *, {_W!r}::DOUBLE * (q + r / 2.0::DOUBLE) AS x, {_EDGE!r}::DOUBLE * 1.5 * r AS y FROM gq),
    i AS (SELECT code, 8 * 4503599627370496 + (q + 33554432) * 67108864 + r + 33554432 AS cell FROM g WHERE x >= x0 AND x < x0 + 5000 AND y >= y0 AND y < y0 + 5000) {pick}"""


@query(_square_sql(4000.0, "lpad(s_suppkey::VARCHAR, 3, '0')", "SELECT cell, min(code) AS code, count(DISTINCT code) AS claims FROM i GROUP BY cell"))
def s21_load_territory(spark, d):
    return readers.load_territory(_squares(spark, d, 4000.0, lambda k: F.lpad(k.cast("string"), 3, "0")))[0]


@query(_square_sql(5200.0, "lpad((s_suppkey + 11000)::VARCHAR, 5, '0')", "SELECT cell, code FROM i"))
def s22_load_communes(spark, d):
    return readers.load_communes(_squares(spark, d, 5200.0, lambda k: F.lpad((k + 11000).cast("string"), 5, "0")))


@query(
    """WITH r AS (SELECT event_id AS k, event_id % 4 AS v, event_id % 7 AS w, event_id % 3 AS p FROM events)
    SELECT k AS "case", CASE v WHEN 0 THEN CASE WHEN p = 0 THEN 'confirmed' ELSE 'probable' END WHEN 1 THEN 'probable' WHEN 2 THEN 'signal_observed' ELSE 'no_evidence_found' END AS verdict,
    CASE v WHEN 0 THEN CASE WHEN p = 0 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
    CASE WHEN v = 3 THEN NULL WHEN w = 0 THEN 'event_outside_window' WHEN w = 1 THEN 'other_location' WHEN p = 2 THEN 'source_not_trusted' END AS error FROM r"""
)
def c8_validate_reviews(spark, d):
    k, ts = _c("event_id"), _c("ts")
    url = F.when(k % 3 == 0, "https://www.sdis11.fr/a").when(k % 3 == 1, "https://www.lemonde.fr/b").otherwise("https://blog.example.com/c")
    source = F.struct(url.alias("url"), F.lit("Feu à Saint-Élie").alias("title"), F.lit(None).cast("string").alias("excerpt"), (ts + F.expr("interval 3 hours")).alias("published_at"), F.when(k % 3 == 0, "direct").otherwise("indirect").alias("strength"), F.lit(True).alias("cited"))
    verdict = F.element_at(F.array(*map(F.lit, ["confirmed", "probable", "signal_observed", "no_evidence_found"])), (k % 4 + 1).cast("int"))
    r = table(spark, d, "events").select(k.alias("case"), verdict.alias("verdict"), F.lit(0.99).alias("confidence"), F.lit(2).alias("searches"), F.when(k % 7 == 0, ts + F.expr("interval 5 days")).otherwise(ts + F.expr("interval 2 hours")).alias("event_at"), F.when(k % 7 == 1, "Narbonne").otherwise("près de saint elie").alias("location"), (ts + F.expr("interval 6 hours")).alias("checked_at"), F.array(source).alias("sources"))
    c = table(spark, d, "events").select(k.alias("case"), F.lit("Saint-Elie").alias("place"), ts.alias("issued_at"), (ts + F.expr("interval 1 day")).alias("window_end"))
    return evidence.validate_reviews(r, c).select("case", "verdict", "confidence", "error")


def _streamed(spark, w, **options):
    path, out, state = scratch(spark, "weather"), scratch(spark, "series"), scratch(spark, "series-state")
    w.write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = jobs.stream_fwi(spark.readStream.schema(w.schema).parquet(path), **options)
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("cell", "date", *(F.round(c, 4).alias(c) for c in weather_index.CODES), "late")


@query(_SERIES + _CODES_SQL.replace(" FROM y", ", false AS late FROM y"))
def n3_stream_fwi(spark, d):
    return _streamed(spark, views.weather_daily(spark, d))


@query(_CELL_SERIES + _CODES_SQL.replace(" FROM y", ", false AS late FROM y"))
def n3_stream_fwi_cells(spark, d):
    w = views.weather_cells(spark, d)
    return _streamed(spark, w, buckets=jobs.state_buckets(w.select("cell").distinct().count()))


_PUBLISHED_SQL = """SELECT cell, date, round(fwi, 4) AS fwi, round(pow(greatest(0::DOUBLE, least(1::DOUBLE, fwi / 30)), 0.6) * pow((0.4::DOUBLE * 0.2 + 0.2::DOUBLE * 0.3) * CASE WHEN isodow(date) >= 6 THEN 1.2::DOUBLE WHEN month(date) IN (12, 1, 2) THEN 0.6::DOUBLE ELSE 1::DOUBLE END, 0.4), 4) AS score FROM y"""


@query(_SERIES + _PUBLISHED_SQL)
def n4_stream_forecast(spark, d):
    return _published(spark, views.weather_daily(spark, d))


@query(_CELL_SERIES + _PUBLISHED_SQL)
def n4_stream_forecast_cells(spark, d):
    return _published(spark, views.weather_cells(spark, d))


def _published(spark, w):
    src, path, manifest, state = (scratch(spark, n) for n in ("hourly", "published", "published-manifest", "forecast-state"))
    w.write.parquet(src)
    static = w.select("cell").distinct().select("cell", F.lit(0.3).alias("road"), F.lit(0.2).alias("hist"), F.lit(0.0).alias("wui"), F.lit(0.0).alias("agri"), F.lit(True).alias("combustible"))
    cal = spark.createDataFrame([], "date date, school_holiday boolean, public_holiday boolean")
    score = lambda df: score_heuristic(weather_index.risk_inputs(static, weather_index.fwi_series(df), cal))
    jobs.stream_forecast(spark.readStream.schema(w.schema).parquet(src), score, lambda df, n: sinks.publish_batch(df, path, manifest, n), state).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_published(spark, path, manifest).select("cell", "date", F.round("fwi", 4).alias("fwi"), F.round("score", 4).alias("score"))


@query(SQL["w8_reactive_cases"])
def n10_stream_reactive_cases(spark, d):
    path, schema = _obs_files(spark, d)
    out, state = scratch(spark, "cases"), scratch(spark, "cases-state")
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_reactive_cases(jobs.stream_signal_windows(arrivals, "60 days"), 3, out, state).trigger(availableNow=True).start().awaitTermination()
    return jobs.read_reactive_cases(spark, out).select("commune", "first_at", "daily_rank")
