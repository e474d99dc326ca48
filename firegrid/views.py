"""Domain tables derived from the star-schema tables, in Spark and as SQL.

The given tables hold no fire data, so cells, stations, weather, scores,
observations and ignitions are integer functions of their keys. ``SQL`` has the
same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import HORIZONS
from .functions.grid import cell_id

LEVEL = 8
START = "timestamp '1995-01-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes))


def cells(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    q, r = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    return t.select(
        cell_id(q, r, LEVEL).alias("cell"), q.alias("q"), r.alias("r"), ((F.col("c_acctbal") + 1000) / 11000).alias("road"),
        (F.col("c_mktsegment") != "BUILDING").alias("combustible"), (F.col("c_mktsegment") == "MACHINERY").alias("agri"), F.col("c_nationkey").alias("department"),
        (F.col("c_custkey") % 7).alias("buildings"), (F.col("c_custkey") % 11 == 0).alias("poi"), (F.col("c_custkey") % 5).alias("population"), F.col("c_custkey").alias("key"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("station"), (k * 7 % 40).alias("q"), (k * 11 % 38).alias("r"), (10 + F.col("s_acctbal") / 500).alias("temp"), (k * 13 % 101).cast("double").alias("rh"), (k * 3 % 40).cast("double").alias("wind"), (k % 5 * F.lit(0.8)).alias("rain"))


def weather_daily(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 8).alias("cell"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_orderkey").alias("s"), F.count("*").alias("n"))
    return g.select("cell", "date", (F.col("s") % 35).cast("double").alias("temp"), (20 + F.col("s") % 71).cast("double").alias("rh"), (F.col("s") % 41).cast("double").alias("wind"), (F.col("s") % 7 * F.lit(0.7)).alias("rain"), F.month("date").alias("month"))


#: Days of each cell's weather in ``weather_cells``.
CELL_DAYS = 40


def weather_cells(spark: SparkSession, d: str) -> DataFrame:
    """Weather of every customer as a cell, so cells grow with the table: a row a day from March on, without one day in ten of each."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(CELL_DAYS - 1))).alias("i")).where("(cell + i) % 10 <> 7 or cell % 3 = 0")
    k = F.col("cell") * 31 + F.col("i") * 17
    date = F.date_add(F.lit("1996-03-20").cast("date"), F.col("i"))
    return c.select("cell", date.alias("date"), (k % 35).cast("double").alias("temp"), (20 + k % 71).cast("double").alias("rh"), (k % 41).cast("double").alias("wind"), (k % 7 * F.lit(0.7)).alias("rain"), F.month(date).alias("month"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _ in HORIZONS))
    hours = F.array(*(F.lit(h) for _, h in HORIZONS))
    h = (F.col("l_linenumber") % 4 + 1).cast("int")
    t = table(spark, d, "lineitem")
    batch = F.date_trunc("month", F.col("l_shipdate"))
    return t.select(
        F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("commune"), F.element_at(names, h).alias("horizon"), (F.col("l_discount") * 10).alias("score"),
        (F.col("l_quantity") / 50).alias("physical"), (F.col("l_tax") * 12.5).alias("human"), batch.alias("computed_at"), (batch + F.make_interval(hours=F.element_at(hours, h))).alias("valid_at"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").alias("observed_at"), (F.col("user_id") % 50).alias("commune"), F.col("value").alias("frp"), F.col("props").alias("payload"), "user_id", F.date_trunc("minute", "ts").alias("minute"))


def ignitions(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cause = F.when(F.col("o_orderpriority").startswith("1"), "accidentelle").when(F.col("o_orderpriority").startswith("2"), "malveillance").when(F.col("o_orderpriority").startswith("3"), "involontaire (travaux)").when(F.col("o_orderpriority").startswith("4"), "naturelle").otherwise("inconnue")
    return table(spark, d, "orders").select(
        k.alias("id"), cell_id(c % 40, F.floor(c / 40), LEVEL).alias("cell"), (F.col("o_orderdate") + F.make_interval(secs=(k * 7919 % 86400))).alias("occurred_at"), cause.alias("cause"),
        (F.col("o_totalprice") / 1000).alias("surface_ha"), (c % 50).alias("commune"), (c * 13 % 1000).cast("double").alias("lat_m"), (c * 17 % 1000).cast("double").alias("lon_m"), c.alias("place"),
    )


def labeled(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"), (k * 7919 % 1009 / F.lit(1009.0)).alias("score"), (k * 104729 % 997 / F.lit(997.0)).alias("score_b"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.to_date("o_orderdate").alias("date"), cell_id(F.col("o_custkey") % 40, F.floor(F.col("o_custkey") / 40), LEVEL).alias("cell"),
        (F.floor(F.col("o_custkey") / 64)).alias("parent"), F.col("c_acctbal").alias("x1"), (F.col("o_totalprice") / 1000).alias("x2"), F.when(k % 10 != 0, (k % 23).cast("double")).alias("x3"),
    )


_CELL = "({r} * 0 + 8) * 4503599627370496 + ({q} + 33554432) * 67108864 + ({r} + 33554432)"


def sql_cell(q: str, r: str) -> str:
    return "(" + _CELL.format(q=q, r=r) + ")"


SQL = {
    "v_cells": f"""SELECT {sql_cell('c_custkey % 40', '(c_custkey // 40)')} AS cell, c_custkey % 40 AS q, c_custkey // 40 AS r, (c_acctbal + 1000) / 11000 AS road,
        c_mktsegment <> 'BUILDING' AS combustible, c_mktsegment = 'MACHINERY' AS agri, c_nationkey AS department, c_custkey % 7 AS buildings, c_custkey % 11 = 0 AS poi, c_custkey % 5 AS population, c_custkey AS key FROM customer""",
    "v_stations": """SELECT s_suppkey AS station, s_suppkey * 7 % 40 AS q, s_suppkey * 11 % 38 AS r, 10 + s_acctbal / 500 AS temp, CAST(s_suppkey * 13 % 101 AS DOUBLE) AS rh,
        CAST(s_suppkey * 3 % 40 AS DOUBLE) AS wind, s_suppkey % 5 * CAST(0.8 AS DOUBLE) AS rain FROM supplier""",
    "v_weather": """SELECT o_custkey % 8 AS cell, CAST(o_orderdate AS DATE) AS date, CAST(CAST(sum(o_orderkey) AS BIGINT) % 35 AS DOUBLE) AS temp, CAST(20 + CAST(sum(o_orderkey) AS BIGINT) % 71 AS DOUBLE) AS rh,
        CAST(CAST(sum(o_orderkey) AS BIGINT) % 41 AS DOUBLE) AS wind, CAST(sum(o_orderkey) AS BIGINT) % 7 * CAST(0.7 AS DOUBLE) AS rain, month(CAST(o_orderdate AS DATE)) AS month FROM orders GROUP BY o_custkey % 8, CAST(o_orderdate AS DATE)""",
    "v_weather_cells": f"""SELECT cell, CAST(DATE '1996-03-20' + i AS DATE) AS date, CAST(k % 35 AS DOUBLE) AS temp, CAST(20 + k % 71 AS DOUBLE) AS rh, CAST(k % 41 AS DOUBLE) AS wind, k % 7 * CAST(0.7 AS DOUBLE) AS rain, month(DATE '1996-03-20' + i) AS month
        FROM (SELECT c_custkey AS cell, CAST(i AS INTEGER) AS i, c_custkey * 31 + i * 17 AS k FROM customer, range({CELL_DAYS}) t(i) WHERE (c_custkey + i) % 10 <> 7 OR c_custkey % 3 = 0)""",
    "v_scores": """SELECT l_partkey AS cell, l_suppkey AS commune, ['nowcast', 'hours_6', 'hours_24', 'hours_48'][l_linenumber % 4 + 1] AS horizon, l_discount * 10 AS score, l_quantity / 50 AS physical, l_tax * 12.5 AS human,
        CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS computed_at, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) + to_hours([0, 6, 24, 48][l_linenumber % 4 + 1]) AS valid_at, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem""",
    "v_observations": """SELECT event_id, event_type AS source, ts AS observed_at, user_id % 50 AS commune, value AS frp, props AS payload, user_id, date_trunc('minute', ts) AS minute FROM events""",
    "v_ignitions": f"""SELECT o_orderkey AS id, {sql_cell('o_custkey % 40', '(o_custkey // 40)')} AS cell, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS occurred_at,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'accidentelle' WHEN '2' THEN 'malveillance' WHEN '3' THEN 'involontaire (travaux)' WHEN '4' THEN 'naturelle' ELSE 'inconnue' END AS cause,
        o_totalprice / 1000 AS surface_ha, o_custkey % 50 AS commune, CAST(o_custkey * 13 % 1000 AS DOUBLE) AS lat_m, CAST(o_custkey * 17 % 1000 AS DOUBLE) AS lon_m, o_custkey AS place FROM orders""",
    "v_labeled": f"""SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS label, (o_orderkey * 7919 % 1009) / CAST(1009 AS DOUBLE) AS score, (o_orderkey * 104729 % 997) / CAST(997 AS DOUBLE) AS score_b,
        year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(o_orderdate AS DATE) AS date, {sql_cell('o_custkey % 40', '(o_custkey // 40)')} AS cell, o_custkey // 64 AS parent, c_acctbal AS x1, o_totalprice / 1000 AS x2,
        CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 23 AS DOUBLE) END AS x3 FROM orders JOIN customer ON o_custkey = c_custkey""",
}


def with_views(*names: str) -> str:
    """The WITH clause that defines some views, up to where further definitions or the query go on."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
