"""Readers and normalisers: every input has a declared schema, bad rows keep their error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid, text

FIRMS = "latitude string, longitude string, bright_ti4 double, scan double, track double, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_ti5 double, frp double, daynight string, _bad string"


def split_ranges(df: DataFrame, start: str, end: str, max_days: int) -> DataFrame:
    """Each row's date range as consecutive windows of at most ``max_days`` days: ``first_day, last_day``."""
    starts = F.expr(f"sequence({start}, {end}, interval {max_days} days)")
    return df.withColumn("first_day", F.explode(starts)).withColumn("last_day", F.least(F.date_add("first_day", max_days - 1), F.col(end)))


def observation_key(lat: Column, lon: Column, *parts: Column) -> Column:
    """A detection's identity: coordinates to five decimals as integers, then the other parts."""
    at = lambda c: F.round(c * 100_000).cast("long").cast("string")
    return F.concat_ws(":", at(lat), at(lon), *(p.cast("string") for p in parts))


def parse_detections(raw: DataFrame, resolution: int = 8) -> tuple[DataFrame, DataFrame]:
    """Satellite detections with instant, cell and identity, and the rejected rows with their error."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    ts = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    rows = raw.withColumn("lat", lat).withColumn("lon", lon).withColumn("observed_at", ts)
    error = F.when(F.col("observed_at").isNull(), "invalid_time").when(F.col("lat").isNull() | ~F.col("lat").between(-90, 90), "invalid_latitude").when(F.col("lon").isNull() | ~F.col("lon").between(-180, 180), "invalid_longitude")
    if "_bad" in raw.columns:
        error = F.when(F.col("_bad").isNotNull(), "malformed_row").otherwise(error)
    rows = rows.withColumn("error", error)
    key = observation_key(F.col("lat"), F.col("lon"), F.unix_timestamp("observed_at"), F.col("satellite"))
    good = rows.where("error is null").select("observed_at", "lat", "lon", grid.cell_of(F.col("lat"), F.col("lon"), resolution).alias("cell"), "frp", "confidence", "satellite", key.alias("dedupe_key"))
    return good, rows.where("error is not null").withColumn("dedupe_key", F.concat(F.lit("rejected:"), F.sha2(F.to_json(F.struct("latitude", "longitude", "acq_date", "acq_time", "satellite")), 256)))


def read_firms(spark: SparkSession, path: str, resolution: int = 8) -> tuple[DataFrame, DataFrame]:
    """The 14-column detection CSV."""
    raw = spark.read.schema(FIRMS).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").csv(path)
    return parse_detections(raw, resolution)


def _not_negative(c: Column) -> Column:
    """Negative values as 0; null stays null."""
    return F.when(c < 0, 0.0).otherwise(c)


def normalise_stations(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Station rows in degrees Celsius, km/h and mm; rows with a missing field go, and those outside the dates."""
    out = df.select("station", "lat", "lon", "observed_at", (F.col("temp_k") - 273.15).alias("temp"), F.col("rh").alias("rh"), (F.col("wind_ms") * 3.6).alias("wind"), _not_negative(F.col("rain")).alias("rain")).na.drop()
    day = F.to_date("observed_at")
    if first:
        out = out.where(day >= F.lit(first).cast("date"))
    return out.where(day <= F.lit(last).cast("date")) if last else out


SYNOP = ["lat", "lon", "geo_id_wmo", "name", "validity_time", "ff", "t", "u", "rr24"]


def read_synop(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The semicolon-separated station CSV; columns are addressed by name."""
    raw = spark.read.options(header=True, sep=";", inferSchema=False).csv(path)
    n = lambda c: F.col(c).try_cast("double")
    return normalise_stations(raw.select(F.col("geo_id_wmo").alias("station"), n("lat").alias("lat"), n("lon").alias("lon"), F.to_timestamp("validity_time").alias("observed_at"), n("t").alias("temp_k"), n("u").alias("rh"), n("ff").alias("wind_ms"), n("rr24").alias("rain")), first, last)


def noon_archive(obs: DataFrame, stations: DataFrame, day_col: str = "date") -> DataFrame:
    """The 12:00 rows of known stations, the first row of each date and station (by ``row``)."""
    known = obs.where(F.date_format("observed_at", "HHmm") == "1200").join(stations.select("station"), "station", "left_semi").withColumn(day_col, F.to_date("observed_at"))
    first = Window.partitionBy(day_col, "station").orderBy("row")
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def missing_days(obs: DataFrame, first: str, last: str, day_col: str = "date") -> DataFrame:
    """Days of a range on which nothing was observed."""
    days = obs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day_col))
    return days.join(obs.select(day_col).distinct(), day_col, "left_anti")


def read_synop_archive(spark: SparkSession, path: str, stations: DataFrame) -> DataFrame:
    """Monthly archive files (plain or gz): ``mq`` means missing; noon rows of known stations without missing values."""
    raw = spark.read.options(header=True, sep=";", nullValue="mq").csv(path).withColumn("row", F.monotonically_increasing_id())
    n = lambda c: F.col(c).try_cast("double")
    rows = raw.select(F.col("numer_sta").alias("station"), F.to_timestamp("date", "yyyyMMddHHmmss").alias("observed_at"), (n("t") - 273.15).alias("temp"), n("u").alias("rh"), (n("ff") * 3.6).alias("wind"), _not_negative(n("rr24")).alias("rain"), "row")
    return noon_archive(rows.na.drop(), stations)


def normalize_hourly_forecast(df: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Parallel hourly arrays (``time, temp, rh, wind, rain``) as one row per hour. Arrays of unequal length, wrong units and missing values raise an error."""
    names = ["time", "temp", "rh", "wind", "rain"]
    same = F.lit(True)
    for c in names[1:]:
        same = same & (F.size(c) == F.size("time"))
    checked = df.withColumn("_ok", F.assert_true(F.coalesce(same, F.lit(False)), F.lit("hourly arrays differ in length")))
    for c, unit in (units or {}).items():
        checked = checked.withColumn(f"_u_{c}", F.assert_true(F.col(f"{c}_unit") == unit, F.lit(f"unexpected unit of {c}")))
    keep = [c for c in df.columns if c not in names]
    rows = checked.where(F.col("_ok").isNull()).select(*keep, F.explode(F.arrays_zip(*names)).alias("h")).select(*keep, *(F.col(f"h.{c}").alias(c) for c in names))
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in names)) == 0
    return rows.withColumn("_v", F.assert_true(missing, F.lit("hourly value missing"))).where(F.col("_v").isNull()).drop("_v")


def combine_gridded_weather(fields: DataFrame, anchors: DataFrame) -> DataFrame:
    """Weather at anchors from decoded quarter-degree fields ``variable, qlat, qlon, value`` (grid indices): each variable from the nearest of the 3 x 3 neighbours; temperature and dew point give humidity, the wind components its speed."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = anchors.withColumn("_o", F.explode(around)).withColumn("qlat", F.floor(F.col("lat") * 4 + 0.5) + F.col("_o.i")).withColumn("qlon", F.floor(F.col("lon") * 4 + 0.5) + F.col("_o.j")).drop("_o")
    d2 = F.pow(F.col("qlat") / 4 - F.col("lat"), 2) + F.pow(F.col("qlon") / 4 - F.col("lon"), 2)
    near = a.join(fields, ["qlat", "qlon"]).withColumn("d2", F.round(d2, 9)).groupBy("anchor", "variable").agg(F.min_by("value", F.struct("d2", "qlat", "qlon")).alias("value"))
    w = near.groupBy("anchor").pivot("variable", ["t2m", "d2m", "u10", "v10", "tp", "tp24"]).agg(F.first("value"))
    from ..functions.fwi import relative_humidity

    return w.select("anchor", (F.col("t2m") - 273.15).alias("temp"), relative_humidity(F.col("t2m") - 273.15, F.col("d2m") - 273.15).alias("rh"), (F.sqrt(F.col("u10") ** 2 + F.col("v10") ** 2) * 3.6).alias("wind"), (F.greatest(F.col("tp") - F.coalesce("tp24", F.lit(0.0)), F.lit(0.0)) * 1000).alias("rain"))


def normalize_fire_records(df: DataFrame, resolution: int = 8) -> DataFrame:
    """Fire records with typed columns, an array of stable error codes, the cause taxonomy, the cell and the raw row."""
    number = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    t = df.withColumn("raw", F.to_json(F.struct(*df.columns)))
    t = t.withColumn("at", F.coalesce(F.try_to_timestamp("occurred_at"), F.try_to_timestamp("occurred_at", F.lit("dd/MM/yyyy HH:mm")))).withColumn("lat", number("latitude")).withColumn("lon", number("longitude")).withColumn("ha", number("surface_ha"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [
        ("missing_identity", blank("external_id")), ("invalid_timestamp", F.col("at").isNull()), ("missing_municipality", blank("municipality")),
        ("invalid_latitude", ~F.coalesce(F.col("lat").between(-90, 90), F.lit(False))), ("invalid_longitude", ~F.coalesce(F.col("lon").between(-180, 180), F.lit(False))),
        ("invalid_surface", ~F.coalesce(F.col("ha") >= 0, F.lit(False))), ("missing_cause", blank("cause")),
    ]
    t = t.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks))))
    ok = F.size("errors") == 0
    return t.select("external_id", F.col("at").alias("occurred_at"), "municipality", "lat", "lon", F.col("ha").alias("surface_ha"), "cause", text.map_cause(F.col("cause")).alias("mapped"), F.when(ok, grid.cell_of(F.col("lat"), F.col("lon"), resolution)).alias("cell"), "errors", "raw")


#: Header names of national exports after folding, and the columns they stand for.
ALIASES = {"date de premiere alerte": "alert", "date alerte": "alert", "nom de la commune": "name", "commune": "name", "code insee": "code", "departement": "department", "surface parcourue m2": "surface_m2", "surface m2": "surface_m2", "nature": "cause", "origine": "cause"}


def normalize_national_export(df: DataFrame, centres: DataFrame, max_reject_ratio: float = 0.05) -> DataFrame:
    """A national export with aliased headers, local times and municipality centres looked up by code, then name and department, then a unique name. Raises an error if too many rows find no centre or date."""
    import unicodedata

    fold = lambda s: " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).split())
    t = df.select(*(F.col(f"`{c}`").alias(ALIASES.get(fold(c), fold(c).replace(" ", "_"))) for c in df.columns))
    patterns = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
    t = t.withColumn("occurred_at", F.to_utc_timestamp(F.coalesce(*(F.try_to_timestamp("alert", F.lit(p)) for p in patterns)), "Europe/Paris"))
    t = t.withColumn("fname", text.fold_text(F.col("name")))
    c = centres.select("code", F.col("department").alias("dep"), text.fold_text(F.col("name")).alias("fname"), "lat", "lon")
    by_code = c.select(F.col("code").alias("c1"), F.struct("lat", "lon").alias("p1"))
    by_both = c.groupBy(F.col("fname").alias("n2"), F.col("dep").alias("d2")).agg(F.min(F.struct("code", "lat", "lon")).alias("p2"))
    by_name = c.groupBy(F.col("fname").alias("n3")).agg(F.min(F.struct("lat", "lon")).alias("p3"), F.count("*").alias("k")).where("k = 1").drop("k")
    t = t.join(by_code, F.col("code") == F.col("c1"), "left").join(by_both, (F.col("fname") == F.col("n2")) & (F.col("department") == F.col("d2")), "left").join(by_name, F.col("fname") == F.col("n3"), "left")
    at = lambda c: F.coalesce(F.col(f"p1.{c}"), F.col(f"p2.{c}"), F.col(f"p3.{c}"))
    t = t.withColumn("lat", at("lat")).withColumn("lon", at("lon")).withColumn("surface_ha", F.regexp_replace("surface_m2", ",", ".").try_cast("double") / 10_000)
    bad = F.col("lat").isNull() | F.col("occurred_at").isNull()
    share = t.agg((F.count_if(bad) / F.greatest(F.count("*"), F.lit(1))).alias("rejected"))
    guarded = t.crossJoin(F.broadcast(share))  # one row
    id_ = F.sha2(F.concat_ws("|", F.unix_timestamp("occurred_at").cast("string"), "code", "name", "surface_m2", "cause"), 256)
    guarded = guarded.withColumn("_g", F.assert_true(F.col("rejected") <= max_reject_ratio, F.lit("too many rejected rows")))
    return guarded.where(F.col("_g").isNull() & ~bad).select(id_.alias("external_id"), "occurred_at", F.col("name").alias("municipality"), "lat", "lon", "surface_ha", "cause")


HISTORY = "external_id string, occurred_at string, municipality string, latitude double, longitude double, surface_ha double, cause string"


def read_fire_history(spark: SparkSession, paths: list[str], bbox: tuple[float, float, float, float]) -> DataFrame:
    """Providers of one schema as one table of historical ignitions within a box."""
    return fire_history([spark.read.schema(HISTORY).option("header", True).csv(p) for p in paths], bbox)


def fire_history(sources: list[DataFrame], bbox: tuple[float, float, float, float]) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.where(grid.in_bbox(F.col("latitude"), F.col("longitude"), bbox))


def read_osm_features(spark: SparkSession, path: str, resolution: int = 8) -> DataFrame:
    raw = spark.read.schema("osm_id string, feature_type string, latitude double, longitude double, end_latitude double, end_longitude double, name string").option("header", True).csv(path)
    return osm_features(raw, resolution)


def osm_features(df: DataFrame, resolution: int = 8) -> DataFrame:
    """Features with the cell of their point, or of a line's midpoint."""
    mid = lambda a, b: F.when(F.col(b).isNotNull(), (F.col(a) + F.col(b)) / 2).otherwise(F.col(a))
    return df.withColumn("cell", grid.cell_of(mid("latitude", "end_latitude"), mid("longitude", "end_longitude"), resolution))


def classify_tags(tags: Column) -> Column:
    """road, power_line, building or poi from a tag map; null for others."""
    return F.when(tags["highway"].isNotNull(), "road").when(tags["power"] == "line", "power_line").when(tags["building"].isNotNull(), "building").when((tags["amenity"] == "parking") | (tags["tourism"] == "camp_site"), "poi")


def aggregate_osm(nodes: DataFrame, ways: DataFrame, resolution: int = 8) -> DataFrame:
    """Per cell: metres of road and power line (segment lengths at their midpoints, to the millimetre), distinct building sub-cells, and points of interest."""
    w = ways.select("way", "kind", F.posexplode("refs").alias("place", "node")).join(nodes, "node")
    seq = Window.partitionBy("way").orderBy("place")
    s = w.where(F.col("kind").isin("road", "power_line")).withColumn("lat2", F.lead("lat").over(seq)).withColumn("lon2", F.lead("lon").over(seq)).where("lat2 is not null")
    seg = grid.segment(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    lines = s.select(grid.cell_of(seg["lat"], seg["lon"], resolution).alias("cell"), "kind", seg["length_m"].alias("m"))
    lines = lines.groupBy("cell").agg(*(F.round(F.sum(F.when(F.col("kind") == k, F.col("m")).otherwise(0.0)), 3).alias(f"{k}_m") for k in ("road", "power_line")))
    spots = w.where(F.col("kind").isin("building", "poi")).groupBy("way", "kind").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    spots = spots.select("kind", grid.cell_of(F.col("lat"), F.col("lon"), resolution).alias("cell"), grid.cell_of(F.col("lat"), F.col("lon"), resolution + 3).alias("sub"))
    spots = spots.groupBy("cell").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "building", F.col("sub")))).alias("building_cells"), F.count_if(F.col("kind") == "poi").alias("poi"))
    return lines.join(spots, "cell", "full").na.fill({"road_m": 0.0, "power_line_m": 0.0, "poi": 0})


def classify_land_cover(code: Column) -> tuple[Column, Column]:
    """``(agricultural, combustible)`` of a land-cover class."""
    agri = code.between(211, 244)
    return agri, agri | code.between(311, 313) | code.between(321, 324) | code.isin(333, 334)


def aggregate_land_cover(xyz: DataFrame, resolution: int = 8) -> DataFrame:
    """Flags per cell from projected raster points ``x, y, code``; class 0 is no data."""
    agri, combustible = classify_land_cover(F.col("code"))
    return xyz.where("code <> 0").groupBy(grid.cell_of_xy(F.col("x"), F.col("y"), resolution).alias("cell")).agg(F.bool_or(agri).alias("agricultural"), F.bool_or(combustible).alias("combustible"))


def aggregate_population(df: DataFrame, resolution: int = 8) -> DataFrame:
    """Population per cell from 200 m squares ``id, ind, imputed`` whose id holds their south-west corner."""
    north, east = (F.regexp_extract("id", p, 1).cast("double") for p in (r"N(\d+)E", r"E(\d+)$"))
    return df.groupBy(grid.cell_of_xy(east + 100, north + 100, resolution).alias("cell")).agg(F.sum(F.greatest("ind", F.lit(0.0))).alias("population"), F.max("imputed").alias("imputed"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, school_holiday boolean, public_holiday boolean, label string").option("header", True).csv(path)


def own_cells(candidates: DataFrame) -> DataFrame:
    """First-code-wins ownership of cells from ``(code, cell)`` candidates, with how many codes claimed each."""
    return candidates.groupBy("cell").agg(F.min("code").alias("code"), F.countDistinct("code").alias("claims"))


def load_territory(features: DataFrame, codes: list[str] | None = None, resolution: int = 8) -> tuple[DataFrame, DataFrame]:
    """Cells whose centre lies in a feature's ring of plane ``(x, y)`` points, each owned by the smallest code; and the wanted codes that no feature has."""
    spark = features.sparkSession
    f = features.where(F.col("code").isin(codes)) if codes is not None else features
    edge = grid.edge_m(resolution)
    bound = lambda fn, c: fn(F.transform("ring", lambda p: p[c]))
    lo_r, hi_r = F.floor(bound(F.array_min, "y") / (edge * 1.5)) - 1, F.ceil(bound(F.array_max, "y") / (edge * 1.5)) + 1
    lo_q = F.floor(bound(F.array_min, "x") / (edge * 3**0.5) - hi_r / 2) - 1
    hi_q = F.ceil(bound(F.array_max, "x") / (edge * 3**0.5) - lo_r / 2) + 1
    c = f.select("code", "ring", F.explode(grid.cells_between(lo_q, hi_q, lo_r, hi_r, resolution)).alias("cell"))
    x, y = grid.cell_xy(F.col("cell"))
    inside = c.where(grid.in_ring(x, y, F.col("ring"))).select("code", "cell")
    wanted = spark.createDataFrame([(c,) for c in codes or []], "code string")
    return own_cells(inside), wanted.join(features.select("code"), "code", "left_anti")


def load_communes(features: DataFrame, resolution: int = 8) -> DataFrame:
    """Municipality cells; codes must be valid and a cell may have one owner only."""
    cells, _ = load_territory(features.where(text.valid_commune_code(F.col("code"))), None, resolution)
    return cells.withColumn("_g", F.assert_true(F.col("claims") == 1, F.lit("a cell has two owners"))).where(F.col("_g").isNull()).select("cell", "code")
