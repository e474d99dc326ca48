"""Queries of quality rules, dataset construction, metrics and models (q, a10-a30, b, w3-w7, u, m, r8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views
from ..functions import grid, text
from ..operators import dataset, metrics, quality, scoring, spatial
from ..sources.staging import staged
from ..views import table, with_views
from .joins import _DIST, _EV, _events, disk
from .registry import query
from .scalar import _CENTRE, _sql_hex, sql_fingerprint

_c = F.col
_L = with_views("v_labeled")

# --- quality ----------------------------------------------------------------

_CAUSE = "CASE WHEN cause = 'naturelle' THEN 'natural_known' WHEN cause = 'inconnue' THEN 'unknown' ELSE 'human_known' END"


def _mapped(spark, d):
    i = views.ignitions(spark, d)
    m = text.map_cause(_c("cause"))
    return i.withColumn("category", m["category"]).withColumn("subcategory", m["subcategory"])


@query(
    with_views("v_ignitions")
    + f""" SELECT id, CASE {_CAUSE} WHEN 'human_known' THEN CASE WHEN cause = 'accidentelle' THEN 'medium' ELSE 'high' END WHEN 'natural_known' THEN 'high' ELSE 'unknown' END AS confidence,
    CASE {_CAUSE} WHEN 'human_known' THEN 'eligible_human_positive' WHEN 'natural_known' THEN 'eligible_natural_cohort' ELSE 'unknown_cause_cohort' END AS eligibility, cause = 'accidentelle' AS sensitivity FROM v_ignitions"""
)
def q1_assess_label(spark, d):
    a = quality.assess_label(_c("category"), _c("subcategory"))
    return _mapped(spark, d).select("id", a["confidence"].alias("confidence"), a["eligibility"].alias("eligibility"), a["sensitivity"].alias("sensitivity"))


_PLACED = with_views("v_ignitions") + ", e AS (SELECT *, 40 + lat_m / 8 AS lat, 1 + lon_m / 8 AS lon FROM v_ignitions), st AS (SELECT lat, lon, count(*) AS n, count(DISTINCT commune) AS m, count(DISTINCT year(occurred_at)) AS y FROM e GROUP BY 1, 2) "


def _placed(spark, d):
    return views.ignitions(spark, d).withColumn("lat", 40 + _c("lat_m") / 8).withColumn("lon", 1 + _c("lon_m") / 8)


@query(_PLACED + "SELECT id, n AS event_count, m AS municipality_count, y AS year_count FROM e JOIN st USING (lat, lon)")
def a10_coordinate_stats(spark, d):
    return quality.coordinate_stats(_placed(spark, d)).select("id", "event_count", "municipality_count", "year_count")


_STATUS = "CASE WHEN m = 1 AND n >= 5 AND y >= 2 THEN 'probable_centroid' WHEN m = 1 AND n >= 3 THEN 'possible_centroid' ELSE 'undetermined' END"


@query(_PLACED + f"SELECT id, {_STATUS} AS status FROM e JOIN st USING (lat, lon)")
def a11_coordinate_signals(spark, d):
    t = quality.coordinate_stats(_placed(spark, d))
    p = F.least(grid.decimal_precision(_c("lat")), grid.decimal_precision(_c("lon")))
    return t.select("id", quality.centroid_status(_c("event_count"), _c("municipality_count"), _c("year_count"), p).alias("status"))


_PROBABLE = f"{_STATUS} = 'probable_centroid'"


@query(
    _PLACED
    + f"""SELECT id, CASE WHEN id % 17 = 0 THEN 'municipality_centroid_confirmed' WHEN {_PROBABLE} THEN 'municipality_centroid_probable' ELSE 'rounded_coordinate_probable' END AS category, CASE WHEN id % 17 = 0 THEN 1::DOUBLE WHEN {_PROBABLE} THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS confidence,
    CASE WHEN id % 17 = 0 THEN 'official_versioned_centroid_match' WHEN {_PROBABLE} THEN 'same_coordinate_repeated_within_one_municipality,multiple_years_without_spatial_variation,no_official_centroid_reference_available' ELSE 'limited_decimal_precision' END AS reasons FROM e JOIN st USING (lat, lon)"""
)
def q2_assess_geography(spark, d):
    g = _geography(spark, d)
    return g.select("id", "g.category", "g.confidence", F.array_join("g.reasons", ",").alias("reasons"))


def _geography(spark, d):
    t = quality.coordinate_stats(_placed(spark, d))
    p = F.least(grid.decimal_precision(_c("lat")), grid.decimal_precision(_c("lon")))
    return t.select("id", quality.assess_geography(quality.centroid_status(_c("event_count"), _c("municipality_count"), _c("year_count"), p), p, _c("id") % 17 == 0).alias("g"))


_PAIRED = (
    with_views("v_ignitions")
    + """, ev AS (SELECT id, occurred_at, commune, cell, lat_m AS x, lon_m AS y, surface_ha, cause, id % 6 = 0 AS amb FROM v_ignitions),
  pr AS (SELECT a.id AS l, b.id AS r, floor(abs(floor(epoch(b.occurred_at)) - floor(epoch(a.occurred_at))) / 60) AS minutes, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, CASE WHEN greatest(a.surface_ha, b.surface_ha) > 0 THEN abs(a.surface_ha - b.surface_ha) / greatest(a.surface_ha, b.surface_ha) ELSE 0 END AS sd,
    a.commune = b.commune AS sm, a.cell = b.cell AS sc, a.cause = b.cause AS ca, a.amb OR b.amb AS amb
    FROM ev a JOIN ev b ON CAST(a.occurred_at AS DATE) = CAST(b.occurred_at AS DATE) AND a.id < b.id WHERE a.commune = b.commune OR greatest(abs((a.cell // 67108864) % 67108864 - (b.cell // 67108864) % 67108864), abs(a.cell % 67108864 - b.cell % 67108864), abs((a.cell // 67108864) % 67108864 - (b.cell // 67108864) % 67108864 + a.cell % 67108864 - b.cell % 67108864)) <= 1),
  s AS (SELECT *, round(greatest(0, least(1, 0.2 + CASE WHEN sm THEN 0.15 ELSE -0.15 END + CASE WHEN sc THEN 0.1 ELSE -0.1 END + CASE WHEN dist <= 25 THEN 0.25 WHEN dist <= 150 THEN 0.12 ELSE -0.15 END + CASE WHEN minutes <= 30 THEN 0.25 WHEN minutes <= 180 THEN 0.12 WHEN minutes >= 720 THEN -0.2 ELSE 0 END
    + CASE WHEN ca THEN 0.15 ELSE -0.08 END + CASE WHEN sd <= 0.05 THEN 0.1 WHEN sd >= 0.75 THEN -0.1 ELSE 0 END + CASE WHEN amb THEN -0.1 ELSE 0 END))::DOUBLE, 6) AS score FROM pr),
  k AS (SELECT *, CASE WHEN score >= 0.92 AND NOT amb AND sm AND sc AND ca AND dist <= 25 AND minutes <= 30 AND sd <= 0.05 THEN 'certain_duplicate' WHEN score >= 0.75 AND NOT amb THEN 'probable_duplicate' WHEN score >= 0.55 THEN 'possible_duplicate' WHEN sc THEN 'indeterminate' ELSE 'probably_distinct' END AS classification FROM s) """
)


def _audited(spark, d):
    return _mapped(spark, d).withColumnsRenamed({"lat_m": "x", "lon_m": "y"}).withColumn("geography", F.when(_c("id") % 6 == 0, "municipality_centroid_probable").otherwise("precision_undocumented"))


@query(_PAIRED + 'SELECT l AS "left", r AS "right", score, classification FROM k')
def q3_assess_duplicates(spark, d):
    return quality.assessed_pairs(_audited(spark, d))


@query(
    _PAIRED
    + """, g AS (SELECT * FROM k WHERE classification IN ('certain_duplicate', 'probable_duplicate', 'possible_duplicate')) SELECT l || ':' || r AS "group", l AS event, 'anchor' AS role, 'keep' AS decision FROM g
    UNION ALL SELECT l || ':' || r, r, 'candidate', CASE WHEN classification = 'certain_duplicate' THEN 'exclude' ELSE 'review' END FROM g"""
)
def q4_duplicate_groups(spark, d):
    return quality.duplicate_groups(quality.assessed_pairs(_audited(spark, d), review=True)).drop("classification")


@query(
    with_views("v_cells", "v_ignitions")
    + f""", n AS (SELECT i.id AS event, n.ring, c.cell FROM v_ignitions i, {disk(2)} n JOIN v_cells c ON c.cell = i.cell + n.dq * 67108864 + n.dr AND c.combustible), k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ring, cell) AS k FROM n),
    a AS (SELECT event, count(*) FILTER (ring = 0) AS r0, count(*) FILTER (ring = 1) AS r1, count(*) FILTER (ring = 2) AS r2, string_agg(cell::VARCHAR, ',' ORDER BY k) FILTER (k <= 5) AS nearest FROM k GROUP BY event)
    SELECT i.id AS event, coalesce(c.combustible, false) AS combustible, coalesce(r0, 0) AS ring_0, coalesce(r1, 0) AS ring_1, coalesce(r2, 0) AS ring_2, nearest,
    concat_ws(',', CASE WHEN c.combustible IS NULL THEN 'static_cell_missing' END, CASE WHEN NOT c.combustible THEN 'cell_not_combustible' END, CASE WHEN coalesce(r1, 0) + coalesce(r2, 0) = 0 THEN 'no_combustible_neighbour' END) AS flags
    FROM v_ignitions i LEFT JOIN v_cells c ON c.cell = i.cell LEFT JOIN a ON a.event = i.id"""
)
def q5_assess_combustibility(spark, d):
    e = views.ignitions(spark, d).select(_c("id").alias("event"), "cell")
    t = quality.assess_combustibility(e, views.cells(spark, d))
    return t.select("event", "combustible", "ring_0", "ring_1", "ring_2", F.array_join(F.transform("nearest", lambda x: x.cast("string")), ",").alias("nearest"), F.array_join("flags", ",").alias("flags"))


@query(_PAIRED + "SELECT classification, count(*) AS pairs FROM k GROUP BY 1")
def q6_audit_summary(spark, d):
    return quality.audit_quality(_audited(spark, d), views.cells(spark, d))["classes"]


@query("SELECT o_orderkey AS key, o_orderkey % 5 IN (0, 1, 2) AS safe FROM orders")
def q7_strict_safe(spark, d):
    names = F.array(*map(F.lit, ["static", "calendar_deterministic", "snapshot_available", "future", "retrospective"]))
    return table(spark, d, "orders").select(_c("o_orderkey").alias("key"), quality.strict_safe(F.element_at(names, (_c("o_orderkey") % 5 + 1).cast("int"))).alias("safe"))


# --- datasets ---------------------------------------------------------------


def _dataset_events(spark, d):
    e = _mapped(spark, d).select("id", "cell", F.to_date("occurred_at").alias("date"), "category")
    low = e.select("id", (_c("id") % 4 == 0).alias("low_geo_confidence"))
    burn = e.select("id", (_c("id") % 5 != 0).alias("combustible"))
    labels = e.select("id", (_c("category") == "human_known").alias("eligible"))
    dup = e.select(_c("id").alias("right"), F.when(_c("id") % 9 == 0, "certain_duplicate").otherwise("possible_duplicate").alias("classification"))
    return dataset.candidate_events(e, labels, low, burn, dup)


_DE = with_views("v_ignitions") + f", de AS (SELECT id, cell, CAST(occurred_at AS DATE) AS date, {_CAUSE} AS category, id % 4 = 0 AS low, id % 5 <> 0 AS combustible, id % 9 = 0 AS dup FROM v_ignitions) "


@query(_DE + "SELECT id, cell, date, category, low AS low_geo_confidence, combustible, dup AS duplicate FROM de")
def b1_candidate_events(spark, d):
    return _dataset_events(spark, d).select("id", "cell", "date", "category", "low_geo_confidence", "combustible", "duplicate")


_POS = _DE + ", pos AS (SELECT cell, date, min(id) AS id, arg_min(combustible, id) AS combustible, bool_or(low) AS low_geo_confidence, bool_and(category = 'human_known' AND NOT low) AS strict, count(*) AS events FROM de WHERE NOT dup GROUP BY cell, date) "


@query(_POS + "SELECT * FROM pos")
def b2_positive_rows(spark, d):
    return _positives(spark, d).select("cell", "date", "id", "combustible", "low_geo_confidence", "strict", "events")


def _positives(spark, d):
    return dataset.positive_rows(_dataset_events(spark, d), (_c("category") == "human_known") & ~_c("low_geo_confidence"))


@query(
    _DE
    + """, inside AS (SELECT * FROM de WHERE year(date) <= 2000), pos AS (SELECT cell, date, min(id) AS id, arg_min(combustible, id) AS combustible, bool_or(low) AS low FROM inside WHERE NOT dup GROUP BY cell, date),
    ev AS (SELECT id, cell, date, CASE WHEN year(date) > 2000 THEN 'out_of_period' WHEN dup THEN 'certain_duplicate' WHEN category = 'unknown' THEN 'unknown_cause' WHEN category = 'natural_known' THEN 'natural_cause' WHEN id % 101 = 0 THEN 'future_data' WHEN cell % 13 = 0 THEN 'out_of_territory' WHEN id % 97 = 0 THEN 'weather_unavailable' END AS reason FROM de)
    SELECT * FROM ev WHERE reason IS NOT NULL UNION ALL SELECT NULL, cell, date, CASE WHEN id % 11 = 0 THEN 'missing_features' WHEN NOT combustible THEN 'non_combustible_cell' ELSE 'insufficient_geographic_quality' END FROM pos WHERE id % 11 = 0 OR NOT combustible OR low"""
)
def b3_exclusions(spark, d):
    e, inside = _dataset_events(spark, d), F.year("date") <= 2000
    checks = {"unknown_cause": _c("category") == "unknown", "natural_cause": _c("category") == "natural_known", "future_data": _c("id") % 101 == 0, "out_of_territory": _c("cell") % 13 == 0, "weather_unavailable": _c("id") % 97 == 0}
    strict = {"missing_features": _c("id") % 11 == 0, "non_combustible_cell": ~_c("combustible"), "insufficient_geographic_quality": _c("low_geo_confidence")}
    return dataset.exclusions(e, inside, checks, strict, dataset.positive_rows(e.where(inside), F.lit(True)))


@query(with_views("v_cells") + " SELECT cell, date FROM (SELECT cell, make_date(y, 6, 15) AS date, row_number() OVER (PARTITION BY y ORDER BY md5('3|' || cell::VARCHAR || '|' || make_date(y, 6, 15)::VARCHAR), cell) AS k FROM v_cells, (VALUES (1996), (1997), (1998)) t(y) WHERE combustible) WHERE k <= 50")
def b4_pilot_negatives(spark, d):
    return dataset.pilot_negatives(views.cells(spark, d), [1996, 1997, 1998], 50, "3").select("cell", "date")


@query(
    _EV
    + f""", b AS (SELECT cell, row_number() OVER (ORDER BY ('0x' || substr(md5(cell::VARCHAR), 1, 2))::BIGINT, cell) - 1 AS rank FROM v_cells WHERE combustible),
    w AS (SELECT i AS draw, ('0x' || substr(md5('9|' || i || '|cell'), 1, 12))::BIGINT % (SELECT count(*) FROM b) AS rank, DATE '1996-01-01' + CAST(('0x' || substr(md5('9|' || i || '|day'), 1, 12))::BIGINT % 365 AS INTEGER) AS date FROM (SELECT unnest(range(0, 16000)) AS i)),
    p AS (SELECT min(draw) AS draw, cell, date FROM w JOIN b USING (rank) GROUP BY cell, date), c AS (SELECT * FROM p WHERE (cell, date) NOT IN (SELECT (cell, date) FROM ev)),
    hit AS (SELECT DISTINCT c.draw FROM c, (SELECT unnest(range(-3, 4)) AS o) JOIN ev e ON e.date = c.date + CAST(o AS INTEGER) WHERE {_DIST} <= 2) SELECT draw, cell, date FROM c WHERE draw NOT IN (SELECT draw FROM hit) ORDER BY draw LIMIT 400"""
)
def b5_sample_negatives(spark, d):
    e = _events(spark, d)
    return dataset.sample_negatives(views.cells(spark, d), e, e, "N2", "1996-01-01", 365, 400, 9).select("draw", "cell", "date")


def _blocks(cell: str) -> str:
    src = f"(SELECT *, {grid.edge_m(8)!r}::DOUBLE * {math.sqrt(3)!r}::DOUBLE * (cq + cr / 2.0::DOUBLE) AS x, {grid.edge_m(8)!r}::DOUBLE * 1.5 * cr AS y FROM (SELECT *, ({cell} // 67108864) % 67108864 - 33554432 AS cq, {cell} % 67108864 - 33554432 AS cr FROM @))"
    return src


def _with_block(relation: str, level: int, name: str) -> str:
    return _sql_hex(_blocks("cell").replace("@", relation), grid.edge_m(level), level, name)


_CAND = """, cd AS (SELECT cell, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) + CAST(key * 37 % 2400 AS INTEGER) AS date FROM v_cells), ps AS (SELECT cell, CAST(occurred_at AS DATE) AS date FROM v_ignitions) """


@query(
    with_views("v_cells", "v_ignitions") + _CAND
    + f""", c2 AS (SELECT cell, date, block, month(date) AS month FROM {_with_block('cd', 5, 'block')}), p2 AS (SELECT block, month(date) AS month, floor(count(*) * 1.5::DOUBLE + 0.5) AS quota FROM {_with_block('ps', 5, 'block')} GROUP BY 1, 2),
    k AS (SELECT c2.*, quota, row_number() OVER (PARTITION BY block, month ORDER BY md5('4|' || cell::VARCHAR || '|' || date::VARCHAR), cell, date) AS n FROM c2 JOIN p2 USING (block, month)) SELECT cell, date FROM k WHERE n <= quota"""
)
def b6_stratified_select(spark, d):
    first = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("f"))
    c = views.cells(spark, d).crossJoin(F.broadcast(first)).select("cell", F.date_add("f", (_c("key") * 37 % 2400).cast("int")).alias("date"))
    p = views.ignitions(spark, d).select("cell", F.to_date("occurred_at").alias("date"))
    return dataset.stratified_select(c, p, 1.5, "4").select("cell", "date")


@query(with_views("v_ignitions", "v_cells") + " SELECT i.id, round(coalesce(c.road, 0), 6) AS road, isodow(CAST(i.occurred_at AS DATE)) >= 6 AS weekend FROM v_ignitions i LEFT JOIN v_cells c ON c.cell = i.cell")
def b7_row_features(spark, d):
    from ..functions.dates import is_weekend

    i = views.ignitions(spark, d).select("id", "cell", F.to_date("occurred_at").alias("date"))
    cal = i.select("date").distinct().withColumn("weekend", is_weekend(_c("date")))
    return dataset.row_features(i, views.cells(spark, d).select("cell", "road"), cal, ["road"]).select("id", F.round("road", 6).alias("road"), "weekend")


@query(
    _POS
    + """, ng AS (SELECT cell + 1 AS cell, date FROM pos WHERE id % 3 = 0), v AS (SELECT unnest(['strict_n2', 'strict_n3', 'inclusive_n2', 'inclusive_n3']) AS v), r AS (SELECT v, 1 AS label, cell, date FROM pos, v WHERE strict OR v LIKE 'inc%' UNION ALL SELECT v, 0, cell, date FROM ng, v)
    SELECT v AS variant, label, count(*) AS n, count(DISTINCT k) AS keys, min(k) AS first_key, max(k) AS last_key, min(date) AS first_day, max(date) AS last_day FROM (SELECT *, sha256(concat_ws('|', v, cell::VARCHAR, date::VARCHAR, label::VARCHAR)) AS k FROM r) GROUP BY 1, 2"""
)
def b8_build_variants(spark, d):
    p = staged(_positives(spark, d).select("cell", "date", "id", "strict"), "positives")  # each variant takes them
    n = p.where("id % 3 = 0").select((_c("cell") + 1).alias("cell"), "date")
    return dataset.variant_stats(dataset.build_variants(p, {"N2": n, "N3": n}))


@query(
    _POS
    + ", ng AS (SELECT cell + 1 AS cell, date FROM pos WHERE id % 3 = 0), r AS (SELECT 1 AS label, cell, date FROM pos WHERE strict UNION ALL SELECT 0, cell, date FROM ng), k AS (SELECT sha256(concat_ws('|', 'strict_n2', cell::VARCHAR, date::VARCHAR, label::VARCHAR)) AS k, sha256(concat_ws('|', cell::VARCHAR, date::VARCHAR, label::VARCHAR)) AS c FROM r) "
    + sql_fingerprint("k")
)
def b8_variant_fingerprint(spark, d):
    p = _positives(spark, d)
    n = p.where("id % 3 = 0").select((_c("cell") + 1).alias("cell"), "date")
    rows = dataset.build_variants(p, {"N2": n}).where("variant = 'strict_n2'")
    return text.fingerprint(rows.withColumn("checksum", text.row_checksum(_c("cell"), _c("date"), _c("label"))), "row_key", "checksum")


@query(
    _L + """, r AS (SELECT *, CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'validation' ELSE 'test' END AS split FROM v_labeled), g AS (SELECT cell, date, count(DISTINCT split) AS s, count(DISTINCT label) AS l FROM r GROUP BY 1, 2)
    SELECT 'date_outside_split' AS rule, count(*) FILTER (split = 'test' AND date > DATE '2000-12-31') AS violations FROM r UNION ALL SELECT 'cell_day_in_two_splits', count(*) FILTER (s > 1) FROM g UNION ALL SELECT 'cell_day_with_two_labels', count(*) FILTER (l > 1) FROM g
    UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1)"""
)
def b9_leakage_checks(spark, d):
    r = views.labeled(spark, d).withColumn("split", F.when(_c("year") <= 1998, "train").when(_c("year") == 1999, "validation").otherwise("test"))
    return dataset.leakage_checks(r, {"train": ("1990-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2000-12-31")})


@query(
    with_views("v_cells", "v_ignitions")
    + f""", e AS (SELECT DISTINCT cell, CAST(occurred_at AS DATE) AS date, {_CAUSE} AS category FROM v_ignitions), w AS (SELECT cell, ('0x' || substr(md5('8|' || cell::VARCHAR), 1, 7))::BIGINT % 365 AS start FROM v_cells WHERE combustible),
    t AS (SELECT cell, k, DATE '1996-01-01' + CAST((start + k) % 365 AS INTEGER) AS date FROM w, (SELECT unnest(range(0, 365)) AS k)) SELECT DISTINCT cell, date, 1 AS label FROM e JOIN v_cells USING (cell) WHERE category = 'human_known' AND combustible
    UNION ALL SELECT cell, arg_min(date, k), 0 FROM t ANTI JOIN (SELECT DISTINCT cell, date FROM e) USING (cell, date) GROUP BY cell"""
)
def b10_training_sample(spark, d):
    e = _mapped(spark, d).select("cell", F.to_date("occurred_at").alias("date"), "category")
    return dataset.training_sample(e, views.cells(spark, d), "1996-01-01", 365, "8")


_PARENT = f"(SELECT key, x7.cell AS parent FROM {_sql_hex(_CENTRE, grid.edge_m(7), 7)} x7)"


@query(with_views("v_cells") + f" SELECT parent, round(avg(road), 6) AS road, bool_or(combustible) AS combustible, count(*) AS children FROM v_cells c JOIN {_PARENT} p USING (key) GROUP BY 1")
def a5_coarsen_features(spark, d):
    return dataset.coarsen_features(views.cells(spark, d), 7, ["road"]).select("parent", F.round("road", 6).alias("road"), "combustible", "children")


_SHARE = with_views("v_cells") + f", pa AS (SELECT c.*, p.parent FROM v_cells c JOIN {_PARENT} p USING (key)), sh AS (SELECT parent, count(*) AS n, avg(combustible::INT) AS s FROM pa GROUP BY 1) "


@query(_SHARE + 'SELECT count(*) AS "rows", count(*) FILTER (s > 0) AS "any", count(*) FILTER (s > 0.5) AS majority, count(*) FILTER (s >= 0.5) AS half, count(*) FILTER (s >= 0.75) AS three_quarters FROM pa JOIN sh USING (parent)')
def a25_combustibility_sensitivity(spark, d):
    c = views.cells(spark, d)
    return dataset.combustibility_sensitivity(c, c.select("cell"), 7)


@query(_SHARE + 'SELECT count(*) AS parents, min(n) AS least, max(n) AS most, count(*) FILTER (n = 1) AS single, count(*) FILTER (s > 0) AS "any", count(*) FILTER (s > 0.5) AS majority, count(*) FILTER (s >= 0.25) AS quarter, count(*) FILTER (s >= 0.75) AS three_quarters, count(*) FILTER ((s > 0) <> (s > 0.5)) AS any_not_majority FROM sh')
def a28_coarsening_census(spark, d):
    return dataset.coarsening_census(views.cells(spark, d), 7)


@query(_SHARE + ", o AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS t FROM sh) SELECT min(n) AS least, min(n) FILTER (k = floor((t - 1) * 0.5::DOUBLE + 0.5) + 1) AS median, max(n) AS most, max(t) AS blocks FROM o")
def a28_block_distribution(spark, d):
    return dataset.block_distribution(views.cells(spark, d).select("cell"), 7)


@query(with_views("v_cells") + " SELECT 'road' AS feature, round(avg((key % 10 <> 0)::INT), 6) AS match_rate, count(*) AS rows FROM v_cells UNION ALL SELECT 'population', round(avg((key % 6 <> 0)::INT), 6), count(*) FROM v_cells")
def a29_feature_parity(spark, d):
    c = views.cells(spark, d)
    stored = c.select("key", F.when(_c("key") % 10 == 0, _c("road") + 1).otherwise(_c("road")).alias("road"), F.when(_c("key") % 6 != 0, _c("population")).alias("population"))
    return dataset.feature_parity(stored, c, "key", ["road", "population"]).select("feature", F.round("match_rate", 6).alias("match_rate"), "rows")


@query(with_views("v_cells", "v_ignitions") + ", cd AS (SELECT cell, DATE '1996-01-01' + CAST(key * 37 % 360 AS INTEGER) AS date FROM v_cells), de AS (SELECT DISTINCT cell, CAST(occurred_at AS DATE) AS date FROM v_ignitions) SELECT count(*) AS candidates, count(*) FILTER (cell IN (SELECT cell FROM de)) AS same_cell, count(*) FILTER ((cell, date) IN (SELECT (cell, date) FROM de)) AS same_cell_day FROM cd")
def a30_contamination(spark, d):
    c = views.cells(spark, d).select("cell", F.date_add(F.lit("1996-01-01").cast("date"), (_c("key") * 37 % 360).cast("int")).alias("date"))
    i = views.ignitions(spark, d).select("cell", F.to_date("occurred_at").alias("date"))
    return dataset.contamination(c, i).select("candidates", "same_cell", "same_cell_day")


@query(with_views("v_ignitions") + """, ev AS (SELECT id AS event, cell, CAST(occurred_at AS DATE) AS date FROM v_ignitions) SELECT event, ring, cell - ring * 67108864 AS cell, date + o AS date FROM ev, (VALUES (0), (1), (2), (3), (5)) r(ring), (VALUES (0), (1), (2), (3), (5)) f(o)""")
def a27_probe_population(spark, d):
    return dataset.probe_population(_events(spark, d)).select("event", "ring", "cell", "date")


@query(_L + ", r AS (SELECT *, CASE WHEN year <= 1998 THEN 'train' ELSE 'test' END AS split FROM v_labeled) SELECT split, count(*) AS rows, count(*) FILTER (x3 IS NOT NULL) AS comparable, count(*) FILTER (x3 IS NOT NULL AND label = 1) AS positives, count(DISTINCT (cell, date)) AS cell_days FROM r GROUP BY 1")
def m12_population_report(spark, d):
    r = views.labeled(spark, d).withColumn("split", F.when(_c("year") <= 1998, "train").otherwise("test")).withColumn("score_b", F.when(_c("x3").isNotNull(), _c("score_b")))
    return dataset.population_report(r)


# --- metrics ----------------------------------------------------------------

_AUC = "(SELECT s, p, n, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM (SELECT {s} AS s, sum(label) AS p, sum(1 - label) AS n FROM v_labeled GROUP BY 1))"


@query(_L + f" SELECT round((sum(n * (ab + p / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM {_AUC.format(s='score')}")
def w3_roc_auc(spark, d):
    return metrics.roc_auc(views.labeled(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(_L + f" SELECT round((sum(n * (ab + p / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM {_AUC.format(s='floor(score * 1000 + 0.5) / 1000.0')}")
def a20_binned_auc(spark, d):
    return metrics.approx_auc(views.labeled(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(_L + ", r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS k, sum(label) OVER (ORDER BY score DESC, id) AS tp FROM v_labeled) SELECT round(avg(tp / k::DOUBLE) FILTER (label = 1), 6) AS average_precision FROM r")
def w4_average_precision(spark, d):
    return metrics.average_precision(views.labeled(spark, d), "id").select(F.round("average_precision", 6).alias("average_precision"))


@query(_L + ", r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS n, sum(label) OVER () AS pos FROM v_labeled) SELECT f::DOUBLE AS fraction, count(*) AS k, round(avg(label), 6) AS \"precision\", round(sum(label) / max(pos)::DOUBLE, 6) AS recall, round(avg(label) / (max(pos) / max(n)::DOUBLE), 6) AS lift FROM r, (VALUES (0.01), (0.05), (0.1)) t(f) WHERE k <= greatest(1, ceil(n * f::DOUBLE)) GROUP BY f")
def w5_at_top(spark, d):
    t = metrics.at_top(views.labeled(spark, d), "id", (0.01, 0.05, 0.1))
    return t.select("fraction", "k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "lift")))


@query(_L + " SELECT round(sum(n * abs(s - l)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(score) AS s, avg(label) AS l FROM v_labeled GROUP BY least(floor(score * 10), 9))")
def a21_ece(spark, d):
    return metrics.ece(views.labeled(spark, d)).select(F.round("ece", 6).alias("ece"))


@query(_L + ", p AS (SELECT *, greatest(1e-12, least(1 - 1e-12, score)) AS q FROM v_labeled), c AS (SELECT avg(pow(score - label, 2)) AS brier, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss, (count(*) FILTER (score >= 0.5 AND label = 1))::DOUBLE AS tp, count(*) FILTER (score >= 0.5) AS hit, sum(label) AS pos FROM p) SELECT round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(tp / hit, 6) AS \"precision\", round(tp / pos, 6) AS recall, round(2 * tp / (hit + pos), 6) AS f1 FROM c")
def a22_point_metrics(spark, d):
    return metrics.point_metrics(views.labeled(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("brier", "log_loss", "precision", "recall", "f1")))


_TOP = ((0.01, "1"), (0.05, "5"), (0.1, "10"))
_SPLIT_METRICS = ["positive_rate", "auc", "average_precision", "log_loss", "brier", "ece", "precision", "recall", "f1", *(f"{m}_{p}" for _, p in _TOP for m in ("precision", "recall", "lift"))]


def _split_sql(name: str, source: str, score: str) -> str:
    """Common table expressions that end in ``<name>``: all metrics of a score by year."""
    in_top = lambda f: f"k <= greatest(1, ceil(n * {f}::DOUBLE))"
    tops = ", ".join(f"sum(label) FILTER ({in_top(f)}) / (count(*) FILTER ({in_top(f)}))::DOUBLE AS precision_{p}, sum(label) FILTER ({in_top(f)}) / max(pos)::DOUBLE AS recall_{p}, (sum(label) FILTER ({in_top(f)}) / (count(*) FILTER ({in_top(f)}))::DOUBLE) / (max(pos) / max(n)::DOUBLE) AS lift_{p}" for f, p in _TOP)
    return f"""{name}_g AS (SELECT year, {score} AS s, sum(label) AS p, sum(1 - label) AS n FROM {source} GROUP BY 1, 2), {name}_u AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY year ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM {name}_g),
    {name}_a AS (SELECT year, (sum(n * (ab + p / 2.0)) / (sum(p) * sum(n)))::DOUBLE AS auc FROM {name}_u GROUP BY 1),
    {name}_e AS (SELECT year, sum(n * abs(s - l)) / sum(n) AS ece FROM (SELECT year, count(*) AS n, avg({score}) AS s, avg(label) AS l FROM {source} GROUP BY year, least(floor({score} * 10), 9)) GROUP BY 1),
    {name}_r AS (SELECT year, label, {score} AS s, greatest(1e-12, least(1 - 1e-12, {score})) AS q, row_number() OVER w AS k, sum(label) OVER w AS tp, count(*) OVER (PARTITION BY year) AS n, sum(label) OVER (PARTITION BY year) AS pos FROM {source} WINDOW w AS (PARTITION BY year ORDER BY {score} DESC, id)),
    {name}_p AS (SELECT year, count(*) AS n, avg(label) AS positive_rate, avg(tp / k::DOUBLE) FILTER (label = 1) AS average_precision, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss, avg(pow(s - label, 2)) AS brier, (count(*) FILTER (s >= 0.5 AND label = 1)) / (count(*) FILTER (s >= 0.5))::DOUBLE AS "precision",
      (count(*) FILTER (s >= 0.5 AND label = 1)) / max(pos)::DOUBLE AS recall, 2.0::DOUBLE * (count(*) FILTER (s >= 0.5 AND label = 1)) / ((count(*) FILTER (s >= 0.5)) + max(pos)) AS f1, {tops} FROM {name}_r GROUP BY 1),
    {name} AS (SELECT * FROM {name}_p JOIN {name}_a USING (year) JOIN {name}_e USING (year))"""


@query(_L + ", " + _split_sql("m", "v_labeled", "score") + " SELECT year::INTEGER AS year, n, " + ", ".join(f'round({c if c != "precision" else chr(34) + c + chr(34)}, 6) AS {c if c != "precision" else chr(34) + c + chr(34)}' for c in _SPLIT_METRICS) + " FROM m")
def m6_split_metrics(spark, d):
    t = metrics.split_metrics(views.labeled(spark, d), "id", "year")
    return t.select("year", "n", *(F.round(c, 6).alias(c) for c in _SPLIT_METRICS))


@query(
    _L + """, tr AS (SELECT * FROM v_labeled WHERE year <= 1998), r2 AS (SELECT parent, avg(label) AS r FROM tr GROUP BY 1 HAVING count(*) >= 10), r3 AS (SELECT parent, month, avg(label) AS r FROM tr GROUP BY 1, 2 HAVING count(*) >= 10), r1 AS (SELECT month, avg(label) AS r FROM tr GROUP BY 1)
    SELECT id, round(coalesce(r3.r, r2.r, r1.r, (SELECT avg(label) FROM tr)), 6) AS baseline FROM v_labeled v LEFT JOIN r3 ON r3.parent = v.parent AND r3.month = v.month LEFT JOIN r2 ON r2.parent = v.parent LEFT JOIN r1 ON r1.month = v.month WHERE year > 1998"""
)
def a23_baselines(spark, d):
    t = views.labeled(spark, d)
    return metrics.apply_baselines(t.where("year > 1998"), metrics.baseline_rates(t.where("year <= 1998"))).select("id", F.round("baseline", 6).alias("baseline"))


@query(_L + ", r AS (SELECT id, label, row_number() OVER (ORDER BY score DESC, id) - 1 AS a, row_number() OVER (ORDER BY score_b DESC, id) - 1 AS b, count(*) OVER () AS n FROM v_labeled) SELECT id, round((b - a) / (n - 1)::DOUBLE, 6) AS gap FROM r WHERE abs(b - a) / (n - 1)::DOUBLE > 0.5")
def w7_disagreement(spark, d):
    return metrics.disagreement(views.labeled(spark, d), "id", "score", "score_b").select("id", F.round("gap", 6).alias("gap"))


@query(_L + ", r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) <= 2000 AS a, row_number() OVER (ORDER BY score_b DESC, id) <= 2000 AS b FROM v_labeled) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM r WHERE label = 1")
def u2_top_overlap(spark, d):
    return metrics.top_overlap(views.labeled(spark, d), "id", "score", "score_b", 2000)


@query(with_views("v_ignitions") + " SELECT cell, date FROM (SELECT cell, CAST(occurred_at AS DATE) AS date FROM v_ignitions WHERE id % 2 = 0 UNION SELECT cell, CAST(occurred_at AS DATE) FROM v_ignitions WHERE id % 3 = 0)")
def u1_union_distinct(spark, d):
    i = views.ignitions(spark, d).select("id", "cell", F.to_date("occurred_at").alias("date"))
    return i.where("id % 2 = 0").unionByName(i.where("id % 3 = 0")).select("cell", "date").distinct()


@query(with_views("v_ignitions") + " SELECT DISTINCT cell, CAST(occurred_at AS DATE) AS date, cause, commune FROM v_ignitions")
def u3_distinct(spark, d):
    return views.ignitions(spark, d).select("cell", F.to_date("occurred_at").alias("date"), "cause", "commune").dropDuplicates()


@query(with_views("v_ignitions") + " SELECT cell, min(commune) AS code, count(DISTINCT commune) AS claims FROM v_ignitions GROUP BY cell")
def u4_own_cells(spark, d):
    from ..sources.readers import own_cells

    return own_cells(views.ignitions(spark, d).select("cell", F.col("commune").alias("code")))


_STATS = ", o AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM (SELECT 'x1' AS feature, x1 AS v FROM v_labeled UNION ALL SELECT 'x2', x2 FROM v_labeled UNION ALL SELECT 'x3', x3 FROM v_labeled) WHERE v IS NOT NULL) "


@query(_L + _STATS + "SELECT feature, count(*) AS present, (SELECT count(*) FROM v_labeled) - count(*) AS missing, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round(min(v) FILTER (k = floor((n - 1) * 0.05::DOUBLE + 0.5)), 4) AS p05, round(min(v) FILTER (k = floor((n - 1) * 0.5::DOUBLE + 0.5)), 4) AS median, round(min(v) FILTER (k = floor((n - 1) * 0.95::DOUBLE + 0.5)), 4) AS p95 FROM o GROUP BY feature")
def a13_feature_stats(spark, d):
    t = metrics.feature_stats(views.labeled(spark, d), ["x1", "x2", "x3"])
    return t.select("feature", "present", "missing", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "p05", "median", "p95")))


@query(_L + _STATS + ", s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd, min(v) FILTER (k = floor((n - 1) * 0.5::DOUBLE + 0.5)) AS md FROM o GROUP BY feature) SELECT id, round((x1 - (SELECT m FROM s WHERE feature = 'x1')) / (SELECT sd FROM s WHERE feature = 'x1'), 5) AS x1, round(ln(1 + greatest(x2, 0)), 5) AS x2, round(coalesce(x3, (SELECT md FROM s WHERE feature = 'x3')), 5) AS x3 FROM v_labeled")
def m1_impute_normalize(spark, d):
    from ..operators.models import fit_transform, transform

    t = views.labeled(spark, d)
    rules = fit_transform(t, {"x1": "standard", "x2": "log1p", "x3": "none"})
    return transform(t, rules).select("id", *(F.round(c, 5).alias(c) for c in ("x1", "x2", "x3")))


_CANDIDATE = "CASE WHEN year % 2 = 1 THEN label * 0.6::DOUBLE + score * 0.4::DOUBLE ELSE score END"


@query(
    _L + f", w AS (SELECT *, {_CANDIDATE} AS candidate FROM v_labeled), " + _split_sql("c", "w", "candidate") + ", " + _split_sql("o", "w", "score_b")
    + """ SELECT c.year::INTEGER AS year, round(c.average_precision - o.average_precision, 6) AS gain, c.average_precision - o.average_precision >= 0 AND c.auc >= 0.6 AND c.brier <= 0.2 AND c.ece <= 0.1 AND c.lift_10 >= 1.5 AS promoted, c.auc >= 0.52 AS activated FROM c JOIN o USING (year)"""
)
def m13_promotion_gate(spark, d):
    t = views.labeled(spark, d)
    t = t.withColumn("candidate", F.when(_c("year") % 2 == 1, _c("label") * 0.6 + _c("score") * 0.4).otherwise(_c("score")))
    new = metrics.split_metrics(t, "id", "year", "candidate")
    old = metrics.average_precision(t, "id", "score_b", by=["year"]).withColumnRenamed("average_precision", "before")
    gain = new.join(old, "year").withColumn("average_precision_gain", _c("average_precision") - _c("before"))
    return dataset.passes(gain).select("year", F.round("average_precision_gain", 6).alias("gain"), _c("passes").alias("promoted"), (_c("auc") >= dataset.LEAST_TRAINED_AUC).alias("activated"))


@query()
def m2_logistic(spark, d):
    from ..operators import models

    return models.fit_and_score(views.labeled(spark, d), ["x1", "x2"], "logistic")


_STEPS, _RATE, _L2 = 25, 0.3, 0.01


@query(
    _L
    + f""", m AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM v_labeled WHERE year < 1999), t AS (SELECT id, year, label AS y, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2 FROM v_labeled, m),
    g AS (SELECT 0 AS step, 0::DOUBLE AS b, 0::DOUBLE AS w1, 0::DOUBLE AS w2 UNION ALL SELECT step + 1, b - {_RATE}::DOUBLE * avg(1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y), w1 - {_RATE}::DOUBLE * (avg((1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y) * x1) + {_L2}::DOUBLE * w1), w2 - {_RATE}::DOUBLE * (avg((1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y) * x2) + {_L2}::DOUBLE * w2) FROM g, t WHERE t.year < 1999 AND step < {_STEPS} GROUP BY step, b, w1, w2)
    SELECT id, round(1 / (1 + exp(-(b + w1 * x1 + w2 * x2))), 6) AS fitted FROM t, g WHERE step = {_STEPS} AND year >= 1999"""
)
def m2_descent(spark, d):
    from ..operators import models

    t = views.labeled(spark, d)
    t = models.transform(t, models.fit_transform(t.where("year < 1999"), {"x1": "standard", "x2": "standard"}))
    fit = models.fit_descent(t.where("year < 1999"), ["x1", "x2"], _L2, _STEPS, _RATE)
    return models.score_descent(t.where("year >= 1999"), ["x1", "x2"], *fit).select("id", F.round("fitted", 6).alias("fitted"))


@query(
    _L
    + f""", g AS (SELECT 0 AS step, 0::DOUBLE AS b, 0::DOUBLE AS w UNION ALL SELECT step + 1, b - {_RATE}::DOUBLE * avg(1 / (1 + exp(-(b + w * score))) - label), w - {_RATE}::DOUBLE * avg((1 / (1 + exp(-(b + w * score))) - label) * score) FROM g, v_labeled WHERE step < {_STEPS} GROUP BY step, b, w)
    SELECT id, round(1 / (1 + exp(-(b + w * score))), 6) AS calibrated FROM v_labeled, g WHERE step = {_STEPS}"""
)
def m4_platt_descent(spark, d):
    from ..operators import models

    t = views.labeled(spark, d)
    fit = models.fit_descent(t, ["score"], 0.0, _STEPS, _RATE)
    return models.score_descent(t, ["score"], *fit, "calibrated").select("id", F.round("calibrated", 6).alias("calibrated"))


def _boosted_sql(features: list[str], rounds: int, depth: int = 3, rate: float = 0.1, least: int = 20, base: str = "base", at: str = "") -> str:
    """Definitions ``z<rounds>`` (rows with their log-odds ``z``) and ``b<round>_<level>`` (splits ``node, f, v``) of boosted trees over ``base``: ``id, label, train`` and the features. One definition a level: order statistics and sums up to them are windows over a node's rows. ``at`` goes before the names."""
    out = [f"{at}s AS (SELECT sum(label) / count(*)::DOUBLE AS p FROM {base} WHERE train)", f"{at}z0 AS MATERIALIZED (SELECT i.*, ln(p / (1 - p)) AS z FROM {base} i, {at}s)"]
    for k in range(rounds):
        out.append(f"{at}t{k}_0 AS MATERIALIZED (SELECT *, label - 1 / (1 + exp(-z)) AS r, 0 AS node FROM {at}z{k})")
        for level in range(depth):
            t, b = f"{at}t{k}_{level}", f"{at}b{k}_{level}"
            sides = " UNION ALL ".join(f"SELECT node, {f} AS f, d, {c} AS v, cnt, tot, below, s FROM (SELECT node, {c}, row_number() OVER (PARTITION BY node ORDER BY {c}) - 1 AS i, count(*) OVER (PARTITION BY node) AS cnt, sum(r) OVER (PARTITION BY node) AS tot, count(*) OVER (PARTITION BY node ORDER BY {c}) AS below, sum(r) OVER (PARTITION BY node ORDER BY {c}) AS s FROM {t} WHERE train), range(1, 10) x(d) WHERE cnt >= {least} AND i = least(cnt * d // 10, cnt - 1)" for f, c in enumerate(features))
            out.append(f"{b} AS MATERIALIZED (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(s * s / below + (tot - s) * (tot - s) / (cnt - below), 9) DESC, f, d) AS best FROM ({sides}) WHERE below < cnt) WHERE best = 1)")
            value = "CASE b.f " + " ".join(f"WHEN {f} THEN {c}" for f, c in enumerate(features)) + " END"
            out.append(f"{at}t{k}_{level + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN t.node WHEN {value} <= b.v THEN 2 * t.node + 1 ELSE 2 * t.node + 2 END AS node FROM {t} t LEFT JOIN {b} b ON b.node = t.node)")
        leaves = f"{at}t{k}_{depth}"
        out.append(f"{at}z{k + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node, r, z), z + {rate}::DOUBLE * l.v AS z FROM {leaves} t JOIN (SELECT node, sum(r) / count(*) AS v FROM {leaves} WHERE train GROUP BY node) l ON l.node = t.node)")
    return ", ".join(out)


@query(_L + ", base AS (SELECT id, label, year < 1999 AS train, x1, x2 FROM v_labeled), " + _boosted_sql(["x1", "x2"], 10) + " SELECT id, label, round(1 / (1 + exp(-z)), 6) AS fitted FROM z10 WHERE NOT train")
def m3_boosted_trees(spark, d):
    from ..operators import models

    return models.fit_and_score(views.labeled(spark, d), ["x1", "x2"], "trees").withColumn("fitted", F.round("fitted", 6))


@query()
def m4_platt(spark, d):
    from ..operators import models

    return models.platt(views.labeled(spark, d)).select("id", "calibrated")


@query(
    _L
    + """, g AS (SELECT score AS x, sum(label)::DOUBLE AS s, count(*)::DOUBLE AS w FROM v_labeled GROUP BY 1), p AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS hs, sum(w) OVER (ORDER BY x) AS hw, sum(s) OVER (ORDER BY x) - s AS ls, sum(w) OVER (ORDER BY x) - w AS lw FROM g),
    m AS (SELECT a.i AS a, b.i AS i, b.x, min((b.hs - a.ls) / (b.hw - a.lw)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM p a JOIN p b ON b.i >= a.i), v AS (SELECT x, round(max(least), 9) AS value FROM m GROUP BY x) SELECT max(x) AS x_max, value FROM v GROUP BY value"""
)
def m5_isotonic(spark, d):
    return metrics.isotonic_blocks(views.labeled(spark, d)).select("x_max", F.round("value", 9).alias("value"))


@query()
def m7_forward_cv(spark, d):
    from ..operators import models

    return models.forward_cv(views.labeled(spark, d), ["x1", "x2"], [1997, 1998, 1999], [0.0, 0.001, 0.01, 0.1])


def _measured_sql(scored: str, by: str) -> str:
    """``mt``: ``by``, ROC AUC, Brier score, log-loss and calibration error of ``scored``: ``by, y, s``."""
    return f"""mp AS MATERIALIZED (SELECT {by}, y, s FROM {scored}), mg AS (SELECT {by}, s, sum(y) AS p, sum(1 - y) AS n FROM mp GROUP BY {by}, s),
    mu AS (SELECT {by}, p, n, coalesce(sum(p) OVER (PARTITION BY {by} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM mg), ma AS (SELECT {by}, coalesce(sum(n * (ab + p / 2.0)) / nullif(sum(p) * sum(n), 0), 0.5)::DOUBLE AS auc FROM mu GROUP BY {by}),
    mc AS (SELECT {by}, sum(n * abs(ms - l)) / sum(n) AS ece FROM (SELECT {by}, count(*) AS n, avg(s) AS ms, avg(y) AS l FROM mp GROUP BY {by}, least(floor(s * 10), 9)) GROUP BY {by}),
    mt AS (SELECT * FROM (SELECT {by}, avg(pow(s - y, 2)) AS brier, avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, s))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, s))))) AS log_loss FROM mp GROUP BY {by}) JOIN ma USING ({by}) JOIN mc USING ({by}))"""


def _descended_sql(rows: str, parts: str) -> str:
    """``mt`` by ``k, l2`` of descents: ``rows`` gives ``k, l2, held, w, y, x1, x2`` (a weight; not standardised), of ``parts``: ``k, l2``."""
    e = "w * (1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y)"
    return (
        f"""dp AS (SELECT k, l2::DOUBLE AS l2 FROM {parts}), dr AS ({rows}), ds AS (SELECT k, l2, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM dr WHERE NOT held GROUP BY 1, 2),
    dt AS (SELECT k, l2, held, w, y, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2 FROM dr JOIN ds USING (k, l2)),
    dg AS (SELECT k, l2, 0 AS step, 0::DOUBLE AS b, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM dp UNION ALL SELECT k, l2, step + 1, b - {_RATE}::DOUBLE * sum({e}) / sum(w), w1 - {_RATE}::DOUBLE * (sum({e} * x1) / sum(w) + l2 * w1), w2 - {_RATE}::DOUBLE * (sum({e} * x2) / sum(w) + l2 * w2) FROM dg JOIN dt USING (k, l2) WHERE NOT held AND step < {_STEPS} GROUP BY k, l2, step, b, w1, w2),
    dh AS (SELECT k, l2, y, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) AS s FROM dg JOIN dt USING (k, l2) WHERE held AND step = {_STEPS}), """
        + _measured_sql("dh", "k, l2")
    )


_PENALTIES = [0.001, 0.01, 0.1, 1.0]
_FORWARD = (
    _L + ", " + _descended_sql(
        "SELECT k, l2, year = k AS held, 1::DOUBLE AS w, label AS y, x1, x2 FROM v_labeled JOIN dp ON year <= k",
        "(SELECT unnest([1997, 1998, 1999]) AS k) CROSS JOIN (SELECT unnest(" + str(_PENALTIES) + ") AS l2)",
    )
)


@query(_FORWARD + " SELECT k::INTEGER AS year, l2, round(auc, 6) AS auc, round(brier, 6) AS brier FROM mt")
def m7_forward_descent(spark, d):
    return _forward(spark, d).select("year", "l2", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


def _forward(spark, d):
    from ..operators.models import forward_cv

    return forward_cv(views.labeled(spark, d), ["x1", "x2"], [1997, 1998, 1999], _PENALTIES, _STEPS)


@query(_FORWARD + " SELECT l2, round(avg(round(auc, 9)), 6) AS auc, count(*) AS years FROM mt GROUP BY l2 ORDER BY avg(round(auc, 9)) DESC, l2 LIMIT 1")
def m7_choose_penalty(spark, d):
    from ..operators.models import choose

    return choose(_forward(spark, d).withColumn("auc", F.round("auc", 9)), ["l2"]).withColumn("auc", F.round("auc", 6))


_GRID = [(3, 2, 0.1), (3, 3, 0.1)]
_BOOSTED_PARTS = [(y, *g, f"q{y}_{g[1]}_") for y in (1998, 1999) for g in _GRID]
_BOOSTED_CV = (
    _L + ", " + ", ".join(f"base{y} AS (SELECT id, label, year, year < {y} AS train, x1, x2 FROM v_labeled WHERE year <= {y})" for y in (1998, 1999))
    + ", " + ", ".join(_boosted_sql(["x1", "x2"], n, depth, rate, base=f"base{y}", at=at) for y, n, depth, rate, at in _BOOSTED_PARTS)
    + ", mh AS (" + " UNION ALL ".join(f"SELECT {y} AS year, {n} AS rounds, {depth} AS depth, {rate}::DOUBLE AS rate, label AS y, round(1 / (1 + exp(-z)), 12) AS s FROM {at}z{n} WHERE NOT train" for y, n, depth, rate, at in _BOOSTED_PARTS) + "), "
    + _measured_sql("mh", "year, rounds, depth, rate")
)


@query(_BOOSTED_CV + " SELECT rounds, depth, rate, round(avg(round(auc, 9)), 6) AS auc, count(*) AS years FROM mt GROUP BY 1, 2, 3 ORDER BY avg(round(auc, 9)) DESC, 1, 2, 3 LIMIT 1")
def m7_choose_trees(spark, d):
    from ..operators.models import choose, forward_cv_boosted

    cv = forward_cv_boosted(views.labeled(spark, d), ["x1", "x2"], [1998, 1999], _GRID)
    return choose(cv.withColumn("auc", F.round("auc", 9)), ["rounds", "depth", "rate"]).withColumn("auc", F.round("auc", 6))


_ROUNDS = (
    _L
    + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS no FROM (SELECT DISTINCT date FROM v_labeled)), dr AS (SELECT r, ('0x' || substr(md5('11|' || r || '|' || no), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS no FROM d, (SELECT unnest(range(0, 200)) AS r)),
    w AS (SELECT r, date, count(*) AS w FROM dr JOIN d USING (no) GROUP BY 1, 2), t AS (SELECT date, label, 'a' AS name, score AS v FROM v_labeled UNION ALL SELECT date, label, 'b', score_b FROM v_labeled),
    c AS (SELECT date, name, floor(v * 1000 + 0.5) AS s, sum(label) AS p, sum(1 - label) AS n, sum(pow(v - label, 2)) AS e FROM t GROUP BY 1, 2, 3), x AS (SELECT r, name, s, sum(w * p)::BIGINT AS p, sum(w * n)::BIGINT AS n, sum(w * e) AS e FROM c JOIN w USING (date) GROUP BY 1, 2, 3),
    y AS (SELECT *, coalesce(sum(p) OVER o, 0)::BIGINT AS ap, coalesce(sum(n) OVER o, 0)::BIGINT AS an FROM x WINDOW o AS (PARTITION BY r, name ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT r, name, sum(n * (ap + p / 2.0::DOUBLE)) / (sum(p) * sum(n))::DOUBLE AS auc, sum(p * CASE WHEN ap + p + an + n > 0 THEN (ap + p)::DOUBLE / (ap + p + an + n) ELSE 0 END) / sum(p)::DOUBLE AS average_precision, sum(e) / (sum(p) + sum(n)) AS brier FROM y GROUP BY 1, 2) """
)


def _interval_sql(source: str) -> str:
    return "SELECT " + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{name}" for m in metrics.BOOTSTRAPPED for q, name in ((0.025, "low"), (0.975, "high"))) + f" FROM {source}"


def _interval(rounds):
    t = metrics.interval(rounds, metrics.BOOTSTRAPPED)
    return t.select(*(F.round(c, 6).alias(c) for c in t.columns))


@query(_ROUNDS + _interval_sql("z WHERE name = 'a'"))
def m8_bootstrap(spark, d):
    return _interval(metrics.bootstrap(views.labeled(spark, d), ["score"]))


@query(_ROUNDS + ", df AS (SELECT " + ", ".join(f"a.{m} - b.{m} AS {m}" for m in metrics.BOOTSTRAPPED) + " FROM z a JOIN z b USING (r) WHERE a.name = 'a' AND b.name = 'b') " + _interval_sql("df"))
def m9_paired_bootstrap(spark, d):
    return _interval(metrics.differences(metrics.bootstrap(views.labeled(spark, d), ["score", "score_b"]), "score", "score_b"))


@query()
def m10_spatial_cv(spark, d):
    from ..operators.models import spatial_cv

    return spatial_cv(views.labeled(spark, d), ["x1", "x2"])


@query(
    _L + ", " + _descended_sql("SELECT k, l2, parent % 5 = k AS held, 1::DOUBLE AS w, label AS y, x1, x2 FROM v_labeled, dp", "(SELECT unnest(range(5)) AS k, 0.01 AS l2)")
    + " SELECT k::INTEGER AS fold, round(auc, 6) AS auc, round(brier, 6) AS brier FROM mt"
)
def m10_spatial_descent(spark, d):
    from ..operators.models import spatial_cv

    return spatial_cv(views.labeled(spark, d), ["x1", "x2"], steps=_STEPS).select("fold", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


@query()
def m11_importances(spark, d):
    from ..operators import models

    return models.feature_importances(views.labeled(spark, d).where("year < 1999"), ["x1", "x2", "x3"])


@query(
    _L + ", base AS (SELECT id, label, true AS train, x1, x2, coalesce(x3, 11) AS x3 FROM v_labeled WHERE year < 1999), " + _boosted_sql(["x1", "x2", "x3"], 4)
    + " SELECT ['x1', 'x2', 'x3'][f + 1] AS feature, count(*) AS splits FROM (" + " UNION ALL ".join(f"SELECT f FROM b{k}_{level}" for k in range(4) for level in range(3)) + ") GROUP BY 1"
)
def m11_split_counts(spark, d):
    from ..operators.boosting import fit_boosted, split_counts

    t = views.labeled(spark, d).where("year < 1999").withColumn("x3", F.coalesce("x3", F.lit(11.0)))
    counts = split_counts(fit_boosted(t, ["x1", "x2", "x3"], rounds=4))
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "feature string, splits long")


@query()
def m11_weighting(spark, d):
    from ..operators.models import compare_weighting

    t = views.labeled(spark, d)
    return compare_weighting(t.where("year < 1998"), t.where("year = 1998"), ["x1", "x2"])


@query(
    _L + ", c AS (SELECT greatest(1, round(sum(1 - label) / sum(label)))::DOUBLE AS n FROM v_labeled WHERE year < 1998), "
    + _descended_sql("SELECT k, l2, year = 1998 AS held, CASE WHEN k = 'class' AND label = 1 THEN n ELSE 1::DOUBLE END AS w, label AS y, x1, x2 FROM v_labeled, c, dp WHERE year <= 1998", "(SELECT unnest(['none', 'class']) AS k, 0.01 AS l2)")
    + " SELECT k AS weighting, round(auc, 6) AS auc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece FROM mt"
)
def m11_weighting_descent(spark, d):
    from ..operators.models import compare_weighting

    t = views.labeled(spark, d)
    out = compare_weighting(t.where("year < 1998"), t.where("year = 1998"), ["x1", "x2"], steps=_STEPS)
    return out.select("weighting", *(F.round(m, 6).alias(m) for m in ("auc", "brier", "log_loss", "ece")))


@query(_L + " SELECT greatest(1, round(sum(1 - label) / sum(label)))::BIGINT AS repeats FROM v_labeled WHERE year < 1998")
def m11_repeats(spark, d):
    from ..operators.models import repeats

    return repeats(views.labeled(spark, d).where("year < 1998"))


@query(_L + " SELECT fold::INTEGER AS fold, count(*) AS rows, sum(label)::BIGINT AS positives FROM (SELECT parent % 5 AS fold, label FROM v_labeled) GROUP BY 1")
def m10_spatial_folds(spark, d):
    from ..operators.models import spatial_fold

    return views.labeled(spark, d).groupBy(spatial_fold(_c("parent")).alias("fold")).agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))


@query(_L + " SELECT label, round((SELECT count(*) FROM v_labeled) / (2.0 * count(*)), 6) AS weight FROM v_labeled GROUP BY label")
def m11_class_weights(spark, d):
    from ..operators.models import class_weights

    return class_weights(views.labeled(spark, d)).select("label", F.round("weight", 6).alias("weight"))


_ARTIFACT = {
    "features": ["x1", "x3"], "fill": {"x1": 0.0, "x3": 11.0}, "start": -1.0, "rate": 0.5,
    "trees": [{"feature": 0, "threshold": 4000.0, "left": {"value": 0.4}, "right": {"feature": 1, "threshold": 10.0, "left": {"value": -0.2}, "right": {"value": 0.9}}}, {"feature": 1, "threshold": 5.0, "left": {"value": 0.1}, "right": {"value": -0.3}}],
    "calibrator": [(0.25, 0.1), (0.3, 0.2), (0.4, 0.45)],
}


@query(_L + """, r AS (SELECT id, 1 / (1 + exp(-(-1 + 0.5 * CASE WHEN x1 <= 4000 THEN 0.4 WHEN coalesce(x3, 11) <= 10 THEN -0.2 ELSE 0.9 END + 0.5 * CASE WHEN coalesce(x3, 11) <= 5 THEN 0.1 ELSE -0.3 END)::DOUBLE)) AS raw FROM v_labeled) SELECT id, round(raw, 6) AS raw, CASE WHEN raw <= 0.25 THEN 0.1::DOUBLE WHEN raw <= 0.3 THEN 0.2::DOUBLE ELSE 0.45::DOUBLE END AS calibrated FROM r""")
def r8_score_artifact(spark, d):
    return scoring.score_artifact(views.labeled(spark, d), _ARTIFACT).select("id", F.round("raw_score", 6).alias("raw"), "calibrated")


@query(_L + " SELECT count(*) AS rows, count(*) FILTER (id % 10 = 0) AS mismatches FROM v_labeled")
def m14_scoring_parity(spark, d):
    t = views.labeled(spark, d)
    b = t.withColumn("score", F.when(_c("id") % 10 == 0, _c("score") + 1e-6).otherwise(_c("score")))
    return scoring.scoring_parity(t, b, "id").select("rows", "mismatches")



@query(
    _PAIRED
    + f""", e AS (SELECT *, 40 + lat_m / 8 AS lat, 1 + lon_m / 8 AS lon FROM v_ignitions), st AS (SELECT lat, lon, count(*) AS n, count(DISTINCT commune) AS m, count(DISTINCT year(occurred_at)) AS y FROM e GROUP BY 1, 2)
    SELECT 'cause' AS kind, cause AS name, count(*) AS n FROM v_ignitions GROUP BY 2
    UNION ALL SELECT 'classification', classification, 2 * count(*) FROM k WHERE classification IN ('certain_duplicate', 'probable_duplicate', 'possible_duplicate') GROUP BY 2
    UNION ALL SELECT 'category', CASE WHEN id % 17 = 0 THEN 'municipality_centroid_confirmed' WHEN {_PROBABLE} THEN 'municipality_centroid_probable' ELSE 'rounded_coordinate_probable' END, count(*) FROM e JOIN st USING (lat, lon) GROUP BY 2
    UNION ALL SELECT 'combustibility', CASE WHEN id % 19 = 0 THEN 'features_missing' WHEN id % 3 = 0 THEN 'combustible' ELSE 'non_combustible' END, count(*) FROM v_ignitions GROUP BY 2
    UNION ALL SELECT 'total', 'events', count(*) FROM v_ignitions UNION ALL SELECT 'total', 'coordinate_groups', count(*) FROM st WHERE n > 1 UNION ALL SELECT 'total', 'duplicate_pairs', count(*) FROM k"""
)
def a15_quality_summary(spark, d):
    from ..operators.reads import quality_summary

    burns = views.ignitions(spark, d).select(F.when(_c("id") % 19 != 0, _c("id") % 3 == 0).alias("combustible"))
    return quality_summary(_placed(spark, d), quality.duplicate_classes(_audited(spark, d)), _geography(spark, d).select("g.category"), burns)


@query(
    _POS
    + """, r AS (SELECT CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) = 1999 THEN 'validation' ELSE 'test' END AS split, 1 AS label FROM pos WHERE strict UNION ALL SELECT CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) = 1999 THEN 'validation' ELSE 'test' END, 0 FROM pos WHERE id % 3 = 0)
    SELECT 'rows' AS kind, split AS name, label, count(*) AS n FROM r GROUP BY 2, 3 UNION ALL SELECT 'exclusions', CASE WHEN NOT combustible THEN 'non_combustible_cell' ELSE 'insufficient_geographic_quality' END, NULL, count(*) FROM pos WHERE NOT combustible OR low_geo_confidence GROUP BY 2
    UNION ALL SELECT 'builds', 'builds', NULL, count(DISTINCT commune) FROM v_ignitions"""
)
def a16_dataset_detail(spark, d):
    from ..operators.reads import dataset_detail

    p = _positives(spark, d)
    split = F.when(F.year("date") <= 1998, "train").when(F.year("date") == 1999, "validation").otherwise("test").alias("split")
    rows = p.where("strict").select(split, F.lit(1).alias("label")).unionByName(p.where("id % 3 = 0").select(split, F.lit(0).alias("label")))
    strict = {"non_combustible_cell": ~_c("combustible"), "insufficient_geographic_quality": _c("low_geo_confidence")}
    left_out = p.select(dataset.exclusion_reason(strict, dataset.STRICT).alias("reason")).where("reason is not null")
    return dataset_detail(rows, left_out, views.ignitions(spark, d).select("commune").distinct())
