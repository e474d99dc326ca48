"""Invariants of writes, guards and joins."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid import views
from firegrid.functions import grid
from firegrid.operators import dataset, metrics, quality, spatial
from firegrid.sources import readers, sinks


def test_insert_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        sinks.insert_new(df, str(tmp_path / "t"), ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a"), (2, "c")]


def test_cells_cache_checks_resolution(spark, tmp_path, sf_dir):
    c = views.cells(spark, sf_dir).select("cell", "road")
    sinks.write_cells(c, str(tmp_path / "c"))
    assert sinks.read_cells(spark, str(tmp_path / "c"), c.schema, 8).count() == c.count()
    with pytest.raises(Exception, match="another resolution"):
        sinks.read_cells(spark, str(tmp_path / "c"), c.schema, 9).count()


def test_changed_definition_and_finalized_versions_are_refused(spark):
    m = spark.createDataFrame([("v1", "draft"), ("v2", "finalized")], "logical_id string, status string").withColumn("definition_hash", F.sha2(F.lit("a"), 256))
    assert sinks.dataset_version(m, "v1", "a").first()["status"] == "draft"
    for name, definition in (("v1", "b"), ("v2", "a")):
        with pytest.raises(Exception, match="definition has changed|finalized"):
            sinks.dataset_version(m, name, definition).collect()


def test_bad_hourly_arrays_are_refused(spark):
    df = spark.sql("select 1 as loc, array(1, 2) as time, array(1.0) as temp, array(1.0, 2.0) as rh, array(1.0, 2.0) as wind, array(1.0, 2.0) as rain")
    with pytest.raises(Exception, match="differ in length"):
        readers.normalize_hourly_forecast(df).collect()


def test_wider_windows_exclude_more(spark, sf_dir):
    from firegrid.queries.joins import _candidates, _events

    left = [spatial.exclude_near(_candidates(spark, sf_dir), _events(spark, sf_dir), s).count() for s in ("N0", "N1", "N2")]
    assert left[0] >= left[1] >= left[2]


def test_isotonic_is_monotone_and_steps(spark):
    df = spark.range(500).select((F.col("id") / 500.0).alias("score"), ((F.col("id") * 7 % 500) < F.col("id")).cast("int").alias("label"))
    blocks = sorted((r["x_max"], r["value"]) for r in metrics.isotonic_blocks(df).collect())
    assert all(a[1] < b[1] for a, b in zip(blocks, blocks[1:], strict=False))
    got = metrics.apply_isotonic(spark.createDataFrame([(blocks[0][0],), (99.0,)], "score double"), blocks).collect()
    assert [r["calibrated"] for r in got] == [blocks[0][1], blocks[-1][1]]


def test_one_class_and_empty_inputs(spark):
    df = spark.createDataFrame([(0.1, 1, 1), (0.2, 1, 2)], "score double, label int, id int")
    assert metrics.roc_auc(df).first()["auc"] == 0.5
    assert metrics.average_precision(df.limit(0), "id").first()["average_precision"] == 0.0


def test_projection_round_trip(spark):
    p = spark.range(400).select((36 + F.col("id") % 20).cast("double").alias("lat"), (-5 + F.col("id") / 25.0).alias("lon"))
    lat, lon = grid.laea_inverse(*grid.laea_forward(F.col("lat"), F.col("lon")))
    worst = p.select(F.max(F.greatest(F.abs(lat - F.col("lat")), F.abs(lon - F.col("lon"))))).first()[0]
    assert worst < 1e-7


def test_territory_owns_each_cell_once(spark):
    ring = lambda x: [(x, 0.0), (x + 9000.0, 0.0), (x + 9000.0, 9000.0), (x, 9000.0), (x, 0.0)]
    f = spark.createDataFrame([("02", ring(0.0)), ("01", ring(4000.0))], "code string, ring array<struct<x:double,y:double>>")
    cells, missing = readers.load_territory(f, ["01", "02", "77"])
    assert cells.count() == cells.select("cell").distinct().count() > 50
    assert {r["code"] for r in cells.where("claims = 2").collect()} == {"01"}
    assert [r["code"] for r in missing.collect()] == ["77"]


def test_controls_wrap_within_the_interval(spark):
    days, first = 60, datetime.date(1996, 1, 1)
    rng = random.Random(3)
    busy = {c: {k for k in range(days) if rng.random() < 0.9} for c in range(30)}
    busy |= {100: set(range(days)), 101: set(range(days)) - {5}, 102: set(range(days)) - {59}, 103: set(range(40)), 104: set(range(20, 60)), 105: {-1, 60, 61}, 106: set(range(days)) - {0}}
    rows = [(c, first + datetime.timedelta(days=k), "natural") for c, ks in busy.items() for k in ks]
    cells = spark.createDataFrame([(c, True) for c in (*busy, 200)], "cell long, combustible boolean")
    got = dataset.training_sample(spark.createDataFrame(rows, "cell long, date date, category string"), cells, "1996-01-01", days, "8").collect()
    want = {}
    for c in (*busy, 200):
        at = int(hashlib.md5(f"8|{c}".encode()).hexdigest()[:7], 16) % days
        free = [k for k in [*range(at, days), *range(at)] if k not in busy.get(c, ())]
        if free:
            want[c] = first + datetime.timedelta(days=free[0])
    assert {r["cell"]: r["date"] for r in got} == want and len(got) == len(want) and 100 not in want


def test_negatives_are_drawn_until_enough(spark):
    days, first = 40, datetime.date(1996, 1, 1)
    cells = spark.createDataFrame([(8 * 2**52 + (2**25 + 9 * k) * 2**26 + 2**25, True) for k in range(25)], "cell long, combustible boolean")
    known = cells.crossJoin(spark.range(days)).where("pmod(hash(cell, id), 10) > 0").select("cell", F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    none = known.limit(0).select("cell", "date", F.lit(1).alias("event"), F.lit("").alias("category"))
    t = dataset.sample_negatives(cells, none, known, "N2", "1996-01-01", days, 30, 9)
    assert t.count() == 30 and t.join(known, ["cell", "date"], "left_semi").count() == 0
    everything = cells.crossJoin(spark.range(days)).select("cell", F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    with pytest.warns(UserWarning, match="0 of 30 negatives found in 1200 draws"):
        assert dataset.sample_negatives(cells, none, everything, "N2", "1996-01-01", days, 30, 9).count() == 0


def test_nearest_by_blocks_equals_search_in_an_array(spark):
    rng = random.Random(4)
    cells = spark.createDataFrame([(k, rng.randrange(-40, 40), rng.randrange(-40, 40)) for k in range(300)] + [(900, 5000, -3), (901, 3, 3)], "cell long, q long, r long")
    points = spark.createDataFrame([(k, rng.randrange(-50, 50), rng.randrange(-50, 50), float(k)) for k in range(80)] + [(99, 3, 3, 0.0)], "station long, sq long, sr long, temp double")
    key = lambda df: sorted((r["cell"], round(r["distance"], 9), r["station"], r["temp"]) for r in df.collect())
    for k in (1, 4, 100):
        one = key(spatial.nearest(cells, points, k))
        assert one == key(spatial.nearest(cells, points, k, most=10)) and len(one) == 302 * min(k, 81)
    far = sorted(points.collect(), key=lambda p: ((5000 - p["sq"]) ** 2 + (5000 - p["sq"]) * (-3 - p["sr"]) + (-3 - p["sr"]) ** 2, p["station"]))
    assert [s for c, _, s, _ in key(spatial.nearest(cells, points, 4, most=10)) if c == 900] == [p["station"] for p in far[:4]]
    assert spatial.nearest(cells, points.limit(0), 4).count() == spatial.nearest(cells.limit(0), points, 4, most=10).count() == 0


def test_all_stations_in_slices_give_the_same_weather(spark):
    cells = spark.createDataFrame([(k, k % 7, k // 7) for k in range(60)], "cell long, q long, r long")
    points = spark.createDataFrame([(k, k * 5 % 11, k * 3 % 9, None if k % 4 == 0 else float(k), 1.0 * k) for k in range(30)], "station long, sq long, sr long, temp double, rain double")
    of = lambda df: {r["cell"]: (r["temp"], r["rain"]) for r in df.collect()}
    whole, sliced = of(spatial.idw_all(cells, points, ["temp", "rain"])), of(spatial.idw_all(cells, points, ["temp", "rain"], most=4))
    pairs = cells.crossJoin(points).withColumn("distance", spatial.axial_length(F.col("q") - F.col("sq"), F.col("r") - F.col("sr")))
    plain = of(spatial.idw(pairs, "cell", ["temp", "rain"]))
    for c, values in plain.items():
        assert values == pytest.approx(whole[c], nan_ok=True) and values == pytest.approx(sliced[c], nan_ok=True)


@pytest.mark.parametrize("strategy", ["N0", "N1", "N2", "N3"])
def test_windows_by_blocks_match_brute_force(spark, strategy):
    rng = random.Random(strategy)
    first, half = datetime.date(1969, 12, 20), 2**25
    cell = lambda q, r, level=8: level * 2**52 + (q + half) * 2**26 + r + half
    at = lambda: (rng.randrange(-20, 20), rng.randrange(-20, 20), rng.randrange(30))
    names = [*spatial.ADAPTIVE, "other"]
    events = [(*at(), rng.choice(names)) for _ in range(60)]
    wanted = [at() for _ in range(500)]
    day = lambda k: first + datetime.timedelta(days=k)
    e = spark.createDataFrame([(k, cell(q, r), day(t), n) for k, (q, r, t, n) in enumerate(events)], "event long, cell long, date date, category string")
    c = spark.createDataFrame([(k, cell(q, r), day(t)) for k, (q, r, t) in enumerate(wanted)] + [(9000, cell(events[0][0], events[0][1], 7), day(events[0][2])), (9001, None, None)], "key long, cell long, date date")
    reach = lambda n: spatial.WINDOWS.get(strategy) or spatial.ADAPTIVE.get(n, spatial.ADAPTIVE_DEFAULT)
    far = lambda a, b, x, y: max(abs(a - x), abs(b - y), abs(a - x + b - y))
    hits = {(k, j) for k, (q, r, t) in enumerate(wanted) for j, (x, y, u, n) in enumerate(events) if far(q, r, x, y) <= reach(n)[0] and abs(t - u) <= reach(n)[1]}
    assert {r["key"] for r in spatial.exclude_near(c, e, strategy).collect()} == ({*range(500)} | {9000, 9001}) - {k for k, _ in hits}
    found = [(r["key"], r["event"]) for r in spatial.near_events(c, e, strategy, ["event"]).collect()]
    assert sorted(found) == sorted(hits)


def test_covered_box_holds_the_cells_of_all_its_points(spark):
    rng = random.Random(9)
    boxes = [(2.0, 43.0, 2.03, 43.02), (-4.9, 48.1, -4.89, 48.11), (9.0, 41.4, 9.15, 41.46)]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "box long, west double, south double, east double, north double")
    cover = {(r["box"], r["cell"]) for r in grid.cells_for_bbox(df, 8).collect()}
    points = spark.createDataFrame([(k, rng.uniform(s, n), rng.uniform(w, e)) for k, (w, s, e, n) in enumerate(boxes) for _ in range(1500)], "box long, lat double, lon double")
    hit = {tuple(r) for r in points.select("box", grid.cell_of(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct().collect()}
    assert hit <= cover and len(cover) <= 1.5 * len(hit) + 12
    centre = spark.createDataFrame(sorted(cover), "box long, cell long").select("box", *(c.alias(n) for c, n in zip(grid.cell_center(F.col("cell")), ("lat", "lon"), strict=True)))
    for r in centre.collect():
        w, s, e, n = boxes[r["box"]]
        assert w - 0.012 <= r["lon"] <= e + 0.012 and s - 0.009 <= r["lat"] <= n + 0.009


def test_outline_of_a_cell_surrounds_its_centre_and_area(spark):
    c = spark.createDataFrame([(43.2, 2.1), (48.9, -3.0)], "lat double, lon double").select(grid.cell_of(F.col("lat"), F.col("lon"), 8).alias("cell"))
    for r in c.select(F.transform(grid.cell_ring(F.col("cell")), lambda p: F.struct(*(v.alias(n) for v, n in zip(grid.laea_forward(p["lat"], p["lon"]), "xy", strict=True)))).alias("ring"), *(v.alias(n) for v, n in zip(grid.cell_xy(F.col("cell")), "xy", strict=True))).collect():
        ring = [(p["x"], p["y"]) for p in r["ring"]]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        assert ring[0] == ring[-1] and area == pytest.approx(grid.AREA_8, rel=1e-6)
        assert all(((x - r["x"]) ** 2 + (y - r["y"]) ** 2) ** 0.5 == pytest.approx(grid.edge_m(8), abs=0.05) for x, y in ring)  # the inverse is a series, good to about a centimetre


def broken(df):
    return df.withColumn("v", F.when(F.col("id") == 9, F.raise_error(F.lit("broken")).cast("int")).otherwise(2))


def test_failed_attempts_leave_what_was_published(spark, tmp_path):
    path, manifest = str(tmp_path / "batches"), str(tmp_path / "manifest")
    df = spark.range(10).withColumn("v", F.lit(1))
    read = lambda: sorted((r["batch"], r["id"], r["v"]) for r in sinks.read_published(spark, path, manifest).collect())
    for _ in range(3):
        sinks.publish_batch(df, path, manifest, "001")
    want = [("001", k, 1) for k in range(10)]
    assert read() == want
    for batch in ("b", "001"):  # a new batch, and one that has been published
        with pytest.raises(Exception, match="broken"):
            sinks.publish_batch(broken(df), path, manifest, batch)
        assert read() == want and len(list((tmp_path / "batches").iterdir())) == 3
    df.where("id < 4").withColumn("batch", F.lit("001")).write.partitionBy("batch").parquet(f"{path}/attempt=torn")  # died before its manifest row
    assert read() == want
    sinks.publish_batch(df.where("id < 2").withColumn("v", F.lit(5)), path, manifest, "001")
    assert read() == [("001", 0, 5), ("001", 1, 5)]
    assert sinks.sweep_attempts(spark, path, manifest) == 4 and read() == [("001", 0, 5), ("001", 1, 5)]


def test_upserts_touch_their_batches_only(spark, tmp_path):
    path, manifest = str(tmp_path / "rows"), str(tmp_path / "manifest")
    df = spark.range(30).select(F.col("id").alias("key"), F.concat(F.lit("b"), F.col("id") % 3).alias("batch"), F.lit(1).alias("version"))
    sinks.upsert_published(df, path, manifest, ["key"], "version")
    old = {r["batch"]: r["attempt"] for r in sinks.live_attempts(spark, manifest).collect()}
    new = spark.createDataFrame([(4, "b1", 2), (100, "b1", 1), (4, "b1", 3)], "key long, batch string, version int")
    sinks.upsert_published(new, path, manifest, ["key"], "version")
    got = {(r["key"], r["batch"]): r["version"] for r in sinks.read_published(spark, path, manifest).collect()}
    assert got == {(k, f"b{k % 3}"): 1 for k in range(30)} | {(4, "b1"): 3, (100, "b1"): 1}
    now = {r["batch"]: r["attempt"] for r in sinks.live_attempts(spark, manifest).collect()}
    assert now["b1"] != old["b1"] and all(now[b] == old[b] for b in ("b0", "b2"))
    with pytest.raises(Exception, match="broken"):
        sinks.upsert_published(new.withColumn("version", F.raise_error(F.lit("broken")).cast("int")), path, manifest, ["key"], "version")
    assert {r["batch"]: r["attempt"] for r in sinks.live_attempts(spark, manifest).collect()} == now


def test_reactive_cases_do_not_depend_on_batches(spark, tmp_path, sf_dir):
    from firegrid.operators.bulletin import reactive_cases, signal_windows
    from firegrid.streaming import jobs

    o = views.observations(spark, sf_dir).where("event_id % 3 = 0")
    want = sorted(tuple(r) for r in reactive_cases(signal_windows(o), 2).select("commune", "first_at", "daily_rank").collect())
    for parts in (1, 3):
        src, out = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        o.repartition(parts).write.parquet(src)
        s = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.stream_reactive_cases(jobs.stream_signal_windows(s, "60 days"), 2, out, f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        assert sorted(tuple(r) for r in jobs.read_reactive_cases(spark, out).select("commune", "first_at", "daily_rank").collect()) == want


def test_ranked_metrics_with_crowded_scores(spark):
    rng = random.Random(2)
    rows = [(k, 0.0 if k % 3 else rng.random() ** 9 / 1000, int(rng.random() < 0.3)) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    pos = sum(r[2] for r in rows)
    tp = ap = 0
    for k, r in enumerate(order, 1):
        tp += r[2]
        ap += r[2] * tp / k
    wins = sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows if a[2] for b in rows if not b[2])
    assert metrics.average_precision(df, "id").first()[0] == pytest.approx(ap / pos)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(wins / (pos * (900 - pos)))
    top = {r["fraction"]: r for r in metrics.at_top(df, "id", (0.001, 0.1)).collect()}
    assert top[0.1]["k"] == 90 and top[0.1]["precision"] == pytest.approx(sum(r[2] for r in order[:90]) / 90) and top[0.001]["k"] == 1
    assert metrics.at_top(df.withColumn("label", F.lit(0)), "id", (0.1,)).first()["recall"] == 0


def test_fingerprint_of_a_table(spark):
    from firegrid.functions.text import fingerprint

    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("c"))
    same = fingerprint(df, "id", "c").first()
    assert fingerprint(df.repartition(7).orderBy(F.desc("c")), "id", "c").first() == same
    for other in (df.where("id <> 3"), df.unionByName(df.where("id = 3")), df.withColumn("c", F.when(F.col("id") == 3, "x").otherwise(F.col("c")))):
        assert fingerprint(other, "id", "c").first() != same
    assert fingerprint(df.limit(0), "id", "c").first()["rows"] == 0


def test_exclusion_reasons_take_precedence_and_unknown_ones_are_refused(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    r = spark.range(1).select(dataset.exclusion_reason({"out_of_period": t, "natural_cause": t}).alias("a"), dataset.exclusion_reason({"natural_cause": n}).alias("b"), dataset.exclusion_reason({"insufficient_geographic_quality": t, "missing_features": t}, dataset.STRICT).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("natural_cause", None, "missing_features")
    with pytest.raises(ValueError, match="unknown reasons"):
        dataset.exclusion_reason({"weather": t})


def test_lattice_search_widens_until_the_nearest_are_certain(spark):
    rng = random.Random(11)
    anchors = [(k, 43 + 0.2 * (k // 9), 1 + 0.2 * (k % 9)) for k in range(81) if rng.random() < 0.4]
    cells = [(k, 43 + rng.random() * 1.6, 1 + rng.random() * 1.6) for k in range(60)] + [(90, 46.0, 1.5), (91, 43.1, -1.0)]
    c, a = spark.createDataFrame(cells, "cell long, lat double, lon double"), spark.createDataFrame(anchors, "anchor long, alat double, alon double")
    for k in (1, 4, 100):
        got = {}
        for r in spatial.nearest_on_lattice(c, a, 0.2, k).collect():
            got.setdefault(r["cell"], set()).add(r["anchor"])
        want = {x: {n for _, n in sorted((round((lat - u) ** 2 + (lon - v) ** 2, 9), n) for n, u, v in anchors)[:k]} for x, lat, lon in cells}
        assert got == want
    assert spatial.nearest_on_lattice(c.limit(0), a, 0.2, 4).count() == spatial.nearest_on_lattice(c, a.limit(0), 0.2, 4).count() == 0


def test_asof_snapshots_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=int(m))
    rows = []
    for k in range(120):
        a = int(rng.integers(0, 4000))
        rows.append((k % 3, k, at(a), None if k % 7 == 0 else at(a + int(rng.integers(-5, 900)))))
    rows += [(0, 500, at(100), at(100)), (0, 501, None, None), (None, 502, at(0), None)]
    facts = [(i, int(rng.integers(0, 3)), at(rng.integers(-50, 5200))) for i in range(400)] + [(400, 0, None), (401, 9, at(5)), (401, 9, at(5)), (402, None, at(5))]
    s = spark.createDataFrame(rows, "family int, snapshot int, available_from timestamp, available_until timestamp")
    f = spark.createDataFrame(facts, "fact int, family int, t timestamp")

    def best(family, t, any_family):
        held = [r for r in rows if t is not None and r[2] is not None and r[2] <= t and (r[3] is None or t < r[3]) and (any_family or (family is not None and r[0] == family))]
        return max(held, key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1]), default=None)

    for by in ("family", None):
        got = spatial.asof_snapshot(f if by else f.drop("family"), s if by else s.withColumnRenamed("family", "of"), "t", "fact", by)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted((i, (best(fam, t, by is None) or [None] * 2)[1]) for i, fam, t in facts)
        assert sorted(((r["fact"], r["snapshot"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert spatial.asof_snapshot(f, s.limit(0), "t", "fact", "family").where("snapshot is null").count() == len(facts)
    assert spatial.asof_snapshot(f.limit(0), s, "t", "fact", "family").count() == 0


def test_weights_from_blocks_of_stations_equal_those_from_all(spark):
    cells = spark.range(500).select(F.col("id").alias("cell"), (F.col("id") % 80).alias("q"), F.floor(F.col("id") / 25).alias("r"))
    points = spark.range(6000).select(F.col("id").alias("station"), (F.col("id") * 7 % 300 - 20).alias("sq"), (F.col("id") * 13 % 250).alias("sr"), F.when(F.col("id") % 5 != 0, F.col("id") % 40).alias("temp"), F.when(F.col("id") % 400 == 3, 1.0).alias("rare"))
    want = spatial.idw_all(cells, points, ["temp", "rare"], most=10_000).toPandas().set_index("cell")
    blocked = spatial.idw_all(cells, points, ["temp", "rare"])
    assert not any(n in blocked._jdf.queryExecution().executedPlan().toString() for n in ("CartesianProduct", "NestedLoop"))
    got = blocked.toPandas().set_index("cell").loc[want.index]
    assert len(want) == 500 and np.allclose(got.temp, want.temp, equal_nan=True) and np.allclose(got.rare, want.rare, equal_nan=True)


def test_crowded_squares_are_settled_at_the_first_hit(spark):
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    n = 100_000
    b = spark.range(n).select(F.lit(base).alias("cell"), (F.col("id") % 997 / 10).alias("x"), (F.col("id") % 991 / 10).alias("y"))
    p = b.select("cell", (F.col("x") + 40).alias("x"), "y")
    none = spark.createDataFrame([], "cell long, combustible boolean")
    assert [r[0] for r in spatial.wui_cells(b, p, none).collect()] == [base]
    # Points of every distance around the limit, against all pairs.
    rng = np.random.default_rng(5)
    cell = lambda k: base + int(k % 5) * 2**26 + int(k // 5)
    rows = [[(cell(k), float(x), float(y)) for k, (x, y) in zip(rng.integers(0, 25, m), rng.uniform(-300, 300, (m, 2)), strict=True)] for m in (60, 150)]
    near = lambda a, c: max(abs(dq := (a - c + 2**25) // 2**26), abs(dr := a - c - dq * 2**26), abs(dq + dr)) <= 1
    want = {a for a, x, y in rows[0] if any(near(a, c) and (x - u) ** 2 + (y - v) ** 2 <= 2500 for c, u, v in rows[1])}
    got = spatial.wui_cells(*(spark.createDataFrame(r, "cell long, x double, y double") for r in rows), none)
    assert {r[0] for r in got.collect()} == want and 0 < len(want) < 25


def test_a_day_of_many_events_meets_part_by_part(spark):
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    e = spark.range(300).select("id", (F.lit(base) + F.col("id") % 40 * 3).alias("cell"), (F.col("id") % 2).alias("commune"), F.lit("2024-07-01 10:00:00").cast("timestamp").alias("occurred_at"))
    e = e.unionByName(e.where("id < 30").select((F.col("id") + 1000).alias("id"), F.when(F.col("id") % 3 > 0, F.col("cell")).alias("cell"), F.when(F.col("id") % 2 == 0, 7).alias("commune"), "occurred_at"))
    pairs = lambda t: sorted(map(tuple, t.collect()))
    want = pairs(spatial.duplicate_pairs(e))
    assert len(want) == len(set(want)) > 150 * 149 and want == pairs(spatial.duplicate_pairs(e, rows=7))
    # 20,000 events of one municipality and day: every pair once, in tasks of two parts.
    many = spark.range(20_000).select("id", (F.lit(base) + F.col("id") * 3).alias("cell"), F.lit(1).alias("commune"), F.lit("2024-07-01 10:00:00").cast("timestamp").alias("occurred_at"))
    assert spatial.duplicate_pairs(many).count() == 20_000 * 19_999 // 2


def test_ranks_over_ranges_are_row_numbers(spark):
    from pyspark.sql import Window

    t = spark.range(20_000).select((F.col("id") % 3).alias("day"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") % 11 / 10).alias("score"), (F.col("id") * 7919 % 20_011).alias("cell"))
    want = t.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "cell")))
    got = spatial.numbered(t.repartition(6), ["day"], [F.desc("score"), F.asc("cell")])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_isotonic_ranges_pool_like_the_whole(spark):
    rng = np.random.default_rng(6)
    cases = [np.arange(300) / 300 > rng.random(300), rng.random(300) > 0.5, np.arange(300) < 150, np.arange(300) >= 150, np.r_[np.zeros(200), np.ones(3), np.zeros(97)] > 0]
    for y in cases:
        df = spark.createDataFrame([(k / 300, int(v)) for k, v in enumerate(y)] + [(None, 1), (0.5, None)], "score double, label int")
        blocks = []
        for k, v in enumerate(y):
            x, s, w = k / 300, float(v), 1.0
            while blocks and blocks[-1][1] * w >= s * blocks[-1][2]:
                _, s2, w2 = blocks.pop()
                s, w = s + s2, w + w2
            blocks.append([x, s, w])
        for rows in (100_000, 40):
            got = sorted(map(tuple, metrics.isotonic_blocks(df, rows=rows).collect()))
            assert got == [(x, pytest.approx(s / w)) for x, s, w in blocks]


def test_bootstrap_equals_drawing_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(f"2024-01-{1 + k % 9:02d}", int(rng.random() < 0.4), float(rng.integers(0, 21)) / 20, float(rng.random())) for k in range(200)]
    df = spark.createDataFrame(rows, "date string, label int, a double, b double")
    got = metrics.bootstrap(df, ["a", "b"], rounds=5, seed=3).toPandas().set_index(["round", "score"])
    draws = metrics.drawn_dates(df, "date", 5, 3).toPandas()
    assert len(got) == 10
    for k in range(5):
        times = draws[draws["round"] == k].set_index("date").w.to_dict()
        some = [r for r in rows for _ in range(times.get(r[0], 0))]
        y = np.array([r[1] for r in some])
        for name, col in (("a", 2), ("b", 3)):
            v = np.array([r[col] for r in some])
            s = np.floor(v * 1000 + 0.5)
            wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
            precision = np.mean([y[s >= t].mean() for t in s[y == 1]])
            assert tuple(got.loc[(k, name)]) == pytest.approx((wins, precision, ((v - y) ** 2).mean()))
    with pytest.raises(ValueError, match="draws"):
        metrics.bootstrap(df, ["a"], rounds=metrics.MOST_DRAWS)


def _tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_at_one_place_are_searched_once(spark):
    """Over 5,000 points at few places, far from most cells: no blocks, no pairs written, and the same rows as brute force."""
    cells = spark.range(300).select(F.col("id").alias("cell"), (F.col("id") % 9).alias("q"), (F.col("id") * 40).alias("r"))
    points = spark.range(6000).select(F.col("id").alias("station"), (F.col("id") * 7 % 10).alias("sq"), (F.col("id") * 11 % 12).alias("sr"), F.when(F.col("id") % 4 > 0, (F.col("id") % 97).cast("double")).alias("temp"))
    near, every = spatial.nearest(cells, points, 4), spatial.idw_all(cells, points, ["temp"])
    assert "MapInArrow" in _tree(near) and "MapInArrow" in _tree(every)
    p, c = points.toPandas(), cells.toPandas()
    q, r = c.q.to_numpy()[:, None] - p.sq.to_numpy(), c.r.to_numpy()[:, None] - p.sr.to_numpy()
    d = np.sqrt((q * q + q * r + r * r).astype(float))
    want = {(int(c.cell[k]), int(s)) for k in range(300) for s in np.lexsort((p.station, d[k]))[:4]}
    assert {(x["cell"], x["station"]) for x in near.collect()} == want == {(x["cell"], x["station"]) for x in spatial.nearest(cells, points, 4, most=20).collect()}
    ok = p.temp.notna().to_numpy()
    for got in (every, spatial.idw_all(cells, points, ["temp"], most=20)):
        for x in got.collect():
            at = d[x["cell"]]
            w = (at == 0).astype(float) if (at == 0).any() else at**-2.0
            if w[ok].sum():
                assert x["temp"] == pytest.approx((w[ok] @ p.temp[ok]) / w[ok].sum())
            else:
                assert x["temp"] is None


def test_a_crowded_lattice_square_is_not_one_task(spark):
    a = spark.range(40).select(F.col("id").alias("anchor"), (43 + F.floor(F.col("id") / 7) * 0.2).alias("alat"), (1 + F.col("id") % 7 * 0.2).alias("alon"))
    c = spark.range(5000).select(F.col("id").alias("cell"), (43 + F.col("id") % 3 * 0.01).alias("lat"), (1 + F.col("id") % 5 * 0.01).alias("lon"))
    got = spatial.nearest_on_lattice(c, a, 0.2, 4)
    assert "Join" not in _tree(got)
    rows = lambda df: sorted((r["cell"], r["anchor"], round(r["d2"], 9)) for r in df.collect())
    assert rows(got) == rows(spatial.nearest_on_lattice(c, a, 0.2, 4, most=10))


def test_buildings_of_other_cells_in_one_square_are_not_compared(spark):
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    b = spark.range(40_000).select((F.lit(base) + F.col("id") * 10).alias("cell"), (F.col("id") % 30).cast("double").alias("x"), F.lit(0.0).alias("y"))
    p = b.select("cell", (F.col("x") + F.when((F.col("cell") - base) % 20 == 0, 45).otherwise(60)).alias("x"), "y")
    none = spark.createDataFrame([], "cell long, combustible boolean")
    out = spatial.wui_cells(b, p, none)
    joins = [line.split("LeftSemi")[0] for line in _tree(out).splitlines() if "_px#" in line and "Join" in line]
    assert joins and all("pcell#" in j for j in joins)
    assert out.count() == 20_000


def test_an_exploded_series_is_never_sent_to_the_driver(spark):
    from firegrid.plans.weather_index import risk_inputs

    static = spark.range(50).select(F.col("id").alias("cell"), F.lit(1.0).alias("road"))
    series = static.select("cell", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).select("cell", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("date"))
    got = risk_inputs(static, series, spark.createDataFrame([], "date date, school_holiday boolean, public_holiday boolean"))
    assert "ShuffledHashJoin" in _tree(got) and got.count() == 2000


def test_sql_of_squares_and_controls_reaches_past_the_small_tables(spark, tmp_path):
    """Squares beyond the first 1,000, and controls moved by over 31 days and past the year's end."""
    import duckdb
    from comparing import assert_same

    from firegrid import catalog

    d, con = str(tmp_path), duckdb.connect()
    con.execute("create view supplier as select (range * 37)::BIGINT as s_suppkey from range(150)")
    con.execute("create view customer as select range::BIGINT as c_custkey, 1.0::DOUBLE as c_acctbal, 'MACHINERY' as c_mktsegment, 1 as c_nationkey from range(40)")
    con.execute("create view orders as select (k * 366 + o)::BIGINT as o_orderkey, k::BIGINT as o_custkey, TIMESTAMP '1996-01-01' + to_days(o::INTEGER) as o_orderdate, '4-X' as o_orderpriority, 1.0::DOUBLE as o_totalprice from range(40) a(k), range(366) b(o) where o <> k * 3")
    for t in ("supplier", "customer", "orders"):
        con.execute(f"copy {t} to '{d}/{t}.parquet' (format parquet)")
    for name in ("s21_load_territory", "s22_load_communes", "b10_training_sample"):
        assert_same(catalog.queries()[name](spark, d).toPandas(), con.execute(catalog.oracle_sql()[name]).df())


def test_pairs_are_assessed_where_they_meet(spark):
    """No join of pairs with events, and the same assessment as with it."""
    from firegrid.operators import quality

    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    k = F.col("id")
    e = spark.range(120).select("id", F.timestamp_seconds(1_700_000_000 + k * 911 % 90_000).alias("occurred_at"), (k % 4).alias("commune"), (F.lit(base) + k % 9).alias("cell"), (k % 50).cast("double").alias("x"), (k % 30).cast("double").alias("y"), (k % 5).cast("double").alias("surface_ha"), F.lit("human_known").alias("category"), (k % 2).cast("string").alias("subcategory"), F.when(k % 6 == 0, "municipality_centroid_probable").otherwise("x").alias("geography"))
    one = quality.assess_duplicates(spatial.duplicate_pairs(e, keep=quality.ASSESSED), e)
    two = quality.assess_duplicates(spatial.duplicate_pairs(e), e)
    rows = lambda t: sorted(map(tuple, t.select("left", "right", "score", "classification").collect()))
    assert rows(one) == rows(two) and "id_l" not in _tree(one) and "classification" in quality.duplicate_groups(one).columns


def test_pairs_are_assessed_where_events_meet(spark, sf_dir):
    """Same pairs, scores and classes as by the joins, with unknown values and groups cut into parts; no pair is a row of a shuffle."""
    from firegrid import catalog

    rng = random.Random(9)
    odd = lambda value, *others: rng.choice([value] * 8 + list(others))
    cell = lambda: (8 << 52) + (rng.randrange(-9, 9) + (1 << 25)) * (1 << 26) + rng.randrange(-9, 9) + (1 << 25)
    at = lambda: datetime.datetime(2024, 7, 1) + datetime.timedelta(seconds=rng.randrange(2 * 86_400))
    near = lambda: odd(float(rng.randrange(0, 90, 5)), None, math.nan)
    kinds = ["municipality_centroid_probable", "precision_undocumented", "x", None]
    rows = [(k * 7 % 601, odd(at(), None), odd(rng.randrange(5), None), odd(cell(), None, (9 << 52) + (1 << 51)), near(), near(), odd(rng.choice([0.0, 1.0, 1.02, 9.0, -1.0]), None, math.nan), odd("human_known", None), rng.choice(["a", "b"]), rng.choice(kinds)) for k in range(600)]
    e = spark.createDataFrame(rows, "id long, occurred_at timestamp, commune long, cell long, x double, y double, surface_ha double, category string, subcategory string, geography string")
    pairs = lambda t: sorted((r["left"], r["right"], round(r["score"], 9), r["classification"]) for r in t.select("left", "right", "score", "classification").collect())
    want = pairs(quality.assess_duplicates(spatial.duplicate_pairs(e), e))
    assert {r[3] for r in want} >= {"probable_duplicate", "possible_duplicate", "indeterminate", "probably_distinct"}
    for part in (2_000, 7):
        assert pairs(quality.assessed_pairs(e, part)) == want
        assert pairs(quality.assessed_pairs(e, part, review=True)) == [r for r in want if r[3] in quality.REVIEWED]
        assert {r["classification"]: r["pairs"] for r in quality.duplicate_classes(e, part).collect()} == Counter(r[3] for r in want)
    one = e.where("id = 0").drop("id").crossJoin(spark.range(50)).fillna(0.0).fillna({"category": "a", "commune": 1, "cell": cell()})
    one = one.withColumn("geography", F.lit("x")).withColumn("occurred_at", F.lit("2024-07-01 10:00:00").cast("timestamp"))
    assert [tuple(r) for r in quality.duplicate_classes(one, 8).collect()] == [("certain_duplicate", 50 * 49 // 2)]
    assert not quality.duplicate_classes(e.limit(0)).collect() and not quality.assessed_pairs(e.limit(0)).collect()
    for name in ("q3_assess_duplicates", "q4_duplicate_groups", "q6_audit_summary", "a15_quality_summary"):
        tree = _tree(catalog.queries()[name](spark, sf_dir))
        assert "occurred_at_l" not in tree and "id2" not in tree, name


def test_boxes_and_outlines_of_a_small_file_are_spread_over_tasks(spark):
    from firegrid.functions import grid
    from firegrid.sources import sinks

    boxes = spark.range(3).select(F.col("id").alias("station"), F.lit(1.0).alias("west"), F.lit(43.0).alias("south"), F.lit(1.01).alias("east"), F.lit(43.01).alias("north"))
    cells = spark.range(3).select((F.lit(8 * 2**52 + 2**25 * 2**26 + 2**25) + F.col("id")).alias("cell"))
    assert all("REPARTITION_BY_NUM" in _tree(t) for t in (grid.cells_for_bbox(boxes, 8), sinks.to_geojson(cells, [])))


def test_variant_keys_are_dealt_into_tasks_by_their_number(spark):
    days = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    pos = spark.range(600).select((F.col("id") % 500).alias("cell"), days.alias("date"), (F.col("id") % 3 == 0).alias("strict"))
    rows = dataset.build_variants(pos.unionByName(pos.limit(20)), {"N2": pos.where("cell < 9").select("cell", "date")})
    t = dataset.variant_stats(rows, rows_per_task=100)
    assert max(int(n) for n in re.findall(r"hashpartitioning\(row_key#\d+, (\d+)\)", t._jdf.queryExecution().toString())) == -(-rows.count() // 100)
    got = {(r["variant"], r["label"]): tuple(r)[2:] for r in t.collect()}
    pdf = rows.toPandas()
    want = {k: (len(g), g.row_key.nunique(), g.row_key.min(), g.row_key.max(), g.date.min(), g.date.max()) for k, g in pdf.groupby(["variant", "label"])}
    assert got == want and any(n > keys for n, keys, *_ in want.values())


def test_census_joins_once_for_all_strategies(spark):
    rng = random.Random(4)
    names = ["precision_undocumented", "rounded_coordinate_probable", "municipality_centroid_probable", "other"]
    cell = lambda: (8 << 52) + (rng.randrange(12) + (1 << 25)) * (1 << 26) + rng.randrange(12) + (1 << 25)
    day = lambda: datetime.date(1996, 1, 1) + datetime.timedelta(rng.randrange(20))
    c = spark.createDataFrame([(k, cell(), day()) for k in range(80)], "key long, cell long, date date")
    e = spark.createDataFrame([(cell(), day(), rng.choice(names), rng.choice("xyz")) for _ in range(25)], "cell long, date date, category string, cause string")
    t = dataset.exclusion_census(c, e)
    assert len(re.findall(r"Join", t._jdf.queryExecution().optimizedPlan().toString())) == 1
    want = {}
    for n, s in enumerate(("N0", "N1", "N2", "N3")):
        for r in spatial.near_events(c, e, s, ["cause"]).collect():
            want.setdefault(r["cause"], [set() for _ in range(4)])[n].add(r["key"])
    assert {r["cause"]: list(r)[1:] for r in t.collect()} == {k: [len(v) for v in sets] for k, sets in want.items()}
