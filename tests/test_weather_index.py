"""The published daily sequence and properties of the recursion."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from firegrid.functions import dates, fwi
from firegrid.plans.weather_index import fwi_series, last_codes

#: The 48 days of the published sequence (13 April to 30 May). Temperature, humidity, wind and rain, then the six values as printed.
SEQUENCE = """
17 42 25 0 87.65 8.545 19.01 10.78 8.49 10.04
20 21 25 2.4 86.2 10.4 23.57 8.771 10.36 9.22
8.5 40 17 0 86.91 11.8 26.05 6.478 11.74 7.517
6.5 25 6 0 88.76 13.18 28.18 4.851 13.11 6.095
13 34 24 0 89.04 15.44 31.47 12.51 15.34 14.73
6 40 22 0.4 88.59 16.47 33.5 10.6 16.37 13.36
5.5 52 6 0 87.28 17.24 35.45 3.923 17.14 5.796
8.5 46 16 0 87.28 18.49 37.93 6.494 18.4 9.502
9.5 54 20 0 86.73 19.68 40.6 7.347 19.58 10.88
7 93 14 9 29.83 10.14 29.52 0.006623 10.91 0.004191
6.5 71 17 1 49.4 10.68 31.65 0.3577 11.59 0.234
6 59 17 0 67.22 11.38 33.68 1.346 12.34 0.9129
13 52 4 0 77.73 13.03 36.98 1.126 13.85 0.8162
15.5 40 11 0 85.41 15.44 40.72 3.88 15.85 5.474
23 25 9 0 91.46 19.82 45.81 8.306 19.78 12.08
19 46 16 0 89.87 22.45 50.19 9.423 22.4 14.2
18 41 20 0 89.87 25.19 54.38 11.53 25.11 17.5
14.5 51 16 0 88.36 27.04 57.95 7.581 26.96 13.17
14.5 69 11 0 85.64 28.31 62.96 4.006 28.25 7.946
15.5 42 8 0 87.32 30.85 68.15 4.367 30.78 9.006
21 37 8 0 89.33 34.51 74.34 5.822 34.43 12.17
23 32 16 0 90.93 38.83 80.88 10.96 38.72 20.88
23 32 14 0 91.15 43.14 87.43 10.23 43.01 20.94
27 33 12 0 91.61 48.1 94.69 9.862 47.95 21.56
28 17 27 0 95.11 54.46 102.13 34.27 54.26 52.31
23.5 54 20 0 89.65 57.43 108.77 11.16 57.24 25.72
16 50 22 12.2 62.2 29.92 91.8 1.405 32.97 3.011
11 58 20 0 76.44 31.26 96.19 2.29 34.49 5.341
16 54 16 0 83.33 33.33 101.47 3.77 36.6 8.786
21.5 37 9 0 88.6 37.08 107.74 5.515 39.86 12.63
14 61 22 0.2 86.62 38.63 112.67 7.997 41.6 17.2
15 30 27 0 89.58 41.6 117.77 15.71 44.18 28.66
20 23 11 0 92.07 45.87 123.78 10.01 47.62 21.72
14 95 3 16.4 21.32 20.09 96.89 0.0002476 26.46 0.0002689
20 53 4 2.8 51 18.24 102.9 0.2256 25.27 0.2378
19.5 30 16 0 82.21 22.03 108.81 3.273 29.25 6.758
25.5 51 20 6 75.32 16.37 106.33 2.135 23.65 3.802
10 38 24 0 84.27 18.19 110.54 6.386 25.77 11.21
19 27 16 0 90.25 22.05 116.36 9.946 29.92 17.1
26 46 11 4.2 77.54 18.67 117.65 1.578 26.74 2.917
30 38 22 0 90.17 23.75 125.46 13.29 32.24 21.91
25.5 67 19 12.6 65.28 13.14 108.44 1.389 20.17 1.862
12 53 28 11.8 55.39 7.74 91.58 1.183 12.78 0.8184
21 38 8 0 80.79 11.35 97.76 1.852 17.59 2.532
13 70 20 3.8 61.7 8.406 97.8 1.238 13.84 0.8966
9 78 24 1.4 64.43 8.991 101.82 1.726 14.73 1.941
11 54 16 0 77.57 10.46 106.21 2.036 16.78 2.766
15.5 39 9 0 85.37 13.12 111.4 3.486 20.27 5.719
"""
DAYS = [(tuple(map(float, d[:4])), tuple(d[4:])) for d in map(str.split, SEQUENCE.strip().splitlines())]


def frame(spark, start="2000-04-13", days=2):
    first = datetime.date.fromisoformat(start)
    rows = [(1, first + datetime.timedelta(days=k), *w) for k, (w, _) in enumerate(DAYS[:days])]
    return spark.createDataFrame(rows, "cell long, date date, temp double, rh double, wind double, rain double")


def test_published_sequence(spark):
    got = fwi_series(frame(spark, days=len(DAYS))).orderBy("date").toPandas()
    for (_, want), (_, row) in zip(DAYS, got.iterrows(), strict=True):
        for text, name in zip(want, ("ffmc", "dmc", "dc", "isi", "bui", "fwi"), strict=True):
            digits = len((text + ".").split(".")[1])
            assert abs(row[name] - float(text)) <= 0.5 * 10**-digits + 1e-10, name


def test_a_series_goes_on_from_stored_codes(spark, tmp_path):
    w = frame(spark, days=len(DAYS))
    w = w.unionByName(w.withColumn("cell", F.lit(2).cast("long")).withColumn("temp", F.col("temp") + 3).where("date <> '2000-05-03'")).unionByName(w.withColumn("cell", F.lit(3).cast("long")).where("date > '2000-05-10'"))
    whole = fwi_series(w).orderBy("cell", "date").toPandas()
    for cuts in (["2000-05-01"], ["2000-04-20", "2000-05-03", "2000-05-04", "2000-05-20"]):
        state, runs = None, []
        for k, (a, b) in enumerate(zip(["2000-01-01", *cuts], [*cuts, "2001-01-01"], strict=True)):
            run = fwi_series(w.where((F.col("date") >= a) & (F.col("date") < b)), state)
            runs.append(run.toPandas())
            last_codes(run, state).write.parquet(str(tmp_path / f"{len(cuts)}-{k}"))
            state = spark.read.parquet(str(tmp_path / f"{len(cuts)}-{k}"))
        got = pd.concat(runs).sort_values(["cell", "date"], ignore_index=True)
        assert got.equals(whole) and state.count() == 3
    # Days that are not after the stored one are left out; a run of no days gives none and keeps the state.
    assert fwi_series(w, state).count() == 0
    assert sorted(last_codes(fwi_series(w.limit(0), state), state).collect()) == sorted(state.collect())


def test_missing_day_starts_afresh_and_order_does_not_matter(spark):
    a = frame(spark).toPandas()
    later = a.assign(date=[d + datetime.timedelta(days=10) for d in a.date])
    both = spark.createDataFrame(pd.concat([later, a]).sample(frac=1, random_state=1))
    got = fwi_series(both.withColumn("date", F.to_date("date"))).orderBy("date").toPandas()
    assert got.fwi[0] != got.fwi[1]
    # April values agree after the gap as month and start are the same
    assert abs(got.fwi[0] - got.fwi[2]) < 1e-9 and abs(got.fwi[1] - got.fwi[3]) < 1e-9


def test_columns_and_arrays_agree(spark):
    import numpy as np

    r = spark.range(200).select(*((F.col("id") * k % m).cast("double").alias(n) for n, k, m in (("f", 7, 101), ("t", 3, 35), ("h", 11, 101), ("w", 13, 40), ("p", 5, 9))))
    p = r.withColumn("y", fwi.ffmc(*map(F.col, "fthwp"))).toPandas()
    assert np.allclose(p.y, fwi.ffmc(*(p[c].to_numpy() for c in "fthwp")), atol=1e-9)


def test_easter(spark):
    got = [r[0].isoformat() for r in spark.createDataFrame([(2020,), (2023,), (2024,), (2025,), (2026,)], "y int").select(dates.easter(F.col("y"))).collect()]
    assert got == ["2020-04-12", "2023-04-09", "2024-03-31", "2025-04-20", "2026-04-05"]


def test_streamed_series_equals_batch(spark, tmp_path):
    from firegrid.streaming.jobs import stream_fwi

    src = frame(spark)
    src.where("date = '2000-04-13'").write.parquet(str(tmp_path / "in/1"))
    src.where("date = '2000-04-14'").write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    try:
        q = stream_fwi(stream).writeStream.format("memory").queryName("series").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    except Exception as e:  # an image without the state server's Python packages can't run it
        if "protobuf" in str(e) or "google" in str(e):
            import pytest

            pytest.skip("stateful Python streams need protobuf")
        raise
    got = spark.table("series").where("not late").orderBy("date").toPandas()
    want = fwi_series(src).orderBy("date").toPandas()
    assert len(got) == 2 and abs(got.fwi - want.fwi).max() < 1e-9


def test_recompute_carries_the_day_before(spark):
    import duckdb
    from conftest import TABLES

    from firegrid import views
    from firegrid.queries import forecasts as q

    sf_dir, duck = "/root/testdata/sf0.01", duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    weather = q._SERIES.replace("WITH RECURSIVE ", q.with_views("v_cells", "v_stations") + ", ", 1)
    sql = weather + f""", p AS (SELECT c.key, c.cell, s.station, sqrt(((c.q - s.q) * (c.q - s.q) + (c.q - s.q) * (c.r - s.r) + (c.r - s.r) * (c.r - s.r))::DOUBLE) AS km, s.temp, s.rh, s.wind, s.rain FROM v_cells c, v_stations s),
    n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY km, station) AS k, min(km) OVER (PARTITION BY cell) AS near FROM p), w AS (SELECT *, CASE WHEN near <= 1e-9 THEN CASE WHEN km <= 1e-9 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE pow(km, -2) END AS w FROM n WHERE k <= 4),
    v AS (SELECT key, cell, sum(w * temp) / sum(w) AS temp, sum(w * rh) / sum(w) AS rh, sum(w * wind) / sum(w) AS wind, sum(w * rain) / sum(w) AS rain FROM w GROUP BY 1, 2),
    o AS (SELECT v.*, y.ffmc IS NOT NULL AS carried, coalesce(y.ffmc, {q._F}) AS f0, coalesce(y.dmc, {q._P}) AS p0, coalesce(y.dc, {q._C}) AS c0 FROM v LEFT JOIN y ON y.cell = v.key % 8 AND y.date = DATE '1996-07-01'),
    fr AS (SELECT *, {q.sql_ffmc('f0', 'temp', 'rh', 'wind', 'rain')} AS ffmc, {q.sql_dmc('p0', 'temp', 'rh', 'rain', '7')} AS dmc, {q.sql_dc('c0', 'temp', 'rain', '7')} AS dc FROM o),
    g AS (SELECT *, {q.sql_isi('ffmc', 'wind')} AS isi, {q.sql_bui('dmc', 'dc')} AS bui FROM fr), h AS (SELECT *, {q.sql_fwi('isi', 'bui')} AS fwi FROM g)
    SELECT h.cell, h.carried, h.fwi, CASE WHEN c.combustible THEN pow(greatest(0::DOUBLE, least(1::DOUBLE, h.fwi / 30)), 0.6) * pow(greatest(0::DOUBLE, least(1::DOUBLE, 0.4 * 0.5 + 0.2 * greatest(0::DOUBLE, least(1::DOUBLE, c.road)) + 0.15 * c.agri::INT)), 0.4) ELSE 0 END AS score FROM h JOIN v_cells c USING (key)"""
    want = duck.execute(sql).df()
    got = q._recomputed(spark, sf_dir).toPandas()
    both = got.merge(want, on="cell", suffixes=("", "_want"))
    assert len(both) == len(got) == len(want) == views.cells(spark, sf_dir).count() and want.carried.any()
    assert np.allclose(both.fwi, both.fwi_want, atol=1e-9) and np.allclose(both.score, both.score_want, atol=1e-9)


def test_repeated_days_do_not_depend_on_arrival(spark):
    a = frame(spark, days=6)
    twice = a.unionByName(a.where("date > '2000-04-14'").withColumn("temp", F.col("temp") + 5))
    first = fwi_series(twice.repartition(3)).orderBy("date").toPandas()
    assert first.equals(fwi_series(twice.orderBy(F.desc("temp"))).orderBy("date").toPandas()) and len(first) == 6
    assert np.allclose(first.fwi, fwi_series(a).orderBy("date").toPandas().fwi)


def test_backtest_sees_earlier_days_only(spark):
    from firegrid.plans.weather_index import backtest_scores

    d = lambda k: datetime.date(2000, 5, 1) + datetime.timedelta(days=k)
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    series = spark.createDataFrame([(base + c, d(k), 10.0) for c in range(6) for k in range(4)], "cell long, date date, fwi double")
    static = spark.createDataFrame([(base + c, 0.5, 0.0, 0.0, True) for c in range(6)], "cell long, road double, wui double, agri double, combustible boolean")
    fires = spark.createDataFrame([(base, d(1)), (base, d(1)), (base + 2, d(2)), (base + 900, d(0))], "cell long, date date")
    cal = spark.createDataFrame([], "date date, school_holiday boolean, public_holiday boolean")
    got = {(r["cell"] - base, r["date"]): (r["hist"], r["ignited"]) for r in backtest_scores(series, static, fires, cal).collect()}
    assert len(got) == 24 and all(h == 0 for (_, day), (h, _) in got.items() if day <= d(1))
    assert {c: got[c, d(2)][0] for c in range(6)} == {0: 1, 1: 0.5, 2: 0.25, 3: 0, 4: 0, 5: 0}
    kernel = {0: 2.25, 1: 1.5, 2: 1.5, 3: 0.5, 4: 0.25, 5: 0}
    assert {c: got[c, d(3)][0] for c in range(6)} == {c: v / 2.25 for c, v in kernel.items()}
    assert {k for k, (_, hit) in got.items() if hit} == {(0, d(1)), (2, d(2))}


def test_backtest_by_lane_equals_that_of_rows(spark):
    """Cells of several blocks that share two series with gaps; no row of a cell and day is shuffled."""
    from firegrid.plans.weather_index import backtest_by_lane, backtest_scores

    d = lambda k: datetime.date(2000, 5, 28) + datetime.timedelta(days=k)
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    rng = np.random.default_rng(3)
    cells = [(base + int(q) * 2**26 + int(r), int(q + r) % 2, float(rng.random()), 0.5, float(r % 2), bool(q % 4)) for q in range(-3, 40, 3) for r in range(28, 36)]
    static = spark.createDataFrame(cells, "cell long, lane long, road double, wui double, agri double, combustible boolean")
    series = spark.createDataFrame([(lane, d(k), 5.0 + 3 * k + lane) for lane in (0, 1) for k in range(8) if (lane, k) != (1, 4)], "lane long, date date, fwi double")
    near = [(cells[int(k)][0] + int(rng.integers(-2, 3)) + int(rng.integers(-2, 3)) * 2**26, d(int(rng.integers(-2, 9)))) for k in rng.integers(0, len(cells), 150)] + [(None, d(1)), (base, None)]
    fires = spark.createDataFrame(near, "cell long, date date")
    cal = spark.createDataFrame([(d(2), True, False), (d(5), None, True)], "date date, school_holiday boolean, public_holiday boolean")
    want = backtest_scores(static.join(series, "lane").select("cell", "date", "fwi"), static.drop("lane"), fires.dropna(), cal).toPandas().sort_values(["date", "cell"])
    got = backtest_by_lane(static, series, fires, cal, "rows")
    got = got.toPandas().sort_values(["date", "cell"])
    assert len(got) == len(want) and (got.cell.to_numpy() == want.cell.to_numpy()).all() and (got.ignited.to_numpy() == want.ignited.to_numpy()).all() and want.ignited.sum() > 5
    assert np.allclose(got.score, want.score)
    days, of = backtest_by_lane(static, series, fires, cal).toPandas().sort_values("date"), want.groupby("date")
    assert (days.cells.to_numpy() == of.size().to_numpy()).all() and np.allclose(days.hist, of["hist"].mean()) and np.allclose(days.score, of["score"].mean()) and np.allclose(days.peak, of["score"].max())


def test_buckets_hold_as_many_cells_in_larger_tables():
    import inspect

    from firegrid.streaming.jobs import state_buckets

    assert [state_buckets(n) for n in (0, 15_000, 900_000, 5_400_000)] == [16, 16, 90, 540]
    assert inspect.signature(fwi_series).parameters["rows_per_bucket"].default <= 200_000


def test_a_backtest_spreads_no_ignitions_that_its_days_do_not_tell_apart(spark, monkeypatch):
    """Those before the first day are one sum a cell, those after the last are not needed; scores stay the same."""
    from firegrid.plans import weather_index

    base = (8 << 52) + (1 << 25) * (1 << 26) + (1 << 25)
    day = lambda k: datetime.date(1996, 5, 1) + datetime.timedelta(k)
    static = spark.createDataFrame([(base + k, 0.5, 0.0, 0.0, True) for k in range(6)], "cell long, road double, wui double, agri double, combustible boolean")
    series = spark.createDataFrame([(base + k, day(n), 10.0) for k in range(6) for n in (0, 1, 3)], "cell long, date date, fwi double")
    fires = [(base + k % 5, day(n)) for k, n in enumerate([-400, -90, -90, -1, -1, 0, 1, 2, 3, 4, 50, 300])]
    written, write = {}, weather_index.staged
    monkeypatch.setattr(weather_index, "staged", lambda df, name: written.setdefault(name, df) and write(df, name))
    ignitions = spark.createDataFrame(fires, "cell long, date date")
    cal = spark.createDataFrame([], "date date, school_holiday boolean, public_holiday boolean")
    t = weather_index.backtest_scores(series, static, ignitions, cal)
    got = {(r["cell"] - base, r["date"]): (r["hist"], r["ignited"]) for r in t.collect()}
    raw = {(k, day(n)): (sum(0.5 ** abs(c - base - k) for c, at in fires if at < day(n) and abs(c - base - k) <= 2), int((base + k, day(n)) in fires)) for k in range(6) for n in (0, 1, 3)}
    top = {n: max(v for (_, at), (v, _) in raw.items() if at == n) for n in {at for _, at in raw}}
    assert set(got) == set(raw)
    assert all(np.isclose(got[key][0], v / top[key[1]]) and got[key][1] == hit for key, (v, hit) in raw.items())
    assert "date_sub" in written["backtest"]._jdf.queryExecution().analyzed().toString()


def test_hits_and_misses_of_lanes_need_no_row_of_a_cell_and_day(spark, monkeypatch):
    """Same rows as by ranks of all cells and days, with ties, gaps and several walks; what is written is smaller."""
    from firegrid.operators import spatial
    from firegrid.plans import weather_index

    d = lambda k: datetime.date(2000, 5, 28) + datetime.timedelta(days=k)
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    rng = np.random.default_rng(5)
    cells = [(base + int(q) * 2**26 + int(r), int(q + r) % 3, float(rng.integers(3)) / 2, 0.5, float(r % 2), bool(q % 4)) for q in range(-3, 40, 2) for r in range(26, 40)]
    static = spark.createDataFrame([*cells, (base + 999, 7, 0.5, 0.5, 0.0, True)], "cell long, lane long, road double, wui double, agri double, combustible boolean")  # no series has lane 7
    series = spark.createDataFrame([(lane, d(k), None if k == 9 else 5.0 + 3 * k + lane) for lane in (0, 1, 2) for k in range(12) if (lane, k) != (1, 4) and k != 6], "lane long, date date, fwi double")
    near = [(cells[int(k)][0] + int(rng.integers(-2, 3)) + int(rng.integers(-2, 3)) * 2**26, d(int(rng.integers(-2, 14)))) for k in rng.integers(0, len(cells), 2_000)] + [(None, d(1)), (base, None), (base + 999, d(3))]
    fires = spark.createDataFrame(near, "cell long, date date")
    cal = spark.createDataFrame([(d(2), True, False), (d(5), None, True)], "date date, school_holiday boolean, public_holiday boolean")
    rows = weather_index.backtest_by_lane(static, series, fires, cal, "rows")
    every = rows.count()
    hits = sorted(map(tuple, weather_index.daily_hits(rows).collect()))
    misses = [tuple(r) for r in weather_index.worst_misses(rows.withColumn("score", F.round("score", 9))).collect()]
    assert len(hits) == 11 and any(0 < h[3] < h[4] < h[2] for h in hits)
    written = []
    for module in (weather_index, spatial):
        write = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, write=write: written.append((out := write(df, name)).count()) or out)
    for splits in (256, 2):
        monkeypatch.setattr(weather_index, "MOST_SPLITS", splits)
        got = weather_index.backtest_by_lane(static, series, fires, cal, "hits")
        assert got.columns == ["date", "cells", "ignited", "hits_5", "hits_10"] and sorted(map(tuple, got.collect())) == hits
    assert [tuple(r) for r in weather_index.backtest_by_lane(static, series, fires, cal, "misses").collect()] == misses
    assert max(written) < every
    none = fires.limit(0)
    assert not weather_index.backtest_by_lane(static, series, none, cal, "misses").collect()
    assert {tuple(r)[2:] for r in weather_index.backtest_by_lane(static, series, none, cal, "hits").collect()} == {(0, 0, 0)}


def test_days_of_lanes_are_the_means_of_rows(spark):
    """The report by day, with cells that no ignition is near: their history is 0."""
    from firegrid.plans.weather_index import backtest_by_lane, backtest_scores

    d = lambda k: datetime.date(2000, 5, 28) + datetime.timedelta(days=k)
    base = 8 * 2**52 + 2**25 * 2**26 + 2**25
    cells = [(base + k * 40, k % 2, k % 3 / 2, 0.5, float(k % 2), bool(k % 4)) for k in range(40)]
    static = spark.createDataFrame(cells, "cell long, lane long, road double, wui double, agri double, combustible boolean")
    series = spark.createDataFrame([(lane, d(k), 5.0 + 3 * k + lane) for lane in (0, 1) for k in range(6) if (lane, k) != (1, 4)], "lane long, date date, fwi double")
    fires = spark.createDataFrame([(base + 1, d(1)), (base + 41, d(2)), (base, d(3)), (base, d(-3))], "cell long, date date")
    cal = spark.createDataFrame([], "date date, school_holiday boolean, public_holiday boolean")
    of = backtest_scores(static.join(series, "lane").select("cell", "date", "fwi"), static.drop("lane"), fires, cal).toPandas().groupby("date")
    days = backtest_by_lane(static, series, fires, cal).toPandas().sort_values("date")
    assert (days["cells"].to_numpy() == of.size().to_numpy()).all() and (days["ignited"].to_numpy() == of["ignited"].sum().to_numpy()).all()
    assert all(np.allclose(days[c], of[name].agg(how)) for c, name, how in (("hist", "hist", "mean"), ("score", "score", "mean"), ("peak", "score", "max")))
