"""Structured Streaming jobs and operational snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import capture_window
from ..functions.grid import cell_center, in_bbox
from ..operators.bulletin import reactive_cases, signal_windows
from ..operators.spatial import fill_missing, latest_per
from ..plans.weather_index import CODES, walk
from ..sources.sinks import read_published, sweep_attempts, upsert_published
from ..sources.staging import staged


def stream_observations(spark: SparkSession, path: str, schema, late: str = "2 days") -> DataFrame:
    """Arriving files without repeated (source, key); later copies than the watermark are dropped by their time."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["source", "dedupe_key"])


def stream_signal_windows(obs: DataFrame, late: str = "2 days") -> DataFrame:
    """Six-hour windows per municipality, updated as rows arrive."""
    return signal_windows(obs.withWatermark("observed_at", late))


class FwiState(StatefulProcessor):
    """Carries the codes of a bucket's cells from day to day, all cells of a day in one NumPy step; a day not after a cell's last one comes back marked late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("codes", "cell array<bigint>, day array<int>, ffmc array<double>, dmc array<double>, dc array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["cell", "date", "temp", "rh", "wind", "rain"]).drop_duplicates(["cell", "date"])
        cells, dates = pdf["cell"].to_numpy(np.int64), pd.to_datetime(pdf["date"])
        old = self.state.get() if self.state.exists() else ([], [], [], [], [])
        known = np.asarray(old[0], np.int64)
        own = np.union1d(known, cells)
        at = np.searchsorted(own, known)
        now = {"cell": own, "day": np.full(len(own), np.datetime64("NaT"), "datetime64[D]"), **{c: np.zeros(len(own)) for c in CODES[:3]}}
        now["day"][at] = np.asarray(old[1], np.int64).astype("datetime64[D]")
        for c, v in zip(CODES[:3], old[2:], strict=True):
            now[c][at] = v
        out, late = walk(cells, dates.to_numpy().astype("datetime64[D]"), dates.dt.month.to_numpy(), {c: pdf[c].to_numpy(float) for c in ("temp", "rh", "wind", "rain")}, now)
        self.state.update((own.tolist(), now["day"].astype(np.int64).tolist(), *(now[c].tolist() for c in CODES[:3])))
        done = pd.concat([pdf[["cell", "date"]].reset_index(drop=True), pd.DataFrame(out, columns=CODES)], axis=1)  # NaN becomes null
        yield done.assign(late=late)

    def close(self) -> None:
        pass


#: Cells are dealt into so many buckets, each with one state; a stream keeps the number it began with.
STATE_BUCKETS = 64


def state_buckets(cells: int, per_bucket: int = 10_000, least: int = 16) -> int:
    """Buckets for so many cells, some ten thousand in each, so that what a task holds at a time doesn't grow with the cells."""
    return max(least, -(-cells // per_bucket))


def stream_fwi(weather: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """The daily index as a stream; needs the RocksDB state store. Choose ``buckets`` so that a bucket has some ten thousand cells."""
    schema = "cell long, date date, ffmc double, dmc double, dc double, isi double, bui double, fwi double, late boolean"
    rows = weather.select(F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("_bucket"), "cell", "date", "temp", "rh", "wind", "rain")
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=FwiState(), outputStructType=schema, outputMode="append", timeMode="None")


def stream_forecast(weather: DataFrame, forecast: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, str], None], checkpoint: str):
    """Each micro-batch as a published forecast batch, named by its id so that a retry writes the same one."""
    return weather.writeStream.foreachBatch(lambda df, n: publish(forecast(df), f"stream-{n:012d}")).option("checkpointLocation", checkpoint)


def stream_updates(scores: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Updates whose cell centre lies in a subscriber's box (edges included)."""
    lat, lon = cell_center(F.col("cell"))
    return scores.where(in_bbox(lat, lon, bbox))


def stream_reactive_cases(windows: DataFrame, per_day: int, path: str, checkpoint: str):
    """Cases of updated signal windows, at most ``per_day`` a day, whatever batches they arrive in.

    The windows' latest states are kept under ``path`` by day: a micro-batch reads
    and writes the days that it touches, each once and by pointer, and their cases
    are chosen again from all their windows; so a day's cases are those that one
    batch of all its rows would give. A retried batch changes nothing.
    """
    windows_at, manifest = f"{path}/windows", f"{path}/manifest"

    def choose(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        days = F.date_format("first_at", "yyyy-MM-dd")
        new = staged(batch.withColumn("batch", days).withColumn("version", F.struct(F.lit(n).alias("n"), "signals")), "windows")
        upsert_published(new, windows_at, manifest, ["commune", "window_start"], "version")
        touched = new.select("batch").distinct()
        latest = read_published(spark, windows_at, manifest).join(touched, "batch", "left_semi").drop("batch", "version")
        reactive_cases(latest, per_day).hint("rebalance", "day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/cases")
        sweep_attempts(spark, windows_at, manifest)  # nobody else reads the windows

    return windows.writeStream.outputMode("update").foreachBatch(choose).option("checkpointLocation", checkpoint)


def read_reactive_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cases")


#: Ages in hours up to which a source counts as normal, transient, degraded, stale.
BANDS = [(3, "normal"), (6, "transient"), (24, "degraded"), (72, "stale")]


def freshness(age_hours: Column) -> Column:
    out = F.when(age_hours.isNull(), "unavailable")
    for most, name in BANDS:
        out = out.when(age_hours <= most, name)
    return out.otherwise("unavailable")


def freshness_alerts(status: DataFrame, now: Column, existing: DataFrame | None = None) -> DataFrame:
    """One alert per source and failed rule, without those already raised for the day."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_success")) / 3600
    t = status.withColumn("band", freshness(age)).withColumn("day", F.to_date(now))
    rules = F.array_compact(F.array(F.when(F.col("band").isin("degraded", "stale", "unavailable"), F.concat(F.lit("freshness_"), F.col("band"))), F.when(F.col("error").isNotNull(), "last_run_failed")))
    found = t.select("source", "band", "day", F.explode(rules).alias("rule"))
    return found if existing is None else found.join(existing.select("source", "rule", "day"), ["source", "rule", "day"], "left_anti")


def volume_counts(runs: DataFrame, at: Column) -> DataFrame:
    """Runs in all and in the last 24 hours, by outcome."""
    recent = F.col("started_at") > at - F.expr("interval 24 hours")
    return runs.where(F.col("started_at") <= at).agg(F.count("*").alias("runs"), F.count_if(recent).alias("recent"), F.count_if(recent & F.col("ok")).alias("recent_ok"), F.count_if(recent & ~F.col("ok")).alias("recent_failed"))


def operational_snapshot(obs: DataFrame, cadence: str) -> DataFrame:
    """Counts per source and hour or day; the window is the key, so writing it again changes nothing."""
    return obs.groupBy("source", capture_window(F.col("observed_at"), cadence).alias("window")).agg(F.count("*").alias("n"), F.max("observed_at").alias("latest"))


def daily_archive(expected: DataFrame, scores: DataFrame, least_coverage: float = 0.99) -> DataFrame:
    """Every expected cell with its score or as missing; too little coverage raises an error."""
    t = fill_missing(expected, scores, "cell")
    share = t.agg(F.avg((F.col("status") == "observed").cast("double")).alias("_share"))
    guarded = t.crossJoin(F.broadcast(share)).withColumn("_g", F.assert_true(F.col("_share") >= least_coverage, F.lit("coverage is too low")))  # one row
    return guarded.where("_g is null").drop("_g", "_share")


def weekly_snapshot(expected: DataFrame, observed: DataFrame, excused: DataFrame) -> DataFrame:
    """Observed cells, and missing ones that were expected to be missing or not."""
    t = fill_missing(expected, observed, "cell").join(excused.select("cell", F.lit(True).alias("_x")), "cell", "left")
    m = F.col("status") == "missing"
    return t.agg(F.count("*").alias("cells"), F.count_if(~m).alias("observed"), F.count_if(m & F.col("_x").isNotNull()).alias("missing_expected"), F.count_if(m & F.col("_x").isNull()).alias("missing_unexpected"))


def link_labels(snapshots: DataFrame, events: DataFrame, cutoff: Column, days: int) -> DataFrame:
    """Events of a snapshot's cell within ``days`` of its valid time that were known at the cut-off: a label per snapshot, joined on cell and day."""
    known = events.where(F.col("updated_at") <= cutoff).select("cell", F.col("occurred_at").alias("t"), F.to_date("occurred_at").alias("day"))
    s = snapshots.withColumn("day", F.explode(F.expr(f"sequence(to_date(valid_at), date_add(to_date(valid_at), {days}))")))
    hit = s.join(known, ["cell", "day"]).where((F.col("t") >= F.col("valid_at")) & (F.col("t") < F.col("valid_at") + F.expr(f"interval {days} days"))).groupBy("snapshot").agg(F.count("*").alias("events"))
    return snapshots.join(hit, "snapshot", "left").na.fill(0, ["events"]).withColumn("label", (F.col("events") > 0).cast("int"))


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """Label history: a changed label closes the old row and opens a new one; an unchanged one stays."""
    o = old.where("current").select("snapshot", F.col("label").alias("_old"))
    changed = new.join(o, "snapshot", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("label"))).select("snapshot", "label")
    closed = old.join(changed.select("snapshot", F.lit(True).alias("_c")), "snapshot", "left").withColumn("current", F.col("current") & F.col("_c").isNull()).select("snapshot", "label", "current")
    return closed.unionByName(changed.withColumn("current", F.lit(True)))


def compare_snapshots(df: DataFrame, days: int) -> DataFrame:
    """Each metric against ``days`` earlier: difference, percentage and direction."""
    before = df.select("metric", F.date_add("date", days).alias("date"), F.col("value").alias("before"))
    t = df.join(before, ["metric", "date"], "left").withColumn("delta", F.col("value") - F.col("before"))
    t = t.withColumn("percent", F.try_divide(100.0 * F.col("delta"), F.col("before").cast("double")))
    return t.withColumn("status", F.when(F.col("before").isNull(), "no_reference").when(F.col("delta") == 0, "stable").when(F.col("delta") > 0, "up").otherwise("down"))


def slot_summary(df: DataFrame, by: list[str], at: str = "observed_at") -> DataFrame:
    """Hourly slots between the first and last row: present, expected, missing."""
    hours = df.select(*by, F.date_trunc("hour", at).alias("h")).distinct()
    t = hours.groupBy(*by).agg(F.min("h").alias("first"), F.max("h").alias("last"), F.count("*").alias("present"))
    expected = ((F.unix_timestamp("last") - F.unix_timestamp("first")) / 3600).cast("long") + 1
    return t.withColumn("expected", expected).withColumn("missing", F.col("expected") - F.col("present"))
