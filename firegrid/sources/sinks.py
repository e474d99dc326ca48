"""Versioned writes: idempotent inserts, upserts, batches, snapshots.

Targets are Parquet folders partitioned by batch or day. What is published is
never rewritten: a new attempt is written, then the manifest row that points to
it; readers join the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.grid import cell_center, cell_ring
from ..functions.text import fingerprint, row_checksum
from ..operators.spatial import latest_per
from .staging import delete_path, spread_out, staged


def new_rows(df: DataFrame, target: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows whose key the target doesn't have, the first of each key."""
    return latest_per(df, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def insert_new(df: DataFrame, path: str, keys: list[str], order: list) -> None:
    """Append new rows to a Parquet folder; running it again adds nothing."""
    new_rows(df, _or_empty(df.sparkSession, path, df), keys, order).write.mode("append").parquet(path)


def _or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder, or an empty table if there is none yet."""
    try:
        found = spark.read.schema(like.schema).parquet(path)
        found.limit(0).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], like.schema)
    return found


def upsert(df: DataFrame, target: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The target with rows of a key replaced by the newest one."""
    both = target.withColumn("_o", F.lit(0)).unionByName(df.withColumn("_o", F.lit(1)))
    return latest_per(both, keys, [F.desc("_o"), F.desc(version)]).drop("_o")


def update_history(static: DataFrame, hist: DataFrame) -> DataFrame:
    """One feature replaced where there is a new value."""
    new = hist.select("cell", F.col("hist").alias("_hist"))
    return static.join(new, "cell", "left").withColumn("hist", F.coalesce("_hist", "hist")).drop("_hist")


_MANIFEST = "batch string, attempt string, version long"


def live_attempts(spark: SparkSession, manifest: str) -> DataFrame:
    """``batch, attempt``: the attempt that each published batch points to, the one of its newest manifest row."""
    rows = _or_empty(spark, manifest, spark.createDataFrame([], _MANIFEST))
    return rows.groupBy("batch").agg(F.max_by("attempt", F.struct("version", "attempt")).alias("attempt"))


def publish(df: DataFrame, path: str, manifest: str) -> None:
    """Publish the batches of a table by its column ``batch``.

    Every attempt writes a folder of its own; only when that is complete, a manifest
    row per batch points to it. So readers see a batch's old rows until its new ones
    are whole, and a failed attempt takes away nothing but its own files. Attempts
    that nothing points to any more can go by :func:`sweep_attempts`.
    """
    spark, attempt = df.sparkSession, f"a{uuid.uuid4().hex}"
    mine = f"{path}/attempt={attempt}"
    try:
        df.hint("rebalance", "batch").write.partitionBy("batch").parquet(mine)  # small batches in few files, large ones in many
    except Exception:
        delete_path(spark, mine)
        raise
    seen = _or_empty(spark, manifest, spark.createDataFrame([], _MANIFEST)).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    done = _attempts(spark, mine).select("batch").distinct()
    done.select("batch", F.lit(attempt).alias("attempt"), F.lit(seen).cast("long").alias("version")).write.mode("append").parquet(manifest)


def publish_batch(df: DataFrame, path: str, manifest: str, batch: str) -> None:
    """:func:`publish` a table as one batch. A batch without rows can't be told from none and is not published."""
    publish(df.withColumn("batch", F.lit(batch)), path, manifest)


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    """All attempts' rows; folder names stay strings as they were written."""
    found = spark.read.parquet(path).schema
    for f in found.fields:
        if f.name in ("batch", "attempt"):
            f.dataType = StringType()
    return spark.read.schema(found).parquet(path)


def read_published(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Rows of the batches that the manifest has, with their ``batch``; other attempts' folders are pruned by the join."""
    return _attempts(spark, path).join(live_attempts(spark, manifest), ["batch", "attempt"], "left_semi").drop("attempt")


def sweep_attempts(spark: SparkSession, path: str, manifest: str) -> int:
    """Delete the attempts that no batch points to; how many went. For when no reader of older attempts is left and nothing is being published."""
    live = {r["attempt"] for r in live_attempts(spark, manifest).select("attempt").distinct().collect()}  # a row per publication that still counts
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    dead = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.getPath().getName().removeprefix("attempt=") not in live]
    for d in dead:
        delete_path(spark, d.toString())
    return len(dead)


def upsert_published(df: DataFrame, path: str, manifest: str, keys: list[str], version: str) -> None:
    """:func:`upsert` rows with a ``batch`` into a published table: only the batches that the new rows touch are read and written again, and all of them change at once."""
    spark = df.sparkSession
    new = staged(df, "upsert")
    if live_attempts(spark, manifest).isEmpty():
        publish(latest_per(new, [*keys, "batch"], [F.desc(version)]), path, manifest)
        return
    old = read_published(spark, path, manifest).join(new.select("batch").distinct(), "batch", "left_semi")
    publish(upsert(new, old.select(*new.columns), [*keys, "batch"], version), path, manifest)


def retire_batches(batches: DataFrame, keep: DataFrame, referenced: DataFrame) -> DataFrame:
    """Batches to drop: neither kept nor referenced by a snapshot or bulletin."""
    return batches.join(keep, "computed_at", "left_anti").join(referenced, "computed_at", "left_anti")


def import_summary(raw: DataFrame, accepted: DataFrame, batch: str, key: str) -> DataFrame:
    """Per batch: received, inserted, ignored and rejected rows and the terminal state."""
    r = raw.groupBy(batch).agg(F.count("*").alias("received"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
    a = accepted.groupBy(batch).agg(F.count(key).alias("inserted"))
    t = r.join(a, batch, "left").na.fill(0, ["inserted"]).withColumn("ignored", F.col("received") - F.col("rejected") - F.col("inserted"))
    return t.withColumn("state", F.when(F.col("rejected") == 0, "succeeded").when(F.col("rejected") < F.col("received"), "partial").otherwise("failed"))


def load_fire_events(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, the first of each source identity, and the rejected ones with their errors."""
    ok = F.size("errors") == 0
    events = latest_per(normalized.where(ok), ["source", "external_id"], ["line"])
    return events, normalized.where(~ok)


def source_status(runs: DataFrame) -> DataFrame:
    """Per source: last run, last success, runs, and the error if the last run failed."""
    last = F.max_by(F.struct("ok", "error"), F.struct("started_at", "run"))
    t = runs.groupBy("source").agg(F.max("started_at").alias("last_run"), F.max(F.when(F.col("ok"), F.col("started_at"))).alias("last_success"), F.count("*").alias("runs"), last.alias("l"))
    return t.select("source", "last_run", "last_success", "runs", F.when(~F.col("l.ok"), F.col("l.error")).alias("error"))


def to_geojson(df: DataFrame, properties: list[str], geometry: str = "polygon") -> DataFrame:
    """One GeoJSON feature per cell, with properties: its outline as a closed polygon, or its centre as a ``point``; degrees to six places."""
    degrees = lambda lon, lat: F.array(F.round(lon, 6), F.round(lat, 6))
    if geometry == "polygon":
        shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(cell_ring(F.col("cell")), lambda p: degrees(p["lon"], p["lat"]))).alias("coordinates"))
    else:
        lat, lon = cell_center(F.col("cell"))
        shape = F.struct(F.lit("Point").alias("type"), degrees(lon, lat).alias("coordinates"))
    return spread_out(df).select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_cells(df: DataFrame, path: str) -> None:
    """Aggregated cells as JSON lines, by Spark's committer (nothing is visible before the job ends)."""
    df.write.mode("overwrite").json(path)


def read_cells(spark: SparkSession, path: str, schema, resolution: int) -> DataFrame:
    """Cells back from JSON lines; a cell of another resolution raises an error."""
    t = spark.read.schema(schema).json(path)
    level = F.assert_true(F.shiftright("cell", 52) == resolution, F.lit("cached cells have another resolution"))
    return t.withColumn("_g", level).where(F.col("_g").isNull()).drop("_g")


def version_outcomes(asked: DataFrame, manifest: DataFrame) -> DataFrame:
    """``logical_id, definition_hash, status, outcome`` for each version asked for by ``logical_id, definition``.

    The existing row is ``reused`` if its definition is the same and it is still
    open; without one a draft is ``created``; a ``changed`` definition and a
    ``finalized`` version are refused.
    """
    old = manifest.select("logical_id", F.col("definition_hash").alias("_hash"), F.col("status").alias("_status"))
    t = asked.select("logical_id", F.sha2("definition", 256).alias("definition_hash")).join(old, "logical_id", "left")
    outcome = F.when(F.col("_hash").isNull(), "created").when(F.col("_hash") != F.col("definition_hash"), "changed").when(F.col("_status") == "finalized", "finalized").otherwise("reused")
    return t.select("logical_id", "definition_hash", F.coalesce("_status", F.lit("draft")).alias("status"), outcome.alias("outcome"))


def dataset_version(manifest: DataFrame, logical_id: str, definition: str) -> DataFrame:
    """One version's manifest row by :func:`version_outcomes`; a refused one raises an error."""
    asked = manifest.sparkSession.range(1).select(F.lit(logical_id).alias("logical_id"), F.lit(definition).alias("definition"))
    t = version_outcomes(asked, manifest)
    t = t.withColumn("_a", F.assert_true(F.col("outcome") != "changed", F.lit("the definition has changed"))).withColumn("_b", F.assert_true(F.col("outcome") != "finalized", F.lit("the version is finalized")))
    return t.where("_a is null and _b is null").select("logical_id", "definition_hash", "status")


def finalize_versions(manifest: DataFrame, rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The manifest with its built versions finalized: rows, positives, negatives, exclusions and a fingerprint of the row keys of each.

    ``rows``: ``logical_id, label, row_key``. A version that is building and has
    rows becomes ``finalized``; finalized ones stay as they are, drafts and empty
    ones too, with null figures.
    """
    word = F.conv(F.substring(F.sha2("row_key", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    built = rows.groupBy("logical_id").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.sha2(F.sum(word).cast("string"), 256).alias("checksum"))
    left_out = exclusions.groupBy("logical_id").agg(F.count("*").alias("exclusions"))
    t = manifest.join(built, "logical_id", "left").join(left_out, "logical_id", "left")
    ready = (F.col("status") == "building") & F.col("rows").isNotNull()
    figures = [F.when(ready, F.col(c)).alias(c) for c in ("rows", "positives", "negatives", "checksum")]
    return t.select("logical_id", F.when(ready, "finalized").otherwise(F.col("status")).alias("status"), *figures, F.when(ready, F.coalesce("exclusions", F.lit(0))).alias("exclusions"))


def activate_snapshot(manifest: DataFrame, snapshot: Column) -> DataFrame:
    """The snapshot becomes its family's active one; the others that were active are superseded."""
    family = manifest.where(snapshot).select(F.col("family").alias("_f"), F.col("id").alias("_id"))
    t = manifest.join(family, F.col("family") == F.col("_f"), "left")
    status = F.when(F.col("_id") == F.col("id"), "active").when(F.col("_id").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return t.withColumn("status", status).drop("_f", "_id")


def publish_mask(cells: DataFrame, family: str) -> DataFrame:
    """A coverage mask's identity: cells, count and a checksum-derived name."""
    t = cells.select("cell").distinct().withColumn("checksum", row_checksum(F.col("cell")))
    return fingerprint(t, "cell", "checksum").select(F.concat(F.lit(f"{family}-"), F.substring("fingerprint", 1, 16)).alias("mask"), "fingerprint", F.col("rows").alias("cells"))


def write_assessments(df: DataFrame, existing: DataFrame, rule: str, checksum: str) -> DataFrame:
    """Rows of a rule version that aren't there yet; the same rule with another checksum raises an error."""
    other = existing.where((F.col("rule") == rule) & (F.col("checksum") != checksum)).agg(F.count("*").alias("_n"))
    t = df.withColumn("rule", F.lit(rule)).withColumn("checksum", F.lit(checksum))
    t = t.crossJoin(F.broadcast(other)).withColumn("_g", F.assert_true(F.col("_n") == 0, F.lit("the rule has another checksum"))).where("_g is null").drop("_g", "_n")  # one row
    return t.join(existing.select("rule", "entity"), ["rule", "entity"], "left_anti")


def verify_snapshot(rows: DataFrame, key: str, expected_rows: int, expected_fingerprint: str, mask: DataFrame) -> DataFrame:
    """Errors and warnings of a snapshot: count, repeated keys, checksum, cells outside or missing from its mask."""
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"))
    digest = fingerprint(rows.select(key, row_checksum(*(F.col(c) for c in sorted(rows.columns))).alias("checksum")), key, "checksum").select("fingerprint")
    outside = rows.join(mask.select(key), key, "left_anti").agg(F.count("*").alias("outside"))
    missing = mask.join(rows.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    t = counts.crossJoin(digest).crossJoin(outside).crossJoin(missing)  # one row each
    errors = F.array_compact(F.array(F.when(F.col("n") != expected_rows, "row_count"), F.when(F.col("k") != F.col("n"), "repeated_key"), F.when(F.col("fingerprint") != expected_fingerprint, "checksum"), F.when(F.col("outside") > 0, "cells_outside_mask")))
    return t.select("n", "fingerprint", errors.alias("errors"), F.array_compact(F.array(F.when(F.col("missing") > 0, "cells_missing"))).alias("warnings"))
