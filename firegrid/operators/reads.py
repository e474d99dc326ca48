"""Read queries over published tables: maps, alerts, details, lists, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..sources.staging import staged
from .quality import REVIEWED
from .spatial import latest_per


def risk_map(latest: DataFrame, horizon: str, min_score: float, limit: int | None, tie: list[str]) -> DataFrame:
    """Latest scores of an area, the highest first, and whether the limit cut some off."""
    t = latest.where((F.col("horizon") == horizon) & (F.col("score") >= min_score))
    if limit is None:
        return t.withColumn("truncated", F.lit(False))
    total = t.agg((F.count("*") > limit).alias("truncated"))
    return t.orderBy(F.desc("score"), *tie).limit(limit).crossJoin(F.broadcast(total))  # one row


def alerts_latest(latest: DataFrame, horizon: str, threshold: float, limit: int, tie: list[str]) -> DataFrame:
    return latest.where((F.col("horizon") == horizon) & (F.col("score") >= threshold)).orderBy(F.desc("score"), *tie).limit(limit)


def cell_detail(scores: DataFrame, forecasts: DataFrame, states: DataFrame, static: DataFrame, horizon: str, hours: int = 24, tie: list[str] | None = None) -> DataFrame:
    """Each cell's current score for a horizon, with its index, features and history.

    The current score is that of the latest batch (``tie`` orders rows of one
    batch); the index ``fwi`` is the batch's own forecast or, where there is none,
    the state of the batch's day; ``index_from`` says which. ``history`` holds
    ``computed_at, score`` of the ``hours`` up to then, the latest first.
    """
    rows = scores.where(F.col("horizon") == horizon)
    current = latest_per(rows, ["cell"], [F.desc("computed_at"), *(tie or [])]).select("cell", "computed_at", "valid_at", "score", F.to_date("computed_at").alias("date"))
    own = forecasts.where(F.col("horizon") == horizon).select("cell", "computed_at", F.col("fwi").alias("_forecast"))
    day = states.select("cell", "date", F.col("fwi").alias("_state"))
    t = current.join(own, ["cell", "computed_at"], "left").join(day, ["cell", "date"], "left").join(static, "cell")
    t = t.withColumn("fwi", F.coalesce("_forecast", "_state")).withColumn("index_from", F.when(F.col("_forecast").isNotNull(), "forecast").when(F.col("_state").isNotNull(), "state")).drop("_forecast", "_state", "date")
    past = rows.select("cell", F.col("computed_at").alias("at"), F.col("score").alias("s")).join(current.select("cell", F.col("computed_at").alias("now")), "cell").where((F.col("at") <= F.col("now")) & (F.col("at") >= F.col("now") - F.make_interval(hours=F.lit(hours))))
    history = past.groupBy("cell").agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("at").alias("computed_at"), F.col("s").alias("score"))))).alias("history"))
    return t.join(history, "cell")


def search_prefix(df: DataFrame, name: str, prefix: str, limit: int = 20) -> DataFrame:
    """Names that begin with at least two letters, in any case."""
    wanted = prefix.strip().lower()
    found = df.where(F.lower(name).startswith(wanted)) if len(wanted) >= 2 else df.limit(0)
    return found.orderBy(name, *[c for c in df.columns if c != name]).limit(limit)


def list_rows(df: DataFrame, filters: dict, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows; filters with None don't apply."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(*order).offset(offset).limit(limit)


def sample_cells(static: DataFrame, n: int, seed: str) -> DataFrame:
    """A deterministic sample of combustible cells."""
    return static.where("combustible").orderBy(hash_order(seed, F.col("cell")), "cell").limit(n)


def cell_history(scores: DataFrame, cell: int, horizon: str, since: Column | None = None) -> DataFrame:
    t = scores.where((F.col("cell") == cell) & (F.col("horizon") == horizon))
    return (t if since is None else t.where(F.col("computed_at") >= since)).orderBy("computed_at")


def commune_risk(latest: DataFrame, commune, horizon: str, min_score: float = 0.0) -> DataFrame:
    return latest.where((F.col("commune") == commune) & (F.col("horizon") == horizon) & (F.col("score") >= min_score))


def commune_scores(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    return scores.join(mapping, "commune")


def overview(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.countDistinct("cell").alias("cells"), F.count_if(F.col("cause") == "naturelle").alias("natural_known"), F.count_if(F.col("cause") == "inconnue").alias("unknown"), F.max("occurred_at").alias("latest"))


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several columns in one table: ``kind, name, n``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in columns))).alias("x"))
    return long.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def quality_summary(events: DataFrame, classes: DataFrame, geography: DataFrame, combustibility: DataFrame) -> DataFrame:
    """``kind, name, n``: events by cause, members of duplicate groups by class, events by geographic category and by what their cell is, and the totals of events, repeated coordinates and pairs. ``classes``: ``classification, pairs``, the number of pairs of each class; a group has two members."""
    burns = combustibility.select(F.when(F.col("combustible"), "combustible").when(~F.col("combustible"), "non_combustible").otherwise("features_missing").alias("combustibility"))
    counted = [counts_by(t, [c]) for t, c in ((events, "cause"), (geography, "category"), (burns, "combustibility"))]
    classes = staged(classes, "classes")  # a row a class
    groups = classes.where(F.col("classification").isin(*REVIEWED)).select(F.lit("classification").alias("kind"), F.col("classification").alias("name"), (2 * F.col("pairs")).alias("n"))
    pairs = classes.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("duplicate_pairs").alias("name"), "n")
    total = lambda t, name: t.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    repeated = events.groupBy("lat", "lon").count().where("count > 1")
    out = counted[0]
    for more in (*counted[1:], groups, total(events, "events"), total(repeated, "coordinate_groups"), pairs):
        out = out.unionByName(more)
    return out


def dataset_detail(rows: DataFrame, exclusions: DataFrame, builds: DataFrame) -> DataFrame:
    """``kind, name, label, n`` of a dataset version: rows by split and label, exclusions by reason, and its builds."""
    none = F.lit(None).cast(rows.schema["label"].dataType).alias("label")
    splits = rows.groupBy("split", "label").agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), F.col("split").alias("name"), "label", "n")
    reasons = exclusions.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("exclusions").alias("kind"), F.col("reason").alias("name"), none, "n")
    return splits.unionByName(reasons).unionByName(builds.agg(F.count("*").alias("n")).select(F.lit("builds").alias("kind"), F.lit("builds").alias("name"), none, "n"))


def calendar_summary(calendar: DataFrame) -> DataFrame:
    return calendar.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("school_holiday").alias("known"), F.count_if(F.col("school_holiday").isNull()).alias("unknown"))


def static_coverage(static: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return static.agg(F.count("*").alias("cells"), *(F.count_if(c).alias(n) for n, c in flags.items()))
