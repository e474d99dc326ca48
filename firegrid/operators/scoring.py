"""Scores with explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_multiplier, is_weekend, season_angle


@dataclass(frozen=True)
class Weights:
    """Parameters of the heuristic score (the defaults are fixed values)."""

    fwi_max: float = 30.0
    alpha: float = 0.6
    beta: float = 0.4
    hist: float = 0.4
    wui: float = 0.25
    road: float = 0.2
    agri: float = 0.15


FEATURES = ["wui", "road", "agri", "population", "poi", "power_line", "weekend", "school_holiday", "public_holiday", "season_sin", "season_cos"]


def unit(c: Column) -> Column:
    """A number clamped to 0..1; null counts 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def top_factors(factors: Column, n: int = 3) -> Column:
    """The ``n`` largest positive contributions, ties by name."""
    positive = F.filter(factors, lambda f: f["contribution"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda f: F.struct((-F.round(f["contribution"], 9)).alias("k"), f["name"].alias("name"), f["value"].alias("value"), f["contribution"].alias("contribution"))))
    return F.slice(F.transform(ordered, lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), f["contribution"].alias("contribution"))), 1, n)


def _factor(name: str, value: Column, contribution: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), contribution.alias("contribution"))


def score_heuristic(df: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Physical and human part, score and its three strongest factors of rows ``fwi, hist, wui, road, agri, combustible, date, school_holiday, public_holiday``."""
    day = F.col("date")
    harvest = F.when(F.month(day).between(6, 8), 1.0).otherwise(0.0)
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    t = df.withColumn("_cal", calendar_multiplier(day, off("school_holiday"), off("public_holiday"))).withColumn("_agri", unit(F.col("agri")) * harvest).withColumn("physical", unit(F.col("fwi") / w.fwi_max))
    parts = [("historical_ignitions", unit(F.col("hist")), w.hist), ("wildland_urban_interface", unit(F.col("wui")), w.wui), ("road_density", unit(F.col("road")), w.road), ("agricultural_activity", F.col("_agri"), w.agri)]
    total = sum((v * k for _, v, k in parts[1:]), parts[0][1] * parts[0][2])
    t = t.withColumn("human", unit(total * F.col("_cal")))
    factors = F.array(*(_factor(n, v, v * k * F.col("_cal")) for n, v, k in parts), _factor("fwi", F.col("physical"), F.col("physical")))
    burns = F.coalesce(F.col("combustible"), F.lit(False))
    score = F.when(burns, unit(F.pow("physical", F.lit(w.alpha)) * F.pow("human", F.lit(w.beta)))).otherwise(0.0)
    return t.withColumn("score", score).withColumn("factors", F.when(burns, top_factors(factors)).otherwise(F.slice(factors, 1, 0))).drop("_cal", "_agri")


def human_features(df: DataFrame) -> Column:
    """The eleven features of the human model as an array."""
    a, day = season_angle(F.col("date")), F.col("date")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    return F.array(*(unit(F.col(c)) for c in FEATURES[:6]), is_weekend(day).cast("double"), flag("school_holiday"), flag("public_holiday"), F.sin(a), F.cos(a))


def score_learned(features: Column, weights: list[float], means: list[float], scales: list[float], intercept: float) -> tuple[Column, Column]:
    """Logistic propensity and each feature's contribution."""
    parts = [(features[k] - m) / s * w for k, (w, m, s) in enumerate(zip(weights, means, scales, strict=True))]
    total = sum(parts[1:], parts[0]) + intercept
    return 1 / (1 + F.exp(-total)), F.array(*(_factor(n, features[k], p) for k, (n, p) in enumerate(zip(FEATURES, parts, strict=False))))


def tree_column(node: dict, names: list[str]) -> Column:
    """A regression tree ``{feature, threshold, left, right}`` or ``{value}`` as a column."""
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(F.col(names[node["feature"]]) <= node["threshold"], tree_column(node["left"], names)).otherwise(tree_column(node["right"], names))


def score_artifact(df: DataFrame, artifact: dict) -> DataFrame:
    """Boosted trees with a step calibrator from a JSON artifact: missing features take the artifact's fill values."""
    from .metrics import apply_isotonic

    names = artifact["features"]
    assert len(set(names)) == len(names) and artifact["trees"], "the artifact is not valid"
    t = df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(float(artifact["fill"][n]))) for n in names})
    raw = F.lit(float(artifact["start"]))
    for tree in artifact["trees"]:
        raw = raw + float(artifact["rate"]) * tree_column(tree, names)
    t = t.withColumn("raw_score", 1 / (1 + F.exp(-raw)))
    return apply_isotonic(t, [tuple(b) for b in artifact["calibrator"]], "raw_score")


def scoring_parity(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Largest difference of two scorings of the same rows, and how many differ."""
    gap = F.abs(F.col("score_a") - F.col("score_b"))
    t = a.select(key, F.col("score").alias("score_a")).join(b.select(key, F.col("score").alias("score_b")), key)
    return t.agg(F.count("*").alias("rows"), F.max(gap).alias("largest"), F.count_if(gap > tolerance).alias("mismatches"))
