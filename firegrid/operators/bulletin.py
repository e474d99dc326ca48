"""Forecast bulletins, alerts, signals, matches with observations, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import top_per

ALERT, CRITICAL = 0.65, 0.75

#: Quotas of a selection of cases to review: national leaders, department leaders, largest rises, and all.
NATIONAL, TERRITORIAL, ACCELERATION, CASES = 6, 6, 4, 16


def bulletin_aggregate(scores: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Per municipality and both day horizons: interpolated 95 % point, maximum, mean, physical and human part at the maximum, and counts over both thresholds. Municipalities need rows of both horizons."""
    s = scores.where(F.col("horizon").isin("hours_24", "hours_48"))
    aggs = [F.countDistinct("cell").alias("cells")]
    for h, n in (("hours_24", "24"), ("hours_48", "48")):
        of = F.col("horizon") == h
        only = lambda c: F.when(of, F.col(c))  # noqa: E731, B023
        peak = F.min_by(F.struct("physical", "human"), F.when(of, F.struct((-F.col("score")).alias("s"), *tie)))
        aggs += [
            F.percentile(only("score"), F.lit(0.95)).alias(f"p95_{n}"), F.max(only("score")).alias(f"max_{n}"), F.avg(only("score")).alias(f"mean_{n}"),
            peak["physical"].alias(f"physical_{n}"), peak["human"].alias(f"human_{n}"),
            F.count_if(of & (F.col("score") >= ALERT)).alias(f"elevated_{n}"), F.count_if(of & (F.col("score") >= CRITICAL)).alias(f"critical_{n}"),
            F.count_if(of).alias(f"rows_{n}"), F.max(only("valid_at")).alias(f"valid_at_{n}"),
        ]
    return s.groupBy(*keys).agg(*aggs).where("rows_24 > 0 and rows_48 > 0")


def bulletin_checks(scores: DataFrame, bulletin: DataFrame) -> DataFrame:
    """One row: cells per day horizon, whether they agree and are some, and whether the municipalities cover 99 % of them."""
    cells = scores.agg(*(F.countDistinct(F.when(F.col("horizon") == h, F.col("cell"))).alias(h) for h in ("hours_24", "hours_48")))
    mapped = bulletin.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("mapped"), F.count("*").alias("communes"))
    both = cells.crossJoin(mapped)  # one row each
    return both.withColumn("complete", (F.col("hours_24") > 0) & (F.col("hours_24") == F.col("hours_48"))).withColumn("covered", (F.col("communes") > 0) & (F.col("mapped") * 100 >= F.col("hours_24") * 99))


def alerts(bulletin: DataFrame, keys: list[str]) -> DataFrame:
    """One row per municipality and day horizon whose 95 % point reaches the alert threshold."""
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), *(F.col(f"{c}_{n}").alias(c) for c in ("p95", "max", "mean", "elevated", "critical", "valid_at"))) for h, n in (("hours_24", "24"), ("hours_48", "48"))))
    out = bulletin.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").withColumnRenamed("p95", "alert_index").where(F.col("alert_index") >= ALERT)
    return out.withColumn("risk_level", F.when(F.col("alert_index") >= CRITICAL, "critical").otherwise("elevated"))


def signal_windows(obs: DataFrame, place: str = "commune", at: str = "observed_at") -> DataFrame:
    """Observations by municipality and six-hour window."""
    g = obs.groupBy(place, F.window(at, "6 hours").alias("w"))
    return g.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("signals"), F.max("frp").alias("max_frp"), F.count_if(F.col("source") == "view").alias("views")).select(place, F.col("w.start").alias("window_start"), "first_at", "last_at", "signals", "max_frp", "views")


def match_ground_truth(obs: DataFrame, bulletins: DataFrame, max_days: int = 4) -> DataFrame:
    """Observations within a bulletin's reach (from issue to schedule plus the horizon) with the class of the match and the lead time.

    ``bulletins``: ``bulletin, commune, issued_at, scheduled_for, horizon, hours,
    alert_index``. Joined on municipality and day: a bulletin stands on each of
    the days it reaches.
    """
    end = F.col("scheduled_for") + F.make_interval(hours=F.col("hours"))
    b = bulletins.withColumn("until", end).withColumn("day", F.explode(F.expr("sequence(to_date(issued_at), to_date(until))")))
    m = obs.withColumn("day", F.to_date("occurred_at")).join(b, ["commune", "day"]).where("occurred_at >= issued_at and occurred_at <= until")
    covered, confirmed = F.col("alert_index") >= ALERT, F.col("evidence") == "confirmed_ignition"
    kind = F.when(confirmed & covered, "confirmed_hit").when(confirmed, "confirmed_miss").when(covered, "signal_covered").otherwise("signal_below_threshold")
    lead = (F.unix_timestamp("occurred_at") - F.unix_timestamp("issued_at")) / 3600.0
    return m.select("observation", "bulletin", "horizon", F.col("alert_index").alias("score"), kind.alias("classification"), lead.alias("lead_time_hours"))


def ground_truth_summary(matches: DataFrame) -> DataFrame:
    """Counts by class, coverage rate of signals and recall of confirmed ignitions; a rate without cases is null."""
    n = lambda c: F.count_if(F.col("classification") == c)
    t = matches.agg(F.count("*").alias("comparisons"), *(n(c).alias(c) for c in ("signal_covered", "signal_below_threshold", "confirmed_hit", "confirmed_miss")))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return t.withColumn("coverage_rate", rate("signal_covered", "signal_below_threshold")).withColumn("recall", rate("confirmed_hit", "confirmed_miss"))


def performance_summary(cases: DataFrame, ranks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Reviewed and pending cases, observed rate, rate among the first ranks, mean score of reviewed and lead time of observed cases."""
    done, seen = F.col("verdict").isin("observed", "not_observed"), F.col("verdict") == "observed"
    rate = lambda c: F.try_divide(F.count_if(c & seen).cast("double"), F.count_if(c & done).cast("double"))
    return cases.agg(F.count("*").alias("eligible"), F.count_if(done).alias("reviewed"), F.count_if(~done).alias("pending"), rate(F.lit(True)).alias("observed_rate"), *(rate(F.col("daily_rank") <= k).alias(f"rate_at_{k}") for k in ranks), F.avg(F.when(done, F.col("score"))).alias("mean_score"), F.avg(F.when(seen, F.col("lead_time"))).alias("mean_lead_time"))


def previous_scores(scores: DataFrame, place: str = "commune", at: str = "computed_at") -> DataFrame:
    """Each municipality's maximum per batch with that of the batch before."""
    top = scores.groupBy(place, at).agg(F.max("score").alias("score"))
    return top.withColumn("previous", F.lag("score").over(Window.partitionBy(place).orderBy(at)))


def select_cases(candidates: DataFrame, limit: int = CASES) -> DataFrame:
    """A diversified selection of at most 16 cases: six national leaders, six best of other departments' rest, four largest rises over the score before (0.65 if none), then filled up from the top; no repeats. Each step takes a few rows from the top, so the steps are unions of limits."""
    best = [F.desc("score"), "name", "code"]

    def take(rows: DataFrame, order: list, n: int, reason: str, step: int) -> DataFrame:
        # a limit's rows are few: numbering them needs no distribution
        some = rows.orderBy(*order).limit(n)
        return some.withColumn("reason", F.lit(reason)).withColumn("step", F.lit(step)).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))

    national = take(candidates, best, NATIONAL, "national_top", 1)
    rest = candidates.join(national.select("code"), "code", "left_anti")
    leaders = top_per(rest.where("department is not null"), ["department"], best).drop("_n")
    territorial = take(leaders, [F.desc("score"), "code"], TERRITORIAL, "territorial_top", 2)
    rest = rest.join(territorial.select("code"), "code", "left_anti")
    rise = F.col("score") - F.coalesce("previous", F.lit(ALERT))
    faster = take(rest, [rise.desc(), F.desc("score"), "code"], ACCELERATION, "risk_acceleration", 3)
    rest = rest.join(faster.select("code"), "code", "left_anti")
    fill = take(rest, best, limit, "national_top", 4)
    every = national.unionByName(territorial).unionByName(faster).unionByName(fill)
    return every.orderBy("step", "place").limit(min(limit, CASES)).select("code", "reason", "score")


def reactive_cases(signals: DataFrame, per_day: int) -> DataFrame:
    """Covered signals as cases, at most ``per_day`` a day: the strongest, the earliest on ties."""
    t = signals.withColumn("day", F.to_date("first_at"))
    return top_per(t, ["day"], [F.desc("max_frp"), "first_at", "commune"], per_day, "daily_rank")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "moderate").otherwise("low")


def area_summary(scores: DataFrame, tie: list[str]) -> DataFrame:
    """Count, maximum, its band and cell, and the times of a set of scores."""
    peak = F.min_by(F.struct("cell", "score"), F.struct((-F.col("score")).alias("s"), *tie))
    return scores.agg(F.count("*").alias("n"), peak.alias("p"), F.max("computed_at").alias("computed_at"), F.min("valid_at").alias("first_valid"), F.max("valid_at").alias("last_valid")).select("n", F.col("p.score").alias("max_score"), score_band(F.col("p.score")).alias("band"), F.col("p.cell").alias("cell"), "computed_at", "first_valid", "last_valid")
