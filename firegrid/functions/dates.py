"""Calendar functions as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARIS = "Europe/Paris"

#: The eleven French public holidays, by month and day or by days after Easter.
FIXED_HOLIDAYS = [(1, 1, "jour_de_l_an"), (5, 1, "fete_du_travail"), (5, 8, "victoire_1945"), (7, 14, "fete_nationale"), (8, 15, "assomption"), (11, 1, "toussaint"), (11, 11, "armistice_1918"), (12, 25, "noel")]
MOVABLE_HOLIDAYS = [(1, "lundi_de_paques"), (39, "ascension"), (50, "lundi_de_pentecote")]

#: Forecast horizons and their hours.
HORIZONS = [("nowcast", 0), ("hours_6", 6), ("hours_24", 24), ("hours_48", 48)]


def iso_dow(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def season(day: Column) -> Column:
    """0 winter (December to February), 1 spring, 2 summer, 3 autumn."""
    return F.floor((F.month(day) % 12) / 3).cast("int")


def season_angle(day: Column) -> Column:
    return 2 * math.pi * (F.dayofyear(day) - 1) / 365.25


def easter(year: Column) -> Column:
    """Easter Sunday (the anonymous Gregorian algorithm)."""
    i = lambda x: F.floor(x).cast("int")
    a, b, c = year % 19, i(year / 100), year % 100
    d, e = i(b / 4), b % 4
    g = i((b - i((b + 8) / 25) + 1) / 3)
    h = (19 * a + b - d - g + 15) % 30
    li = (32 + 2 * e + 2 * i(c / 4) - h - c % 4) % 7
    n = h + li - 7 * i((a + 11 * h + 22 * li) / 451) + 114
    return F.make_date(year, i(n / 31), n % 31 + 1)


def public_holidays(years: DataFrame) -> DataFrame:
    """``year, date, label`` for each ``year``."""
    y = F.col("year").cast("int")
    days = [F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("label")) for m, d, n in FIXED_HOLIDAYS]
    days += [F.struct(F.date_add(easter(y), k).alias("date"), F.lit(n).alias("label")) for k, n in MOVABLE_HOLIDAYS]
    return years.select(y.alias("year"), F.explode(F.array(*days)).alias("h")).select("year", "h.date", "h.label")


def build_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day: weekday, season, holiday and whether the next or previous day of the same year is one."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    holidays = public_holidays(days.select(F.year("date").alias("year")).distinct()).select("date", "label")

    def at(shift: int, name: str) -> DataFrame:
        return holidays.groupBy(F.date_add("date", shift).alias("date"), F.year("date").alias("y")).agg(F.min("label").alias(name))

    out = days.withColumn("y", F.year("date"))
    for shift, name in ((0, "holiday_label"), (-1, "next_label"), (1, "previous_label")):
        out = out.join(F.broadcast(at(shift, name)), ["date", "y"], "left")  # eleven rows a year
    return out.select("date", iso_dow(F.col("date")).alias("weekday"), is_weekend(F.col("date")).alias("weekend"), season(F.col("date")).alias("season"), F.col("holiday_label").isNotNull().alias("public_holiday"), "holiday_label", F.col("next_label").isNotNull().alias("holiday_eve"), F.col("previous_label").isNotNull().alias("holiday_after"))


def calendar_multiplier(day: Column, school: Column, public: Column) -> Column:
    """1.4 on a summer day off in the school holidays, 1.2 on another day off, 0.6 in winter, else 1."""
    off, month = is_weekend(day) | public, F.month(day)
    return F.when(off & school & month.between(6, 8), 1.4).when(off, 1.2).when(month.isin(12, 1, 2), 0.6).otherwise(1.0)


def split_for_year(year: Column, train: tuple[int, int] = (2020, 2023), validation: int = 2024, test: int = 2025, prospective: int = 2026) -> Column:
    return F.when(year.between(*train), "train").when(year == validation, "validation").when(year == test, "test").when(year == prospective, "prospective")


def latest_noon(ts: Column) -> Column:
    """The last 12:00 UTC at or before an instant."""
    noon = F.date_trunc("day", ts) + F.expr("interval 12 hours")
    return F.when(noon <= ts, noon).otherwise(noon - F.expr("interval 1 day"))


def noons_between(first: Column, last: Column) -> Column:
    """Array of the noons after ``first`` up to ``last``."""
    days = F.sequence(F.date_trunc("day", first), F.date_trunc("day", last), F.expr("interval 1 day"))
    return F.filter(F.transform(days, lambda d: d + F.expr("interval 12 hours")), lambda t: (t > first) & (t <= last))


def forecast_sample_times(base: Column) -> Column:
    """Sorted distinct instants a forecast needs: base, +6, +24 and +48 h, and every noon from the last one on."""
    hours = F.array(*(base + F.expr(f"interval {h} hours") for _, h in HORIZONS))
    last = base + F.expr("interval 48 hours")
    return F.array_sort(F.array_distinct(F.concat(hours, F.array(latest_noon(base)), noons_between(base, last))))


def capture_window(ts: Column, cadence: str) -> Column:
    """Start of the hour or day of an instant."""
    return F.date_trunc(cadence, ts)


def local_date(ts: Column, tz: str = PARIS) -> Column:
    """Civil date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def with_horizons(df: DataFrame, base: str = "base") -> DataFrame:
    """Each row once per horizon, with its ``valid_at``."""
    rows = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("hours")) for n, h in HORIZONS))
    return df.withColumn("_h", F.explode(rows)).withColumn("horizon", F.col("_h.horizon")).withColumn("valid_at", F.col(base) + F.make_interval(hours=F.col("_h.hours"))).drop("_h")
