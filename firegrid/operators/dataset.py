"""Dataset construction, leakage checks and censuses."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import cell_disk, cell_parent
from ..functions.text import hash_order, row_checksum
from .spatial import exclude_near, near_by_strategy, top_per


#: Rows that a task of :func:`candidate_events` or :func:`variant_stats` holds, about.
ROWS_PER_TASK = 500_000


def _tasks(df: DataFrame, rows_per_task: int) -> tuple[int, bool]:
    """Tasks for so many rows each, and whether these are more than Spark's own."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = -(-df.count() // rows_per_task)
    return max(least, n), n > least


def candidate_events(events: DataFrame, labels: DataFrame, geography: DataFrame, combustibility: DataFrame, duplicates: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Events with their assessments and whether they are the later member of a certain duplicate. Tasks that join grow in number with the events."""
    n, more = _tasks(events, rows_per_task)
    later = duplicates.where("classification = 'certain_duplicate'").select(F.col("right").alias("id")).distinct().withColumn("duplicate", F.lit(True))
    t = (events.repartition(n, "id") if more else events).join(labels, "id").join(geography, "id").join(combustibility, "id", "left").join(later, "id", "left")
    return t.na.fill(False, ["duplicate"])


def positive_rows(events: DataFrame, strict: Column) -> DataFrame:
    """One row per cell and local day with an event that is no duplicate: the first event (day, id) stands for it; low confidence if any has it, strict if all are."""
    first = F.min(F.struct("date", "id", "combustible", "category"))
    t = events.where("not duplicate").groupBy("cell", "date").agg(first.alias("f"), F.bool_or("low_geo_confidence").alias("low_geo_confidence"), F.bool_and(strict).alias("strict"), F.count("*").alias("events"), F.array_sort(F.collect_list("id")).alias("ids"))
    return t.select("cell", "date", F.col("f.id").alias("id"), F.col("f.combustible").alias("combustible"), F.col("f.category").alias("category"), "low_geo_confidence", "strict", "events", "ids")


#: Why a row is left out, in order of precedence (fixed values).
REASONS = ["unknown_cause", "natural_cause", "indeterminate", "certain_duplicate", "insufficient_geographic_quality", "non_combustible_cell", "missing_features", "invalid_snapshot", "future_data", "out_of_period", "out_of_territory", "weather_unavailable", "technical_error"]

#: A strict row's reasons, the first that holds: without features nothing is known of the cell, and location matters only where it burns.
STRICT = ["missing_features", "non_combustible_cell", "insufficient_geographic_quality"]


def exclusion_reason(checks: dict[str, Column], order: list[str] = REASONS) -> Column:
    """The first reason in ``order`` whose check holds, null if none does; a null check doesn't hold."""
    unknown = set(checks) - set(REASONS)
    if unknown:
        raise ValueError(f"unknown reasons: {sorted(unknown)}")
    out = F.lit(None).cast("string")
    for name in reversed([r for r in order if r in checks]):
        out = F.when(checks[name], name).otherwise(out)
    return out


def exclusions(events: DataFrame, period: Column, checks: dict[str, Column], strict: dict[str, Column], positives: DataFrame) -> DataFrame:
    """``id, cell, date, reason`` of all that a build leaves out.

    Each event outside ``period``, else each later member of a certain duplicate,
    else each whose ``checks`` name a reason; and each cell-day of ``positives``
    that the strict rule refuses, with the first of its reasons and no event id.
    """
    reason = F.when(~F.coalesce(period, F.lit(False)), "out_of_period").when(F.col("duplicate"), "certain_duplicate").otherwise(exclusion_reason(checks))
    of_events = events.select("id", "cell", "date", reason.alias("reason")).where("reason is not null")
    of_days = positives.select(F.lit(None).cast(events.schema["id"].dataType).alias("id"), "cell", "date", exclusion_reason(strict, STRICT).alias("reason")).where("reason is not null")
    return of_events.unionByName(of_days)


def pilot_negatives(cells: DataFrame, years: list[int], n: int, seed: str) -> DataFrame:
    """Combustible cells on a fixed mid-June day of each year, the first ``n`` a year in hash order."""
    days = F.explode(F.array(*(F.make_date(F.lit(y), F.lit(6), F.lit(15)) for y in years))).alias("date")
    t = cells.where("combustible").select("cell", days)
    return top_per(t, ["date"], [hash_order(seed, F.col("cell"), F.col("date")), "cell"], n).drop("_n")


def draw_pool(cells: DataFrame, first: str, days: int, n: int, seed: int) -> DataFrame:
    """``n`` deterministic draws ``draw, cell, date`` from combustible cells and days, without repeats. Cells are numbered within 256 buckets of their md5 and across these; draws take numbers and days from md5 too."""
    spark = cells.sparkSession
    c = cells.where("combustible").select("cell")
    count = c.count()
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")
    bucket = F.conv(F.substring(F.md5(F.col("cell").cast("string")), 1, 2), 16, 10).cast("int")
    sizes = c.groupBy(bucket.alias("_b")).agg(F.count("*").alias("k"))
    offsets = sizes.select("_b", F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # 256 rows
    ranked = c.withColumn("_b", bucket).join(F.broadcast(offsets), "_b").select("cell", (F.row_number().over(Window.partitionBy("_b").orderBy("cell")) - 1 + F.col("base")).alias("rank"))
    draw = F.col("id").cast("string")
    draws = spark.range(n).select(F.col("id").alias("draw"), (number(F.lit(f"{seed}"), draw, F.lit("cell")) % max(count, 1)).alias("rank"), F.date_add(F.lit(first).cast("date"), (number(F.lit(f"{seed}"), draw, F.lit("day")) % days).cast("int")).alias("date"))
    return top_per(draws.join(ranked, "rank"), ["cell", "date"], ["draw"]).select("draw", "cell", "date")


def sample_negatives(cells: DataFrame, events: DataFrame, known: DataFrame, strategy: str, first: str, days: int, n: int, seed: int, oversample: int = 5, most: int = 40) -> DataFrame:
    """The first ``n`` draws that lie on no known event cell-day and outside all events' windows.

    If ``oversample * n`` draws hold fewer, they are doubled until ``n`` are found
    or ``most * n`` are drawn; what is missing then is reported by a warning. A
    draw depends on its number alone, so a larger pool begins as the smaller one.
    """
    known = known.select("cell", "date").distinct()
    while True:
        pool = draw_pool(cells, first, days, n * oversample, seed).join(known, ["cell", "date"], "left_anti")
        found = exclude_near(pool, events, strategy).orderBy("draw").limit(n)
        count = found.count()
        if count >= n or oversample >= most:
            break
        oversample = min(2 * oversample, most)
    if count < n:
        warnings.warn(f"{count} of {n} negatives found in {oversample * n} draws", stacklevel=2)
    return found


def stratified_select(candidates: DataFrame, positives: DataFrame, ratio: float, seed: str, resolution: int = 5) -> DataFrame:
    """Candidates by coarse cell and month in the positives' proportions: ``round(share * positives * ratio)`` of each, in hash order."""
    stratum = lambda t: t.withColumn("block", cell_parent(F.col("cell"), resolution)).withColumn("month", F.month("date"))
    # share * total * ratio is the stratum's own count times the ratio
    quota = stratum(positives).groupBy("block", "month").agg(F.floor(F.count("*") * ratio + 0.5).alias("quota"))
    t = stratum(candidates).join(quota, ["block", "month"])
    order = Window.partitionBy("block", "month").orderBy(hash_order(seed, F.col("cell"), F.col("date")), "cell", "date")
    return t.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def row_features(rows: DataFrame, features: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with coarse features and calendar flags; missing numbers count 0."""
    return rows.join(features, "cell", "left").join(calendar, "date", "left").na.fill(0, columns)


def build_variants(positives: DataFrame, negatives: dict[str, DataFrame]) -> DataFrame:
    """Strict and inclusive positives with each strategy's negatives: ``variant, label, cell, date, row_key``."""
    out = None
    for kind in ("strict", "inclusive"):
        p = positives.where("strict") if kind == "strict" else positives
        for name, neg in negatives.items():
            t = p.select("cell", "date", F.lit(1).alias("label")).unionByName(neg.select("cell", "date", F.lit(0).alias("label")))
            t = t.withColumn("variant", F.lit(f"{kind}_{name.lower()}"))
            out = t if out is None else out.unionByName(t)
    return out.withColumn("row_key", row_checksum(F.col("variant"), F.col("cell"), F.col("date"), F.col("label")))


def variant_stats(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per variant and label: rows, distinct keys with the first and last of them, and the days.

    Rows are dealt by key into as many tasks as they need, so a task holds about
    ``rows_per_task`` keys however long the table is.
    """
    by = ["variant", "label"]
    dealt = rows.select(*by, "row_key", "date").repartition(_tasks(rows, rows_per_task)[0], "row_key")
    keys = dealt.groupBy(*by, "row_key").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return keys.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))


def leakage_checks(rows: DataFrame, bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """Violations per rule: dates outside their split, cell-days in several splits, cell-days with both labels, repeated keys."""
    late = F.lit(False)
    for split, (a, b) in bounds.items():
        late = late | ((F.col("split") == split) & ~F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    per = rows.groupBy("cell", "date").agg(F.countDistinct("split").alias("s"), F.countDistinct("label").alias("l"))
    rule = lambda t, name: t.select(F.lit(name).alias("rule"), F.col("n").alias("violations"))
    return (
        rule(rows.agg(F.count_if(late).alias("n")), "date_outside_split")
        .unionByName(rule(per.agg(F.count_if(F.col("s") > 1).alias("n")), "cell_day_in_two_splits"))
        .unionByName(rule(per.agg(F.count_if(F.col("l") > 1).alias("n")), "cell_day_with_two_labels"))
        .unionByName(rule(rows.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("n")), "repeated_key"))
    )


def training_sample(events: DataFrame, cells: DataFrame, first: str, days: int, seed: str) -> DataFrame:
    """Known-human events on combustible cells, and a control for each sampled combustible cell: a hashed day of the interval, moved on to the next day without an event.

    After the interval's last day comes its first. A cell with an event on every
    day has no control.
    """
    burning = cells.where("combustible").select("cell")
    pos = events.where("category = 'human_known'").join(burning, "cell", "left_semi").select("cell", "date", F.lit(1).alias("label")).distinct()
    at = F.conv(F.substring(hash_order(seed, F.col("cell")), 1, 7), 16, 10).cast("long") % days
    want = burning.withColumn("at", at.cast("int"))
    taken = events.select("cell", F.datediff("date", F.lit(first).cast("date")).alias("day")).where(F.col("day").between(0, days - 1)).distinct()
    # days of one run of days with events have the same distance to their place
    place = Window.partitionBy("cell").orderBy("day")
    runs = taken.withColumn("run", F.col("day") - F.row_number().over(place)).groupBy("cell", "run").agg(F.min("day").alias("from"), F.max("day").alias("to"))
    whole = Window.partitionBy("cell")
    runs = runs.withColumn("head", F.max(F.when(F.col("from") == 0, F.col("to") + 1)).over(whole))  # the first free day, if day 0 has an event
    free = F.when(F.col("to") < days - 1, F.col("to") + 1).otherwise(F.coalesce("head", F.lit(0)))
    runs = runs.select(F.col("cell").alias("_cell"), "from", "to", F.when(free < days, free).otherwise(-1).alias("free"))
    moved = want.join(runs, (F.col("cell") == F.col("_cell")) & F.col("at").between(F.col("from"), F.col("to")), "left")
    moved = moved.withColumn("day", F.coalesce("free", "at")).where("day >= 0")
    return pos.unionByName(moved.select("cell", F.date_add(F.lit(first).cast("date"), F.col("day")).alias("date"), F.lit(0).alias("label")))


def coarsen_features(static: DataFrame, resolution: int, means: list[str]) -> DataFrame:
    """Means without nulls, combustible if any child is, and the number of children per coarse cell."""
    g = static.groupBy(cell_parent(F.col("cell"), resolution).alias("parent"))
    return g.agg(*(F.avg(c).alias(c) for c in means), F.bool_or("combustible").alias("combustible"), F.count("*").alias("children"))


def combustibility_sensitivity(static: DataFrame, rows: DataFrame, resolution: int) -> DataFrame:
    """How many rows stay under each rule for a coarse cell to count as combustible."""
    share = static.groupBy(cell_parent(F.col("cell"), resolution).alias("parent")).agg(F.avg(F.col("combustible").cast("double")).alias("share"))
    t = rows.withColumn("parent", cell_parent(F.col("cell"), resolution)).join(share, "parent")
    s = F.col("share")
    return t.agg(F.count("*").alias("rows"), F.count_if(s > 0).alias("any"), F.count_if(s > 0.5).alias("majority"), F.count_if(s >= 0.5).alias("half"), F.count_if(s >= 0.75).alias("three_quarters"))


def coarsening_census(static: DataFrame, resolution: int) -> DataFrame:
    """Coarse cells by number of children and by the share of them that burns."""
    p = static.groupBy(cell_parent(F.col("cell"), resolution).alias("parent")).agg(F.count("*").alias("n"), F.avg(F.col("combustible").cast("double")).alias("share"))
    s = F.col("share")
    return p.agg(F.count("*").alias("parents"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(s > 0).alias("any"), F.count_if(s > 0.5).alias("majority"), F.count_if(s >= 0.25).alias("quarter"), F.count_if(s >= 0.75).alias("three_quarters"), F.count_if((s > 0) != (s > 0.5)).alias("any_not_majority"))


def block_distribution(rows: DataFrame, resolution: int) -> DataFrame:
    """Least, nearest-rank median and most rows per coarse block."""
    n = rows.groupBy(cell_parent(F.col("cell"), resolution).alias("block")).agg(F.count("*").alias("n"))
    counts = n.groupBy("n").agg(F.count("*").alias("blocks"))
    w = Window.partitionBy(F.lit(0)).orderBy("n")  # one row per distinct count
    t = counts.withColumn("upto", F.sum("blocks").over(w)).withColumn("total", F.sum("blocks").over(Window.partitionBy(F.lit(0))))
    at = F.floor((F.col("total") - 1) * 0.5 + 0.5)
    return t.agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > at, F.col("n"))).alias("median"), F.max("n").alias("most"), F.max("total").alias("blocks"))


def feature_parity(rows: DataFrame, current: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Share of rows per feature whose stored value equals the current one; a value missing on one side is a mismatch."""
    now = current.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    t = rows.join(now, key, "left")
    same = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False))
    long = t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), same(c).cast("double").alias("m")) for c in columns))).alias("x"))
    return long.groupBy("x.feature").agg(F.avg("x.m").alias("match_rate"), F.count("*").alias("rows"))


def contamination(candidates: DataFrame, detections: DataFrame) -> DataFrame:
    """Candidates that share a cell, or a cell and day, with a detection; the detections' years."""
    cells = detections.select("cell").distinct().withColumn("_c", F.lit(1))
    days = detections.select("cell", "date").distinct().withColumn("_d", F.lit(1))
    t = candidates.join(cells, "cell", "left").join(days, ["cell", "date"], "left")
    return t.agg(F.count("*").alias("candidates"), F.count("_c").alias("same_cell"), F.count("_d").alias("same_cell_day")).crossJoin(detections.agg(F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year")))  # one row each


def probe_population(events: DataFrame, rings: tuple[int, ...] = (0, 1, 2, 3, 5), days: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """One probe cell per event, ring and day offset: the smallest cell of the ring."""
    near = F.transform(F.array(*map(F.lit, rings)), lambda k: F.struct(k.alias("ring"), F.array_min(F.transform(F.filter(cell_disk(F.col("cell"), max(rings)), lambda n: n["ring"] == k), lambda n: n["cell"])).alias("cell")))
    t = events.select("event", "date", F.explode(near).alias("p"))
    return t.select("event", "p.ring", "p.cell", F.explode(F.array(*map(F.lit, days))).alias("offset"), "date").withColumn("date", F.date_add("date", F.col("offset")))


def population_report(rows: DataFrame) -> DataFrame:
    """Rows, positives and cell-days per split that two scores have in common."""
    both = F.col("score").isNotNull() & F.col("score_b").isNotNull()
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(both).alias("comparable"), F.count_if(both & (F.col("label") == 1)).alias("positives"), F.countDistinct("cell", "date").alias("cell_days"))


#: A candidate's fixed bounds for promotion, and the least ROC AUC for a trained model to be activated (fixed values).
AT_LEAST = {"average_precision_gain": 0.0, "auc": 0.60, "lift_10": 1.5}
AT_MOST = {"brier": 0.20, "ece": 0.10}
LEAST_TRAINED_AUC = 0.52


def passes(metrics: DataFrame, least: dict[str, float] = AT_LEAST, most: dict[str, float] = AT_MOST) -> DataFrame:
    """Whether each metric row meets all bounds; a null metric meets none."""
    ok = F.lit(True)
    for name, bound in least.items():
        ok = ok & (F.col(name) >= bound)
    for name, bound in most.items():
        ok = ok & (F.col(name) <= bound)
    return metrics.withColumn("passes", F.coalesce(ok, F.lit(False)))


def exclusion_census(candidates: DataFrame, events: DataFrame, by: str = "cause") -> DataFrame:
    """How many candidates each strategy rules out, by an attribute of the event (a candidate may count under several)."""
    names = ["N0", "N1", "N2", "N3"]
    near = near_by_strategy(candidates, events, names, [by]).groupBy("key", by).agg(*(F.bool_or(s.lower()).alias(s.lower()) for s in names))
    found = near.groupBy(by).agg(*(F.count_if(F.col(s.lower())).alias(s.lower()) for s in names))
    return found.where("n0 + n1 + n2 + n3 > 0")
