"""Metrics of scores against labels. Scores are aggregated to their distinct values first, and ranks come from running sums over those."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, str], parts: int = 64) -> DataFrame:
    """Running sums *before* each row in descending ``order[0]``, in two levels: ranges between quantiles of it, then rows within a range. No task holds a whole group, however its values crowd; only rows of one equal value stay together."""
    name = order[0]
    cuts = df.agg(F.array_distinct(F.percentile_approx(name, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(10_000))).alias("_cuts"))
    t = df.crossJoin(F.broadcast(cuts)).withColumn("_cut", F.size(F.filter("_cuts", lambda c: c < F.col(name)))).drop("_cuts")  # one row
    totals = t.groupBy(*by, "_cut").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_cut", *(F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inner = Window.partitionBy(*by, "_cut").orderBy(F.desc(name), *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(totals, [*by, "_cut"])
    for n, c in sums.items():
        t = t.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return t.drop("_cut", *(f"_b_{n}" for n in sums))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve with mid-ranks for ties; 0.5 if one class is absent."""
    by = by or []
    g = df.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    r = running(g, by, [score], {"above_p": "p"})
    won = F.sum(F.col("n") * (F.col("above_p") + F.col("p") / 2.0))
    out = r.groupBy(*by).agg(won.alias("w"), F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return out.select(*by, F.coalesce(F.try_divide(F.col("w").cast("double"), (F.col("tp") * F.col("tn")).cast("double")), F.lit(0.5)).alias("auc"))


def average_precision(df: DataFrame, key: str, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Mean precision at each positive, rows in order of score, then key; 0 without positives."""
    by = by or []
    r = running(df.withColumn("_one", F.lit(1)), by, [score, key], {"rank": "_one", "tp": label})
    p = F.when(F.col(label) == 1, (F.col("tp") + 1) / (F.col("rank") + 1))
    return r.groupBy(*by).agg(F.coalesce(F.avg(p), F.lit(0.0)).alias("average_precision"))


def top_metrics(df: DataFrame, key: str, fractions: tuple[float, ...], score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """One row per group with ``k_1, precision_1, recall_1, lift_1`` and so on, by per cent: among the first ``max(1, ceil(n * f))`` rows by score, then key. Recall and lift are 0 without positives."""
    by = by or []
    n = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    ranked = running(df.withColumn("_one", F.lit(1)), by, [score, key], {"rank": "_one"})
    ranked = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))  # one row
    k = {f: F.greatest(F.lit(1), F.ceil(F.col("n") * f)) for f in fractions}
    t = ranked.groupBy(*by, "n", "positives").agg(*(F.count_if(F.col("rank") < c).alias(f"k_{_percent(f)}") for f, c in k.items()), *(F.sum(F.when(F.col("rank") < c, F.col(label)).otherwise(0)).alias(f"_tp_{_percent(f)}") for f, c in k.items()))
    for p in map(_percent, fractions):
        t = t.withColumn(f"precision_{p}", F.col(f"_tp_{p}") / F.col(f"k_{p}"))
        t = t.withColumn(f"recall_{p}", F.coalesce(F.try_divide(F.col(f"_tp_{p}").cast("double"), F.col("positives").cast("double")), F.lit(0.0)))
        t = t.withColumn(f"lift_{p}", F.coalesce(F.try_divide(F.col(f"precision_{p}"), F.col("positives") / F.col("n")), F.lit(0.0))).drop(f"_tp_{p}")
    return t.drop("n", "positives")


def _percent(fraction: float) -> str:
    return f"{100 * fraction:g}".replace(".", "_")


def at_top(df: DataFrame, key: str, fractions: tuple[float, ...], score: str = "score", label: str = "label") -> DataFrame:
    """:func:`top_metrics` of a whole table, a row per fraction."""
    rows = (F.struct(F.lit(f).alias("fraction"), *(F.col(f"{n}_{_percent(f)}").alias(n) for n in ("k", "precision", "recall", "lift"))) for f in fractions)
    return top_metrics(df, key, fractions, score, label).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def approx_auc(df: DataFrame, score: str = "score", label: str = "label", bins: int = 1000) -> DataFrame:
    """Area under the ROC curve from scores rounded to ``bins`` steps."""
    return roc_auc(df.withColumn(score, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) * bins + 0.5) / F.lit(float(bins))), score, label)


def ece(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over equal bins."""
    by = by or []
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    g = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("l"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("l"))) / F.sum("n")).alias("ece"))


def point_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Brier score, log-loss (scores clamped by 1e-12), precision, recall and F1 at a threshold."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(score)))
    y, hit = F.col(label), F.col(score) >= threshold
    c = lambda x: F.count_if(x).cast("double")
    t = df.groupBy(*(by or [])).agg(F.avg((F.col(score) - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), c(hit & (y == 1)).alias("tp"), c(hit & (y == 0)).alias("fp"), c(~hit & (y == 1)).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "fp", "fn")


def split_metrics(df: DataFrame, key: str, by: str, score: str = "score", label: str = "label", fractions: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """One row per split: rows and positive rate, ROC AUC, average precision, the point metrics, calibration error, and precision, recall and lift among the first rows."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("positive_rate"))
    for more in (roc_auc(df, score, label, [by]), average_precision(df, key, score, label, [by]), point_metrics(df, score, label, by=[by]), ece(df, score, label, by=[by]), top_metrics(df, key, fractions, score, label, [by])):
        out = out.join(more, by)
    return out


def baseline_rates(train: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Positive rates: overall, by month, by parent cell, and by both where there are ``least`` rows."""
    rate = F.avg("label")
    return train.agg(rate.alias("r0")), train.groupBy("month").agg(rate.alias("r1")), train.groupBy("parent").agg(rate.alias("r2"), F.count("*").alias("n2")).where(F.col("n2") >= least).drop("n2"), train.groupBy("parent", "month").agg(rate.alias("r3"), F.count("*").alias("n3")).where(F.col("n3") >= least).drop("n3")


def apply_baselines(df: DataFrame, rates) -> DataFrame:
    """The most specific rate there is for each row: both, parent, month, overall."""
    r0, r1, r2, r3 = rates
    return df.join(r3, ["parent", "month"], "left").join(r2, "parent", "left").join(r1, "month", "left").crossJoin(F.broadcast(r0)).withColumn("baseline", F.coalesce("r3", "r2", "r1", "r0")).drop("r0", "r1", "r2", "r3")


def disagreement(df: DataFrame, key: str, a: str, b: str, least: float = 0.5) -> DataFrame:
    """Rows whose rank percentiles by two scores lie more than ``least`` apart."""
    n = df.agg(F.count("*").alias("n"))
    one = df.withColumn("_one", F.lit(1))
    ra = running(one, [], [a, key], {"ra": "_one"}).select(key, "ra", a, b, "label")
    rb = running(one, [], [b, key], {"rb": "_one"}).select(key, "rb")
    t = ra.join(rb, key).crossJoin(F.broadcast(n))
    gap = (F.col("rb") - F.col("ra")) / F.greatest(F.col("n") - 1, F.lit(1))
    return t.withColumn("gap", gap).where(F.abs("gap") > least)


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """Of the positives: how many both scores have among their first ``k``, and how many only one."""
    one = df.withColumn("_one", F.lit(1))
    ra = running(one, [], [a, key], {"ra": "_one"}).select(key, "ra", "label")
    t = ra.join(running(one, [], [b, key], {"rb": "_one"}).select(key, "rb"), key).where("label = 1")
    in_a, in_b = F.col("ra") < k, F.col("rb") < k
    return t.agg(F.count_if(in_a & in_b).alias("both"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(~in_a & in_b).alias("only_b"), F.count_if(~in_a & ~in_b).alias("neither"))


def drawn_dates(df: DataFrame, unit: str, rounds: int, seed: int) -> DataFrame:
    """``round, <unit>, w``: how often each round draws each date, as many draws with replacement as there are dates. A date's number and a draw's pick come from md5, so draws are the same everywhere."""
    dates = df.select(unit).distinct()
    n = dates.count()
    numbered = dates.withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(unit)) - 1)  # dates are few
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("i"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    return draws.select("round", pick.cast("int").alias("_no")).groupBy("round", "_no").agg(F.count("*").alias("w")).join(numbered, "_no").drop("_no")


#: Draws (rounds times dates) that go to all tasks as a matrix.
MOST_DRAWS = 20_000_000


def bootstrap(df: DataFrame, scores: list[str], label: str = "label", unit: str = "date", rounds: int = 200, seed: int = 11, steps: int = 1000) -> DataFrame:
    """``round, score, auc, average_precision, brier`` on ``rounds`` draws of whole dates with replacement; all scores take the same draws.

    Rows are summed up by date and score first, scores rounded to ``steps`` steps
    for the ranked metrics, so at most ``steps + 1`` rows a date and score go on,
    however long the table is. The draws are a matrix of rounds by dates (at most
    ``MOST_DRAWS`` entries, else ValueError); each step's sums by date are
    multiplied by it, which gives the step's sums in every round at once, and of a
    score one task takes ``steps + 1`` such rows. Rows of one step share the
    precision at its end.
    """
    step = lambda s: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(s))) * steps + 0.5)
    long = df.select(unit, F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(s).alias("score"), step(s).alias("s"), F.pow(F.col(s) - F.col(label), 2).alias("e")) for s in scores))).alias("x")).select(unit, "y", "x.*")
    sums = long.groupBy(unit, "score", "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.sum("e").alias("e"))
    sums = staged(sums.select(F.col(unit).cast("string").alias("unit"), "score", "s", *(F.col(c).cast("double").alias(c) for c in "pne")), "sums")
    days = sums.select("unit").distinct().orderBy("unit")
    if days.limit(MOST_DRAWS // rounds + 1).count() > MOST_DRAWS // rounds:
        raise ValueError("too many draws: take fewer rounds or longer units")
    names = pa.array([r["unit"] for r in days.collect()], pa.string())  # checked above
    draws = drawn_dates(sums.select("unit"), "unit", rounds, seed).toArrow()
    weights = np.zeros((rounds, len(names)))
    weights[draws["round"].to_numpy(), pc.index_in(draws["unit"], names).to_numpy()] = draws["w"].to_numpy()

    def multiply(table: pa.Table) -> pa.Table:
        """Sums of each step in every round, by blocks of steps."""
        at = pc.index_in(table["unit"], names).to_numpy()
        step_of, own = np.unique(table["s"].to_numpy(), return_inverse=True)
        out = []
        for c in "pne":
            by_step = np.zeros((len(names), len(step_of)))
            by_step[at, own] = table[c].to_numpy()
            out.append(pa.array((weights @ by_step).T.tolist(), pa.list_(pa.float64())))
        return pa.table({"score": pa.array([table["score"][0].as_py()] * len(step_of), pa.string()), "s": pa.array(step_of, pa.int64()), **dict(zip("pne", out, strict=True))})

    def measure(table: pa.Table) -> pa.Table:
        """A score's metrics in every round from its steps, the highest first."""
        order = np.argsort(-table["s"].to_numpy())
        p, n, e = (np.array(table[c].to_pylist())[order] for c in "pne")
        above_p, above_n = np.cumsum(p, 0) - p, np.cumsum(n, 0) - n
        tp, tn = p.sum(0), n.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            auc = (n * (above_p + p / 2)).sum(0) / (tp * tn)
            hit = np.nansum(p * (above_p + p) / (above_p + p + above_n + n), 0) / tp
            brier = e.sum(0) / (tp + tn)
        metrics = np.where(tp * tn > 0, auc, 0.5), np.where(tp > 0, hit, 0.0), brier
        return pa.table({"round": pa.array(np.arange(rounds)), "score": pa.array([table["score"][0].as_py()] * rounds, pa.string()), **{m: pa.array(v) for m, v in zip(BOOTSTRAPPED, metrics, strict=True)}})

    blocks = sums.groupBy("score", F.floor(F.col("s") / 50).alias("_block")).applyInArrow(multiply, "score string, s long, p array<double>, n array<double>, e array<double>")
    return blocks.groupBy("score").applyInArrow(measure, "round long, score string, auc double, average_precision double, brier double")


BOOTSTRAPPED = ["auc", "average_precision", "brier"]


def differences(rounds: DataFrame, a: str, b: str) -> DataFrame:
    """Per round the metrics of score ``a`` minus those of ``b``, from the same draws."""
    of = lambda s, sign: rounds.where(F.col("score") == s).select("round", *((sign * F.col(m)).alias(m) for m in BOOTSTRAPPED))
    return of(a, 1).unionByName(of(b, -1)).groupBy("round").agg(*(F.sum(m).alias(m) for m in BOOTSTRAPPED))


def interval(rounds: DataFrame, names: list[str]) -> DataFrame:
    """2.5 and 97.5 % points of bootstrapped metrics."""
    return rounds.agg(*(F.percentile(n, F.lit(q)).alias(f"{n}_{label}") for n in names for q, label in ((0.025, "low"), (0.975, "high"))))


def feature_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group and feature: present and missing rows, mean, population deviation, nearest-rank 5, 50 and 95 % points, extremes."""
    keys = [*(by or []), "feature"]
    long = df.select(*(by or []), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*(by or []), "x.*")
    base = long.groupBy(*keys).agg(F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    values = long.where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    span = values.join(base.select(*keys, "lo", "hi", "present"), keys)
    scaled = span.withColumn("_s", F.when(F.col("hi") > F.col("lo"), 1 - (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    r = running(scaled, keys, ["_s"], {"before": "n"})
    at = lambda q: F.floor((F.col("present") - 1) * q + 0.5)
    holds = lambda q: (F.col("before") <= at(q)) & (at(q) < F.col("before") + F.col("n"))
    points = r.groupBy(*keys).agg(*(F.max(F.when(holds(q), F.col("v"))).alias(name) for q, name in ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))))
    return base.join(points, keys)


def part_stats(df: DataFrame, parts: list[Column], columns: list[str], accuracy: int = 1_000) -> list[dict]:
    """:func:`feature_stats` of every part of the rows (a condition; parts may overlap), without the extremes; a feature that a part has no value of is left out. ``part`` numbers the parts.

    Nothing is sorted or shuffled whole: approximate quantiles on both sides of a
    point bound it, and only what lies between is counted by value, some
    ``4 / accuracy`` of the rows. Where a bound doesn't hold, wider ones are taken.
    """
    names = [f"_v{k}" for k in range(len(columns))]
    t = staged(df.select(*(F.coalesce(p, F.lit(False)).alias(f"_p{k}") for k, p in enumerate(parts)), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))), "parts")
    sets = [(k, c, n) for k in range(len(parts)) for c, n in zip(columns, names, strict=True)]
    of = {(k, c): F.when(F.col(f"_p{k}"), F.col(n)) for k, c, n in sets}
    points, margins = {"p05": 0.05, "median": 0.5, "p95": 0.95}, [2 / accuracy, 20 / accuracy, 200 / accuracy]
    plain = iter(t.agg(*(x for k, c, n in sets for x in (F.count(of[k, c]), F.count_if(F.col(f"_p{k}") & F.col(n).isNull()), F.avg(of[k, c]), F.stddev_pop(of[k, c]), F.min(of[k, c]), F.max(of[k, c])))).first())
    sides = F.array(*(F.lit(min(max(q + side * m, 0.0), 1.0)) for q in points.values() for m in margins for side in (-1, 1)))
    near = t.agg(*(F.percentile_approx(of[k, c], sides, F.lit(accuracy)) for k, c, _ in sets)).first()
    out, bounds = {}, {}
    for (k, c, _), cuts in zip(sets, near, strict=True):
        present, missing, mean, sd, low, high = (next(plain) for _ in range(6))
        if present:
            out[k, c] = {"part": k, "feature": c, "present": present, "missing": missing, "mean": mean, "sd": sd}
            for at, (name, q) in enumerate(points.items()):
                own = cuts[2 * len(margins) * at : 2 * len(margins) * (at + 1)]
                bounds[k, c, name] = math.floor((present - 1) * q + 0.5), [*zip(own[::2], own[1::2], strict=True), (low, high)]
    for turn in range(len(margins) + 1):
        left = [(key, place, tries[turn]) for key, (place, tries) in bounds.items() if key[2] not in out[key[:2]]]
        if not left:
            break
        below = t.agg(*(F.count_if(of[key[:2]] < low) for key, _, (low, _) in left)).first()
        inside = reduce(or_, (of[key[:2]].between(low, high) for key, _, (low, high) in left))
        hits = (F.when(of[key[:2]].between(low, high), F.struct(F.lit(i).alias("i"), of[key[:2]].alias("v"))) for i, (key, _, (low, high)) in enumerate(left))
        counts = t.where(inside).select(F.explode(F.array_compact(F.array(*hits))).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
        place = F.element_at(F.array(*(F.lit(place - b) for (_, place, _), b in zip(left, below, strict=True))), F.col("i") + 1)
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
        for r in upto.where((place >= F.col("upto") - F.col("n")) & (place < F.col("upto"))).select("i", "v").collect():  # one a point
            key = left[r["i"]][0]
            out[key[:2]][key[2]] = r["v"]
    return list(out.values())


def _pooled(table: pa.Table) -> pa.Table:
    """Adjacent violators pooled, over rows ``x, s, w``: the last score, sum of labels and weight of each block."""
    table = table.sort_by("x")
    blocks: list[list[float]] = []
    for x, s, w in zip(*(table[c].to_pylist() for c in "xsw"), strict=True):
        while blocks and blocks[-1][1] * w >= s * blocks[-1][2]:
            _, s2, w2 = blocks.pop()
            s, w = s + s2, w + w2
        blocks.append([x, s, w])
    return pa.table({c: pa.array([b[k] for b in blocks], pa.float64()) for k, c in enumerate("xsw")})


def isotonic_blocks(df: DataFrame, score: str = "score", label: str = "label", rows: int = 100_000) -> DataFrame:
    """Pool-adjacent-violators blocks ``x_max, value`` of labels over scores.

    Distinct scores are cut into ranges of about ``rows`` and pooled within them.
    Neighbouring ranges whose boundary still violates the order are then pooled
    together, two and two, odd and even in turn, and parted again where they were:
    no range grows, so no task holds over two of them, and when no boundary
    violates, the blocks of all ranges are those of the whole. Null scores and
    labels take no part.
    """
    g = staged(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(label).cast("double").alias("s"), F.count("*").cast("double").alias("w")), "scores")
    n = max(1, -(-g.count() // rows))
    cut = g.repartitionByRange(n, "x").withColumn("range", F.spark_partition_id()) if n > 1 else g.withColumn("range", F.lit(0))
    schema = "range int, x double, s double, w double"

    def within(table: pa.Table) -> pa.Table:
        return _keep(_pooled(table), [(None, table["range"][0].as_py())])

    def _keep(table: pa.Table, ends: list) -> pa.Table:
        """Blocks with their range: ``ends`` are ``(last score or None, range)``."""
        own = [next(r for end, r in ends if end is None or x <= end) for x in table["x"].to_pylist()]
        return pa.table({"range": pa.array(own, pa.int32()), **{c: table[c] for c in "xsw"}})

    def together(table: pa.Table) -> pa.Table:
        """Two ranges pooled as one, parted at the first one's last score."""
        ranges = sorted(set(table["range"].to_pylist()))
        ends = [(max(x for x, r in zip(table["x"].to_pylist(), table["range"].to_pylist(), strict=True) if r == ranges[0]), ranges[0]), (None, ranges[-1])]
        return _keep(_pooled(table), ends if len(ranges) > 1 else [(None, ranges[0])])

    blocks = staged(cut.groupBy("range").applyInArrow(within, schema), "pooled")
    turn, quiet = 0, 0
    while n > 1:
        value = F.col("s") / F.col("w")
        order = Window.orderBy("range")  # a row per range
        edges = blocks.groupBy("range").agg(F.min_by(value, "x").alias("first"), F.max_by(value, "x").alias("last")).withColumn("k", F.row_number().over(order)).withColumn("before", F.lag("last").over(order)).withColumn("other", F.lag("range").over(order))
        bad = edges.where(F.col("before") >= F.col("first"))
        mine = bad.where(F.col("k") % 2 == turn).select("other", "range")
        pairs = staged(mine.select(F.col("other").alias("pair"), F.explode(F.array("other", "range")).alias("range")), "pairs")
        turn = 1 - turn
        if pairs.isEmpty():
            quiet += 1
            if quiet == 2:  # neither odd nor even boundaries violate
                break
            continue
        quiet = 0
        merged = blocks.join(pairs, "range").groupBy("pair").applyInArrow(together, schema)
        blocks = staged(blocks.join(pairs, "range", "left_anti").select("range", "x", "s", "w").unionByName(merged), "pooled")
    return blocks.select(F.col("x").alias("x_max"), (F.col("s") / F.col("w")).alias("value"))


def apply_isotonic(df: DataFrame, blocks: list[tuple[float, float]], score: str = "score") -> DataFrame:
    """A step function: the first block whose ``x_max`` reaches the score, else the last."""
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(v).alias("v")) for x, v in sorted(blocks)))
    reached = F.get(F.filter(steps, lambda b: b["x"] >= F.col(score)), F.lit(0))["v"]
    return df.withColumn("calibrated", F.coalesce(reached, F.element_at(steps, -1)["v"]))
