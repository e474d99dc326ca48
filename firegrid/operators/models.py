"""Model fitting with MLlib, calibration and validation schemes."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .boosting import fit_boosted, score_boosted, split_counts
from .metrics import ece, part_stats, point_metrics, roc_auc


def fit_transform(train: DataFrame, scaling: dict[str, str]) -> dict[str, tuple[str, float, float, float]]:
    """Per feature its scaling, fill value, centre and scale from the training rows; features with over half missing are left out."""
    return fit_transforms(train, [F.lit(True)], scaling)[0]


def fit_transforms(df: DataFrame, parts: list[Column], scaling: dict[str, str]) -> list[dict[str, tuple[str, float, float, float]]]:
    """As :func:`fit_transform` for every part of the rows (a condition; parts may overlap), all together."""
    rules: list[dict] = [{} for _ in parts]
    for r in part_stats(df, parts, list(scaling)):
        if r["missing"] > r["present"]:
            continue
        kind = scaling[r["feature"]]
        centre, scale = {"standard": (r["mean"], r["sd"]), "robust": (r["median"], r["p95"] - r["p05"])}.get(kind, (0.0, 1.0))
        rules[r["part"]][r["feature"]] = (kind, float(r["median"]), float(centre), float(scale) or 1.0)
    return rules


def scaled(rules: dict[str, tuple[str, float, float, float]]) -> dict[str, Column]:
    """The columns of :func:`transform`."""
    out = {}
    for name, (kind, fill, centre, scale) in rules.items():
        v = F.coalesce(F.col(name).cast("double"), F.lit(fill))
        out[name] = F.log1p(F.greatest(v, F.lit(0.0))) if kind == "log1p" else (v - centre) / scale
    return out


def transform(df: DataFrame, rules: dict[str, tuple[str, float, float, float]]) -> DataFrame:
    """Missing values filled with the training median, then scaled."""
    return df.withColumns(scaled(rules))


def _assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_logistic(df: DataFrame, columns: list[str], l2: float = 0.01, weight: str | None = None):
    """L2 logistic regression (L-BFGS on the same penalised objective as gradient descent)."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, maxIter=100)
    return (model.setWeightCol(weight) if weight else model).fit(_assemble(df, columns))


def _logistic(xs: list[Column], weights: list[float], bias: float) -> Column:
    return 1 / (1 + F.exp(-sum((F.lit(w) * x for x, w in zip(xs, weights, strict=True)), F.lit(bias))))


def fit_descent(df: DataFrame, columns: list[str], l2: float = 0.01, steps: int = 300, rate: float = 0.3, label: str = "label") -> tuple[list[float], float]:
    """Weights and bias of logistic regression after so many full-batch gradient steps from zero; the penalty leaves the bias alone.

    An empty table gives zeros. For a converged fit use :func:`fit_logistic`.
    """
    return fit_descents(df, [(F.lit(True), [F.col(c) for c in columns], F.lit(1.0))], [l2], steps, rate, label)[0][0]


def fit_descents(df: DataFrame, parts: list[tuple[Column, list[Column], Column]], penalties: list[float], steps: int = 300, rate: float = 0.3, label: str = "label") -> list[list[tuple[list[float], float]]]:
    """As :func:`fit_descent`, for every part (which rows train, features, weight of a row) and penalty at once.

    The table is written down once with what the parts need, packed; a step is one
    pass over it that takes all gradients in NumPy, block by block, so folds, years and
    penalties cost one pass together, and only gradients reach the driver. A row
    that lacks its label, weight or a feature does not train; a part without rows
    gives zeros.
    """
    given = [(train, F.lit(False), weight, [(x, None) for x in xs]) for train, xs, weight in parts]
    t, features = _descent_rows(df, given, label)
    return _descend(t.drop("label"), features, penalties, steps, rate)


def _descent_rows(df: DataFrame, parts: list[tuple[Column, Column, Column, list]], label: str = "label") -> tuple[DataFrame, list[tuple[str, list[tuple[str, tuple | None]]]]]:
    """The rows that any part trains on or holds out, written down: ``label``, its number ``_y``, the parts that train on the row and those that hold it out as bits of ``_t`` and ``_h``, weights ``_w<k>`` and features ``_x<k>`` not yet scaled, those that parts share once. Also each part's weight column and its features: column and rule of :func:`scaled`, if any. Takes up to 62 parts."""
    if len(parts) > 62:
        raise ValueError("too many parts: a bit each")
    y, raw, used, features = F.col(label).cast("double"), {}, {}, []
    trains, holds = F.lit(0).cast("long"), F.lit(0).cast("long")
    for p, (train, held, weight, xs) in enumerate(parts):
        own = used.setdefault(id(weight), (f"_w{len(used)}", weight))[0]
        features.append((own, [(raw.setdefault(id(x), (f"_x{len(raw)}", x))[0], rule) for x, rule in xs]))
        there = reduce(and_, (c.isNotNull() for c in (y, weight, *(x for x, rule in xs if rule is None))), train)
        bit = lambda c, p=p: F.when(c, F.lit(1 << p).cast("long")).otherwise(F.lit(0).cast("long"))
        trains, holds = trains.bitwiseOR(bit(there)), holds.bitwiseOR(bit(held))
    t = df.select(F.col(label).alias("label"), y.alias("_y"), trains.alias("_t"), holds.alias("_h"), *(c.cast("double").alias(n) for n, c in (*used.values(), *raw.values())))
    return staged(t.where("_t <> 0 or _h <> 0"), "descent"), features


def _scaled_values(v: np.ndarray, missing: np.ndarray | None, rule: tuple | None) -> np.ndarray:
    """A feature's numbers scaled as by :func:`scaled`."""
    kind, fill, centre, scale = rule or (None, 0.0, 0.0, 1.0)
    v = v if missing is None else np.where(missing, fill, v)
    return v if kind is None else np.log1p(np.maximum(v, 0.0)) if kind == "log1p" else (v - centre) / scale


def _taken(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A column's numbers in some rows of a batch, and which are missing, if any."""
    column = batch[name]
    missing = column.is_null().to_numpy(zero_copy_only=False)[rows] if column.null_count else None
    return column.fill_null(0.0).to_numpy()[rows], missing


def _descent_blocks(t: DataFrame, weights: list[str], names: list[str]) -> DataFrame:
    """The rows of :func:`_descent_rows` that train, packed and written: a row for up to a batch of those that the same parts ``t`` train on, with its label and features as bytes (and which are missing, if any), and by part the weights (one for all, if they are equal). A step then reads some bytes a row and no rows."""

    def pack(batches):
        for batch in batches:
            trains, out = batch["_t"].to_numpy(), []
            for kind in np.unique(trains):
                rows = np.flatnonzero(trains == kind)
                ws = [_taken(batch, n, rows)[0] for n in weights]
                xs = [_taken(batch, n, rows) for n in names]
                out.append((int(kind), _taken(batch, "_y", rows)[0].tobytes(), [x.tobytes() for x, _ in xs], [None if m is None else m.tobytes() for _, m in xs], [w[:1].tobytes() if (w == w[0]).all() else w.tobytes() for w in ws]))
            if out:
                kinds = [pa.int64(), pa.binary(), *[pa.list_(pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "y", "x", "missing", "w"])

    rows = t.where("_t <> 0").select("_t", "_y", *weights, *names)
    return staged(rows.mapInArrow(pack, "t long, y binary, x array<binary>, missing array<binary>, w array<binary>"), "blocks")


def _sigmoid(xs: list[np.ndarray], weights: list[float], bias: float, rows: int) -> np.ndarray:
    z = np.full(rows, bias)
    for w, x in zip(weights, xs, strict=True):
        z += w * x
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _descend(t: DataFrame, features: list[tuple[str, list[tuple[str, tuple | None]]]], penalties: list[float], steps: int, rate: float) -> list[list[tuple[list[float], float]]]:
    """Steps from zero over the rows of :func:`_descent_rows`."""
    fits = [[([0.0] * len(xs), 0.0) for _ in penalties] for _, xs in features]
    weights_of, names = ([c for c in t.columns if c.startswith(start)] for start in ("_w", "_x"))
    at = [(weights_of.index(weight), [(names.index(n), rule) for n, rule in own]) for weight, own in features]
    blocks = _descent_blocks(t, weights_of, names)

    def gradients(batches):
        """Of a task, for every part its mass and for each penalty the gradients of bias and weights."""
        sums = None
        for batch in batches:
            for block in range(batch.num_rows):
                y = np.frombuffer(batch["y"][block].as_buffer())
                xs = [np.frombuffer(v.as_buffer()) for v in batch["x"][block]]
                missing = [np.frombuffer(m.as_buffer(), bool) if m.is_valid else None for m in batch["missing"][block]]
                own = []
                trains, ws = batch["t"][block].as_py(), [np.frombuffer(w.as_buffer()) for w in batch["w"][block]]
                for p, (weight, columns) in enumerate(at):
                    if not trains >> p & 1:
                        own += [0.0] * (1 + len(fits[p]) * (1 + len(columns)))
                        continue
                    w, scaled_xs = np.broadcast_to(ws[weight], y.shape), [_scaled_values(xs[k], missing[k], rule) for k, rule in columns]
                    own.append(w.sum())
                    for weights, bias in fits[p]:
                        error = w * (_sigmoid(scaled_xs, weights, bias, len(y)) - y)
                        own += [error.sum(), *((error * x).sum() for x in scaled_xs)]
                sums = np.array(own) if sums is None else sums + own
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["g"])

    for _ in range(steps):
        tasks = [r["g"] for r in blocks.mapInArrow(gradients, "g array<double>").collect()]  # a row a task
        if not tasks:
            break
        got = iter([math.fsum(g) for g in zip(*tasks, strict=True)])
        new = []
        for own in fits:
            mass, moved = next(got), []
            for l2, (weights, bias) in zip(penalties, own, strict=True):
                down, *slopes = [next(got) for _ in range(len(weights) + 1)]
                moved.append(([w - rate * (g / mass + l2 * w) for w, g in zip(weights, slopes, strict=True)], bias - rate * down / mass) if mass else (weights, bias))
            new.append(moved)
        fits = new
    return fits


def score_descent(df: DataFrame, columns: list[str], weights: list[float], bias: float, name: str = "fitted") -> DataFrame:
    return df.withColumn(name, _logistic([F.col(c) for c in columns], weights, bias))


def score_with(model, df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(_assemble(df, columns)).withColumn("fitted", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_and_score(df: DataFrame, columns: list[str], kind: str, first_test: int = 1999) -> DataFrame:
    """Fit on earlier years and score the later ones."""
    t = staged(df.select("id", "label", "year", *columns), "years")
    rules = fit_transform(t.where(F.col("year") < first_test), {c: "standard" for c in columns})
    t = transform(t, rules)
    train, later = t.where(F.col("year") < first_test), t.where(F.col("year") >= first_test)
    scored = score_with(fit_logistic(train, list(rules)), later, list(rules)) if kind == "logistic" else score_boosted(later, fit_boosted(train, list(rules)))
    return scored.select("id", "label", "fitted")


def platt(df: DataFrame, score: str = "score") -> DataFrame:
    """Logistic calibration of one score."""
    model = fit_logistic(df, [score], 0.0)
    return score_with(model, df, [score]).withColumnRenamed("fitted", "calibrated")


def _descended(df: DataFrame, parts: list[tuple[dict[str, Column], Column, Column, Column, dict]], penalties: list[float], steps: int, rate: float = 0.3) -> DataFrame:
    """``label, fitted, l2`` and a part's names, of the rows that each part holds out; ``parts``: names, rows that train, rows held out, weight, scaling."""
    columns = {name: F.col(name) for *_, rules in parts for name in rules}
    t, features = _descent_rows(df, [(train, held, weight, [(columns[name], rule) for name, rule in rules.items()]) for _, train, held, weight, rules in parts])
    fits = _descend(t.drop("label"), features, penalties, steps, rate)
    kind = t.schema["label"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            held = batch["_h"].to_numpy()
            for p, (_, names) in enumerate(features):
                rows = np.flatnonzero(held >> p & 1)
                xs, label = [_scaled_values(*_taken(batch, n, rows), rule) for n, rule in names], batch["label"].take(pa.array(rows))
                for m, fit in enumerate(fits[p]):
                    constant = [pa.array(np.full(len(rows), k, np.int32)) for k in (p, m)]
                    yield pa.RecordBatch.from_arrays([label, pa.array(_sigmoid(xs, *fit, len(rows))), *constant], ["label", "fitted", "_p", "_m"])

    scored = t.where("_h <> 0").select("label", "_h", *(c for c in t.columns if c.startswith("_x"))).mapInArrow(score, f"label {kind}, fitted double, _p int, _m int")
    named = F.element_at(F.array(*(F.struct(*(c.alias(n) for n, c in names.items())) for names, *_ in parts)), F.col("_p") + 1)
    l2 = F.element_at(F.array(*(F.lit(float(v)) for v in penalties)), F.col("_m") + 1)
    return scored.select("label", "fitted", l2.alias("l2"), named.alias("_s")).select("label", "fitted", "l2", "_s.*")


def forward_cv(df: DataFrame, columns: list[str], years: list[int], penalties: list[float], steps: int | None = None) -> DataFrame:
    """``year, l2, auc, brier`` for each penalty and validation year: fitted on earlier years, with their statistics only, and measured on that year. With ``steps``, all fits descend together (:func:`fit_descents`)."""
    y, scored = F.col("year"), None
    t = staged(df.select("label", "year", *columns), "years")
    rules = fit_transforms(t, [y < year for year in years], {c: "standard" for c in columns})
    if steps:
        one = F.lit(1.0)
        parts = [({"year": F.lit(year)}, y < year, y == year, one, own) for year, own in zip(years, rules, strict=True)]
        return _measured(_descended(t, parts, penalties, steps), ["year", "l2"])
    for year, own in zip(years, rules, strict=True):
        both = transform(t, own)
        for l2 in penalties:
            model = fit_logistic(both.where(y < year), list(own), l2)
            s = score_with(model, both.where(y == year), list(own)).select(F.lit(year).alias("year"), F.lit(float(l2)).alias("l2"), "label", "fitted")
            scored = s if scored is None else scored.unionByName(s)
    return _measured(scored, ["year", "l2"])


def forward_cv_boosted(df: DataFrame, columns: list[str], years: list[int], grid: list[tuple[int, int, float]], least_rows: int = 100) -> DataFrame:
    """As :func:`forward_cv` for boosted trees: ``year, rounds, depth, rate, auc, brier``. A year with under ``least_rows`` rows before it, or none of its own, is left out; without any year the table is empty."""
    y = F.col("year")
    sizes = df.agg(*(F.count_if(c) for year in years for c in (y < year, y == year))).first()
    scored = df.sparkSession.createDataFrame([], "year int, rounds int, depth int, rate double, label int, fitted double")
    years = [year for year, before, own in zip(years, sizes[::2], sizes[1::2], strict=True) if before >= least_rows and own]
    for year, rules in zip(years, fit_transforms(df, [y < year for year in years], {c: "standard" for c in columns}) if years else [], strict=True):
        t = staged(transform(df.where(y <= year), rules).select("year", "label", *rules), "years")
        for rounds, depth, rate in grid:
            model = fit_boosted(t.where(y < year), list(rules), rounds=rounds, depth=depth, rate=rate)
            named = {"year": F.lit(year), "rounds": F.lit(rounds), "depth": F.lit(depth), "rate": F.lit(float(rate))}
            scored = scored.unionByName(score_boosted(t.where(y == year), model).select(*(c.alias(n) for n, c in named.items()), F.col("label").cast("int").alias("label"), "fitted"))
    return _measured(scored, ["year", "rounds", "depth", "rate"])


def choose(measured: DataFrame, by: list[str]) -> DataFrame:
    """``by, auc, years``: the setting of largest mean ROC AUC over the validation years (ties: the smallest in the order of ``by``); one row, none of an empty table."""
    means = measured.groupBy(*by).agg(F.avg("auc").alias("auc"), F.count("*").alias("years"))
    return means.orderBy(F.desc("auc"), *by).limit(1)


def _measured(scored: DataFrame, by: list[str]) -> DataFrame:
    """ROC AUC and Brier score of ``label, fitted`` in each group, from one table of all groups."""
    t = staged(scored, "scored")
    return roc_auc(t, "fitted", by=by).join(point_metrics(t, "fitted", by=by).select(*by, "brier"), by)


def spatial_fold(parent: Column, folds: int = 5) -> Column:
    """Fold of a coarse cell."""
    return F.pmod(parent, F.lit(folds)).cast("int")


def spatial_cv(df: DataFrame, columns: list[str], folds: int = 5, steps: int | None = None) -> DataFrame:
    """``fold, auc, brier``: fitted without each fold of coarse cells, with the statistics of the rest, and measured on it. With ``steps``, all fits descend together (:func:`fit_descents`)."""
    t, fold, scored = staged(df.select("label", spatial_fold(F.col("parent"), folds).alias("fold"), *columns), "folds"), F.col("fold"), None
    rules = fit_transforms(t, [fold != k for k in range(folds)], {c: "standard" for c in columns})
    if steps:
        one = F.lit(1.0)
        parts = [({"fold": F.lit(k)}, fold != k, fold == k, one, own) for k, own in enumerate(rules)]
        return _measured(_descended(t, parts, [0.01], steps), ["fold"])
    for k, own in enumerate(rules):
        s = transform(t, own)
        held = score_with(fit_logistic(s.where(fold != k), list(own)), s.where(fold == k), list(own)).select("fold", "label", "fitted")
        scored = held if scored is None else scored.unionByName(held)
    return _measured(scored, ["fold"])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights that give both classes equal mass."""
    n = df.agg(F.count("*").alias("n"))
    return df.groupBy(label).agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select(label, (F.col("n") / (2.0 * F.col("k"))).alias("weight"))  # one row


def feature_importances(train: DataFrame, columns: list[str], rounds: int = 10) -> DataFrame:
    """``feature, coefficient, splits``: of a logistic model, and how many splits boosted trees have on it, both on the same standardised rows."""
    rules = fit_transform(train, {c: "standard" for c in columns})
    t, names = staged(transform(train, rules), "standardised"), list(rules)
    linear, splits = fit_logistic(t, names).coefficients.toArray(), split_counts(fit_boosted(t, names, rounds=rounds))
    return train.sparkSession.createDataFrame([(n, float(c), splits[n]) for n, c in zip(names, linear, strict=True)], "feature string, coefficient double, splits long")


def repeats(df: DataFrame, label: str = "label") -> DataFrame:
    """``repeats``: how often a positive row counts so that both classes weigh about the same: negatives over positives, rounded, 1 at least."""
    t = df.agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    return t.select(F.coalesce(F.greatest(F.lit(1), F.floor((F.col("n") - F.col("p")) / F.nullif("p", F.lit(0)) + 0.5)), F.lit(1)).cast("long").alias("repeats"))


def compare_weighting(train: DataFrame, calibration: DataFrame, columns: list[str], l2: float = 0.01, steps: int | None = None) -> DataFrame:
    """``weighting, auc, brier, log_loss, ece`` on the calibration rows, of a logistic fit on the training rows as they are and with positives counted :func:`repeats` times; both take the training rows' scaling. With ``steps``, both fits descend together (:func:`fit_descents`)."""
    rules = fit_transform(train, {c: "standard" for c in columns})
    names, by, scored = list(rules), ["weighting"], None
    weight = F.when(F.col("label") == 1, F.lit(float(repeats(train).first()[0]))).otherwise(1.0)
    if steps:
        both = train.select("label", *columns, F.lit(False).alias("_held")).unionByName(calibration.select("label", *columns, F.lit(True).alias("_held")))
        parts = [({"weighting": F.lit(name)}, ~F.col("_held"), F.col("_held"), w, rules) for name, w in (("none", F.lit(1.0)), ("class", weight))]
        scored = _descended(both, parts, [l2], steps)
    else:
        t, held = staged(transform(train, rules).withColumn("_w", weight), "weighted"), transform(calibration, rules)
        for name, own in (("none", None), ("class", "_w")):
            s = score_with(fit_logistic(t, names, l2, own), held, names).select(F.lit(name).alias("weighting"), "label", "fitted")
            scored = s if scored is None else scored.unionByName(s)
    scored = staged(scored, "scored")
    out = roc_auc(scored, "fitted", by=by).join(point_metrics(scored, "fitted", by=by).select(*by, "brier", "log_loss"), by)
    return out.join(ece(scored, "fitted", by=by), by)
