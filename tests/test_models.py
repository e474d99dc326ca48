"""Fitted models against NumPy: gradients, a fit of its own, and monotone losses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid import catalog, views
from firegrid.operators import boosting, metrics, models, scoring


def rows(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) * (1, 40) + (3, -20)
    p = 1 / (1 + np.exp(-(x[:, 0] - 3 + (x[:, 1] + 20) / 40)))
    y, year = (rng.random(n) < p).astype(int), 1995 + np.arange(n) % 6
    data = [(k, int(a), float(b), float(c), int(e), int(k % 40)) for k, (a, b, c, e) in enumerate(zip(y, x[:, 0], x[:, 1], year, strict=True))]
    return spark.createDataFrame(data, "id long, label int, x1 double, x2 double, year int, parent long").cache()


def logistic(x, y, l2):
    """Newton's method on the mean log-loss plus half ``l2`` times the squared weights (not the intercept)."""
    a = np.column_stack([x, np.ones(len(x))])
    w, pen = np.zeros(a.shape[1]), np.diag([l2] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + pen, a.T @ (p - y) / len(a) + pen @ w)
    return w


def auc(s, y):
    wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    return wins


def scaled(pdf, train):
    x, t = pdf[["x1", "x2"]].to_numpy(), train[["x1", "x2"]].to_numpy()
    return (x - t.mean(0)) / t.std(0)


def test_logistic_meets_its_gradient_condition(spark):
    df = rows(spark)
    t = models.transform(df, models.fit_transform(df, {"x1": "standard", "x2": "standard"}))
    for l2 in (0.0, 0.01, 0.3):
        m = models.fit_logistic(t, ["x1", "x2"], l2)
        pdf = t.toPandas()
        x, y = pdf[["x1", "x2"]].to_numpy(), pdf.label.to_numpy()
        w = np.append(m.coefficients.toArray(), m.intercept)
        p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
        sd = x.std(0, ddof=1)  # the library's penalty is on coefficients of unit deviation
        gradient = np.append(x.T @ (p - y) / len(y) + l2 * w[:2] * sd**2, (p - y).mean())
        assert np.abs(gradient).max() < 1e-4
        assert np.allclose(w, logistic(x, y, l2), atol=0.01)


def test_descent_takes_full_batch_steps(spark):
    df = rows(spark, 600)
    t = models.transform(df, models.fit_transform(df, {"x1": "standard", "x2": "standard"}))
    pdf = t.toPandas()
    x, y, w, b = pdf[["x1", "x2"]].to_numpy(), pdf.label.to_numpy(), np.zeros(2), 0.0
    for _ in range(12):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.3 * (x.T @ e / len(y) + 0.01 * w), b - 0.3 * e.mean()
    weights, bias = models.fit_descent(t, ["x1", "x2"], 0.01, 12)
    assert np.allclose(weights, w, atol=1e-12) and bias == pytest.approx(b, abs=1e-12)
    got = models.score_descent(t, ["x1", "x2"], weights, bias).toPandas().fitted
    assert np.allclose(got, 1 / (1 + np.exp(-(x @ w + b))))
    assert models.fit_descent(t.limit(0), ["x1"], steps=3) == ([0.0], 0.0)


def test_descents_of_parts_and_penalties_equal_single_ones(spark):
    """Weights count, rows without a label or feature do not train, a part without rows stays at zero."""
    df = rows(spark, 400).withColumn("x2", F.when(F.col("id") % 50 != 0, F.col("x2") / 40)).withColumn("label", F.when(F.col("id") % 70 != 1, F.col("label")))
    xs, twice = [F.col("x1") - 3, F.col("x2")], F.when(F.col("label") == 1, 2.0).otherwise(1.0)
    got = models.fit_descents(df, [(F.col("year") < 1998, xs, F.lit(1.0)), (F.col("year") >= 1998, xs, twice), (F.col("year") < 0, xs, F.lit(1.0))], [0.0, 0.2], 8, 0.3)
    pdf = df.toPandas().dropna(subset=["label", "x2"])
    for part, keep, n in ((0, pdf.year < 1998, 1), (1, pdf.year >= 1998, 2)):
        t = pdf[keep]
        x, y = np.column_stack([t.x1 - 3, t.x2]), t.label.to_numpy(float)
        weight = np.where(y == 1, n, 1.0)
        for at, l2 in enumerate((0.0, 0.2)):
            w, b = np.zeros(2), 0.0
            for _ in range(8):
                e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
                w, b = w - 0.3 * (x.T @ e / weight.sum() + l2 * w), b - 0.3 * e.sum() / weight.sum()
            assert np.allclose([*got[part][at][0], got[part][at][1]], [*w, b], atol=1e-9)
    assert got[2] == [([0.0, 0.0], 0.0)] * 2


def test_scaling_of_parts_equals_that_of_their_rows(spark):
    df = rows(spark, 300)
    parts = [F.col("year") < 1997, F.col("parent") % 5 != 2, F.col("year") < 0]
    scaling = {"x1": "standard", "x2": "robust"}
    for got, part in zip(models.fit_transforms(df, parts, scaling), parts, strict=True):
        alone = models.fit_transform(df.where(part), scaling)
        assert set(got) == set(alone)
        assert all(got[c][0] == alone[c][0] and got[c][1:] == pytest.approx(alone[c][1:]) for c in got)


def test_trees_are_validated_on_years_with_enough_rows_before(spark):
    df = rows(spark, 240)
    got = models.forward_cv_boosted(df, ["x1", "x2"], [1996, 1999, 2005], [(2, 2, 0.1)]).collect()
    assert [(r["year"], r["rounds"], r["depth"]) for r in got] == [(1999, 2, 2)]  # 40 rows before 1996, none in 2005
    assert got[0]["auc"] > 0.6


def test_the_setting_of_largest_mean_is_chosen(spark):
    t = spark.createDataFrame([(1997, 0.1, 0.6), (1998, 0.1, 0.8), (1997, 0.01, 0.7), (1998, 0.01, 0.7), (1997, 1.0, 0.5)], "year int, l2 double, auc double")
    assert models.choose(t, ["l2"]).collect() == [(0.01, 0.7, 2)]
    assert models.choose(t.where("false"), ["l2"]).count() == 0


def test_later_years_are_scored_by_earlier_ones(spark):
    df = rows(spark)
    pdf = df.toPandas()
    got = models.fit_and_score(df, ["x1", "x2"], "logistic").toPandas().set_index("id")
    train = pdf[pdf.year < 1999]
    w = logistic(scaled(train, train), train.label.to_numpy(), 0.01)
    later = pdf[pdf.year >= 1999].set_index("id")
    want = 1 / (1 + np.exp(-(scaled(later, train) @ w[:2] + w[2])))
    assert set(got.index) == set(later.index) and np.allclose(got.loc[later.index].fitted, want, atol=0.005)


def test_forward_validation_matches_numpy(spark):
    df = rows(spark)
    pdf = df.toPandas()
    got = {(r["year"], r["l2"]): r for r in models.forward_cv(df, ["x1", "x2"], [1997, 1998, 1999], [0.0, 0.1]).collect()}
    assert len(got) == 6
    for (year, l2), r in got.items():
        train, test = pdf[pdf.year < year], pdf[pdf.year == year]
        w = logistic(scaled(train, train), train.label.to_numpy(), l2)
        p = 1 / (1 + np.exp(-(scaled(test, train) @ w[:2] + w[2])))
        assert r["auc"] == pytest.approx(auc(p, test.label.to_numpy()), abs=0.01)
        assert r["brier"] == pytest.approx(((p - test.label) ** 2).mean(), abs=0.005)


def test_spatial_validation_leaves_each_fold_out(spark):
    df = rows(spark)
    pdf = df.toPandas()
    got = {r["fold"]: r["auc"] for r in models.spatial_cv(df, ["x1", "x2"]).collect()}
    for fold, found in got.items():
        train, test = pdf[pdf.parent % 5 != fold], pdf[pdf.parent % 5 == fold]
        w = logistic(scaled(train, train), train.label.to_numpy(), 0.01)
        assert found == pytest.approx(auc(scaled(test, train) @ w[:2], test.label.to_numpy()), abs=0.01)
    assert set(got) == set(range(5))


def grow(x, r, depth, least=20):
    """One tree on residuals, by sorting: the best of the nine deciles of each feature."""
    n = len(r)
    if depth == 0 or n < least:
        return {"value": r.mean()}
    best = None
    for f in range(x.shape[1]):
        values = np.sort(x[:, f])
        for d in range(1, 10):
            v = values[min(n * d // 10, n - 1)]
            left = x[:, f] <= v
            if 0 < left.sum() < n:
                gain = round(r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum(), 9)
                if best is None or gain > best[0]:
                    best = (gain, f, v, left)
    if best is None:
        return {"value": r.mean()}
    _, f, v, left = best
    return {"feature": f, "threshold": v, "left": grow(x[left], r[left], depth - 1, least), "right": grow(x[~left], r[~left], depth - 1, least)}


def reach(tree, x):
    while "feature" in tree:
        tree = tree["left"] if x[tree["feature"]] <= tree["threshold"] else tree["right"]
    return tree["value"]


def same_tree(a, b):
    if "value" in a or "value" in b:
        assert a["value"] == pytest.approx(b["value"], abs=1e-9)
        return
    assert (a["feature"], a["threshold"]) == (b["feature"], pytest.approx(b["threshold"], abs=1e-12))
    same_tree(a["left"], b["left"])
    same_tree(a["right"], b["right"])


@pytest.mark.parametrize(("ranges", "fold"), [(256, 10), (5, 1)])
def test_boosted_trees_equal_sorted_ones(spark, ranges, fold):
    df = rows(spark, 1200).withColumn("x3", F.col("id") % 4).withColumn("x4", F.when(F.col("id") < 1100, 0.0).otherwise(F.col("x1")))
    pdf = df.toPandas()
    x, y = pdf[["x1", "x2", "x3", "x4"]].to_numpy(float), pdf.label.to_numpy(float)
    model = boosting.fit_boosted(df, ["x1", "x2", "x3", "x4"], rounds=3, ranges=ranges, fold=fold)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for tree in model["trees"]:
        want = grow(x, y - 1 / (1 + np.exp(-z)), 3)
        same_tree(tree, want)
        z += 0.1 * np.array([reach(want, row) for row in x])
    got = boosting.score_boosted(df, model).toPandas().set_index("id").loc[pdf.id].fitted
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-9)
    # The same model goes through the scorer of stored artifacts.
    whole = scoring.score_artifact(df, model | {"calibrator": [(1.0, 0.5)]}).toPandas().set_index("id").loc[pdf.id].raw_score
    assert np.allclose(got, whole, atol=1e-12)
    assert sum(boosting.split_counts(model).values()) >= 9


def test_boosting_of_few_rows_and_one_class(spark):
    few = boosting.fit_boosted(rows(spark, 19), ["x1"], rounds=2)
    assert [set(t) for t in few["trees"]] == [{"value"}] * 2
    same = boosting.fit_boosted(rows(spark, 60).withColumn("label", F.lit(1)).withColumn("x1", F.lit(2.0)), ["x1"], rounds=1)
    assert same["trees"][0] == {"value": pytest.approx(1e-6, rel=1e-3)} and same["start"] > 13
    with pytest.raises(ValueError):
        boosting.fit_boosted(rows(spark, 30).where("id < 0"), ["x1"])


def test_passes_of_boosting_are_spread_over_tasks(spark, monkeypatch):
    """A table in one partition is dealt to all tasks once, so that none of the passes over it is a single task."""
    df = spark.range(0, 45_000, 1, 1).select((F.col("id") * 7919 % 1009).alias("x1"), (F.col("id") * 31 % 997).alias("x2"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    tasks, candidates = [], boosting._candidates
    monkeypatch.setattr(boosting, "_candidates", lambda t, *rest: tasks.append(t.rdd.getNumPartitions()) or candidates(t, *rest))
    boosting.fit_boosted(df, ["x1", "x2"], rounds=2, depth=2)
    assert tasks == [4] * 4


def test_values_are_summed_in_wanted_ranges_only(spark):
    """Whatever number of rows is summed at a time, and with values that repeat."""
    t = spark.range(1000).select((F.col("id") % 3 == 0).cast("double").alias("y"), (F.col("id") * 7 % 40 / 4).alias("v0"), F.col("id").cast("double").alias("v1"))
    cuts, pdf = [[2.0, 5.0], [300.0, 600.0]], t.toPandas()
    blocks, kind = boosting._packed(t, cuts, 0.0)
    tree = {"feature": 1, "threshold": 499.5, "left": {"open": 0}, "right": {"value": 0.0}}
    walk, open_ = boosting._walk(kind, tree, [{"value": 2.0}], 0.5), pdf[pdf.v1 <= 499.5]
    r = open_.y - 1 / (1 + np.exp(-1.0))
    sums = {row["cell"]: row for row in boosting._range_sums(blocks, walk, 2, 3, 3)}
    for cell, column, inside in [(0, "v0", open_.v0 < 2), (1, "v0", (open_.v0 >= 2) & (open_.v0 < 5)), (2, "v0", open_.v0 >= 5), (3, "v1", open_.v1 < 300), (4, "v1", open_.v1 >= 300)]:
        v = open_[column][inside]
        assert tuple(sums.pop(cell)) == (cell, len(v), pytest.approx(r[inside].sum()), v.min(), v.max())
    assert not sums
    want = r[(open_.v0 >= 2) & (open_.v0 < 5)].groupby(open_.v0).agg(["size", "sum"])
    for at_once in (1, 50, 10_000):
        got = boosting._value_sums(blocks, walk, np.array([[False, True, False], [False] * 3]), 3, at_once).groupBy("cell", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas().set_index("v")
        assert (got.cell == 1).all() and len(got) == len(want) == 12
        assert got.n.loc[want.index].tolist() == want["size"].tolist() and np.allclose(got.s.loc[want.index], want["sum"])


def test_boosting_refuses_missing_features_and_counts_rows_without_a_label(spark):
    df = rows(spark, 300)
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="null or NaN"):
            boosting.fit_boosted(df.withColumn("x1", F.when(F.col("id") != 7, F.col("x1")).otherwise(F.lit(bad))), ["x1"], rounds=1)
    some = df.withColumn("label", F.when(F.col("id") % 5 != 0, F.col("label")))
    pdf = some.toPandas()
    y = pdf.label.to_numpy(float)
    p = np.nansum(y) / len(y)
    same_tree(boosting.fit_boosted(some, ["x1", "x2"], rounds=1)["trees"][0], grow(pdf[["x1", "x2"]].to_numpy(), np.nan_to_num(y - p), 3))


def test_weighting_is_compared_on_the_calibration_rows(spark):
    df = rows(spark).where("label = 0 or id % 4 = 0")
    train, held = df.where("year < 1999"), df.where("year >= 1999")
    got = models.compare_weighting(train, held, ["x1", "x2"]).toPandas().set_index("weighting")
    pdf, test = train.toPandas(), held.toPandas()
    times = max(1, int(np.floor((pdf.label == 0).sum() / (pdf.label == 1).sum() + 0.5)))
    assert models.repeats(train).first()[0] == times > 1
    for name, n in (("none", 1), ("class", times)):
        x, y = scaled(pdf, pdf), pdf.label.to_numpy()
        more = np.repeat(np.arange(len(y)), np.where(y == 1, n, 1))
        w = logistic(x[more], y[more], 0.01)
        p = 1 / (1 + np.exp(-(scaled(test, pdf) @ w[:2] + w[2])))
        assert got.loc[name, "auc"] == pytest.approx(auc(p, test.label.to_numpy()), abs=0.01)
        assert got.loc[name, "brier"] == pytest.approx(((p - test.label) ** 2).mean(), abs=0.01)
    assert got.loc["class", "brier"] != pytest.approx(got.loc["none", "brier"], abs=1e-3)


def test_platt_scaling_is_a_fit_of_one_score(spark):
    df = rows(spark).withColumn("score", 1 / (1 + F.exp(-F.col("x1") / 2)))
    got = models.platt(df).toPandas()
    w = logistic(got[["score"]].to_numpy(), got.label.to_numpy(), 0.0)
    assert np.allclose(got.calibrated, 1 / (1 + np.exp(-(got.score * w[0] + w[1]))), atol=0.005)


def test_importances_agree_with_the_signal(spark):
    df = rows(spark).withColumn("x3", F.rand(3))
    got = {r["feature"]: r for r in models.feature_importances(df, ["x1", "x2", "x3"], rounds=3).collect()}
    assert set(got) == {"x1", "x2", "x3"} and min(got["x1"]["coefficient"], got["x2"]["coefficient"]) > 5 * abs(got["x3"]["coefficient"])
    assert 3 <= sum(r["splits"] for r in got.values()) <= 21 and got["x1"]["splits"] > got["x3"]["splits"]


@pytest.mark.parametrize("name", ["m2_logistic", "m3_boosted_trees", "m4_platt"])
def test_registered_fits_are_calibrated_on_their_rows(name, spark, sf_dir):
    """Labels there do not depend on the features, so scores must stay near the share of positives."""
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    column = "calibrated" if name == "m4_platt" else "fitted"
    assert len(got) > 100 and got.id.is_unique and got[column].between(0, 1).all() and abs(got[column].mean() - 0.2) < 0.08


def test_registered_validations_cover_years_penalties_and_folds(spark, sf_dir):
    q = catalog.queries()
    cv = q["m7_forward_cv"](spark, sf_dir).toPandas()
    assert sorted(zip(cv.year, cv.l2, strict=True)) == [(y, p) for y in (1997, 1998, 1999) for p in (0.0, 0.001, 0.01, 0.1)] and cv.auc.between(0.2, 0.8).all()
    folds = q["m10_spatial_cv"](spark, sf_dir).toPandas()
    parents = {r["parent"] % 5 for r in views.labeled(spark, sf_dir).select("parent").distinct().collect()}
    assert set(folds.fold) == parents and len(folds) == len(parents) and folds.auc.between(0.1, 0.9).all()
    assert sorted(q["m11_importances"](spark, sf_dir).toPandas().feature) == ["x1", "x2", "x3"]


def test_statistics_of_parts_come_from_bounds_and_not_from_sorting(spark):
    """Ties, missing values, an empty part, and bounds so loose that wider ones are needed."""
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3000 / 10).alias("a"), F.when(F.col("id") % 9 != 0, (F.col("id") % 4).cast("double")).alias("b"))
    pdf = df.toPandas()
    parts = {0: pdf.id >= 0, 1: pdf.id % 3 == 0, 3: pdf.id < 2}
    for accuracy in (1_000, 20):
        got = {(r["part"], r["feature"]): r for r in metrics.part_stats(df, [F.lit(True), F.col("id") % 3 == 0, F.col("id") < 0, F.col("id") < 2], ["a", "b"], accuracy)}
        assert set(got) == {(p, c) for p in parts for c in "ab"}
        for (p, c), r in got.items():
            v = np.sort(pdf[parts[p]][c].dropna())
            assert (r["present"], r["missing"]) == (len(v), int(pdf[parts[p]][c].isna().sum()))
            assert [r["p05"], r["median"], r["p95"]] == [v[int((len(v) - 1) * q + 0.5)] for q in (0.05, 0.5, 0.95)]
            assert (r["mean"], r["sd"]) == pytest.approx((v.mean(), v.std()))


def test_a_descent_writes_a_shared_feature_once(spark):
    """Folds differ in scaling only, so five of them need no five copies of each feature."""
    parts = [(F.col("year") != k, F.col("year") == k, F.lit(1.0), [(x, ("standard", 0.0, float(k), 2.0)) for x in xs]) for xs in [[F.col("x1"), F.col("x2")]] for k in range(1995, 2000)]
    t, features = models._descent_rows(rows(spark, 60), parts)
    assert [c for c in t.columns if c.startswith("_x")] == ["_x0", "_x1"] and [[n for n, _ in own] for _, own in features] == [["_x0", "_x1"]] * 5
