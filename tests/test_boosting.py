"""Boosted trees against a plain version that looks at every row, and their stored form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.operators import boosting
from wardflow.operators.boosting import Boosted, bin_edges, fit_boosted

SETTINGS = {"maxIter": 4, "maxDepth": 3, "numLeaves": 5, "stepSize": 0.3, "minInstancesPerNode": 5, "regLambda": 1.0}


def by_hand(x, y, loss):
    """Leaf-wise boosting on rows: repeatedly split the leaf of largest gain."""
    start = {"log": lambda: np.log(y.mean() / (1 - y.mean())), "poisson": lambda: np.log(y.mean()), "absolute": lambda: np.median(y)}[loss]()
    score = start * np.ones(len(y))
    for _ in range(SETTINGS["maxIter"]):
        mean = 1 / (1 + np.exp(-score)) if loss == "log" else np.exp(score) if loss == "poisson" else score
        g = np.sign(score - y) if loss == "absolute" else mean - y
        h = {"log": mean * (1 - mean), "poisson": mean, "absolute": np.ones_like(y)}[loss]
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < SETTINGS["numLeaves"]:
            options = []
            for at, (rows, depth) in enumerate(leaves):
                for f in range(x.shape[1]) if depth < SETTINGS["maxDepth"] else ():
                    for cut in np.unique(x[rows, f])[:-1]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(len(left), len(right)) < SETTINGS["minInstancesPerNode"] or min(h[left].sum(), h[right].sum()) < 1e-3:
                            continue
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
                        gain = part(left) + part(right) - part(rows)
                        if gain > 1e-9:
                            options.append((-round(gain, 6), f, cut, at, left, right, depth + 1))
            if not options:
                break
            _, _, _, at, left, right, depth = min(options, key=lambda o: o[:3])
            leaves[at : at + 1] = [(left, depth), (right, depth)]
        if len(leaves) == 1:
            break
        for rows, _ in leaves:
            if loss == "absolute":
                steps = np.sort(np.round((y[rows] - score[rows]) * 64))
                step = steps[(len(steps) - 1) // 2] / 64
            else:
                step = -g[rows].sum() / (h[rows].sum() + 1)
            score = score.copy()
            score[rows] += 0.3 * step
    return 1 / (1 + np.exp(-score)) if loss == "log" else np.exp(score) if loss == "poisson" else score


@pytest.mark.parametrize("loss", ["log", "poisson", "absolute"])
def test_boosting_is_that_of_all_rows(spark, loss):
    pick = np.random.default_rng(7)
    x = np.column_stack((pick.integers(0, 12, 400), pick.integers(0, 5, 400), pick.integers(0, 30, 400))).astype(float)
    signal = 0.3 * x[:, 0] - 0.5 * (x[:, 1] > 2) + 0.02 * x[:, 2]
    y = {"log": (pick.random(400) < 1 / (1 + np.exp(1.5 - signal))).astype(float), "poisson": pick.poisson(np.exp(signal / 3)).astype(float),
         "absolute": np.round(10 + 4 * signal + pick.normal(size=400))}[loss]
    rows = [(i, *(float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame([*rows, (999, 1.0, 1.0, 1.0, None)], "i int, a double, b double, c double, y double").repartition(3)
    model = fit_boosted(frame, ["a", "b", "c"], "y", loss, params=SETTINGS)
    want = by_hand(x, y, loss)
    again = Boosted.from_json(model.to_json())
    got = {r["i"]: r["p"] for r in again.transform(frame, "p").collect()}
    assert np.abs(np.array([got[i] for i in range(400)]) - want).max() < 1e-9
    assert len(model.trees) == 4 and all((t.child > 0).sum() <= 4 for t in model.trees)
    assert np.argmax(model.influence()) == 0


def test_a_constant_label_gives_a_constant(spark):
    frame = spark.createDataFrame([(float(i), 3.0) for i in range(50)], "a double, y double")
    for loss in ("poisson", "absolute"):
        model = fit_boosted(frame, ["a"], "y", loss, params=SETTINGS)
        assert model.trees == [] and model.transform(frame, "p").agg(F.min("p"), F.max("p")).first() == (pytest.approx(3.0), pytest.approx(3.0))
    with pytest.raises(ValueError, match="no loss"):
        fit_boosted(frame, ["a"], "y", "squared")
    assert fit_boosted(frame.filter("a < 0"), ["a"], "y", "log", params=SETTINGS).trees == []


def test_scores_survive_refreshing_and_sampling_is_repeatable(spark):
    frame = spark.range(600).select(F.pmod(F.hash("id"), F.lit(100)).cast("double").alias("a"), F.pmod(F.hash("id", F.lit(1)), F.lit(7)).cast("double").alias("b")).withColumn("y", (F.col("a") > 50).cast("double"))
    settings = {"maxIter": 23, "maxDepth": 2, "minInstancesPerNode": 10, "subsamplingRate": 0.7, "featureFraction": 0.5}
    one, two = (fit_boosted(frame, ["a", "b"], "y", "log", params=settings) for _ in range(2))
    assert one.to_json() == two.to_json() and 1 <= len(one.trees) <= 23
    assert one.transform(frame, "p").filter("(p > 0.5) <> (y > 0.5)").count() == 0


def test_edges_are_the_values_if_they_are_few_and_percentiles_else(spark):
    frame = spark.range(20_000).select((F.col("id") % 9).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"))
    few, many, none = bin_edges(frame, ["few", "many", "none"])
    assert few.tolist() == list(range(8)) and none.tolist() == []
    assert 240 <= len(many) <= 254 and np.abs(np.diff(many) - 20_000 / 255).max() < 60


def test_a_level_is_one_job(spark):
    """Three levels and the two passes for the medians: five jobs a tree."""
    frame = spark.range(400).select(F.pmod(F.hash("id"), F.lit(40)).cast("double").alias("a")).withColumn("y", F.col("a") + F.pmod(F.hash("a"), F.lit(5)))

    def jobs(trees):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "")
        assert len(fit_boosted(frame, ["a"], "y", "absolute", params={**SETTINGS, "maxIter": trees}).trees) == trees
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}"))

    few, more = jobs(1), jobs(5)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more - few <= 4 * 5


@pytest.mark.parametrize("loss", ["log", "poisson", "absolute"])
def test_sums_by_combination_give_the_trees_of_sums_by_level_in_fewer_jobs(spark, loss, monkeypatch):
    rows = spark.range(600).select(F.pmod(F.hash("id"), F.lit(9)).cast("double").alias("a"), F.pmod(F.hash("id", F.lit(1)), F.lit(30)).cast("double").alias("b"))
    frame = rows.withColumn("y", ((F.col("a") > 4) != (F.col("b") > 20)).cast("double")).repartition(3).localCheckpoint()
    settings = {**SETTINGS, "subsamplingRate": 0.8}

    def fitted(trees):
        spark.sparkContext.setJobGroup(f"{loss}-{trees}-{boosting.MOST_JOINT}", "")
        model = fit_boosted(frame, ["a", "b"], "y", loss, params={**settings, "maxIter": trees})
        return model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{loss}-{trees}-{boosting.MOST_JOINT}"))

    (one, few), (joint, many) = fitted(1), fitted(6)
    monkeypatch.setattr(boosting, "MOST_JOINT", 0)
    (level, _) = fitted(6)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many - few <= (3 if loss == "absolute" else 1) * 5 and len(one.trees) == 1
    assert [(t.feature.tolist(), t.cut.tolist(), t.child.tolist()) for t in joint.trees] == [(t.feature.tolist(), t.cut.tolist(), t.child.tolist()) for t in level.trees]
    assert max(np.abs(a.value - b.value).max() for a, b in zip(joint.trees, level.trees)) < 1e-9


def test_the_larger_sibling_is_the_rest_of_its_parent(spark, monkeypatch):
    asked, plain = [], boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda blocks, grown, frontier, *a: asked.append(len(frontier)) or plain(blocks, grown, frontier, *a))
    frame = spark.range(800).select((F.col("id") % 64).cast("double").alias("a")).withColumn("y", F.pmod(F.hash("a"), F.lit(50)).cast("double"))
    fit_boosted(frame, ["a"], "y", "absolute", params={**SETTINGS, "maxIter": 1, "numLeaves": 8})
    assert asked == [1, 1, 2]
