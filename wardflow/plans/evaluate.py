"""Rolling-origin evaluation of the three models against their baselines, and its gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardflow.operators import demand, features as FT, metrics, models, splits
from wardflow.session import concurrently, materialize

# What a model must clear.
GATES = {"pr_auc_ratio": 1.15, "roc_auc": 0.60, "demand_mae_ratio": 1.0, "duration_mae_ratio": 1.0}


def _pool(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def evaluate_no_show(frame: DataFrame, folds: list[splits.Fold], *, seed: int = models.SEED, fold_history_only: bool = False) -> dict:
    """Metrics per fold for the model, plain logistic regression and the base rate.

    History features of a test fold read every outcome known at booking time;
    ``fold_history_only`` restricts them to the fold itself.
    """
    codes = materialize(FT.category_codes(frame))

    def of_fold(fold: splits.Fold) -> tuple:
        train, test = splits.split_by_fold(frame, fold)
        splits.assert_no_temporal_leakage(train, test)
        rate = FT.base_rate(train).first()[0]
        x_train = materialize(FT.no_show_features(train, rate, codes=codes, keep=("appointment_date",)))
        x_test = FT.no_show_features(
            test, rate, outcomes=None if fold_history_only else frame, codes=codes, keep=("appointment_date",)
        )
        model = models.fit_no_show(x_train, seed=seed)
        plain = models.fit_no_show(x_train, seed=seed, calibrate=False)
        scored = plain.transform(model.transform(x_test), "logistic").select(
            F.lit(fold.index).alias("fold"), "label", F.col("score").alias("model"), F.col("logistic").alias("logistic_regression"),
            F.lit(rate).alias("base_rate"),
        )
        return materialize(scored), (fold.index, model.importance())

    found = concurrently(frame.sparkSession, (lambda f=f: of_fold(f) for f in folds))
    every = _pool([scored for scored, _ in found])
    long = every.select(
        "fold", "label", F.explode(F.array(*[
            F.struct(F.lit(n).alias("candidate"), F.col(n).alias("score")) for n in ("model", "logistic_regression", "base_rate")
        ])).alias("s"),
    ).select("fold", "label", "s.*")
    per_fold = materialize(metrics.classification_metrics(long, 0.5, ["fold", "candidate"]))
    summary = _summary(per_fold, ("pr_auc", "roc_auc", "brier", "precision", "recall", "f1"))
    pooled_scores = every.select("label", F.col("model").alias("score"))
    return {
        "per_fold": per_fold,
        "summary": summary,
        "operating_points": metrics.operating_points(pooled_scores),
        "curve": metrics.pr_curve(pooled_scores),
        "importance": _importances(frame, [i for _, i in found]),
    }


def _summary(per_fold: DataFrame, names: tuple[str, ...]) -> DataFrame:
    long = per_fold.select(
        "candidate", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    ).select("candidate", "m.*")
    return metrics.mean_std(long, "value", ["candidate", "metric"])


def evaluate_demand(frame: DataFrame, folds: list[splits.Fold], *, seed: int = models.SEED, trees: int | None = None) -> dict:
    grid = materialize(demand.demand_grid(frame))
    codes = materialize(FT.category_codes(grid))
    def of_fold(fold: splits.Fold) -> tuple:
        train, test = splits.split_by_fold(grid, fold)
        splits.assert_no_temporal_leakage(train, test)
        profile = materialize(demand.demand_profile(train))
        x_train = materialize(FT.demand_features(train, profile, codes, keep=("appointment_date",)))
        x_test = FT.demand_features(test, profile, codes, keep=("specialty", "appointment_date"))
        model = models.fit_demand(x_train, seed=seed, params={"maxIter": trees} if trees else None)
        naive = demand.seasonal_naive(train, test).select("specialty", "appointment_date", "hour_of_day", F.col("prediction").alias("seasonal_naive"))
        scored = model.transform(x_test, "model").join(naive, ["specialty", "appointment_date", "hour_of_day"])
        held = materialize(scored.select(F.lit(fold.index).alias("fold"), F.col("count").alias("label"), "model", "seasonal_naive"))
        return held, (fold.index, model.strategy, model.selection_scores), model.importance()

    found = concurrently(frame.sparkSession, (lambda f=f: of_fold(f) for f in folds))
    per_fold = _regression(_pool([held for held, _, _ in found]), ("model", "seasonal_naive"))
    strategies = grid.sparkSession.createDataFrame([s for _, s, _ in found], "fold int, strategy string, selection_scores map<string, double>")
    zero = grid.agg(metrics.X.half_even(F.avg((F.col("count") == 0).cast("double")), 4).alias("zero_cell_fraction"),
                    F.count(F.lit(1)).alias("total_cells"))
    return {"per_fold": per_fold, "summary": _summary(per_fold, ("mae", "rmse", "bias", "r2")), "strategies": strategies,
            "importance": _importances(grid, [(s[0], i) for _, s, i in found]), "grid": zero}


def evaluate_duration(frame: DataFrame, folds: list[splits.Fold], *, seed: int = models.SEED, trees: int | None = None) -> dict:
    codes = materialize(FT.category_codes(frame))

    def of_fold(fold: splits.Fold) -> tuple:
        train, test = splits.split_by_fold(frame, fold)
        splits.assert_no_temporal_leakage(train, test)
        x_train = materialize(FT.duration_features(train, codes=codes))
        model = models.fit_duration(x_train, seed=seed, params={"maxIter": trees} if trees else None)
        done = train.filter("status = 'completed'")
        means = done.groupBy("specialty").agg(F.avg("duration_minutes").alias("specialty_mean"))
        overall = done.agg(F.avg("duration_minutes").alias("m")).first()[0]
        x_test = FT.duration_features(test, outcomes=frame, codes=codes, keep=("specialty",))
        naive = demand.lookup_with_fallback(x_test, means, ["specialty"], "specialty_mean", overall)
        scored = model.transform(naive, "model")
        held = materialize(scored.select(F.lit(fold.index).alias("fold"), F.col("duration_minutes").alias("label"), "model", "specialty_mean"))
        return held, (fold.index, model.importance())

    found = concurrently(frame.sparkSession, (lambda f=f: of_fold(f) for f in folds))
    per_fold = _regression(_pool([held for held, _ in found]), ("model", "specialty_mean"))
    return {"per_fold": per_fold, "summary": _summary(per_fold, ("mae", "rmse", "bias", "r2")), "importance": _importances(frame, [i for _, i in found])}


def _importances(frame: DataFrame, by_fold: list[tuple]) -> DataFrame:
    """``fold, feature, importance`` of the model of every fold."""
    rows = [(fold, feature, value) for fold, pairs in by_fold for feature, value in pairs]
    return frame.sparkSession.createDataFrame(rows, "fold int, feature string, importance double")


def _regression(pooled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    long = pooled.select(
        "fold", "label", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(n).alias("prediction")) for n in names])).alias("p")
    ).select("fold", "label", "p.*")
    return metrics.regression_metrics(long, ["fold", "candidate"])


def gates(no_show: DataFrame, demand_summary: DataFrame, duration_summary: DataFrame) -> DataFrame:
    """(name, passed, detail) from the three summaries (candidate, metric, mean, std)."""
    def value(df: DataFrame, candidate: str, metric: str):
        return df.filter((F.col("candidate") == candidate) & (F.col("metric") == metric)).agg(F.max("mean").alias("v")).scalar()

    one = no_show.sparkSession.range(1).select(
        value(no_show, "model", "pr_auc").alias("pr"), value(no_show, "base_rate", "pr_auc").alias("base"),
        value(no_show, "logistic_regression", "pr_auc").alias("logit"), value(no_show, "model", "roc_auc").alias("roc"),
        value(demand_summary, "model", "mae").alias("d"), value(demand_summary, "seasonal_naive", "mae").alias("dn"),
        value(duration_summary, "model", "mae").alias("u"), value(duration_summary, "specialty_mean", "mae").alias("un"),
    )
    f = F.col

    def check(name, passed, text, *values):
        return F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.format_string(text, *values).alias("detail"))

    rows = F.array(
        check("no_show_beats_base_rate", f("pr") >= F.lit(GATES["pr_auc_ratio"]) * f("base"), "PR-AUC %.3f vs %.3f", f("pr"), f("base")),
        check("no_show_roc_auc", f("roc") >= GATES["roc_auc"], "%.3f", f("roc")),
        check("no_show_vs_logistic", F.lit(True), "PR-AUC %.3f vs logistic %.3f (informational)", f("pr"), f("logit")),
        check("demand_not_worse", f("d") <= f("dn") * GATES["demand_mae_ratio"], "MAE %.4f vs naive %.4f", f("d"), f("dn")),
        check("duration_not_worse", f("u") <= f("un") * GATES["duration_mae_ratio"], "MAE %.3f vs mean %.3f", f("u"), f("un")),
    )
    return one.select(F.inline(rows))
