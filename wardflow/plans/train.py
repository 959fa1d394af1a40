"""Training job: three models with their cards, refused on too little data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardflow.operators import demand, features as FT, metrics, models, quality, splits
from wardflow.session import materialize
from wardflow.sources import registry, tables

MISSED_COST, EXTRA_COST = 3.0, 1.0


class NotEnoughData(RuntimeError):
    pass


def train(frame: DataFrame, folder: str, *, seed: int = models.SEED, minimum_rows: int = quality.MIN_TRAINING_ROWS,
          trees: int | None = None, test_fraction: float = 0.2) -> dict[str, registry.ModelCard]:
    """Fit on all but the last dates, keep those as an honest score, save everything."""
    spark = frame.sparkSession
    summary = tables.training_summary(frame).first()
    if summary["resolved_rows"] < minimum_rows:
        raise NotEnoughData(f"only {summary['resolved_rows']} resolved visits, {minimum_rows} needed")
    span = [str(summary["first_date"]), str(summary["last_date"])]
    sized = {"maxIter": trees} if trees else None
    codes = materialize(FT.category_codes(frame))
    train_rows, test_rows = splits.final_holdout(frame, test_fraction=test_fraction)
    cards: dict[str, registry.ModelCard] = {}

    # no-show
    rate = FT.base_rate(train_rows).first()[0]
    x_train = materialize(FT.no_show_features(train_rows, rate, codes=codes, keep=("appointment_date",)))
    x_test = materialize(FT.no_show_features(test_rows, rate, outcomes=frame, codes=codes, keep=("appointment_date",)))
    kind, selection = models.select_estimator(x_train, seed=seed, params=sized)
    model = models.fit_no_show(x_train, estimator=kind, seed=seed, params=sized if kind == "gradient_boosting" else None)
    scored = materialize(model.transform(x_test).select("label", "score"))
    best = metrics.threshold_for_cost(scored, MISSED_COST, EXTRA_COST).first()
    quality_row = metrics.classification_metrics(scored, best["threshold"]).first().asDict()
    cards["no_show"] = registry.ModelCard(
        "no_show", "classifier", seed, model.feature_names, summary["resolved_rows"], span, dict(model.params),
        {"holdout": quality_row, "selection": selection, "importance": dict(model.importance())},
        best["threshold"], best["rationale"], rate,
    )
    registry.save_model(spark, model, cards["no_show"], folder, codes=codes)

    # demand
    grid = demand.demand_grid(frame)
    head, tail = splits.final_holdout(grid, test_fraction=test_fraction)
    profile = materialize(demand.demand_profile(head))
    g_codes = materialize(FT.category_codes(grid))
    d_train = materialize(FT.demand_features(head, profile, g_codes, keep=("appointment_date",)))
    d_test = FT.demand_features(tail, profile, g_codes, keep=("appointment_date",))
    d_model = models.fit_demand(d_train, seed=seed, params=sized)
    d_scored = d_model.transform(d_test).withColumn("label", F.col("count"))
    cards["demand"] = registry.ModelCard(
        "demand", "regressor", seed, d_model.feature_names, summary["row_count"], span, {},
        {"holdout": metrics.regression_metrics(d_scored).first().asDict(), "selection": d_model.selection_scores,
         "importance": dict(d_model.importance())},
    )
    registry.save_model(spark, d_model, cards["demand"], folder, codes=g_codes, profile=profile)

    # duration
    u_train = materialize(FT.duration_features(train_rows, codes=codes))
    u_model = models.fit_duration(u_train, seed=seed, params=sized)
    u_scored = u_model.transform(FT.duration_features(test_rows, outcomes=frame, codes=codes)).withColumn(
        "label", F.col("duration_minutes")
    )
    cards["duration"] = registry.ModelCard(
        "duration", "regressor", seed, u_model.feature_names, summary["row_count"], span, {},
        {"holdout": metrics.regression_metrics(u_scored).first().asDict(), "importance": dict(u_model.importance())},
    )
    registry.save_model(spark, u_model, cards["duration"], folder, codes=codes)
    return cards
