"""No-show, demand and duration models: linear ones on ``pyspark.ml``, boosted ones on :mod:`boosting`.

The data stay in Spark; the driver holds coefficients, trees, fold dates and
one number per fold and metric. Fits that do not depend on each other run as
concurrent jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import demand, features as FT, metrics, splits
from wardflow.operators.boosting import Boosted, fit_boosted
from wardflow.session import concurrently, stored

DAY = "appointment_date"
KINDS = ("logistic_regression", "gradient_boosting")
# Model settings and gates.
SEED = 42
NO_SHOW_PARAMS = {"maxIter": 400, "maxDepth": 6, "numLeaves": 31, "stepSize": 0.05, "subsamplingRate": 0.8, "featureFraction": 0.8, "minInstancesPerNode": 40}
DURATION_PARAMS = {"maxIter": 400, "maxDepth": 6, "numLeaves": 31, "stepSize": 0.05, "subsamplingRate": 0.9, "featureFraction": 0.9, "minInstancesPerNode": 40}
DEMAND_PARAMS = {"maxIter": 300, "maxDepth": 6, "numLeaves": 24, "stepSize": 0.05, "subsamplingRate": 0.9, "featureFraction": 0.9, "minInstancesPerNode": 100}
CALIBRATION_FOLDS = 3
DEFAULT_DURATION_MINUTES = 30.0
SCORE_DECIMALS = 4  # isotonic input: at most 10,001 weighted score bins
Base = PipelineModel | Boosted


@dataclass
class NoShowModel:
    """Base models with their calibrators; the probability is their mean."""

    estimator: str
    feature_names: list[str]
    parts: list[tuple[Base, IsotonicRegressionModel | None]]
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        out, total = df, None
        for i, (base, calibrator) in enumerate(self.parts):
            raw = f"_raw{i}"
            out = _base_score(base, out, self.feature_names, raw)
            if calibrator is not None:
                out = out.withColumn(raw, F.round(raw, SCORE_DECIMALS))  # as the calibrator was fitted
                calibrator = calibrator.copy().setFeaturesCol(raw).setPredictionCol(f"_cal{i}")
                out = calibrator.transform(out)
                raw = f"_cal{i}"
            total = F.col(raw) if total is None else total + F.col(raw)
        return out.withColumn(name, total / len(self.parts)).select(*df.columns, name)

    def importance(self) -> list[tuple[str, float]]:
        return _importance([base for base, _ in self.parts], self.feature_names)


@dataclass
class DemandModel:
    strategy: str
    feature_names: list[str]
    model: Base | None
    selection_scores: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.greatest("profile_mean", F.lit(0.0)))
        if isinstance(self.model, Boosted):
            return self.model.transform(df, name).withColumn(name, F.greatest(name, F.lit(0.0)))
        out = self.model.transform(_ready(df, self.feature_names))
        return out.withColumn(name, F.greatest("_prediction", F.lit(0.0))).select(*df.columns, name)

    def importance(self) -> list[tuple[str, float]]:
        return [("profile_mean", 1.0)] if self.model is None else _importance([self.model], self.feature_names)


@dataclass
class DurationModel:
    feature_names: list[str]
    model: Boosted

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.model.transform(df, name).withColumn(name, X.clip_duration(name))

    def importance(self) -> list[tuple[str, float]]:
        return _importance([self.model], self.feature_names)


def _ready(df: DataFrame, names: list[str]) -> DataFrame:
    """Model inputs beside the original columns, NULL read as 0."""
    return df.withColumns({f"_x_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def _assembler(names: list[str], prefix: str = "_x_") -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{prefix}{n}" for n in names], outputCol="_features")


def _scaler(ready: DataFrame, names: list[str]) -> tuple[int, SQLTransformer]:
    """The number of rows, and a stage that adds the inputs with mean 0 and deviation 1 (a constant one as 0): plain expressions, fitted by one aggregate."""
    inputs = [F.col(f"_x_{n}") for n in names]
    found = ready.agg(F.count(F.lit(1)), *[F.avg(c) for c in inputs], *[F.stddev_samp(c) for c in inputs]).first()
    means, deviations = found[1 : len(names) + 1], found[len(names) + 1 :]
    scaled = [f"(`_x_{n}` - {m!r}D) / {s!r}D AS `_z_{n}`" if s else f"0D AS `_z_{n}`" for n, m, s in zip(names, means, deviations)]
    return found[0], SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def _base_score(base: Base, df: DataFrame, names: list[str], name: str) -> DataFrame:
    if isinstance(base, Boosted):
        return base.transform(df, name)
    if not isinstance(base.stages[0], SQLTransformer):  # saved before scaling was a plain expression
        out = base.transform(_ready(df, names)).withColumn(name, vector_to_array("_probability")[1])
    else:  # the probability as an expression of the scaled inputs: no vector is made of a row
        margin = F.lit(float(base.stages[-1].intercept))
        for n, weight in zip(names, base.stages[-1].coefficients.toArray()):
            margin = margin + F.col(f"_z_{n}") * float(weight)
        out = base.stages[0].transform(_ready(df, names)).withColumn(name, 1.0 / (1.0 + F.exp(-margin)))
    return out.select(*df.columns, name)


def _fit_base(kind: str, train: DataFrame, names: list[str], seed: int, params: dict | None) -> Base:
    """Standardised logistic regression (C = 1) or boosted trees under log loss."""
    if kind == "gradient_boosting":
        return fit_boosted(train, names, "label", "log", seed=seed, params={**NO_SHOW_PARAMS, **(params or {})})
    ready = _ready(train, names)
    n, scaler = _scaler(ready, names)
    # an L2 penalty of 1/(2C) on the summed loss is 1/(C n) on the mean loss
    model = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class",
                               maxIter=200, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[scaler, _assembler(names, "_z_"), model]).fit(ready)


def _calibrate(base: Base, held_out: DataFrame, names: list[str]) -> IsotonicRegressionModel:
    """Isotonic map from score bins to outcome means; the bins bound what is collected."""
    scored = _base_score(base, held_out, names, "_s")
    bins = scored.groupBy(F.round("_s", SCORE_DECIMALS).alias("_s")).agg(
        F.avg("label").alias("_mean"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    return IsotonicRegression(featuresCol="_s", labelCol="_mean", weightCol="_w", isotonic=True).fit(bins)


def fit_no_show(train: DataFrame, *, estimator: str = "logistic_regression", names: list[str] | None = None,
                calibrate: bool = True, seed: int = SEED, params: dict | None = None, day: str = DAY) -> NoShowModel:
    """Fit on a feature table that keeps ``day``. It is read many times, and should be stored. Calibration folds are contiguous in time."""
    names = list(names or FT.NO_SHOW_FEATURES)
    n, positives = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if calibrate and not 0 < (positives or 0) < n:
        raise ValueError("calibration needs visits with and without a no-show: ask for calibrate=False")
    if not calibrate:
        return NoShowModel(estimator, names, [(_fit_base(estimator, train, names, seed, params), None)], params or {})
    dates = splits.block_dates(train, day, n_splits=CALIBRATION_FOLDS - 1)

    def part(i: int):
        inside = F.col(day).between(*dates[i]) if i in dates else F.lit(False)
        base = _fit_base(estimator, train.filter(~inside & F.col(day).isNotNull()), names, seed, params)
        return base, _calibrate(base, train.filter(inside), names)

    return NoShowModel(estimator, names, concurrently(train.sparkSession, (lambda i=i: part(i) for i in range(CALIBRATION_FOLDS))), params or {})


def select_estimator(train: DataFrame, *, seed: int = SEED, n_splits: int = 3, params: dict | None = None,
                     names: list[str] | None = None, day: str = DAY) -> tuple[str, dict[str, float]]:
    """Better mean average precision over expanding date splits of the training rows."""
    names = list(names or FT.NO_SHOW_FEATURES)
    tagged = stored(train.join(splits.time_series_blocks(train, day, n_splits).select(day, "block"), day))

    def score(kind: str, i: int) -> float:
        base = _fit_base(kind, tagged.filter(F.col("block") < i), names, seed, params if kind == "gradient_boosting" else None)
        return metrics.average_precision(_base_score(base, tagged.filter(F.col("block") == i), names, "score")).first()[0]

    found = iter(concurrently(train.sparkSession, (lambda k=k, i=i: score(k, i) for k in KINDS for i in range(1, n_splits + 1))))
    scores = {kind: sum(next(found) for _ in range(n_splits)) / n_splits for kind in KINDS}
    winner = max(KINDS, key=lambda k: scores[k])
    return winner, {k: round(v, 4) for k, v in scores.items()}


# --- demand ------------------------------------------------------------------------
def _fit_demand_base(strategy: str, train: DataFrame, names: list[str], seed: int, params: dict | None) -> Base:
    """Boosted trees under Poisson loss, or a Poisson regression."""
    if strategy == "gbm":
        return fit_boosted(train, names, "count", "poisson", seed=seed, params={**DEMAND_PARAMS, **(params or {})})
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_features", labelCol="count", predictionCol="_prediction", regParam=1e-4)
    return Pipeline(stages=[_assembler(names), model]).fit(_ready(train, names))


def fit_demand(train: DataFrame, *, strategy: str = "auto", candidates: tuple[str, ...] = ("poisson", "gbm"), seed: int = SEED,
               n_splits: int = 3, params: dict | None = None, day: str = DAY) -> DemandModel:
    """Compare the models with the profile on date splits; a tie keeps the profile."""
    names = list(FT.DEMAND_FEATURES)
    chosen, scores = strategy, {}
    if strategy == "auto":
        tagged = stored(train.join(splits.time_series_blocks(train, day, n_splits).select(day, "block"), day))

        def error(s: str, i: int) -> float:
            part, test = tagged.filter(F.col("block") < i), tagged.filter(F.col("block") == i)
            fitted = None if s == "profile" else _fit_demand_base(s, part, names, seed, params)
            return DemandModel(s, names, fitted).transform(test).agg(F.avg(F.abs(F.col("prediction") - F.col("count")))).first()[0]

        every = ("profile", *candidates)
        found = iter(concurrently(train.sparkSession, (lambda s=s, i=i: error(s, i) for s in every for i in range(1, n_splits + 1))))
        means = {s: sum(next(found) for _ in range(n_splits)) / n_splits for s in every}
        scores = {f"{s}_mae": round(v, 4) for s, v in means.items()}
        best = min(candidates, key=lambda s: means[s])
        chosen = best if means[best] < means["profile"] else "profile"
    fitted = None if chosen == "profile" else _fit_demand_base(chosen, train, names, seed, params)
    return DemandModel(chosen, names, fitted, scores)


# --- duration ------------------------------------------------------------------------
def fit_duration(train: DataFrame, *, seed: int = SEED, params: dict | None = None) -> DurationModel:
    """Boosted trees under absolute loss: the median length."""
    names = list(FT.DURATION_FEATURES)
    return DurationModel(names, fit_boosted(train, names, "duration_minutes", "absolute", seed=seed, params={**DURATION_PARAMS, **(params or {})}))


# --- serving ------------------------------------------------------------------------
def predict_no_show(candidates: DataFrame, history: DataFrame, model: NoShowModel, *, base_rate: float, codes: DataFrame,
                    threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """Score visits that may not exist yet, with the base rate and codes of the card."""
    rows = FT.no_show_features(candidates, base_rate, outcomes=history, codes=codes, keep=keep, resolved_only=False)
    scored = model.transform(rows, "_p")
    return scored.select(
        *keep,
        X.half_even("_p", 4, exact=True).alias("no_show_probability"),
        (F.col("_p") >= threshold).alias("flagged"),
        F.lit(float(threshold)).alias("threshold"),
    )


def predict_duration(candidates: DataFrame, history: DataFrame, model: DurationModel | None, *, codes: DataFrame | None,
                     keep: tuple[str, ...]) -> DataFrame:
    """Predicted length, or 30 minutes marked as a fallback when there is no model."""
    if model is None:
        return candidates.select(
            *keep, F.lit(DEFAULT_DURATION_MINUTES).alias("predicted_duration_minutes"), F.lit(True).alias("fallback")
        )
    if "duration_minutes" not in candidates.columns:
        candidates = candidates.withColumn("duration_minutes", F.lit(0))
    rows = FT.duration_features(candidates, outcomes=history, codes=codes, keep=keep, completed_only=False)
    return model.transform(rows, "_m").select(
        *keep, X.half_even("_m", 1, exact=True).alias("predicted_duration_minutes"), F.lit(False).alias("fallback")
    )


def predict_demand(model: DemandModel, profile: DataFrame, start, end, *, codes: DataFrame | None, open_hour: int = 8,
                   close_hour: int = 18) -> DataFrame:
    """Forecast cells of every specialty in the profile over a date range, by a fitted model."""
    if start > end:
        raise ValueError("start must not be after end")
    spine = demand.calendar_spine(profile.select("specialty").distinct(), F.lit(start), F.lit(end), open_hour, close_hour)
    scored = model.transform(FT.demand_features(spine, profile, codes, keep=("specialty", DAY)), "_d")
    return scored.select(
        "specialty", DAY, F.col("hour_of_day").cast("int").alias("hour_of_day"), X.half_even("_d", 3, exact=True).alias("predicted_demand")
    )


# --- inspection ------------------------------------------------------------------------
def _influence(base: Base) -> list[float]:
    """Gain of the splits on each feature, or sizes of the coefficients."""
    if isinstance(base, Boosted):
        return base.influence()
    return [abs(float(v)) for v in base.stages[-1].coefficients.toArray()]


def _importance(bases: list[Base], names: list[str]) -> list[tuple[str, float]]:
    """Mean influence over the base models, normalised to 1, largest first."""
    sums = [sum(column) for column in zip(*[_influence(b) for b in bases])]
    total = sum(sums) or 1.0
    return sorted(((n, round(v / total, 4)) for n, v in zip(names, sums)), key=lambda p: -p[1])


def ablation(train: DataFrame, test: DataFrame, *, seed: int = SEED) -> list[dict]:
    """Ranking quality with all features, without patient history, and with it alone."""
    groups = {
        "all features": FT.NO_SHOW_FEATURES,
        "without patient history": [c for c in FT.NO_SHOW_FEATURES if c not in FT.HISTORY_FEATURES],
        "patient history only": FT.HISTORY_FEATURES,
    }

    def ranked(label: str, names: list[str]) -> dict:
        auc, ap = metrics.ranking_metrics(fit_no_show(train, names=names, seed=seed).transform(test)).first()
        return {"features": label, "roc_auc": auc, "pr_auc": ap}

    return concurrently(train.sparkSession, (lambda p=p: ranked(*p) for p in groups.items()))
