"""Registered queries: fitted models.

Iterative fits have no SQL form. What a fit has to satisfy, and the keys and
counts of what it scores, are stated in SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import demand, features as FT, metrics, models, quality, splits
from wardflow.plans.catalog import register, with_views
from wardflow.session import stored
from wardflow.operators.boosting import fit_boosted
from wardflow.plans.registered_history import CODES_SQL, CUTOFF_SQL
from wardflow.sources import sinks, tables as T


def _bookings(spark, folder):
    """The bookings, joined once and stored: codes, cutoff, rate, training rows and outcomes are all read from them. No model reads the doctor."""
    return stored(T.bookings(spark, folder).drop("doctor_id"))


def _codes(frame):
    """The catalogue of codes, stored: its size is known when a join is planned, so rows are not shuffled by specialty to meet a few codes."""
    return stored(FT.category_codes(frame))


def _holdout(spark, folder):
    """Feature tables of the last dates and of everything before them."""
    frame = _bookings(spark, folder)
    codes = _codes(frame)
    train, test = splits.final_holdout(frame)
    rate = FT.base_rate(train).first()[0]
    x_train = FT.no_show_features(train, rate, codes=codes, keep=("appointment_date",))
    x_test = FT.no_show_features(test, rate, outcomes=frame, codes=codes, keep=("patient_id", "appointment_date"))
    return stored(x_train), x_test


def _both(spark, folder):
    """The tables of :func:`_holdout`, where the test rows are read too: one history serves both, and what is stored is read by date."""
    frame = _bookings(spark, folder)
    codes = _codes(frame)
    cutoff = F.lit(splits.holdout_cutoff(frame).first()[0])
    day = F.col("appointment_date")
    rate = FT.base_rate(frame.filter(day < cutoff)).first()[0]
    rows = stored(FT.no_show_features(frame, rate, codes=codes, keep=("patient_id", "appointment_date"), closed=cutoff))
    return rows.filter(day < cutoff).drop("patient_id"), rows.filter(day >= cutoff)


def _scored(model, test):
    """What the measures read several times, without the features and the history behind it."""
    return stored(model.transform(test).select("label", "score"))


def _grid(spark, folder):
    """The demand grid, a calendar's worth of cells, counted once and stored."""
    return stored(demand.demand_grid(T.visits(spark, folder)))


@register("no_show_logistic_scores")
def no_show_logistic_scores(spark, folder):
    train, test = _both(spark, folder)
    scored = models.fit_no_show(train, calibrate=False).transform(test)
    return scored.select("patient_id", "appointment_date", "label", F.round("score", 6).alias("score"))


@register("no_show_calibrated_metrics")
def no_show_calibrated_metrics(spark, folder):
    train, test = _both(spark, folder)
    return metrics.classification_metrics(_scored(models.fit_no_show(train), test), 0.3)


@register("no_show_boosted_metrics")
def no_show_boosted_metrics(spark, folder):
    train, test = _both(spark, folder)
    model = models.fit_no_show(train, estimator="gradient_boosting", calibrate=False)
    return metrics.classification_metrics(_scored(model, test), 0.3)


@register("no_show_feature_importance")
def no_show_feature_importance(spark, folder):
    train, _ = _holdout(spark, folder)
    pairs = models.fit_no_show(train, calibrate=False).importance()
    return spark.createDataFrame(pairs, "feature string, importance double")


@register("demand_poisson_metrics")
def demand_poisson_metrics(spark, folder):
    grid = _grid(spark, folder)
    codes = FT.category_codes(grid)
    train, test = splits.final_holdout(grid)
    profile = demand.demand_profile(train)
    model = models.fit_demand(stored(FT.demand_features(train, profile, codes, keep=("appointment_date",))), strategy="poisson")
    scored = model.transform(FT.demand_features(test, profile, codes)).withColumn("label", F.col("count"))
    return metrics.regression_metrics(scored)


@register("demand_boosted_metrics")
def demand_boosted_metrics(spark, folder):
    grid = _grid(spark, folder)
    codes = FT.category_codes(grid)
    train, test = splits.final_holdout(grid)
    profile = demand.demand_profile(train)
    model = models.fit_demand(stored(FT.demand_features(train, profile, codes, keep=("appointment_date",))), strategy="gbm")
    scored = model.transform(FT.demand_features(test, profile, codes)).withColumn("label", F.col("count"))
    return metrics.regression_metrics(scored)


@register("duration_boosted_metrics")
def duration_boosted_metrics(spark, folder):
    frame = _bookings(spark, folder)
    codes = _codes(frame)
    train, test = splits.final_holdout(frame)
    model = models.fit_duration(stored(FT.duration_features(train, codes=codes)))
    scored = model.transform(FT.duration_features(test, outcomes=frame, codes=codes)).withColumn("label", F.col("duration_minutes"))
    return metrics.regression_metrics(scored)


@register("candidate_scores")
def candidate_scores(spark, folder):
    """Cancelled bookings offered again: scored as candidates with history and a flag."""
    frame = _bookings(spark, folder)
    codes = _codes(frame)
    rate = FT.base_rate(frame).first()[0]
    train = stored(FT.no_show_features(frame, rate, codes=codes, keep=("appointment_date",)))
    model = models.fit_no_show(train, calibrate=False)
    again = frame.filter(~X.occupies())
    return models.predict_no_show(
        again, frame, model, base_rate=rate, codes=codes, threshold=0.4, keep=("patient_id", "appointment_date")
    )


RESOLVED_TRAIN = "status IN ('completed', 'no_show') AND appointment_date < cutoff"


@register(
    "no_show_score_equations",
    with_views("bookings", f"""SELECT is_new_patient, count(*) AS n, sum(CAST(status = 'no_show' AS INT)) AS no_shows, true AS balanced
        FROM bookings, cut WHERE {RESOLVED_TRAIN} GROUP BY 1""", cut=CUTOFF_SQL),
)
def no_show_score_equations(spark, folder):
    """At the optimum of the logistic fit, expected and observed no-shows agree for both values of an indicator."""
    train, _ = _holdout(spark, folder)
    scored = models.fit_no_show(train, calibrate=False).transform(train)
    sums = scored.groupBy((F.col("is_new_patient") == 1).alias("is_new_patient")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("no_shows"), F.sum("score").alias("_expected")
    )
    return sums.select("is_new_patient", "n", "no_shows", (F.abs(F.col("_expected") - F.col("no_shows")) < 0.002 * F.col("n")).alias("balanced"))


@register(
    "no_show_scored_rows",
    with_views("bookings", """SELECT CAST(appointment_date AS VARCHAR) AS appointment_date, count(*) AS n, count(DISTINCT patient_id) AS patients,
        sum(CAST(status = 'no_show' AS INT)) AS no_shows, true AS in_range FROM bookings, cut
        WHERE status IN ('completed', 'no_show') AND appointment_date >= cutoff GROUP BY 1""", cut=CUTOFF_SQL),
)
def no_show_scored_rows(spark, folder):
    """Every resolved booking of the last dates gets one probability."""
    train, test = _both(spark, folder)
    scored = models.fit_no_show(train, calibrate=False).transform(test)
    return scored.groupBy("appointment_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("patients"), F.sum("label").alias("no_shows"),
        F.min(F.col("score").between(0, 1) & F.col("score").isNotNull()).alias("in_range"),
    )


@register(
    "calibrator_facts",
    with_views("bookings", f"""SELECT count(*) AS n, sum(CAST(status = 'no_show' AS INT)) AS no_shows, true AS mean_kept, true AS rising
        FROM bookings, cut WHERE {RESOLVED_TRAIN}""", cut=CUTOFF_SQL),
)
def calibrator_facts(spark, folder):
    """The isotonic map keeps the mean of the rows it was fitted on and never falls."""
    train, _ = _holdout(spark, folder)
    base = models.fit_no_show(train, calibrate=False).parts[0][0]
    fitted = models.NoShowModel("logistic_regression", list(FT.NO_SHOW_FEATURES), [(base, models._calibrate(base, train, list(FT.NO_SHOW_FEATURES)))])
    plain = models.NoShowModel("logistic_regression", list(FT.NO_SHOW_FEATURES), [(base, None)])
    both = fitted.transform(plain.transform(train, "raw"), "score").withColumn("raw", F.round("raw", models.SCORE_DECIMALS))
    steps = both.groupBy("raw").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    # Bounded by the decimals of a score: at most 10,001 rows.
    falls = steps.select(F.lead("low").over(Window.partitionBy(F.lit(0)).orderBy("raw")).alias("next"), "high").agg(F.count_if(F.col("next") < F.col("high") - 1e-9).alias("n"))
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("no_shows"), F.sum("score").alias("s"))
    return sums.select("n", "no_shows", (F.abs(F.col("s") - F.col("no_shows")) < 1e-6 * F.col("n")).alias("mean_kept"), (falls.scalar() == 0).alias("rising"))


@register(
    "demand_score_equations",
    with_views("grid", """SELECT isodow(appointment_date) >= 6 AS is_weekend, count(*) AS n, CAST(sum(count) AS BIGINT) AS visits, true AS balanced
        FROM grid GROUP BY 1"""),
)
def demand_score_equations(spark, folder):
    """At the optimum of the Poisson fit, expected and observed visits agree on weekends and on weekdays."""
    grid = _grid(spark, folder)
    rows = stored(FT.demand_features(grid, None, FT.category_codes(grid)))
    scored = models.fit_demand(rows, strategy="poisson").transform(rows)
    sums = scored.groupBy((F.col("is_weekend") == 1).alias("is_weekend")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").cast("long").alias("visits"), F.sum("prediction").alias("_expected")
    )
    return sums.select("is_weekend", "n", "visits", (F.abs(F.col("_expected") - F.col("visits")) < 0.01 * F.col("visits") + 1).alias("balanced"))


@register(
    "importance_facts",
    "SELECT CAST(17 AS BIGINT) AS features, true AS sums_to_one, true AS none_negative, count(*) AS orders FROM orders",
)
def importance_facts(spark, folder):
    train, _ = _holdout(spark, folder)
    pairs = spark.createDataFrame(models.fit_no_show(train, calibrate=False).importance(), "feature string, importance double")
    orders = spark.read.parquet(f"{folder}/orders.parquet").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.count_distinct("feature").alias("features"), (F.abs(F.sum("importance") - 1) < 0.002).alias("sums_to_one"), (F.min("importance") >= 0).alias("none_negative"),
    ).withColumn("orders", orders.scalar())


@register(
    "fitted_demand_forecast",
    with_views("grid", """SELECT specialty, CAST(14 * 11 AS BIGINT) AS cells, CAST(last + 1 AS VARCHAR) AS first_date, CAST(last + 14 AS VARCHAR) AS last_date,
        CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS repeated
        FROM (SELECT DISTINCT specialty FROM grid), (SELECT max(appointment_date) AS last FROM grid)"""),
)
def fitted_demand_forecast(spark, folder):
    """Two weeks after the data, forecast by a fitted model, written as a model version, read back and checked."""
    grid = _grid(spark, folder)
    codes, profile = FT.category_codes(grid), demand.demand_profile(grid)
    model = models.fit_demand(stored(FT.demand_features(grid, profile, codes)), strategy="poisson")
    last = grid.agg(F.max("appointment_date")).first()[0]
    cells = models.predict_demand(model, profile, last + dt.timedelta(days=1), last + dt.timedelta(days=14), codes=codes)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/forecast-{uuid.uuid4().hex}"
    sinks.write_forecast(cells, place, "poisson")
    written = spark.read.parquet(place)
    wrong = F.lit(False)
    for rule in quality.FORECAST_RULES.values():
        wrong = wrong | ~F.expr(rule)
    return written.groupBy("specialty").agg(
        F.count(F.lit(1)).alias("cells"), F.min("appointment_date").alias("first_date"), F.max("appointment_date").alias("last_date"),
        F.count_if(wrong).alias("violations"), (F.count(F.lit(1)) - F.count_distinct(*sinks.FORECAST_KEY)).alias("repeated"),
    )


@register(
    "duration_fallback",
    with_views("bookings", """SELECT patient_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
        CAST(30 AS DOUBLE) AS predicted_duration_minutes, true AS fallback FROM bookings"""),
)
def duration_fallback(spark, folder):
    """Without a model every candidate gets the default length, marked as a fallback."""
    frame = T.bookings(spark, folder)
    return models.predict_duration(frame, frame, None, codes=None, keep=("patient_id", "appointment_date"))


# --- boosted trees ----------------------------------------------------------------------
# The first split of an ensemble is a closed expression of the data, so SQL can state it for every loss.
SPLIT_SQL = """SELECT feature, v AS threshold, round(gain, 3) AS gain, {left} AS left_value, {right} AS right_value
    FROM (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM sides WHERE nl >= {least} AND n - nl >= {least})
    WHERE gain > 1e-9 ORDER BY round(gain, 6) DESC, place, v LIMIT 1"""
SIDES_SQL = """SELECT place, feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
      sum(g) OVER (PARTITION BY place) AS g, sum(h) OVER (PARTITION BY place) AS h, sum(n) OVER (PARTITION BY place) AS n
    FROM (SELECT place, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM long GROUP BY ALL) WINDOW w AS (PARTITION BY place ORDER BY v)"""
NEWTON = {"left": "round(-gl / (hl + 1), 6)", "right": "round(-(g - gl) / (h - hl + 1), 6)"}
MEDIANS = {"left": "(SELECT quantile_disc(y - start, 0.5) FROM long l WHERE l.place = b.place AND l.v <= b.threshold)",
           "right": "(SELECT quantile_disc(y - start, 0.5) FROM long l WHERE l.place = b.place AND l.v > b.threshold)"}
DATE_SQL = {"weekday": "isodow(appointment_date) - 1", "month": "month(appointment_date)", "week_of_year": "weekofyear(appointment_date)",
            "is_weekend": "CAST(isodow(appointment_date) >= 6 AS INT)", "hour_of_day": "{hour}", "specialty_code": "code",
            "lead_time_days": "greatest(date_diff('day', booked_at, appointment_date), 0)", "is_new_patient": "CAST(is_new_patient AS INT)",
            "urgency_ordinal": "CASE urgency WHEN 'urgent' THEN 1 WHEN 'emergency' THEN 2 ELSE 0 END"}
NO_SHOW_SMALL = ["lead_time_days", "weekday", "hour_of_day", "month", "is_new_patient", "urgency_ordinal", "specialty_code"]
DEMAND_SMALL = ["weekday", "hour_of_day", "month", "specialty_code", "is_weekend", "week_of_year"]
DURATION_SMALL = ["specialty_code", "is_new_patient", "urgency_ordinal", "weekday", "hour_of_day"]


def _split_sql(source: str, where: str, names: list[str], y: str, g: str, h: str, least: int, hour: str = "start_minute // 60", median: bool = False) -> str:
    """Best first split over all distinct values of the named features."""
    values = ", ".join(f"{{'place': {i}, 'feature': '{n}', 'v': CAST({DATE_SQL[n].format(hour=hour)} AS DOUBLE)}}" for i, n in enumerate(names))
    start = "median(y)" if median else "avg(y)"
    body = SPLIT_SQL.format(least=least, **({"left": "place", "right": "place"} if median else NEWTON))
    if median:
        body = f"SELECT feature, threshold, gain, {MEDIANS['left']} AS left_value, {MEDIANS['right']} AS right_value FROM (" + body.replace(
            "place AS left_value, place AS right_value", "place") + ") b"
    return with_views(
        source, body, codes=CODES_SQL.replace("FROM bookings", f"FROM {source}"), cut=CUTOFF_SQL.replace("FROM bookings", f"FROM {source}"),
        chosen=f"SELECT *, CAST({y} AS DOUBLE) AS y FROM {source} JOIN codes USING (specialty), cut WHERE {where}",
        begun=f"SELECT {start} AS start FROM chosen",
        long=f"""SELECT y, start, {g} AS g, {h} AS h, x.place AS place, x.feature AS feature, x.v AS v
                 FROM (SELECT y, start, unnest([{values}]) AS x FROM chosen, begun)""",
        sides=SIDES_SQL)


def _root_split(spark, rows, names, label, loss, least):
    settings = {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "minInstancesPerNode": least}
    model = fit_boosted(rows, names, label, loss, params=settings)
    found = [(names[t.feature[0]], float(model.edges[t.feature[0]][t.cut[0]]), float(t.gain[0]), float(t.value[1]), float(t.value[2])) for t in model.trees]
    out = spark.createDataFrame(found, "feature string, threshold double, gain double, left_value double, right_value double")
    return out.select("feature", "threshold", F.round("gain", 3).alias("gain"), F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"))


@register("no_show_root_split", _split_sql("bookings", RESOLVED_TRAIN, NO_SHOW_SMALL, "status = 'no_show'", "start - y", "start * (1 - start)", 40))
def no_show_root_split(spark, folder):
    """Log loss: the first split of the boosted no-show model and the Newton steps of its sides."""
    train, _ = _holdout(spark, folder)
    return _root_split(spark, train, NO_SHOW_SMALL, "label", "log", 40)


@register("demand_root_split", _split_sql("grid", "appointment_date < cutoff", DEMAND_SMALL, "count", "start - y", "start", 100, "hour_of_day"))
def demand_root_split(spark, folder):
    """Poisson loss: the first split of the boosted demand model and the Newton steps of its sides."""
    grid = _grid(spark, folder)
    rows = FT.demand_features(splits.final_holdout(grid)[0], None, FT.category_codes(grid))
    return _root_split(spark, rows, DEMAND_SMALL, "count", "poisson", 100)


@register("duration_root_split", _split_sql("bookings", "status = 'completed' AND appointment_date < cutoff", DURATION_SMALL, "duration_minutes", "sign(start - y)", "1.0", 40, median=True))
def duration_root_split(spark, folder):
    """Absolute loss: the first split of the boosted duration model and the medians of its sides."""
    frame = _bookings(spark, folder)
    rows = FT.duration_features(splits.final_holdout(frame)[0], codes=_codes(frame))
    return _root_split(spark, stored(rows.select(*DURATION_SMALL, "duration_minutes")), DURATION_SMALL, "duration_minutes", "absolute", 40)


# --- serving and selection ----------------------------------------------------------------
@register(
    "duration_served",
    with_views("bookings", "SELECT specialty, count(*) AS n, true AS in_range, CAST(0 AS BIGINT) AS fallbacks FROM bookings WHERE status = 'cancelled' GROUP BY 1"),
)
def duration_served(spark, folder):
    """Cancelled bookings offered again get a length from a fitted model, none of them the fallback."""
    frame = _bookings(spark, folder)
    codes = _codes(frame)
    model = models.fit_duration(stored(FT.duration_features(frame, codes=codes)), params={"maxIter": 10})
    again = frame.filter(~X.occupies())
    served = models.predict_duration(again, frame, model, codes=codes, keep=("specialty",))
    inside = F.col("predicted_duration_minutes").between(5, 240)
    return served.groupBy("specialty").agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_range"), F.count_if("fallback").alias("fallbacks"))


@register("estimator_selection")
def estimator_selection(spark, folder):
    """Mean average precision of both estimators over date splits that run side by side, and the winner."""
    train, _ = _holdout(spark, folder)
    winner, scores = models.select_estimator(train)
    return spark.createDataFrame([(name, value, name == winner) for name, value in scores.items()], "estimator string, average_precision double, chosen boolean")


@register("feature_ablation")
def feature_ablation(spark, folder):
    """Ranking quality with all features, without patient history and with it alone; the three fits run side by side."""
    train, test = _both(spark, folder)
    rows = models.ablation(train, test)
    return spark.createDataFrame([(r["features"], r["roc_auc"], r["pr_auc"]) for r in rows], "features string, roc_auc double, pr_auc double")
