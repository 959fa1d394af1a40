"""Feature tables of the three models; every feature is known at booking time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.contract import require_columns
from wardflow.functions import scalar as X
from wardflow.operators import demand, history

NO_SHOW_FEATURES = [
    "lead_time_days",
    "log_lead_time",
    "weekday",
    "hour_of_day",
    "month",
    "is_new_patient",
    "urgency_ordinal",
    "duration_minutes",
    "patient_prior_appointments",
    "patient_prior_no_show_rate",
    "patient_prior_no_shows",
    "days_since_patient_last_appointment",
    "specialty_code",
    "is_monday",
    "is_friday",
    "is_early_slot",
    "is_late_slot",
]
HISTORY_FEATURES = [
    "patient_prior_appointments",
    "patient_prior_no_show_rate",
    "patient_prior_no_shows",
    "days_since_patient_last_appointment",
]
DEMAND_FEATURES = [
    "weekday",
    "hour_of_day",
    "month",
    "day_of_year",
    "specialty_code",
    "is_weekend",
    "week_of_year",
    "season_sin",
    "season_cos",
    "profile_mean",
]
DURATION_FEATURES = [
    "specialty_code",
    "is_new_patient",
    "urgency_ordinal",
    "weekday",
    "hour_of_day",
    "patient_prior_appointments",
]
DEFAULT_BASE_RATE = 0.2


def category_codes(df: DataFrame, column: str = "specialty") -> DataFrame:
    """Code = position in the sorted distinct values; fitted once, stored with the model."""
    order = Window.partitionBy(F.lit(0)).orderBy(column)  # the catalogue
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.select((F.row_number().over(order) - 1).alias("specialty_code"), column)


def base_rate(visits: DataFrame) -> DataFrame:
    """One row: mean outcome of the resolved visits, 0.2 when there are none."""
    return visits.agg(F.coalesce(F.avg(X.outcome()), F.lit(DEFAULT_BASE_RATE)).alias("base_rate"))


def _with_codes(df: DataFrame, codes: DataFrame | None) -> DataFrame:
    codes = category_codes(df) if codes is None else codes
    # An unseen category keeps -1, the code of a missing category.
    return df.join(codes, "specialty", "left").withColumn("specialty_code", F.coalesce("specialty_code", F.lit(-1)))


def no_show_features(visits: DataFrame, rate: float | None = None, *, outcomes: DataFrame | None = None,
                     codes: DataFrame | None = None, keep: tuple[str, ...] = (), resolved_only: bool = True, closed: Column | None = None) -> DataFrame:
    """17 features and ``label``; unresolved visits are dropped unless scoring.

    ``rate`` smooths sparse history and must come from training rows when a test
    set is built. ``outcomes`` is the table history is read from (default: the
    visits themselves); the as-of rule keeps it leakage-safe either way.
    ``closed`` keeps later outcomes from the rows dated before it, see :func:`history.asof_history`.
    """
    require_columns(visits)
    frame = visits.withColumn("label", X.outcome())
    known = None if outcomes is None else outcomes.withColumn("label", X.outcome())
    prior_rate = F.lit(float(rate)) if rate is not None else base_rate(visits).scalar()
    rows = frame.filter(F.col("label").isNotNull()) if resolved_only else frame
    if "duration_minutes" not in rows.columns:
        rows = rows.withColumn("duration_minutes", F.lit(None).cast("double"))
    rows = _with_codes(history.asof_history(rows, known, closed=closed), codes).withColumn("_rate", prior_rate)
    hour, weekday = X.hour_of(), X.weekday0()
    flag = lambda c: c.cast("int")
    derived = {
        "lead_time_days": X.lead_days(),
        "log_lead_time": F.log1p(X.lead_days()),
        "weekday": weekday,
        "hour_of_day": hour,
        "month": F.month("appointment_date"),
        "is_new_patient": flag(F.col("is_new_patient")),
        "urgency_ordinal": X.urgency_ordinal(),
        "duration_minutes": F.col("duration_minutes"),
        "patient_prior_appointments": F.col("prior_n"),
        "patient_prior_no_show_rate": X.shrunk_rate("prior_k", "prior_n", "_rate"),
        "patient_prior_no_shows": F.col("prior_k"),
        "days_since_patient_last_appointment": F.col("days_since_last"),
        "specialty_code": F.col("specialty_code"),
        "is_monday": flag(weekday == 0),
        "is_friday": flag(weekday == 4),
        "is_early_slot": flag(hour <= 9),
        "is_late_slot": flag(hour >= 17),
    }
    return rows.select(
        *keep, *[derived[name].cast("double").alias(name) for name in NO_SHOW_FEATURES], F.col("label").cast("int").alias("label")
    )


def demand_features(grid: DataFrame, profile: DataFrame | None = None, codes: DataFrame | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """10 calendar features, and ``count`` where the grid has it. No lags: they do not exist weeks ahead."""
    profile = demand.demand_profile(grid) if profile is None else profile
    rows = demand.with_profile(_with_codes(grid, codes), profile)
    derived = {
        "weekday": F.col("weekday"),
        "hour_of_day": F.col("hour_of_day"),
        "month": F.month("appointment_date"),
        "day_of_year": F.dayofyear("appointment_date"),
        "specialty_code": F.col("specialty_code"),
        "is_weekend": (F.col("weekday") >= 5).cast("int"),
        "week_of_year": F.weekofyear("appointment_date"),
        "season_sin": F.sin(X.season_angle()),
        "season_cos": F.cos(X.season_angle()),
        "profile_mean": F.col("profile_mean"),
    }
    return rows.select(
        *keep,
        *[derived[n].cast("double").alias(n) for n in DEMAND_FEATURES],
        *[F.col("count").cast("double").alias("count")] * ("count" in grid.columns),
    )


def duration_features(visits: DataFrame, *, outcomes: DataFrame | None = None, codes: DataFrame | None = None,
                      keep: tuple[str, ...] = (), completed_only: bool = True) -> DataFrame:
    """6 features and ``duration_minutes``; only completed visits have a length."""
    frame = visits.withColumn("label", X.outcome())
    if outcomes is None:
        rows = history.asof_history(frame)
        rows = rows.filter(F.col("status") == "completed") if completed_only else rows
    else:
        rows = frame.filter(F.col("status") == "completed") if completed_only else frame
        rows = history.asof_history(rows, outcomes.withColumn("label", X.outcome()))
    rows = _with_codes(rows, codes)
    derived = {
        "specialty_code": F.col("specialty_code"),
        "is_new_patient": F.col("is_new_patient").cast("int"),
        "urgency_ordinal": X.urgency_ordinal(),
        "weekday": X.weekday0(),
        "hour_of_day": X.hour_of(),
        "patient_prior_appointments": F.col("prior_n"),
    }
    return rows.select(
        *keep,
        *[derived[n].cast("double").alias(n) for n in DURATION_FEATURES],
        F.col("duration_minutes").cast("double").alias("duration_minutes"),
    )


def specialty_mean_duration(train: DataFrame, test: DataFrame) -> DataFrame:
    """Baseline prediction: mean length of the specialty, overall mean if unseen."""
    means = train.groupBy("specialty").agg(F.avg("duration_minutes").alias("prediction"))
    overall = train.agg(F.avg("duration_minutes").alias("m")).scalar()
    return demand.lookup_with_fallback(test, means, ["specialty"], "prediction", overall)
