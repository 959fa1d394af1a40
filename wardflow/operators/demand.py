"""Demand grid, profile and the shape aggregates behind the structure gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions import scalar as X

GRID = ["specialty", "appointment_date", "hour_of_day"]
PROFILE = ["specialty", "weekday", "hour_of_day"]

# Right-closed lead-time edges and their labels.
LEAD_EDGES = [-1, 0, 1, 3, 7, 14, 21, 30, 45, 1000]
LEAD_LABELS = ["0", "1", "2-3", "4-7", "8-14", "15-21", "22-30", "31-45", "46+"]


def calendar_spine(keys: DataFrame, lo, hi, open_hour: int, close_hour: int) -> DataFrame:
    """Every (key, date, hour): generated per key row, without a cross join."""
    return (
        keys.withColumn("_lo", X.col(lo))
        .withColumn("_hi", X.col(hi))
        .withColumn("appointment_date", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
        .withColumn("hour_of_day", F.explode(F.sequence(F.lit(open_hour), F.lit(close_hour))))
    )


def demand_grid(visits: DataFrame, *, open_hour: int = 8, close_hour: int = 18) -> DataFrame:
    """Zero-filled count per (specialty, date, hour); cancelled visits are not demand."""
    observed = (
        visits.filter(X.occupies())
        .groupBy("specialty", "appointment_date", X.hour_of().alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # Keys and bounds come from the reduced counts, so the fact is read once.
    bounds = observed.agg(F.min("appointment_date").alias("lo"), F.max("appointment_date").alias("hi"))
    spine = calendar_spine(
        observed.select("specialty").distinct(),
        bounds.select("lo").scalar(),
        bounds.select("hi").scalar(),
        open_hour,
        close_hour,
    )
    return spine.join(observed, GRID, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def demand_profile(train_grid: DataFrame) -> DataFrame:
    """Mean count per (specialty, weekday, hour), from training rows only."""
    return (
        train_grid.withColumn("weekday", X.weekday0())
        .groupBy(*PROFILE)
        .agg(F.avg("count").alias("profile_mean"))
    )


def lookup_with_fallback(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, fallback) -> DataFrame:
    """Left lookup; rows without a match take ``fallback`` (a literal or a scalar)."""
    return df.join(table.select(*keys, value), list(keys), "left").withColumn(
        "_fallback", X.col(fallback)
    ).withColumn(value, F.coalesce(value, "_fallback", F.lit(0.0))).drop("_fallback")


def with_profile(grid: DataFrame, profile: DataFrame) -> DataFrame:
    """Profile feature; unseen combinations take the mean of the profile."""
    overall = profile.agg(F.avg("profile_mean").alias("m")).scalar()
    return lookup_with_fallback(grid.withColumn("weekday", X.weekday0()), profile, PROFILE, "profile_mean", overall)


def seasonal_naive(train_grid: DataFrame, test_grid: DataFrame) -> DataFrame:
    """Profile prediction; unseen combinations take the mean training count."""
    overall = train_grid.agg(F.avg("count").alias("m")).scalar()
    return lookup_with_fallback(
        test_grid.withColumn("weekday", X.weekday0()), demand_profile(train_grid), PROFILE, "profile_mean", overall
    ).withColumnRenamed("profile_mean", "prediction")


def forecast_demand(profile: DataFrame, start, end, *, open_hour: int = 8, close_hour: int = 18) -> DataFrame:
    """Forecast cells of every specialty in the profile over a date range."""
    if start > end:
        raise ValueError("start must not be after end")
    spine = calendar_spine(profile.select("specialty").distinct(), F.lit(start), F.lit(end), open_hour, close_hour)
    return with_profile(spine, profile).select(
        *GRID, X.half_even(F.greatest("profile_mean", F.lit(0.0)), 3, exact=True).alias("predicted_demand")
    )


# --- shapes ----------------------------------------------------------------------
def lead_buckets(past: DataFrame, lead: str = "lead_days", label: str = "no_show") -> DataFrame:
    """No-show rate by right-closed lead-time bucket."""
    index = None
    for i, upper in enumerate(LEAD_EDGES[1:]):
        inside = F.col(lead) <= upper
        index = F.when(inside, i) if index is None else index.when(inside, i)
    return (
        past.withColumn("bucket", index)
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.avg(label).alias("mean"), F.count(label).alias("count"))
        .withColumn("lead_bucket", F.element_at(F.array(*[F.lit(x) for x in LEAD_LABELS]), F.col("bucket") + 1))
    )


def rate_by(past: DataFrame, column: str, label: str = "no_show") -> DataFrame:
    return past.groupBy(column).agg(F.avg(label).alias("rate"), F.count(label).alias("n"))


def day_edges_rates(past: DataFrame) -> DataFrame:
    """Monday, Friday, midweek and edge/middle-of-day rates (means of group means)."""
    by_day = rate_by(past, "weekday")
    by_hour = rate_by(past, "hour")
    return by_day.agg(
        F.max(F.when(F.col("weekday") == 0, F.col("rate"))).alias("monday"),
        F.max(F.when(F.col("weekday") == 4, F.col("rate"))).alias("friday"),
        F.avg(F.when(F.col("weekday").isin(1, 2, 3), F.col("rate"))).alias("midweek"),
    ).withColumn(
        "edges", by_hour.agg(F.avg(F.when(F.col("hour").isin(8, 17, 18), F.col("rate"))).alias("e")).scalar()
    ).withColumn(
        "middle", by_hour.agg(F.avg(F.when(F.col("hour").isin(11, 12, 13), F.col("rate"))).alias("m")).scalar()
    )


def _visits(weight: str | None) -> Column:
    """Number of visits: rows, or the count column of an input that is already reduced."""
    return F.sum(weight) if weight else F.count(F.lit(1))


def weekday_load(every: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean visits per active day by weekday; days without visits are not averaged."""
    per_day = every.filter(X.occupies()).groupBy("appointment_date").agg(_visits(weight).alias("n"))
    return per_day.groupBy(X.weekday0().alias("weekday")).agg(
        F.avg("n").alias("mean_visits"), F.count(F.lit(1)).alias("active_days")
    )


def weekday_split(load: DataFrame) -> DataFrame:
    """Weekday and weekend means (of the weekday means) and the busiest working day."""
    working = F.col("weekday") < 5
    return load.agg(
        F.avg(F.when(working, F.col("mean_visits"))).alias("weekday_mean"),
        F.avg(F.when(~working, F.col("mean_visits"))).alias("weekend_mean"),
        F.min_by("weekday", F.when(working, F.struct(-F.col("mean_visits"), F.col("weekday")))).alias("busiest_weekday"),
    )


def hour_of_week(every: DataFrame) -> DataFrame:
    """Hour x weekday matrix of non-cancelled visits, empty cells 0."""
    live = every.filter(X.occupies()).select(X.hour_of().alias("hour"), X.weekday0().alias("weekday"))
    wide = live.groupBy("hour").pivot("weekday", list(range(7))).agg(F.count(F.lit(1)))
    return wide.select("hour", *[F.coalesce(F.col(str(d)), F.lit(0).cast("long")).alias(f"wd{d}") for d in range(7)])


def hour_profile(every: DataFrame, weight: str | None = None) -> DataFrame:
    """Per specialty and hour: count, share of the specialty, and the peak hour."""
    hour = F.col("hour") if weight else X.hour_of().alias("hour")
    counts = every.filter(X.occupies()).groupBy("specialty", hour).agg(_visits(weight).alias("n"))
    whole = Window.partitionBy("specialty")  # at most 24 rows
    return counts.select(
        "specialty",
        "hour",
        "n",
        (F.col("n") / F.sum("n").over(whole)).alias("share"),
        F.first("hour").over(whole.orderBy(F.desc("n"), "hour")).alias("peak_hour"),
    )


def duration_by_specialty(every: DataFrame) -> DataFrame:
    """Mean duration, and the new-patient difference, per specialty."""
    return every.groupBy("specialty").agg(
        F.avg("duration_minutes").alias("mean_duration"),
        F.avg(F.when(F.col("is_new_patient"), F.col("duration_minutes"))).alias("mean_new"),
        F.avg(F.when(~F.col("is_new_patient"), F.col("duration_minutes"))).alias("mean_returning"),
    ).withColumn("new_minus_returning", F.col("mean_new") - F.col("mean_returning"))
