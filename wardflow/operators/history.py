"""Leakage-safe history: only outcomes that were known at booking time count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions import scalar as X
from wardflow.operators.running import ID_DIGITS, ID_LEVELS, prior_totals, with_id_digits


def asof_history(
    queries: DataFrame,
    outcomes: DataFrame | None = None,
    *,
    key: str = "patient_id",
    query_day: str = "booked_at",
    outcome_day: str = "appointment_date",
    label: str = "label",
    closed: Column | None = None,
) -> DataFrame:
    """Strict as-of join: outcomes dated before the query day.

    Adds ``prior_n``, ``prior_k`` and ``days_since_last``. Both sides are reduced
    to one row per (key, day) before the shuffle; the running window then sees at
    most one row per calendar day of a key, however many visits the key has. With
    one row per day "all rows before this one" is exactly the strict comparison.
    Without ``outcomes`` the rows themselves have them, and are read once for
    both sides.

    ``closed`` is a date: rows whose own outcome is dated before it see only
    outcomes dated before it (and none without a date), as if nothing later
    existed. So training and test rows read one history in one pass.
    """
    booked = day = F.to_date(query_day)
    inside = F.lit(False)
    if closed is not None:
        inside = F.coalesce(F.to_date(outcome_day) < closed, F.lit(False))
        day = F.when(inside & (booked > closed), closed).otherwise(booked)
    asked = F.struct(day.alias("_day"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_k"), F.lit(True).alias("_asked"))
    seen = F.struct(
        F.to_date(outcome_day).alias("_day"), F.lit(1).alias("_n"), F.col(label).cast("long").alias("_k"), F.lit(False).alias("_asked")
    )
    if outcomes is None:
        both = F.when(F.col(label).isNotNull(), F.array(seen, asked)).otherwise(F.array(asked))
        events = queries.select(key, F.inline(both))
    else:
        known = outcomes.filter(F.col(label).isNotNull()).select(key, seen.alias("e"))
        events = known.unionByName(queries.select(key, asked.alias("e"))).select(key, "e.*")
    daily = events.groupBy(key, "_day").agg(
        F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.bool_or("_asked").alias("_asked")
    )
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = {"prior_n": F.col("_n"), "prior_k": F.col("_k")}
    if closed is not None:
        counts |= {f"_undated{c}": F.when(F.col("_day").isNull(), F.col(c)) for c in ("_n", "_k")}
    state = (
        daily.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in counts.items()})
        .withColumn("_last", F.max(F.when(F.col("_n") > 0, F.col("_day"))).over(before))
        .filter("_asked")
        .select(key, "_day", *counts, "_last")
    )
    # Rows without a booking day match nothing and have no known history.
    joined = queries.withColumn("_day", day).join(state, [key, "_day"], "left")
    if closed is not None:
        joined = joined.withColumns({f"prior{c}": F.col(f"prior{c}") - F.when(inside, F.col(f"_undated{c}")).otherwise(0) for c in ("_n", "_k")})
    return (
        joined.withColumn("days_since_last", F.datediff(booked, "_last"))
        .drop("_day", "_last", "_undated_n", "_undated_k")
        .withColumn("prior_n", F.coalesce("prior_n", F.lit(0).cast("long")))
        .withColumn("prior_k", F.coalesce("prior_k", F.lit(0).cast("long")))
    )


def flag_first_visit(
    visits: DataFrame,
    *,
    key: str = "patient_id",
    order: Sequence[str] = ("appointment_date", "start_minute", "visit_id"),
    visit_id: str = "visit_id",
    name: str = "is_new_patient",
) -> DataFrame:
    """True on the first visit of each patient.

    The first row is found by a minimum (partial aggregation), and marked through
    the unique visit id, so no task ever holds all visits of a patient.
    """
    firsts = visits.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).select(
        F.col(f"_first.{visit_id}").alias(visit_id), F.lit(True).alias(name)
    )
    return visits.join(firsts, visit_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def expanding_prior_rate(
    visits: DataFrame,
    base_rate: float,
    *,
    key: str = "patient_id",
    day: str = "appointment_date",
    visit_id: str = "visit_id",
    label: str = "label",
    low: float = 0.01,
    high: float = 0.99,
) -> DataFrame:
    """Running no-show rate of all earlier rows, shrunk to ``base_rate``."""
    counted = prior_totals(
        with_id_digits(visits, visit_id),
        [key],
        [day, *ID_LEVELS],
        [visit_id],
        {"prior_n": F.lit(1), "prior_k": F.col(label)},
    ).drop(*ID_DIGITS)
    rate = X.shrunk_rate("prior_k", "prior_n", F.lit(base_rate))
    return counted.withColumn("prior_rate", F.least(F.greatest(rate, F.lit(low)), F.lit(high)))


def split_half_rates(
    outcomes: DataFrame | None = None,
    *,
    key: str = "patient_id",
    day: str = "appointment_date",
    order: Sequence[str] = ("visit_id",),
    label: str = "label",
    minimum: int = 6,
) -> DataFrame:
    """Mean label in the first ``n // 2`` outcomes of a patient and in the rest.

    Days that lie wholly in one half count as day totals. Only the day that the
    middle of a patient's history falls into is put in order row by row. The last
    column of ``order`` may be the unique id; it is then blocked by its digits.
    """
    daily = outcomes.groupBy(key, day).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_k"))
    history = Window.partitionBy(key)  # one row per calendar day
    before = F.coalesce(F.sum("_n").over(history.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.floor(F.col("n_outcomes") / 2)
    days = (
        daily.withColumn("_before", before)
        .withColumn("n_outcomes", F.sum("_n").over(history))
        .withColumn("_all_k", F.sum("_k").over(history))
        .filter(F.col("n_outcomes") >= minimum)
        .withColumn("_take", F.least(F.greatest(half - F.col("_before"), F.lit(0)), F.col("_n")))
    )
    whole = days.select(
        key, "n_outcomes", "_all_k", F.when(F.col("_take") == F.col("_n"), F.col("_k")).otherwise(0).alias("_early_k")
    )
    middle = days.filter((F.col("_take") > 0) & (F.col("_take") < F.col("_n"))).select(key, day, "_take", "n_outcomes", "_all_k")
    lead, last = list(order[:-1]), order[-1]
    rows = outcomes.join(middle, [key, day])
    levels = [[*lead, last]]  # of a clock and labels
    if last == "visit_id":
        rows, levels = with_id_digits(rows, last), [*lead, *ID_LEVELS]
    placed = prior_totals(rows, [key, day], levels, list(order), {"_position": F.lit(1)})
    split = placed.filter(F.col("_position") < F.col("_take")).select(
        key, "n_outcomes", "_all_k", F.col(label).cast("long").alias("_early_k")
    )
    first = F.floor(F.max("n_outcomes") / 2)
    return whole.unionByName(split).groupBy(key).agg(
        F.max("n_outcomes").alias("n_outcomes"),
        (F.sum("_early_k") / first).alias("early_rate"),
        ((F.max("_all_k") - F.sum("_early_k")) / (F.max("n_outcomes") - first)).alias("late_rate"),
    )
