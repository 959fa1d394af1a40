"""Leakage cases with hand-checked numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.contract import require_columns
from wardflow.operators import demand, features, history, splits
from wardflow.functions import scalar as X

D = dt.date


def visits(spark, rows):
    """rows: id, patient, date, booked, status[, specialty, start, duration]."""
    full = []
    for r in rows:
        r = list(r) + [None] * (8 - len(r))
        full.append((r[0], r[1], 7, r[5] or "cardiology", r[2], r[6] or 540, r[7] or 30, r[4], "routine", False, r[3]))
    return spark.createDataFrame(
        full,
        "visit_id long, patient_id long, doctor_id long, specialty string, appointment_date date, start_minute int, "
        "duration_minutes int, status string, urgency string, is_new_patient boolean, booked_at date",
    )


def built(spark, rows, rate=0.2):
    out = features.no_show_features(visits(spark, rows), rate, keep=("visit_id",))
    return {r["visit_id"]: r for r in out.collect()}


def test_own_outcome_is_excluded(spark):
    row = built(spark, [(1, 1, D(2026, 3, 10), D(2026, 3, 1), "no_show")])[1]
    assert (row["patient_prior_appointments"], row["patient_prior_no_shows"], row["label"]) == (0, 0, 1)


def test_history_accumulates_and_ties_are_excluded(spark):
    rows = [
        (1, 1, D(2026, 1, 10), D(2026, 1, 1), "no_show"),
        (2, 1, D(2026, 2, 10), D(2026, 2, 1), "no_show"),
        (3, 1, D(2026, 3, 10), D(2026, 3, 1), "completed"),
        (4, 1, D(2026, 4, 10), D(2026, 4, 1), "completed"),
        (5, 1, D(2026, 4, 20), D(2026, 4, 10), "completed"),  # booked on the day of visit 4
    ]
    got = built(spark, rows)
    assert [got[i]["patient_prior_appointments"] for i in range(1, 6)] == [0, 1, 2, 3, 3]
    assert [got[i]["patient_prior_no_shows"] for i in range(1, 6)] == [0, 1, 2, 2, 2]
    assert got[2]["days_since_patient_last_appointment"] == 22
    assert got[1]["days_since_patient_last_appointment"] is None


def test_booked_but_not_attended_is_unknown(spark):
    rows = [
        (1, 1, D(2026, 6, 1), D(2026, 1, 1), "no_show"),
        (2, 1, D(2026, 3, 1), D(2026, 2, 1), "completed"),
    ]
    assert built(spark, rows)[2]["patient_prior_appointments"] == 0


def test_patients_do_not_mix_and_cancelled_has_no_label(spark):
    rows = [
        (1, 1, D(2026, 1, 10), D(2026, 1, 1), "no_show"),
        (2, 2, D(2026, 3, 10), D(2026, 3, 1), "completed"),
        (3, 2, D(2026, 1, 12), D(2026, 1, 1), "cancelled"),
    ]
    got = built(spark, rows)
    assert set(got) == {1, 2}
    assert got[2]["patient_prior_appointments"] == 0


def test_shrinkage_and_injected_base_rate(spark):
    rows = [(1, 1, D(2026, 1, 10), D(2026, 1, 1), "no_show"), (2, 1, D(2026, 3, 10), D(2026, 3, 1), "completed")]
    assert built(spark, rows)[2]["patient_prior_no_show_rate"] == pytest.approx((1 + 5 * 0.2) / 6)
    low, high = built(spark, rows, 0.05)[2], built(spark, rows, 0.5)[2]
    assert low["patient_prior_no_show_rate"] < high["patient_prior_no_show_rate"]


def test_missing_booking_day_has_no_history(spark):
    rows = [(1, 1, D(2026, 1, 10), D(2026, 1, 1), "no_show"), (2, 1, D(2026, 3, 10), None, "completed")]
    got = built(spark, rows)
    assert got[2]["patient_prior_appointments"] == 0
    assert got[2]["lead_time_days"] == 0


def test_one_hot_patient_equals_brute_force(spark):
    """One patient with most of the rows, many on the same day."""
    rows = [(i, 1 if i % 3 else i % 7, D(2026, 1, 1) + dt.timedelta(days=(i * 37) % 60), D(2025, 12, 20) + dt.timedelta(days=(i * 11) % 70),
             ["completed", "no_show", "cancelled"][i % 3 if i % 5 else 1]) for i in range(600)]
    frame = visits(spark, rows).withColumn("label", X.outcome())
    got = {r["visit_id"]: (r["prior_n"], r["prior_k"]) for r in history.asof_history(frame, frame).collect()}
    for i, patient, _, booked, _ in rows:
        seen = [s for (_, p, day, _, s) in rows if p == patient and day < booked and s in ("completed", "no_show")]
        assert got[i] == (len(seen), seen.count("no_show"))


def test_expanding_rate_equals_brute_force(spark):
    rows = [(i, i % 2, D(2026, 1, 1) + dt.timedelta(days=(i * 7) % 5), D(2026, 1, 1), ["completed", "no_show"][(i * i) % 2]) for i in range(200)]
    frame = visits(spark, rows).withColumn("label", X.outcome())
    got = {r["visit_id"]: (r["prior_n"], r["prior_k"]) for r in history.expanding_prior_rate(frame, 0.2).collect()}
    for i, patient, day, _, _ in rows:
        seen = [s for (j, p, d, _, s) in rows if p == patient and (d, j) < (day, i)]
        assert got[i] == (len(seen), seen.count("no_show"))


def test_required_columns():
    class Frame:
        columns = ["patient_id", "status"]

    with pytest.raises(ValueError, match=r"missing required columns: \['appointment_date', 'booked_at'"):
        require_columns(Frame())


def test_demand_grid_is_zero_filled(spark):
    rows = [
        (1, 1, D(2026, 3, 2), D(2026, 3, 1), "completed", "a", 540),
        (2, 1, D(2026, 3, 4), D(2026, 3, 1), "completed", "a", 600),
        (3, 1, D(2026, 3, 3), D(2026, 3, 1), "cancelled", "a", 600),
    ]
    grid = demand.demand_grid(visits(spark, rows), open_hour=9, close_hour=11).collect()
    assert len(grid) == 9
    assert sum(r["count"] for r in grid) == 2
    assert sum(r["count"] == 0 for r in grid) == 7


def test_profile_fallback_is_the_profile_mean(spark):
    rows = [(1, 1, D(2026, 3, 2), D(2026, 3, 1), "completed", "a", 540)]
    grid = demand.demand_grid(visits(spark, rows), open_hour=9, close_hour=10)
    unseen = spark.createDataFrame([("z", D(2026, 3, 3), 9, 0)], "specialty string, appointment_date date, hour_of_day int, count long")
    assert demand.with_profile(unseen, demand.demand_profile(grid)).first()["profile_mean"] == pytest.approx(0.5)


def test_specialty_means_with_fallback(spark):
    train = spark.createDataFrame([("a", 10), ("a", 20), ("b", 40), ("b", 60)], "specialty string, duration_minutes int")
    test = spark.createDataFrame([("a",), ("b",), ("c",)], "specialty string")
    got = {r["specialty"]: r["prediction"] for r in features.specialty_mean_duration(train, test).collect()}
    assert got == {"a": 15.0, "b": 50.0, "c": 32.5}


def test_folds_grow_and_never_overlap(spark):
    days = spark.range(800).select(F.date_add(F.lit(D(2024, 1, 1)), F.col("id").cast("int")).alias("appointment_date"))
    folds = splits.rolling_origin_folds(days)
    assert len(folds) == 4
    sizes = []
    for fold in folds:
        train, test = splits.split_by_fold(days, fold)
        splits.assert_no_temporal_leakage(train, test)
        sizes.append(train.count())
        assert test.count() == 90
    assert sizes == sorted(sizes) and len(set(sizes)) == 4
    table = [tuple(r) for r in splits.fold_table(days).orderBy("fold").collect()]
    assert table == [(f.index, f.train_end, f.test_start, f.test_end) for f in folds]
    with pytest.raises(ValueError, match="need"):
        splits.rolling_origin_folds(days, n_folds=9)
    with pytest.raises(AssertionError, match="not before the first test date"):
        splits.assert_no_temporal_leakage(days, days)


def test_holdout_is_chronological(spark):
    days = spark.range(10).select(F.date_add(F.lit(D(2024, 1, 1)), F.col("id").cast("int")).alias("appointment_date"))
    train, test = splits.final_holdout(days)
    assert (train.count(), test.count()) == (8, 2)
    with pytest.raises(ValueError):
        splits.final_holdout(days, test_fraction=1.0)
