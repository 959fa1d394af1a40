"""Registered queries: as-of history, feature tables and temporal splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import features, history, splits
from wardflow.plans.catalog import register, with_views
from wardflow.sources import tables as T

LABEL_SQL = "CASE status WHEN 'no_show' THEN 1 WHEN 'completed' THEN 0 END"
CUT = dt.date(2000, 7, 1)


# --- history --------------------------------------------------------------------------
ASOF_SQL = """SELECT b.*, coalesce(h.n, 0) AS prior_n, coalesce(h.k, 0) AS prior_k, date_diff('day', h.last, b.booked_at) AS days_since_last
    FROM bookings b LEFT JOIN (
      SELECT q.patient_id, q.booked_at, count(*) AS n, CAST(sum(o.label) AS BIGINT) AS k, max(o.appointment_date) AS last
      FROM (SELECT DISTINCT patient_id, booked_at FROM bookings) q
      JOIN (SELECT patient_id, appointment_date, CASE status WHEN 'no_show' THEN 1 ELSE 0 END AS label
            FROM bookings WHERE status IN ('completed', 'no_show')) o
        ON o.patient_id = q.patient_id AND o.appointment_date < q.booked_at GROUP BY ALL) h
    ON h.patient_id = b.patient_id AND h.booked_at = b.booked_at"""


@register(
    "asof_history",
    with_views("bookings", """SELECT patient_id, CAST(booked_at AS VARCHAR) AS booked_at, CAST(appointment_date AS VARCHAR) AS appointment_date,
        status, prior_n, prior_k, CAST(days_since_last AS INT) AS days_since_last FROM known""", known=ASOF_SQL),
)
def asof_history(spark, folder):
    rows = T.bookings(spark, folder).withColumn("label", X.outcome())
    out = history.asof_history(rows)
    return out.select("patient_id", "booked_at", "appointment_date", "status", "prior_n", "prior_k", "days_since_last")


@register(
    "expanding_prior_rate",
    with_views("visits", """SELECT visit_id, prior_n, prior_k, round(least(greatest((prior_k + 5 * 0.2) / (prior_n + 5), 0.01), 0.99), 9) AS prior_rate
        FROM (SELECT visit_id, count(*) OVER w AS prior_n, CAST(coalesce(sum(CAST(status = 'no_show' AS INT)) OVER w, 0) AS BIGINT) AS prior_k
              FROM visits WHERE status IN ('completed', 'no_show')
              WINDOW w AS (PARTITION BY patient_id ORDER BY appointment_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
)
def expanding_prior_rate(spark, folder):
    rows = T.visits(spark, folder).withColumn("label", X.outcome()).filter(F.col("label").isNotNull())
    out = history.expanding_prior_rate(rows, 0.2)
    return out.select("visit_id", "prior_n", "prior_k", F.round("prior_rate", 9).alias("prior_rate"))


@register(
    "split_half_rates",
    with_views("visits", """SELECT patient_id, n AS n_outcomes, round(avg(label) FILTER (WHERE pos < n // 2), 9) AS early_rate,
          round(avg(label) FILTER (WHERE pos >= n // 2), 9) AS late_rate
        FROM (SELECT patient_id, CAST(status = 'no_show' AS INT) AS label, count(*) OVER (PARTITION BY patient_id) AS n,
                row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date, visit_id) - 1 AS pos
              FROM visits WHERE status IN ('completed', 'no_show')) WHERE n >= 6 GROUP BY ALL"""),
)
def split_half_rates(spark, folder):
    rows = T.visits(spark, folder).withColumn("label", X.outcome()).filter(F.col("label").isNotNull())
    out = history.split_half_rates(rows)
    return out.select("patient_id", "n_outcomes", F.round("early_rate", 9).alias("early_rate"), F.round("late_rate", 9).alias("late_rate"))


@register(
    "history_with_candidates",
    with_views("visits", """SELECT c.visit_id, count(o.visit_id) AS prior_n, CAST(coalesce(sum(CAST(o.status = 'no_show' AS INT)), 0) AS BIGINT) AS prior_k
        FROM (SELECT * FROM visits WHERE status = 'scheduled') c
        LEFT JOIN (SELECT * FROM visits WHERE status IN ('completed', 'no_show')) o
          ON o.patient_id = c.patient_id AND o.appointment_date < c.appointment_date - 2 GROUP BY 1"""),
)
def history_with_candidates(spark, folder):
    """Candidates (booked two days ahead) and the history of their patients in one frame."""
    visits = T.visits(spark, folder)
    candidates = visits.filter("status = 'scheduled'").withColumn("booked_at", F.date_sub("appointment_date", 2)).withColumn(
        "is_candidate", F.lit(True)
    )
    past = T.history_of(visits, candidates).filter(X.resolved()).withColumn("is_candidate", F.lit(False))
    both = past.unionByName(candidates, allowMissingColumns=True).withColumn("label", X.outcome())
    scored = history.asof_history(both.filter("is_candidate"), both.filter("NOT is_candidate"))
    return scored.select("visit_id", "prior_n", "prior_k")


# --- features ---------------------------------------------------------------------------
FEATURE_SQL = """SELECT patient_id, CAST(appointment_date AS VARCHAR) AS appointment_date, CAST(greatest(date_diff('day', booked_at, appointment_date), 0) AS DOUBLE) AS lead_time_days,
    round(ln(1 + greatest(date_diff('day', booked_at, appointment_date), 0)), 9) AS log_lead_time,
    CAST(isodow(appointment_date) - 1 AS DOUBLE) AS weekday, CAST(start_minute // 60 AS DOUBLE) AS hour_of_day,
    CAST(month(appointment_date) AS DOUBLE) AS month, CAST(is_new_patient AS INT)::DOUBLE AS is_new_patient,
    CAST(CASE urgency WHEN 'urgent' THEN 1 WHEN 'emergency' THEN 2 ELSE 0 END AS DOUBLE) AS urgency_ordinal,
    CAST(duration_minutes AS DOUBLE) AS duration_minutes, CAST(prior_n AS DOUBLE) AS patient_prior_appointments,
    round((prior_k + 5 * (SELECT avg({label}) FROM bookings)) / (prior_n + 5), 9) AS patient_prior_no_show_rate,
    CAST(prior_k AS DOUBLE) AS patient_prior_no_shows, CAST(days_since_last AS DOUBLE) AS days_since_patient_last_appointment,
    CAST(code AS DOUBLE) AS specialty_code, CAST(isodow(appointment_date) = 1 AS INT)::DOUBLE AS is_monday,
    CAST(isodow(appointment_date) = 5 AS INT)::DOUBLE AS is_friday, CAST(start_minute // 60 <= 9 AS INT)::DOUBLE AS is_early_slot,
    CAST(start_minute // 60 >= 17 AS INT)::DOUBLE AS is_late_slot, CAST({label} AS INT) AS label
    FROM known JOIN codes USING (specialty) WHERE status IN ('completed', 'no_show')""".format(label=LABEL_SQL)
CODES_SQL = "SELECT specialty, row_number() OVER (ORDER BY specialty) - 1 AS code FROM (SELECT DISTINCT specialty FROM bookings)"


@register("no_show_features", with_views("bookings", FEATURE_SQL, known=ASOF_SQL, codes=CODES_SQL))
def no_show_features(spark, folder):
    out = features.no_show_features(T.bookings(spark, folder), keep=("patient_id", "appointment_date"))
    for name in ("log_lead_time", "patient_prior_no_show_rate"):
        out = out.withColumn(name, F.round(name, 9))
    return out


@register(
    "duration_features",
    with_views("bookings", """SELECT patient_id, CAST(code AS DOUBLE) AS specialty_code, CAST(is_new_patient AS INT)::DOUBLE AS is_new_patient,
          CAST(CASE urgency WHEN 'urgent' THEN 1 WHEN 'emergency' THEN 2 ELSE 0 END AS DOUBLE) AS urgency_ordinal,
          CAST(isodow(appointment_date) - 1 AS DOUBLE) AS weekday, CAST(start_minute // 60 AS DOUBLE) AS hour_of_day,
          CAST(prior_n AS DOUBLE) AS patient_prior_appointments, CAST(duration_minutes AS DOUBLE) AS duration_minutes
        FROM known JOIN codes USING (specialty) WHERE status = 'completed'""", known=ASOF_SQL, codes=CODES_SQL),
)
def duration_features(spark, folder):
    return features.duration_features(T.bookings(spark, folder), keep=("patient_id",))


@register("category_codes", with_views("bookings", "SELECT specialty, CAST(code AS INT) AS specialty_code FROM codes", codes=CODES_SQL))
def category_codes(spark, folder):
    return features.category_codes(T.bookings(spark, folder))


@register(
    "base_rate",
    with_views("bookings", f"SELECT round(coalesce(avg({LABEL_SQL}), 0.2), 9) AS base_rate FROM bookings"),
)
def base_rate(spark, folder):
    return features.base_rate(T.bookings(spark, folder)).select(F.round("base_rate", 9).alias("base_rate"))


@register(
    "specialty_mean_duration",
    with_views("bookings", """SELECT specialty, duration_minutes, round(coalesce(m, (SELECT avg(duration_minutes) FROM train)), 9) AS prediction, count(*) AS n
        FROM bookings LEFT JOIN (SELECT specialty, avg(duration_minutes) AS m FROM train GROUP BY 1) USING (specialty)
        WHERE status = 'completed' AND appointment_date >= DATE '2000-07-01' GROUP BY ALL""",
               train="SELECT * FROM bookings WHERE status = 'completed' AND appointment_date < DATE '2000-07-01' AND specialty <> 'SMALL'"),
)
def specialty_mean_duration(spark, folder):
    done = T.bookings(spark, folder).filter("status = 'completed'")
    cut = F.lit(CUT)
    train = done.filter((F.col("appointment_date") < cut) & (F.col("specialty") != "SMALL"))
    test = done.filter(F.col("appointment_date") >= cut)
    out = features.specialty_mean_duration(train, test)
    return out.groupBy("specialty", "duration_minutes", F.round("prediction", 9).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


# --- splits -------------------------------------------------------------------------------
FOLDS_SQL = """SELECT fold, last - CAST(90 * (4 - fold) + 89 AS INT) AS train_end, last - CAST(90 * (4 - fold) + 89 AS INT) AS test_start,
    last - CAST(90 * (4 - fold) AS INT) AS test_end
    FROM (SELECT max(appointment_date) AS last FROM bookings), (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS fold)"""


@register(
    "rolling_origin_folds",
    with_views("bookings", """SELECT fold, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start,
        CAST(test_end AS VARCHAR) AS test_end FROM folds""", folds=FOLDS_SQL),
)
def rolling_origin_folds(spark, folder):
    return splits.fold_table(T.bookings(spark, folder))


@register(
    "fold_sizes",
    with_views("bookings", """SELECT fold, role, count(*) AS n, CAST(min(appointment_date) AS VARCHAR) AS first_date,
          CAST(max(appointment_date) AS VARCHAR) AS last_date
        FROM (SELECT fold, appointment_date, CASE WHEN appointment_date < train_end THEN 'train'
                WHEN appointment_date BETWEEN test_start AND test_end THEN 'test' END AS role FROM bookings, folds)
        WHERE role IS NOT NULL GROUP BY ALL""", folds=FOLDS_SQL),
)
def fold_sizes(spark, folder):
    bookings = T.bookings(spark, folder)
    folds = splits.rolling_origin_folds(bookings)
    roles = splits.fold_roles(bookings.select("appointment_date"), folds)
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("appointment_date").alias("first_date"), F.max("appointment_date").alias("last_date")
    )


CUTOFF_SQL = """SELECT d AS cutoff FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n
    FROM (SELECT DISTINCT appointment_date AS d FROM bookings)) WHERE pos = CAST(floor(n * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)"""


@register(
    "final_holdout",
    with_views("bookings", """SELECT count(*) FILTER (WHERE appointment_date < cutoff) AS train_rows,
          count(*) FILTER (WHERE appointment_date >= cutoff) AS test_rows,
          CAST(max(appointment_date) FILTER (WHERE appointment_date < cutoff) AS VARCHAR) AS train_last,
          CAST(min(appointment_date) FILTER (WHERE appointment_date >= cutoff) AS VARCHAR) AS test_first FROM bookings, cut""", cut=CUTOFF_SQL),
)
def final_holdout(spark, folder):
    train, test = splits.final_holdout(T.bookings(spark, folder).select("appointment_date"))
    tail = test.agg(F.count(F.lit(1)).alias("test_rows"), F.min("appointment_date").alias("test_first"))
    return (
        train.agg(F.count(F.lit(1)).alias("train_rows"), F.max("appointment_date").alias("train_last"))
        .withColumn("test_rows", tail.select("test_rows").scalar())
        .withColumn("test_first", tail.select("test_first").scalar())
    )


@register(
    "time_series_blocks",
    with_views("bookings", """SELECT CAST(d AS VARCHAR) AS appointment_date, n,
          CAST(least(CASE WHEN pos < total - 3 * (total // 4) THEN 0 ELSE (pos - (total - 3 * (total // 4))) // (total // 4) + 1 END, 3) AS INT) AS block
        FROM (SELECT d, n, CAST(coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
                CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT appointment_date AS d, count(*) AS n FROM bookings GROUP BY 1))"""),
)
def time_series_blocks(spark, folder):
    return splits.time_series_blocks(T.bookings(spark, folder))
