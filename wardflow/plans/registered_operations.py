"""Registered queries: readers, listings, dashboards and demand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import demand, features, history, intervals, operations as ops, quality
from wardflow.plans.catalog import register, with_views
from wardflow.sources import tables as T
from wardflow.streaming import maintain

AS_OF = dt.date(2024, 1, 20)
LO, HI = dt.date(2024, 1, 11), dt.date(2024, 1, 20)
VISIT_COLUMNS = ["visit_id", "patient_id", "doctor_id", "appointment_date", "start_minute", "status"]
VISIT_SQL = ("visit_id, patient_id, doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, "
             "start_minute, status")


# --- readers -----------------------------------------------------------------------
@register(
    "load_visits",
    with_views("bookings", """SELECT patient_id, doctor_id, specialty, CAST(appointment_date AS VARCHAR) AS appointment_date,
        start_minute, duration_minutes, status, urgency, is_new_patient, CAST(booked_at AS VARCHAR) AS booked_at FROM bookings"""),
)
def load_visits(spark, folder):
    return T.load_visits(T.bookings(spark, folder))


@register("list_specialties", with_views("specialties", "SELECT specialty, default_duration_minutes FROM specialties ORDER BY specialty"))
def list_specialties(spark, folder):
    return T.specialties(spark, folder).orderBy("specialty")


@register("active_doctors", with_views("doctors", "SELECT * FROM doctors WHERE is_active ORDER BY doctor_id"))
def active_doctors(spark, folder):
    return T.load_active(T.doctors(spark, folder), "doctor_id")


@register("active_rooms", with_views("rooms", "SELECT * FROM rooms WHERE is_active ORDER BY name"))
def active_rooms(spark, folder):
    return T.load_active(T.rooms(spark, folder), "name")


@register(
    "windows_in_force",
    with_views("availability", """SELECT doctor_id, weekday, start_minute, end_minute FROM availability
        WHERE is_active AND effective_from <= DATE '2024-01-25' AND (effective_to IS NULL OR effective_to >= DATE '2024-01-25')"""),
)
def windows_in_force(spark, folder):
    found = T.doctor_windows(T.availability(spark, folder), on=dt.date(2024, 1, 25))
    return found.select("doctor_id", "weekday", "start_minute", "end_minute")


@register(
    "past_resolved_visits",
    with_views("past", "SELECT patient_id, specialty, hour, weekday, CAST(lead_days AS INT) AS lead_days, no_show FROM past"),
)
def past_resolved_visits(spark, folder):
    past, _ = T.past_and_all(T.bookings(spark, folder), dt.date(2001, 1, 1))
    return past.select("patient_id", "specialty", "hour", "weekday", "lead_days", "no_show")


@register(
    "history_of_scored_patients",
    with_views("visits", f"""SELECT {VISIT_SQL} FROM visits WHERE patient_id IN
        (SELECT patient_id FROM visits WHERE status = 'scheduled' AND appointment_date >= DATE '2024-01-28')"""),
)
def history_of_scored_patients(spark, folder):
    visits = T.visits(spark, folder)
    scored = visits.filter((F.col("status") == "scheduled") & (F.col("appointment_date") >= F.lit(dt.date(2024, 1, 28))))
    return T.history_of(visits, scored).select(*VISIT_COLUMNS)


@register(
    "training_summary",
    with_views("bookings", """SELECT count(*) AS row_count, count(*) FILTER (WHERE status IN ('completed', 'no_show')) AS resolved_rows,
        round_even(avg(CASE status WHEN 'no_show' THEN 1 WHEN 'completed' THEN 0 END), 4) AS no_show_rate,
        CAST(min(appointment_date) AS VARCHAR) AS first_date, CAST(max(appointment_date) AS VARCHAR) AS last_date,
        count(DISTINCT patient_id) AS patients, count(DISTINCT specialty) AS specialties FROM bookings"""),
)
def training_summary(spark, folder):
    return T.training_summary(T.bookings(spark, folder))


# --- listings ----------------------------------------------------------------------
LIST_SQL = "status = 'completed' AND appointment_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"


@register(
    "listing_page",
    with_views("visits", f"""SELECT {VISIT_SQL} FROM visits WHERE {LIST_SQL}
        ORDER BY visits.appointment_date DESC, start_minute, visit_id LIMIT 200 OFFSET 100"""),
)
def listing_page(spark, folder):
    found = ops.listing(T.visits(spark, folder), date_from=LO, date_to=HI, status="completed")
    return ops.page(found, limit=200, offset=100).select(*VISIT_COLUMNS)


@register("listing_total", with_views("visits", f"SELECT count(*) AS total FROM visits WHERE {LIST_SQL}"))
def listing_total(spark, folder):
    return ops.page_total(ops.listing(T.visits(spark, folder), date_from=LO, date_to=HI, status="completed"))


@register(
    "scoped_to_doctors",
    with_views("visits doctors", f"""SELECT {VISIT_SQL} FROM visits WHERE doctor_id IN
        (SELECT doctor_id FROM doctors WHERE clinic_id = 1)"""),
)
def scoped_to_doctors(spark, folder):
    callers = T.doctors(spark, folder).filter("clinic_id = 1")
    return ops.scope_to_caller(T.visits(spark, folder), "doctor", callers).select(*VISIT_COLUMNS)


@register(
    "search_patients",
    with_views("patients", """SELECT patient_id, first_name, last_name, email FROM patients
        WHERE first_name ILIKE '%build%' OR last_name ILIKE '%build%' OR email ILIKE '%build%'
        ORDER BY last_name, patient_id LIMIT 50"""),
)
def search_patients(spark, folder):
    return ops.search_people(T.patients(spark, folder), "build").select("patient_id", "first_name", "last_name", "email")


@register(
    "outcome_labels",
    with_views("bookings", """SELECT status, CASE status WHEN 'no_show' THEN 1 WHEN 'completed' THEN 0 END AS label,
        count(*) AS n FROM bookings GROUP BY ALL"""),
)
def outcome_labels(spark, folder):
    return T.bookings(spark, folder).groupBy("status", X.outcome().alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "status_subsets",
    with_views("visits", """SELECT count(*) FILTER (WHERE status IN ('completed', 'no_show')) AS resolved,
        count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'cancelled') AS occupying,
        count(*) FILTER (WHERE status = 'scheduled' AND appointment_date > DATE '2024-01-20') AS upcoming FROM visits"""),
)
def status_subsets(spark, folder):
    return T.visits(spark, folder).agg(
        F.count_if(X.resolved()).alias("resolved"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(X.occupies()).alias("occupying"),
        F.count_if((F.col("status") == "scheduled") & (F.col("appointment_date") > F.lit(AS_OF))).alias("upcoming"),
    )


@register(
    "my_upcoming",
    with_views("visits", f"""SELECT {VISIT_SQL}, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
        ORDER BY appointment_date, start_minute, visit_id) AS position FROM visits
        WHERE appointment_date >= DATE '2024-01-20' AND status IN ('scheduled', 'completed')) WHERE position <= 50"""),
)
def my_upcoming(spark, folder):
    return ops.my_upcoming(T.visits(spark, folder), AS_OF).select(*VISIT_COLUMNS, "position")


@register(
    "doctor_today",
    with_views("visits", f"SELECT {VISIT_SQL} FROM visits WHERE appointment_date = DATE '2024-01-20' AND status <> 'cancelled'"),
)
def doctor_today(spark, folder):
    return ops.doctor_today(T.visits(spark, folder), AS_OF).select(*VISIT_COLUMNS)


@register(
    "doctor_upcoming",
    with_views("visits", f"""SELECT {VISIT_SQL}, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doctor_id
        ORDER BY appointment_date, start_minute, visit_id) AS position FROM visits
        WHERE appointment_date > DATE '2024-01-20' AND status = 'scheduled') WHERE position <= 20"""),
)
def doctor_upcoming(spark, folder):
    return ops.doctor_upcoming(T.visits(spark, folder), AS_OF).select(*VISIT_COLUMNS, "position")


@register(
    "patient_recent",
    with_views("visits", f"""SELECT {VISIT_SQL}, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
        ORDER BY appointment_date DESC, start_minute DESC, visit_id DESC) AS position FROM visits
        WHERE appointment_date < DATE '2024-01-20') WHERE position <= 20"""),
)
def patient_recent(spark, folder):
    return ops.patient_recent(T.visits(spark, folder), AS_OF).select(*VISIT_COLUMNS, "position")


@register(
    "patient_upcoming",
    with_views("visits", f"SELECT {VISIT_SQL} FROM visits WHERE appointment_date >= DATE '2024-01-20' AND status = 'scheduled'"),
)
def patient_upcoming(spark, folder):
    return ops.patient_upcoming(T.visits(spark, folder), AS_OF).select(*VISIT_COLUMNS)


@register(
    "doctor_day_card",
    with_views("visits", """SELECT doctor_id, coalesce(today, 0) AS today, round_even(coalesce(m, 0) / 60, 1) AS booked_hours,
          coalesce(upcoming, 0) AS upcoming
        FROM (SELECT doctor_id, count(*) AS today, sum(duration_minutes) AS m FROM visits
              WHERE appointment_date = DATE '2024-01-20' AND status <> 'cancelled' GROUP BY 1)
        FULL JOIN (SELECT doctor_id, count(*) AS upcoming FROM visits
              WHERE appointment_date > DATE '2024-01-20' AND status = 'scheduled' GROUP BY 1) USING (doctor_id)"""),
)
def doctor_day_card(spark, folder):
    return ops.doctor_day_card(T.visits(spark, folder), AS_OF)


@register(
    "patient_card",
    with_views("visits", """SELECT patient_id, attended, missed, round_even(CASE WHEN attended + missed > 0
          THEN missed / (attended + missed) * 100 END, 0) AS missed_pct
        FROM (SELECT patient_id, count(*) FILTER (WHERE status = 'completed') AS attended,
                     count(*) FILTER (WHERE status = 'no_show') AS missed
              FROM visits WHERE appointment_date < DATE '2024-01-20' GROUP BY 1)"""),
)
def patient_card(spark, folder):
    return ops.patient_card(T.visits(spark, folder), AS_OF)


@register(
    "visit_records",
    with_views("visits doctors patients", """SELECT visit_id, v.patient_id, v.doctor_id, status,
          'Dr. ' || d.first_name || ' ' || d.last_name AS doctor_name, d.clinic_id AS doctor_clinic, p.last_name AS patient_name
        FROM visits v JOIN doctors d USING (doctor_id) JOIN patients p USING (patient_id)"""),
)
def visit_records(spark, folder):
    records = ops.visit_records(T.visits(spark, folder), T.doctors(spark, folder), T.patients(spark, folder))
    return records.select(
        "visit_id", "patient_id", "doctor_id", "status",
        F.col("doctor.name").alias("doctor_name"),
        F.col("doctor.clinic_id").alias("doctor_clinic"),
        F.col("patient.last_name").alias("patient_name"),
    )


@register(
    "bookings_with_doctor_name",
    with_views("bookings doctors", """SELECT specialty, 'Dr. ' || first_name || ' ' || last_name AS doctor_name, count(*) AS n
        FROM bookings JOIN doctors USING (doctor_id) GROUP BY ALL"""),
)
def bookings_with_doctor_name(spark, folder):
    """Fact joined to a dimension; the fact is reduced to (doctor, specialty) first."""
    counts = T.bookings(spark, folder).groupBy("doctor_id", "specialty").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(T.doctors(spark, folder), "doctor_id")
    return named.groupBy("specialty", X.doctor_name().alias("doctor_name")).agg(F.sum("n").alias("n"))


@register(
    "booking_records",
    with_views("bookings doctors patients specialties", """SELECT b.patient_id, b.doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, start_minute, status,
          'Dr. ' || d.first_name || ' ' || d.last_name AS doctor_name, p.last_name AS patient_name, s.specialty AS specialty_name, s.default_duration_minutes
        FROM bookings b JOIN doctors d USING (doctor_id) JOIN patients p USING (patient_id)
        LEFT JOIN (SELECT * FROM specialties WHERE specialty <> 'SMALL') s ON s.specialty = b.specialty"""),
)
def booking_records(spark, folder):
    """Bookings with doctor, patient and specialty embedded; one specialty is missing in the catalogue."""
    known = T.specialties(spark, folder).filter("specialty <> 'SMALL'")
    records = ops.visit_records(T.bookings(spark, folder), T.doctors(spark, folder), T.patients(spark, folder), known)
    return records.select(
        "patient_id", "doctor_id", "appointment_date", "start_minute", "status", F.col("doctor.name").alias("doctor_name"), F.col("patient.last_name").alias("patient_name"),
        F.col("specialty_record.specialty").alias("specialty_name"), F.col("specialty_record.default_duration_minutes").alias("default_duration_minutes"),
    )


ACTION_SQL = """SELECT *, CASE visit_id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'reschedule' ELSE 'set_status' END AS action,
    CASE visit_id % 2 WHEN 0 THEN 'completed' ELSE 'arrived' END AS requested_status FROM visits"""


@register(
    "status_transitions",
    with_views("visits", """SELECT visit_id, action, status, verdict, CASE WHEN verdict <> 'ok' THEN status
          WHEN action = 'set_status' THEN requested_status ELSE 'cancelled' END AS new_status
        FROM (SELECT *, CASE WHEN action = 'cancel' AND status = 'completed' THEN 'completed_cannot_be_cancelled'
               WHEN action = 'reschedule' AND status <> 'scheduled' THEN 'only_scheduled_can_move'
               WHEN action = 'set_status' AND requested_status = 'arrived' THEN 'unknown_status' ELSE 'ok' END AS verdict
              FROM asked)""", asked=ACTION_SQL),
)
def status_transitions(spark, folder):
    visits = T.visits(spark, folder)
    kind = F.col("visit_id") % 3
    asked = visits.withColumn(
        "action", F.when(kind == 0, "cancel").when(kind == 1, "reschedule").otherwise("set_status")
    ).withColumn("requested_status", F.when(F.col("visit_id") % 2 == 0, "completed").otherwise("arrived"))
    return ops.status_transitions(asked).select("visit_id", "action", "status", "verdict", "new_status")


@register(
    "doctor_calendar",
    with_views("visits", f"""SELECT {VISIT_SQL} FROM visits WHERE doctor_id = 5
        AND appointment_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"""),
)
def doctor_calendar(spark, folder):
    return ops.doctor_calendar(T.visits(spark, folder), 5, LO, HI).select(*VISIT_COLUMNS)


@register(
    "week_calendar",
    with_views("visits", """SELECT doctor_id, CAST(isodow(appointment_date) - 1 AS INT) AS day_index,
          CAST(appointment_date AS VARCHAR) AS appointment_date, visit_id, start_minute, end_minute, status
        FROM (SELECT doctor_id, CAST(unnest(generate_series(DATE '2024-01-15', DATE '2024-01-21', INTERVAL 1 DAY)) AS DATE)
                AS appointment_date
              FROM (SELECT DISTINCT doctor_id FROM visits WHERE appointment_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'))
        LEFT JOIN visits USING (doctor_id, appointment_date)"""),
)
def week_calendar(spark, folder):
    return ops.week_calendar(T.visits(spark, folder), dt.date(2024, 1, 17))


@register(
    "moved_visits",
    with_views("visits doctors", """SELECT visit_id, status, CAST(appointment_date AS VARCHAR) AS appointment_date, start_minute, end_minute
        FROM (SELECT visit_id, CASE WHEN moved THEN 'cancelled' ELSE status END AS status, appointment_date, start_minute, end_minute FROM tagged
              UNION ALL SELECT visit_id + 1000000000, status, appointment_date + 7, 600, 600 + duration_minutes FROM tagged WHERE moved)""",
               tagged="""SELECT v.*, status = 'scheduled' AND start_minute < 480
                     AND doctor_id IN (SELECT doctor_id FROM doctors WHERE is_active) AS moved FROM visits v"""),
)
def moved_visits(spark, folder):
    visits = T.visits(spark, folder)
    moves = visits.filter("status = 'scheduled' AND start_minute < 480").select(
        "visit_id",
        "doctor_id",
        (F.col("visit_id") + 1_000_000_000).alias("new_visit_id"),
        F.date_add("appointment_date", 7).alias("new_date"),
        F.lit(600).alias("new_start"),
        F.lit(None).cast("int").alias("new_duration"),
    )
    active = T.doctors(spark, folder).select("doctor_id", "is_active")
    verdicts = moves.join(active, "doctor_id", "left").select(
        "visit_id", F.when(F.col("is_active"), "ok").otherwise("inactive_doctor").alias("verdict")
    )
    return ops.apply_moves(visits, moves, verdicts).select("visit_id", "status", "appointment_date", "start_minute", "end_minute")


# --- dashboards ----------------------------------------------------------------------
CELL_SQL = """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, scheduled_count, completed_count,
    cancelled_count, no_show_count, booked_minutes FROM cells"""


@register("utilization_cells", with_views("cells", CELL_SQL))
def utilization_cells(spark, folder):
    return ops.utilization_cells(T.visits(spark, folder))


@register(
    "headline_metrics",
    with_views("visits", """
        SELECT label, value, unit, CASE WHEN prev <> 0 THEN round_even((cmp - prev) / prev * 100, 1) END AS change_pct FROM (
          SELECT 'Appointments' AS label, CAST(c.total AS DOUBLE) AS value, NULL AS unit, CAST(c.total AS DOUBLE) AS cmp, CAST(p.total AS DOUBLE) AS prev FROM c, p
          UNION ALL SELECT 'No-show rate', c.rate, '%', c.rate, p.rate FROM c, p
          UNION ALL SELECT 'Cancellations', c.cancelled, NULL, c.cancelled, p.cancelled FROM c, p
          UNION ALL SELECT 'Booked hours', round_even(c.minutes / 60, 1), 'h', c.minutes, p.minutes FROM c, p)""",
               w="""SELECT appointment_date >= DATE '2024-01-11' AS cur, count(*) AS total, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
                    round_even(count(*) FILTER (WHERE status = 'no_show') / greatest(count(*) FILTER (WHERE status <> 'cancelled'), 1) * 100, 1) AS rate,
                    CAST(sum(duration_minutes) AS DOUBLE) AS minutes FROM visits
                    WHERE appointment_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1""",
               c="SELECT * FROM w WHERE cur", p="SELECT * FROM w WHERE NOT cur"),
)
def headline_metrics(spark, folder):
    return ops.headline_metrics(T.visits(spark, folder), LO, HI)


@register(
    "demand_by_hour",
    with_views("visits", """SELECT CAST(start_minute // 60 AS INT) AS hour, count(*) AS n FROM visits WHERE status <> 'cancelled'
        AND appointment_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' GROUP BY 1"""),
)
def demand_by_hour(spark, folder):
    return ops.demand_by_hour(T.visits(spark, folder), LO, HI)


@register(
    "available_minutes",
    with_views("windays", """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
        CAST(sum(end_minute - start_minute) AS BIGINT) AS available_minutes FROM windays GROUP BY ALL"""),
)
def available_minutes(spark, folder):
    return intervals.available_minutes(T.availability(spark, folder), *T.visit_span(spark, folder))


BY_DOCTOR_SQL = """SELECT doctor_id, 'Dr. ' || first_name || ' ' || last_name AS doctor_name, coalesce(b, 0) AS booked_minutes,
    coalesce(a, 0) AS available_minutes, CASE WHEN coalesce(a, 0) > 0 THEN round_even(coalesce(b, 0) / a * 100, 1) ELSE 0.0 END AS utilization_pct,
    coalesce(s, 0) AS scheduled_count, coalesce(c, 0) AS completed_count, coalesce(x, 0) AS cancelled_count, coalesce(n, 0) AS no_show_count
    FROM doctors LEFT JOIN (SELECT doctor_id, CAST(sum(booked_minutes) AS BIGINT) AS b, CAST(sum(scheduled_count) AS BIGINT) AS s,
        CAST(sum(completed_count) AS BIGINT) AS c, CAST(sum(cancelled_count) AS BIGINT) AS x, CAST(sum(no_show_count) AS BIGINT) AS n
      FROM cells WHERE appointment_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' GROUP BY 1) USING (doctor_id)
    LEFT JOIN (SELECT doctor_id, CAST(sum(end_minute - start_minute) AS BIGINT) AS a FROM windays
      WHERE appointment_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' GROUP BY 1) USING (doctor_id)
    WHERE is_active"""


def _by_doctor(spark, folder):
    cells = ops.utilization_cells(T.visits(spark, folder))
    return ops.utilization_by_doctor(T.doctors(spark, folder), cells, T.availability(spark, folder), LO, HI)


@register("utilization_by_doctor", with_views("doctors cells windays", BY_DOCTOR_SQL))
def utilization_by_doctor(spark, folder):
    return _by_doctor(spark, folder)


@register(
    "doctors_by_utilization",
    with_views("doctors cells windays", f"""SELECT doctor_id, utilization_pct, least(greatest(utilization_pct, 0.0), 100.0) AS meter_pct
        FROM ({BY_DOCTOR_SQL})"""),
)
def doctors_by_utilization(spark, folder):
    return ops.rank_by_utilization(_by_doctor(spark, folder)).select("doctor_id", "utilization_pct", "meter_pct")


TREND_SQL = """SELECT CAST(appointment_date AS VARCHAR) AS appointment_date, booked_minutes, {avail} AS available_minutes,
    CASE WHEN {avail} > 0 THEN round_even(booked_minutes / {avail} * 100, 1) ELSE 0.0 END AS utilization_pct
    FROM (SELECT appointment_date, CAST(sum(booked_minutes) AS BIGINT) AS booked_minutes FROM cells GROUP BY 1) {join}"""
ACTIVE_DAYS = "SELECT windays.* FROM windays WHERE doctor_id IN (SELECT doctor_id FROM doctors WHERE is_active)"


@register(
    "utilization_trend",
    with_views("doctors cells windays", TREND_SQL.format(avail="avail", join=", span"), active=ACTIVE_DAYS,
               span="""SELECT CAST(floor((SELECT sum(end_minute - start_minute) FROM active WHERE appointment_date BETWEEN lo AND hi)
                       / (date_diff('day', lo, hi) + 1)) AS BIGINT) AS avail
                       FROM (SELECT min(appointment_date) AS lo, max(appointment_date) AS hi FROM cells)"""),
)
def utilization_trend(spark, folder):
    cells = ops.utilization_cells(T.visits(spark, folder))
    return ops.utilization_trend(T.doctors(spark, folder), cells, T.availability(spark, folder), *T.visit_span(spark, folder))


@register(
    "utilization_trend_exact",
    with_views("doctors cells windays", TREND_SQL.format(
        avail="coalesce(a, 0)",
        join="LEFT JOIN (SELECT appointment_date, CAST(sum(end_minute - start_minute) AS BIGINT) AS a FROM active GROUP BY 1) USING (appointment_date)"),
        active=ACTIVE_DAYS),
)
def utilization_trend_exact(spark, folder):
    cells = ops.utilization_cells(T.visits(spark, folder))
    return ops.utilization_trend(T.doctors(spark, folder), cells, T.availability(spark, folder), *T.visit_span(spark, folder), exact=True)


@register(
    "clinic_day_utilization",
    with_views("visits windays", """SELECT clinic_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
          round_even(round(avg(busy / avail * 100), 9), 1) AS utilization_pct
        FROM (SELECT clinic_id, doctor_id, appointment_date, sum(duration_minutes) AS busy FROM visits WHERE status <> 'cancelled' GROUP BY ALL)
        JOIN (SELECT doctor_id, appointment_date, sum(end_minute - start_minute) AS avail FROM windays GROUP BY ALL)
          USING (doctor_id, appointment_date) GROUP BY ALL"""),
)
def clinic_day_utilization(spark, folder):
    return ops.clinic_day_utilization(T.visits(spark, folder), T.availability(spark, folder), *T.visit_span(spark, folder))


@register(
    "busiest_doctor",
    with_views("visits", "SELECT doctor_id, count(*) AS n_visits FROM visits GROUP BY 1 ORDER BY n_visits DESC, doctor_id LIMIT 1"),
)
def busiest_doctor(spark, folder):
    return ops.busiest(T.visits(spark, folder), "doctor_id")


@register(
    "recent_weekdays",
    with_views("visits", """SELECT CAST(d AS VARCHAR) AS appointment_date FROM (SELECT DISTINCT appointment_date AS d FROM visits
        WHERE status <> 'cancelled' AND isodow(appointment_date) < 6 AND appointment_date < DATE '2024-01-20' ORDER BY d DESC LIMIT 10)"""),
)
def recent_weekdays(spark, folder):
    return ops.recent_weekdays(T.visits(spark, folder), AS_OF, 10)


@register(
    "specialties_of_doctors",
    with_views("bridge", "SELECT doctor_id, string_agg(specialty, ',' ORDER BY specialty) AS specialties FROM bridge GROUP BY 1"),
)
def specialties_of_doctors(spark, folder):
    held = ops.specialties_of_doctors(T.specialty_bridge(spark, folder))
    return held.select("doctor_id", F.array_join("specialties", ",").alias("specialties"))


@register(
    "holders_of_specialty",
    with_views("doctors bridge", """SELECT doctor_id, last_name FROM doctors
        WHERE doctor_id IN (SELECT doctor_id FROM bridge WHERE specialty = 'PROMO')"""),
)
def holders_of_specialty(spark, folder):
    return ops.holders_of(T.doctors(spark, folder), T.specialty_bridge(spark, folder), "PROMO").select("doctor_id", "last_name")


@register(
    "active_dates_and_patients",
    with_views("visits", "SELECT DISTINCT CAST(appointment_date AS VARCHAR) AS appointment_date, specialty FROM visits"),
)
def active_dates_and_patients(spark, folder):
    return T.visits(spark, folder).select("appointment_date", "specialty").distinct()


# --- demand --------------------------------------------------------------------------
@register(
    "demand_grid",
    with_views("grid", "SELECT specialty, CAST(appointment_date AS VARCHAR) AS appointment_date, hour_of_day, count FROM grid"),
)
def demand_grid(spark, folder):
    return demand.demand_grid(T.visits(spark, folder))


PROFILE_SQL = """SELECT specialty, CAST(isodow(appointment_date) - 1 AS INT) AS weekday, hour_of_day, avg(count) AS profile_mean
    FROM grid WHERE appointment_date < DATE '2024-01-20' GROUP BY ALL"""


def _train_profile(spark, folder):
    grid = demand.demand_grid(T.visits(spark, folder))
    return grid, demand.demand_profile(grid.filter(F.col("appointment_date") < F.lit(AS_OF)))


@register(
    "demand_profile",
    with_views("grid", f"SELECT specialty, weekday, hour_of_day, round(profile_mean, 9) AS profile_mean FROM ({PROFILE_SQL})"),
)
def demand_profile(spark, folder):
    _, profile = _train_profile(spark, folder)
    return profile.select("specialty", "weekday", "hour_of_day", F.round("profile_mean", 9).alias("profile_mean"))


@register(
    "demand_features",
    with_views("grid", """SELECT specialty, CAST(appointment_date AS VARCHAR) AS appointment_date, CAST(hour_of_day AS DOUBLE) AS hour_of_day,
          CAST(isodow(appointment_date) - 1 AS DOUBLE) AS weekday, CAST(month(appointment_date) AS DOUBLE) AS month,
          CAST(dayofyear(appointment_date) AS DOUBLE) AS day_of_year, CAST(dense_rank() OVER (ORDER BY specialty) - 1 AS DOUBLE) AS specialty_code,
          CAST(isodow(appointment_date) >= 6 AS INT)::DOUBLE AS is_weekend, CAST(weekofyear(appointment_date) AS DOUBLE) AS week_of_year,
          round(sin(2 * pi() * dayofyear(appointment_date) / 365.25), 9) AS season_sin,
          round(cos(2 * pi() * dayofyear(appointment_date) / 365.25), 9) AS season_cos,
          round(coalesce(p.profile_mean, (SELECT avg(profile_mean) FROM profile)), 9) AS profile_mean, CAST(count AS DOUBLE) AS count
        FROM grid LEFT JOIN profile p ON p.specialty = grid.specialty AND p.hour_of_day = grid.hour_of_day
          AND p.weekday = isodow(appointment_date) - 1""".replace("SELECT specialty,", "SELECT grid.specialty,").replace(
              "CAST(hour_of_day AS DOUBLE)", "CAST(grid.hour_of_day AS DOUBLE)").replace("ORDER BY specialty", "ORDER BY grid.specialty"),
        profile=PROFILE_SQL),
)
def demand_features(spark, folder):
    grid, profile = _train_profile(spark, folder)
    out = features.demand_features(grid, profile, keep=("specialty", "appointment_date"))
    for name in ("season_sin", "season_cos", "profile_mean"):
        out = out.withColumn(name, F.round(name, 9))
    return out


@register(
    "forecast_demand",
    with_views("grid", """SELECT s.specialty, CAST(d.day AS DATE)::VARCHAR AS appointment_date, h.hour_of_day,
          round_even(greatest(coalesce(p.profile_mean, (SELECT avg(profile_mean) FROM profile)), 0.0), 3) AS predicted_demand
        FROM (SELECT DISTINCT specialty FROM profile) s
        CROSS JOIN (SELECT unnest(generate_series(DATE '2024-02-01', DATE '2024-02-28', INTERVAL 1 DAY)) AS day) d
        CROSS JOIN (SELECT CAST(unnest(generate_series(8, 18)) AS INT) AS hour_of_day) h
        LEFT JOIN profile p ON p.specialty = s.specialty AND p.hour_of_day = h.hour_of_day AND p.weekday = isodow(d.day) - 1""",
               profile=PROFILE_SQL),
)
def forecast_demand(spark, folder):
    _, profile = _train_profile(spark, folder)
    return demand.forecast_demand(profile, dt.date(2024, 2, 1), dt.date(2024, 2, 28))


@register(
    "seasonal_naive",
    with_views("grid", """SELECT grid.specialty, CAST(appointment_date AS VARCHAR) AS appointment_date, grid.hour_of_day, count,
          round(coalesce(p.profile_mean, (SELECT avg(count) FROM grid WHERE appointment_date < DATE '2024-01-20')), 9) AS prediction
        FROM grid LEFT JOIN profile p ON p.specialty = grid.specialty AND p.hour_of_day = grid.hour_of_day
          AND p.weekday = isodow(appointment_date) - 1 WHERE appointment_date >= DATE '2024-01-20'""", profile=PROFILE_SQL),
)
def seasonal_naive(spark, folder):
    grid = demand.demand_grid(T.visits(spark, folder))
    cut = F.lit(AS_OF)
    out = demand.seasonal_naive(grid.filter(F.col("appointment_date") < cut), grid.filter(F.col("appointment_date") >= cut))
    return out.select("specialty", "appointment_date", "hour_of_day", "count", F.round("prediction", 9).alias("prediction"))


@register(
    "lead_time_buckets",
    with_views("past", """SELECT lead_bucket, round(avg(no_show), 9) AS mean, count(*) AS count FROM (SELECT no_show, CASE WHEN lead_days <= 0 THEN '0'
        WHEN lead_days <= 1 THEN '1' WHEN lead_days <= 3 THEN '2-3' WHEN lead_days <= 7 THEN '4-7' WHEN lead_days <= 14 THEN '8-14'
        WHEN lead_days <= 21 THEN '15-21' WHEN lead_days <= 30 THEN '22-30' WHEN lead_days <= 45 THEN '31-45'
        WHEN lead_days <= 1000 THEN '46+' END AS lead_bucket FROM past) WHERE lead_bucket IS NOT NULL GROUP BY 1"""),
)
def lead_time_buckets(spark, folder):
    past, _ = T.past_and_all(T.bookings(spark, folder), dt.date(2001, 1, 1))
    return demand.lead_buckets(past).select("lead_bucket", F.round("mean", 9).alias("mean"), "count")


RATES_SQL = """SELECT {c}, avg(no_show) AS rate, count(*) AS n FROM past GROUP BY 1"""


@register("no_show_by_weekday", with_views("past", f"SELECT weekday, round(rate, 9) AS rate, n FROM ({RATES_SQL.format(c='weekday')})"))
def no_show_by_weekday(spark, folder):
    past, _ = T.past_and_all(T.bookings(spark, folder), dt.date(2001, 1, 1))
    return demand.rate_by(past, "weekday").withColumn("rate", F.round("rate", 9))


@register(
    "day_edges_rates",
    with_views("past", f"""SELECT round(max(rate) FILTER (WHERE weekday = 0), 9) AS monday, round(max(rate) FILTER (WHERE weekday = 4), 9) AS friday,
          round(avg(rate) FILTER (WHERE weekday IN (1, 2, 3)), 9) AS midweek,
          round((SELECT avg(rate) FROM ({RATES_SQL.format(c='hour')}) WHERE hour IN (8, 17, 18)), 9) AS edges,
          round((SELECT avg(rate) FROM ({RATES_SQL.format(c='hour')}) WHERE hour IN (11, 12, 13)), 9) AS middle
        FROM ({RATES_SQL.format(c='weekday')})"""),
)
def day_edges_rates(spark, folder):
    past, _ = T.past_and_all(T.bookings(spark, folder), dt.date(2001, 1, 1))
    out = demand.day_edges_rates(past)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


LOAD_SQL = """SELECT CAST(isodow(appointment_date) - 1 AS INT) AS weekday, avg(n) AS mean_visits, count(*) AS active_days
    FROM (SELECT appointment_date, count(*) AS n FROM visits WHERE status <> 'cancelled' GROUP BY 1) GROUP BY 1"""


@register("weekday_load", with_views("visits", f"SELECT weekday, round(mean_visits, 9) AS mean_visits, active_days FROM ({LOAD_SQL})"))
def weekday_load(spark, folder):
    return demand.weekday_load(T.visits(spark, folder)).withColumn("mean_visits", F.round("mean_visits", 9))


@register(
    "weekday_split",
    with_views("visits", f"""SELECT round(avg(mean_visits) FILTER (WHERE weekday < 5), 9) AS weekday_mean,
        round(avg(mean_visits) FILTER (WHERE weekday > 4), 9) AS weekend_mean,
        (SELECT weekday FROM ({LOAD_SQL}) WHERE weekday < 5 ORDER BY mean_visits DESC, weekday LIMIT 1) AS busiest_weekday FROM ({LOAD_SQL})"""),
)
def weekday_split(spark, folder):
    out = demand.weekday_split(demand.weekday_load(T.visits(spark, folder)))
    return out.select(F.round("weekday_mean", 9).alias("weekday_mean"), F.round("weekend_mean", 9).alias("weekend_mean"), "busiest_weekday")


@register(
    "hour_of_week",
    with_views("visits", "SELECT CAST(start_minute // 60 AS INT) AS hour, "
               + ", ".join(f"count(*) FILTER (WHERE isodow(appointment_date) = {d + 1}) AS wd{d}" for d in range(7))
               + " FROM visits WHERE status <> 'cancelled' GROUP BY 1"),
)
def hour_of_week(spark, folder):
    return demand.hour_of_week(T.visits(spark, folder))


@register(
    "hour_profile",
    with_views("visits", """SELECT specialty, hour, n, round(n / sum(n) OVER (PARTITION BY specialty), 9) AS share,
          first_value(hour) OVER (PARTITION BY specialty ORDER BY n DESC, hour) AS peak_hour
        FROM (SELECT specialty, CAST(start_minute // 60 AS INT) AS hour, count(*) AS n FROM visits WHERE status <> 'cancelled' GROUP BY ALL)"""),
)
def hour_profile(spark, folder):
    return demand.hour_profile(T.visits(spark, folder)).withColumn("share", F.round("share", 9))


@register(
    "duration_by_specialty",
    with_views("bookings", """SELECT specialty, round(avg(duration_minutes), 9) AS mean_duration,
          round(avg(duration_minutes) FILTER (WHERE is_new_patient), 9) AS mean_new,
          round(avg(duration_minutes) FILTER (WHERE NOT is_new_patient), 9) AS mean_returning FROM bookings GROUP BY 1"""),
)
def duration_by_specialty(spark, folder):
    out = demand.duration_by_specialty(T.bookings(spark, folder)).drop("new_minus_returning")
    return out.select("specialty", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# --- scalar functions ------------------------------------------------------------------
@register(
    "calendar_functions",
    with_views("visits", """SELECT visit_id, CAST(start_minute // 60 AS INT) AS hour, CAST(isodow(appointment_date) - 1 AS INT) AS weekday,
          CAST(isodow(appointment_date) AS INT) AS iso_weekday, CAST(month(appointment_date) AS INT) AS month,
          CAST(dayofyear(appointment_date) AS INT) AS day_of_year, CAST(weekofyear(appointment_date) AS INT) AS week,
          CAST(date_trunc('week', appointment_date) AS DATE)::VARCHAR AS week_start,
          strftime(date_trunc('week', appointment_date), '%d %b') || ' - ' || strftime(date_trunc('week', appointment_date) + INTERVAL 6 DAY, '%d %b %Y') AS week_label,
          lpad(CAST(start_minute // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_minute % 60 AS VARCHAR), 2, '0') AS clock,
          start_minute AS minute_again FROM visits"""),
)
def calendar_functions(spark, folder):
    return T.visits(spark, folder).select(
        "visit_id",
        X.hour_of().alias("hour"),
        X.weekday0().alias("weekday"),
        X.iso_weekday().alias("iso_weekday"),
        F.month("appointment_date").alias("month"),
        F.dayofyear("appointment_date").alias("day_of_year"),
        F.weekofyear("appointment_date").alias("week"),
        X.week_start().alias("week_start"),
        X.week_label().alias("week_label"),
        X.wall_clock("start_minute").alias("clock"),
        X.minute_of(X.wall_clock("start_minute")).alias("minute_again"),
    )


@register(
    "scheduling_functions",
    with_views("visits", """SELECT visit_id, CAST(CASE urgency WHEN 'urgent' THEN 1 WHEN 'emergency' THEN 2 ELSE 0 END AS INT) AS ordinal,
          CAST(CASE urgency WHEN 'urgent' THEN 3 WHEN 'emergency' THEN 8 ELSE 1 END AS DOUBLE) AS weight,
          CAST(ceil(start_minute / 15) * 15 AS INT) AS up, CAST(floor(start_minute / 15) * 15 AS INT) AS down,
          CAST(least(round_even(duration_minutes * CAST(0.15 AS DOUBLE), 0), 15) AS INT) AS buffer,
          CASE WHEN end_minute < 1440 THEN end_minute END AS ends,
          CAST(greatest(5, least(240, duration_minutes * 3 - 20)) AS DOUBLE) AS clipped FROM visits"""),
)
def scheduling_functions(spark, folder):
    return T.visits(spark, folder).select(
        "visit_id",
        X.urgency_ordinal().alias("ordinal"),
        X.urgency_weight().alias("weight"),
        X.grid_up("start_minute").alias("up"),
        X.grid_down("start_minute").alias("down"),
        X.slack_buffer("duration_minutes").alias("buffer"),
        X.booking_end("start_minute", "duration_minutes").alias("ends"),
        X.clip_duration(F.col("duration_minutes") * 3 - 20).alias("clipped"),
    )


# --- maintained summary ------------------------------------------------------------------
CHANGES_SQL = """SELECT visit_id, CASE visit_id % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS op,
    doctor_id AS od, appointment_date AS oa, status AS os, duration_minutes AS om,
    (doctor_id + 1) % 16 AS nd, appointment_date + CAST(visit_id % 2 AS INT) AS na,
    CASE WHEN visit_id % 3 = 0 THEN 'cancelled' ELSE status END AS ns, duration_minutes AS nm FROM visits"""
DELTA_SQL = """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
    CAST(sum(sign * CAST(status = 'scheduled' AS INT)) AS BIGINT) AS scheduled_count, CAST(sum(sign * CAST(status = 'completed' AS INT)) AS BIGINT) AS completed_count,
    CAST(sum(sign * CAST(status = 'cancelled' AS INT)) AS BIGINT) AS cancelled_count, CAST(sum(sign * CAST(status = 'no_show' AS INT)) AS BIGINT) AS no_show_count,
    CAST(sum(CASE WHEN status = 'cancelled' THEN 0 ELSE sign * minutes END) AS BIGINT) AS booked_minutes
    FROM (SELECT od AS doctor_id, oa AS appointment_date, os AS status, om AS minutes, -1 AS sign FROM changes WHERE op <> 'INSERT'
          UNION ALL SELECT nd, na, ns, nm, 1 FROM changes WHERE op <> 'DELETE') GROUP BY 1, 2"""


def changes_from_visits(visits):
    """A change feed over every visit: inserts, deletes and moving updates."""
    kind = F.col("visit_id") % 4
    side = lambda d, a, s: F.struct(
        d.alias("doctor_id"), a.alias("appointment_date"), s.alias("status"), F.col("duration_minutes")
    )
    return visits.select(
        F.when(kind == 0, "INSERT").when(kind == 1, "DELETE").otherwise("UPDATE").alias("op"),
        side(F.col("doctor_id"), F.col("appointment_date"), F.col("status")).alias("old"),
        side(
            (F.col("doctor_id") + 1) % 16,
            F.date_add("appointment_date", (F.col("visit_id") % 2).cast("int")),
            F.when(F.col("visit_id") % 3 == 0, "cancelled").otherwise(F.col("status")),
        ).alias("new"),
    )


@register("utilization_deltas", with_views("visits", DELTA_SQL, changes=CHANGES_SQL))
def utilization_deltas(spark, folder):
    deltas = maintain.utilization_deltas(changes_from_visits(T.visits(spark, folder)))
    return deltas.groupBy(*ops.CELL).agg(*[F.sum(c).alias(c) for c in maintain.MEASURES])


@register(
    "maintained_cells",
    with_views("visits", "SELECT doctor_id, appointment_date, " + ", ".join(
        f"greatest({c}, 0) AS {c}" for c in maintain.MEASURES) + f" FROM ({DELTA_SQL})", changes=CHANGES_SQL),
)
def maintained_cells(spark, folder):
    return maintain.accumulate(maintain.utilization_deltas(changes_from_visits(T.visits(spark, folder))))


STORED_SQL = """SELECT doctor_id, appointment_date, scheduled_count, completed_count + CAST(doctor_id % 5 = 0 AS INT) AS completed_count,
    cancelled_count, no_show_count, booked_minutes + CASE WHEN doctor_id % 7 = 0 THEN 30 ELSE 0 END AS booked_minutes
    FROM cells WHERE doctor_id <> 9
    UNION ALL SELECT doctor_id + 100, appointment_date, 1, 0, 0, 0, 45 FROM cells WHERE doctor_id = 3"""


def stored_with_drift(cells):
    """The summary with known faults: changed fields, a missing and an extra doctor."""
    faulty = (
        cells.filter("doctor_id <> 9")
        .withColumn("completed_count", F.col("completed_count") + F.when(F.col("doctor_id") % 5 == 0, 1).otherwise(0))
        .withColumn("booked_minutes", F.col("booked_minutes") + F.when(F.col("doctor_id") % 7 == 0, 30).otherwise(0))
    )
    extra = cells.filter("doctor_id = 3").select(
        (F.col("doctor_id") + 100).alias("doctor_id"), "appointment_date", F.lit(1).alias("scheduled_count"),
        F.lit(0).alias("completed_count"), F.lit(0).alias("cancelled_count"), F.lit(0).alias("no_show_count"),
        F.lit(45).alias("booked_minutes"),
    )
    return faulty.unionByName(extra)


@register(
    "reconcile_drift",
    with_views("cells", " UNION ALL ".join(
        f"""SELECT coalesce(c.doctor_id, s.doctor_id) AS doctor_id, CAST(coalesce(c.appointment_date, s.appointment_date) AS VARCHAR) AS appointment_date,
            '{field}' AS field, coalesce(c.{c}, 0) AS expected, CAST(coalesce(s.{c}, 0) AS BIGINT) AS actual
            FROM cells c FULL JOIN stored s ON c.doctor_id = s.doctor_id AND c.appointment_date = s.appointment_date
            WHERE coalesce(c.{c}, 0) <> coalesce(s.{c}, 0)""" for field, c in maintain.FIELDS.items()), stored=STORED_SQL),
)
def reconcile_drift(spark, folder):
    visits = T.visits(spark, folder)
    stored = stored_with_drift(ops.utilization_cells(visits))
    return maintain.drift_rows(maintain.drift(stored, visits))


@register(
    "reconcile_repair",
    with_views("cells", CELL_SQL + """ UNION ALL SELECT doctor_id + 100, CAST(appointment_date AS VARCHAR), 0, 0, 0, 0, 0
        FROM cells WHERE doctor_id = 3"""),
)
def reconcile_repair(spark, folder):
    visits = T.visits(spark, folder)
    return maintain.repaired(stored_with_drift(ops.utilization_cells(visits)), visits)


@register(
    "outside_domain_values",
    "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('click', 'error', 'purchase', 'view') GROUP BY 1",
)
def outside_domain_values(spark, folder):
    return quality.outside_domain(T.table(spark, folder, "events"), "event_type", ("click", "error", "purchase", "view"))


@register(
    "hourly_demand_feed",
    """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, 's' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) AS specialty,
       count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL""",
)
def hourly_demand_feed(spark, folder):
    """The live-feed aggregate over the whole table at once."""
    out = maintain.demand_stream(T.visit_feed(spark, folder))
    return out.select(F.unix_timestamp("hour_start").alias("hour_start"), "specialty", "n")


@register(
    "first_visit_flag",
    with_views("visits", """SELECT visit_id, patient_id, row_number() OVER (PARTITION BY patient_id
        ORDER BY appointment_date, start_minute, visit_id) = 1 AS is_new_patient FROM visits"""),
)
def first_visit_flag(spark, folder):
    return history.flag_first_visit(T.visits(spark, folder)).select("visit_id", "patient_id", "is_new_patient")
