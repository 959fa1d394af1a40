"""Registered queries: overlap, availability, concurrency, slots and audits of intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import booking, intervals, operations as ops, quality
from wardflow.plans.catalog import register, with_views
from wardflow.sources import tables as T



@register(
    "overlap_audit",
    with_views("visits", """SELECT a.visit_id, a.doctor_id, count(*) AS n_overlaps FROM visits a JOIN visits b
        ON a.doctor_id = b.doctor_id AND a.appointment_date = b.appointment_date AND a.visit_id <> b.visit_id
          AND a.start_minute < b.end_minute AND b.start_minute < a.end_minute
        WHERE a.status <> 'cancelled' AND b.status <> 'cancelled' GROUP BY ALL"""),
)
def overlap_audit(spark, folder):
    return intervals.overlap_audit(T.visits(spark, folder)).select("visit_id", "doctor_id", "n_overlaps")


@register(
    "room_overlaps",
    with_views("visits", """SELECT a.visit_id, a.room_id, count(*) AS n_overlaps FROM visits a JOIN visits b
        ON a.room_id = b.room_id AND a.appointment_date = b.appointment_date AND a.visit_id <> b.visit_id
          AND a.start_minute < b.end_minute AND b.start_minute < a.end_minute
        WHERE a.status <> 'cancelled' AND b.status <> 'cancelled' GROUP BY ALL"""),
)
def room_overlaps(spark, folder):
    audit = intervals.overlap_audit(T.visits(spark, folder).filter("room_id IS NOT NULL"), ("room_id", "appointment_date"))
    return audit.select("visit_id", "room_id", "n_overlaps")


@register(
    "conflicts_running_max",
    with_views("visits", """SELECT visit_id, doctor_id FROM (SELECT visit_id, doctor_id, start_minute,
          max(end_minute) OVER (PARTITION BY doctor_id, appointment_date ORDER BY start_minute, visit_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM visits WHERE status <> 'cancelled') WHERE busy > start_minute"""),
)
def conflicts_running_max(spark, folder):
    return intervals.conflicts_running_max(T.visits(spark, folder)).select("visit_id", "doctor_id")


EDGES_SQL = """SELECT {k}, appointment_date, minute, sum(delta) OVER (PARTITION BY {k}, appointment_date ORDER BY minute, delta, visit_id
      ROWS UNBOUNDED PRECEDING) AS load, delta
    FROM (SELECT {k}, appointment_date, visit_id, start_minute AS minute, 1 AS delta FROM visits WHERE status <> 'cancelled' AND {k} IS NOT NULL
          UNION ALL SELECT {k}, appointment_date, visit_id, end_minute, -1 FROM visits WHERE status <> 'cancelled' AND {k} IS NOT NULL)"""


@register(
    "peak_concurrency",
    with_views("visits", "SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, CAST(max(load) AS BIGINT) AS peak FROM edges GROUP BY ALL",
               edges=EDGES_SQL.format(k="doctor_id")),
)
def peak_concurrency(spark, folder):
    return intervals.peak_concurrency(T.visits(spark, folder).filter(X.occupies()))


@register(
    "capacity_pressure",
    with_views("visits rooms", """SELECT room_id, CAST(appointment_date AS VARCHAR) AS appointment_date, CAST(capacity AS BIGINT) AS capacity,
          CAST(max(load) AS BIGINT) AS peak, count(*) FILTER (WHERE delta = 1 AND load > capacity) AS above_capacity
        FROM edges JOIN rooms USING (room_id) GROUP BY ALL""", edges=EDGES_SQL.format(k="room_id")),
)
def capacity_pressure(spark, folder):
    return intervals.capacity_pressure(T.visits(spark, folder), T.rooms(spark, folder))


@register(
    "merged_busy",
    with_views("visits", """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, min(start_minute) AS start_minute, max(end_minute) AS end_minute
        FROM (SELECT *, sum(new) OVER (PARTITION BY doctor_id, appointment_date ORDER BY start_minute, visit_id ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, CASE WHEN start_minute <= max(end_minute) OVER (PARTITION BY doctor_id, appointment_date ORDER BY start_minute, visit_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM visits WHERE status <> 'cancelled'))
        GROUP BY doctor_id, visits_alias.appointment_date, island""".replace("visits_alias.", "")),
)
def merged_busy(spark, folder):
    return intervals.merged_busy(T.visits(spark, folder).filter(X.occupies()))


COVER_SQL = """SELECT v.*, EXISTS (SELECT 1 FROM availability a WHERE a.doctor_id = v.doctor_id AND a.is_active
    AND a.weekday = isodow(v.appointment_date) AND a.start_minute <= v.start_minute AND v.end_minute <= a.end_minute
    AND a.effective_from <= v.appointment_date AND (a.effective_to IS NULL OR a.effective_to >= v.appointment_date)) AS is_covered FROM visits v"""


@register("covered_by_availability", with_views("visits availability", "SELECT visit_id, is_covered FROM cover", cover=COVER_SQL))
def covered_by_availability(spark, folder):
    return intervals.covered_by_availability(T.visits(spark, folder), T.availability(spark, folder)).select("visit_id", "is_covered")


@register(
    "free_slots",
    with_views("visits windays", """SELECT w.doctor_id, CAST(w.appointment_date AS VARCHAR) AS appointment_date, slot_start, slot_start + 15 AS slot_end,
          NOT busy AS is_free, CASE WHEN busy THEN 'booked' END AS reason
        FROM (SELECT w.*, EXISTS (SELECT 1 FROM visits v WHERE v.doctor_id = w.doctor_id AND v.appointment_date = w.appointment_date
                AND v.status <> 'cancelled' AND v.start_minute < slot_start + 15 AND slot_start < v.end_minute) AS busy
              FROM (SELECT doctor_id, appointment_date, CAST(unnest(generate_series(start_minute, end_minute - 15, 15)) AS INT) AS slot_start FROM windays) w) w"""),
)
def free_slots(spark, folder):
    return intervals.free_slots(T.availability(spark, folder), T.visits(spark, folder), *T.visit_span(spark, folder))


# --- booking verdicts --------------------------------------------------------------------
REQUESTS_SQL = """SELECT visit_id AS request_id, CAST(visit_id % 40 AS BIGINT) AS doctor_id, (patient_id * 37) % 2000 AS patient_id,
    CASE visit_id % 4 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'LARGE' ELSE 'UNKNOWN' END AS specialty,
    appointment_date + CAST(visit_id % 3 AS INT) AS appointment_date, start_minute,
    CASE WHEN visit_id % 5 <> 0 THEN duration_minutes END AS duration_minutes,
    CASE WHEN visit_id % 2 = 0 THEN CAST(visit_id % 30 AS BIGINT) END AS room_id FROM visits"""


def booking_requests(visits):
    """A booking request derived from every visit, valid and invalid ones."""
    v = F.col("visit_id")
    return visits.select(
        v.alias("request_id"),
        (v % 40).alias("doctor_id"),
        (F.col("patient_id") * 37 % 2000).alias("patient_id"),
        F.when(v % 4 == 0, "ECONOMY").when(v % 4 == 1, "PROMO").when(v % 4 == 2, "LARGE").otherwise("UNKNOWN").alias("specialty"),
        F.date_add("appointment_date", (v % 3).cast("int")).alias("appointment_date"),
        "start_minute",
        F.when(v % 5 != 0, F.col("duration_minutes")).alias("duration_minutes"),
        F.when(v % 2 == 0, v % 30).alias("room_id"),
    )


@register(
    "booking_verdicts",
    with_views("visits doctors patients clinics rooms bridge availability specialties", """
        SELECT request_id, CASE WHEN appointment_date < DATE '2024-01-05' THEN 'past_date' WHEN doctor_active IS NULL THEN 'unknown_doctor'
          WHEN length IS NULL THEN 'unknown_specialty' WHEN length <= 0 THEN 'duration_not_positive' WHEN start_minute + length >= 1440 THEN 'past_midnight'
          WHEN NOT doctor_active THEN 'inactive_doctor' WHEN NOT known_patient THEN 'unknown_patient' WHEN open_minute IS NULL THEN 'unknown_clinic'
          WHEN start_minute < open_minute OR start_minute + length > close_minute THEN 'outside_clinic_hours'
          WHEN NOT holds THEN 'specialty_mismatch' WHEN NOT covered THEN 'doctor_unavailable'
          WHEN room_id IS NOT NULL AND capacity IS NULL THEN 'unknown_room' WHEN room_id IS NOT NULL AND in_room >= capacity THEN 'room_full'
          WHEN with_doctor > 0 THEN 'slot_taken' ELSE 'ok' END AS verdict FROM staged""",
        asked=REQUESTS_SQL,
        sized="""SELECT r.*, d.is_active AS doctor_active, coalesce(r.duration_minutes, s.default_duration_minutes) AS length,
                   c.open_minute, c.close_minute, ro.capacity
                 FROM asked r LEFT JOIN doctors d USING (doctor_id) LEFT JOIN specialties s USING (specialty)
                 LEFT JOIN clinics c ON c.clinic_id = d.clinic_id LEFT JOIN rooms ro ON ro.room_id = r.room_id""",
        live="SELECT * FROM visits WHERE status <> 'cancelled'",
        staged="""SELECT r.*, r.patient_id IN (SELECT patient_id FROM patients) AS known_patient,
                 EXISTS (SELECT 1 FROM bridge b WHERE b.doctor_id = r.doctor_id AND b.specialty = r.specialty) AS holds,
                 EXISTS (SELECT 1 FROM availability a WHERE a.doctor_id = r.doctor_id AND a.is_active AND a.weekday = isodow(r.appointment_date)
                   AND a.start_minute <= r.start_minute AND r.start_minute + r.length <= a.end_minute AND a.effective_from <= r.appointment_date
                   AND (a.effective_to IS NULL OR a.effective_to >= r.appointment_date)) AS covered,
                 (SELECT count(*) FROM live v WHERE v.room_id = r.room_id AND v.appointment_date = r.appointment_date
                   AND v.start_minute < r.start_minute + r.length AND r.start_minute < v.end_minute) AS in_room,
                 (SELECT count(*) FROM live v WHERE v.doctor_id = r.doctor_id AND v.appointment_date = r.appointment_date
                   AND v.start_minute < r.start_minute + r.length AND r.start_minute < v.end_minute) AS with_doctor
                 FROM sized r"""),
)
def booking_verdicts(spark, folder):
    visits = T.visits(spark, folder)
    out = quality.booking_verdicts(
        booking_requests(visits),
        visits,
        doctors=T.doctors(spark, folder),
        patients=T.patients(spark, folder),
        clinics=T.clinics(spark, folder),
        rooms=T.rooms(spark, folder),
        bridge=T.specialty_bridge(spark, folder),
        availability=T.availability(spark, folder),
        specialties=T.specialties(spark, folder),
        as_of=dt.date(2024, 1, 5),
    )
    return out.select("request_id", "verdict")


# --- a batch of bookings -------------------------------------------------------------------
BATCH_SQL = f"""SELECT 2 * request_id AS request_id, doctor_id, patient_id, specialty, appointment_date, start_minute, duration_minutes, room_id,
      CAST(NULL AS BIGINT) AS moves_visit_id FROM ({REQUESTS_SQL})
    UNION ALL SELECT 2 * visit_id + 1, doctor_id, (patient_id * 37) % 100 + 1, CASE visit_id % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END,
      CASE visit_id % 2 WHEN 0 THEN appointment_date ELSE appointment_date + 7 END, CASE visit_id % 2 WHEN 0 THEN start_minute + 15 ELSE 600 END,
      duration_minutes, room_id, visit_id FROM visits WHERE status IN ('scheduled', 'completed') AND visit_id % 4 < 2"""
STATIC_SQL = """SELECT *, CASE WHEN moves_visit_id IS NOT NULL AND old_status <> 'scheduled' THEN 'only_scheduled_can_move'
      WHEN appointment_date < DATE '2024-01-05' THEN 'past_date' WHEN doctor_active IS NULL THEN 'unknown_doctor'
      WHEN length IS NULL THEN 'unknown_specialty' WHEN length <= 0 THEN 'duration_not_positive' WHEN start_minute + length >= 1440 THEN 'past_midnight'
      WHEN NOT doctor_active THEN 'inactive_doctor' WHEN NOT known_patient THEN 'unknown_patient' WHEN open_minute IS NULL THEN 'unknown_clinic'
      WHEN start_minute < open_minute OR start_minute + length > close_minute THEN 'outside_clinic_hours'
      WHEN NOT holds THEN 'specialty_mismatch' WHEN NOT covered THEN 'doctor_unavailable'
      WHEN room_id IS NOT NULL AND capacity IS NULL THEN 'unknown_room' END AS refused
    FROM (SELECT r.*, r.patient_id IN (SELECT patient_id FROM patients) AS known_patient,
        EXISTS (SELECT 1 FROM bridge b WHERE b.doctor_id = r.doctor_id AND b.specialty = r.specialty) AS holds,
        EXISTS (SELECT 1 FROM availability a WHERE a.doctor_id = r.doctor_id AND a.is_active AND a.weekday = isodow(r.appointment_date)
          AND a.start_minute <= r.start_minute AND r.start_minute + r.length <= a.end_minute AND a.effective_from <= r.appointment_date
          AND (a.effective_to IS NULL OR a.effective_to >= r.appointment_date)) AS covered
      FROM (SELECT r.*, d.is_active AS doctor_active, coalesce(r.duration_minutes, s.default_duration_minutes) AS length, c.open_minute, c.close_minute, ro.capacity,
              o.status AS old_status
            FROM batch r LEFT JOIN doctors d USING (doctor_id) LEFT JOIN specialties s USING (specialty) LEFT JOIN clinics c ON c.clinic_id = d.clinic_id
            LEFT JOIN rooms ro ON ro.room_id = r.room_id LEFT JOIN visits o ON o.visit_id = r.moves_visit_id) r)"""
# One request after the other: what was accepted and which visits were moved away is carried from step to step.
FOLD_SQL = """SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(d BIGINT, r BIGINT, day DATE, s INT, e INT)[]) AS taken, CAST([] AS BIGINT[]) AS freed,
      CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS verdict
    UNION ALL SELECT k, CASE WHEN verdict = 'ok' THEN list_append(taken, slot) ELSE taken END,
      CASE WHEN verdict = 'ok' AND moves_visit_id IS NOT NULL THEN list_append(freed, moves_visit_id) ELSE freed END, request_id, verdict
    FROM (SELECT c.k, taken, freed, c.request_id, c.moves_visit_id, c.slot,
            CASE WHEN c.moves_visit_id IS NOT NULL AND list_contains(freed, c.moves_visit_id) THEN 'only_scheduled_can_move'
              WHEN c.room_id IS NOT NULL AND len(list_filter(c.in_room, lambda v: NOT list_contains(freed, v)))
                + len(list_filter(taken, lambda t: t.r = c.slot.r AND t.day = c.slot.day AND t.s < c.slot.e AND c.slot.s < t.e)) >= c.capacity THEN 'room_full'
              WHEN len(list_filter(c.with_doctor, lambda v: NOT list_contains(freed, v)))
                + len(list_filter(taken, lambda t: t.d = c.slot.d AND t.day = c.slot.day AND t.s < c.slot.e AND c.slot.s < t.e)) > 0 THEN 'slot_taken'
              ELSE 'ok' END AS verdict
          FROM fold f JOIN queue c ON c.k = f.k + 1)"""
QUEUE_SQL = """SELECT row_number() OVER (ORDER BY request_id) AS k, request_id, moves_visit_id, room_id, capacity,
      {'d': doctor_id, 'r': room_id, 'day': appointment_date, 's': CAST(start_minute AS INT), 'e': CAST(start_minute + length AS INT)} AS slot,
      coalesce((SELECT list(v.visit_id) FROM live v WHERE v.room_id = r.room_id AND v.appointment_date = r.appointment_date
        AND v.start_minute < r.start_minute + r.length AND r.start_minute < v.end_minute AND v.visit_id IS DISTINCT FROM r.moves_visit_id), []) AS in_room,
      coalesce((SELECT list(v.visit_id) FROM live v WHERE v.doctor_id = r.doctor_id AND v.appointment_date = r.appointment_date
        AND v.start_minute < r.start_minute + r.length AND r.start_minute < v.end_minute AND v.visit_id IS DISTINCT FROM r.moves_visit_id), []) AS with_doctor
    FROM static r WHERE refused IS NULL"""
BATCH_VIEWS = {"batch": BATCH_SQL, "static": STATIC_SQL, "live": "SELECT * FROM visits WHERE status <> 'cancelled'", "queue": QUEUE_SQL, "fold": FOLD_SQL,
               "verdicts": """SELECT request_id, refused AS verdict FROM static WHERE refused IS NOT NULL UNION ALL SELECT request_id, verdict FROM fold WHERE request_id IS NOT NULL"""}
BATCH_TABLES = "visits doctors patients clinics rooms bridge availability specialties"


def batch_requests(visits):
    """New bookings and moves in turn: every visit asks for one, some scheduled and completed ones also ask to be moved."""
    v = F.col("visit_id")
    asked = booking_requests(visits).withColumn("request_id", F.col("request_id") * 2).withColumn("moves_visit_id", F.lit(None).cast("long"))
    same_day = v % 2 == 0
    moves = visits.filter(F.col("status").isin("scheduled", "completed") & (v % 4 < 2)).select(
        (v * 2 + 1).alias("request_id"),
        "doctor_id",
        (F.col("patient_id") * 37 % 100 + 1).alias("patient_id"),
        F.when(v % 3 == 0, "ECONOMY").when(v % 3 == 1, "PROMO").otherwise("LARGE").alias("specialty"),
        F.when(same_day, F.col("appointment_date")).otherwise(F.date_add("appointment_date", 7)).alias("appointment_date"),
        F.when(same_day, F.col("start_minute") + 15).otherwise(600).alias("start_minute"),
        "duration_minutes",
        "room_id",
        v.alias("moves_visit_id"),
    )
    return asked.unionByName(moves)


def _batch(spark, folder):
    visits = T.visits(spark, folder)
    requests = batch_requests(visits)
    verdicts = booking.book_batch(
        requests,
        visits,
        doctors=T.doctors(spark, folder),
        patients=T.patients(spark, folder),
        clinics=T.clinics(spark, folder),
        rooms=T.rooms(spark, folder),
        bridge=T.specialty_bridge(spark, folder),
        availability=T.availability(spark, folder),
        specialties=T.specialties(spark, folder),
        as_of=dt.date(2024, 1, 5),
    )
    return visits, requests, verdicts


@register("booking_batch", with_views(BATCH_TABLES, "SELECT request_id, verdict FROM verdicts", **BATCH_VIEWS))
def booking_batch(spark, folder):
    """Bookings and moves that compete for slots, rooms and visits, decided as if one came after the other."""
    return _batch(spark, folder)[2]


@register(
    "batch_schedule",
    with_views(BATCH_TABLES, """SELECT visit_id, status, CAST(appointment_date AS VARCHAR) AS appointment_date, start_minute, end_minute FROM (
          SELECT v.visit_id, CASE WHEN m.moves_visit_id IS NOT NULL THEN 'cancelled' ELSE status END AS status, v.appointment_date, v.start_minute, v.end_minute
            FROM visits v LEFT JOIN moved m ON v.visit_id = m.moves_visit_id
          UNION ALL SELECT m.request_id + 1000000000, 'scheduled', m.appointment_date, CAST(m.start_minute AS INT), CAST(m.start_minute + m.duration_minutes AS INT) FROM moved m)""",
        **BATCH_VIEWS, moved="SELECT b.* FROM batch b JOIN verdicts USING (request_id) WHERE verdict = 'ok' AND moves_visit_id IS NOT NULL"),
)
def batch_schedule(spark, folder):
    """The visits after the accepted moves of the batch: the old rows cancelled, the new ones added."""
    visits, requests, verdicts = _batch(spark, folder)
    moves = requests.filter("moves_visit_id IS NOT NULL").select(
        F.col("moves_visit_id").alias("visit_id"), (F.col("request_id") + 1_000_000_000).alias("new_visit_id"), F.col("appointment_date").alias("new_date"),
        F.col("start_minute").alias("new_start"), F.col("duration_minutes").alias("new_duration"), "request_id")
    of_visit = moves.join(verdicts, "request_id").select("visit_id", "verdict")
    return ops.apply_moves(visits, moves.drop("request_id"), of_visit).select("visit_id", "status", "appointment_date", "start_minute", "end_minute")


PROBLEM_SQL = """
    SELECT visit_id, 'no_availability' AS problem FROM tagged WHERE longest IS NULL
    UNION ALL SELECT visit_id, 'specialty_not_held' FROM tagged WHERE longest IS NOT NULL AND any_held AND NOT holds
    UNION ALL SELECT visit_id, 'no_window_long_enough' FROM tagged WHERE longest < duration_minutes"""


@register(
    "schedule_request_problems",
    with_views("requests windays bridge", PROBLEM_SQL,
               asked="SELECT r.* REPLACE (CASE visit_id % 2 WHEN 0 THEN 'PROMO' ELSE 'TELE' END AS specialty) FROM requests r",
               tagged="""SELECT r.*, w.longest, r.doctor_id IN (SELECT doctor_id FROM bridge) AS any_held,
                  EXISTS (SELECT 1 FROM bridge b WHERE b.doctor_id = r.doctor_id AND b.specialty = r.specialty) AS holds
                  FROM asked r LEFT JOIN (SELECT doctor_id, appointment_date, max(end_minute - start_minute) AS longest FROM windays GROUP BY ALL) w
                  USING (doctor_id, appointment_date)"""),
)
def schedule_request_problems(spark, folder):
    asked = T.schedule_requests(spark, folder).withColumn(
        "specialty", F.when(F.col("visit_id") % 2 == 0, "PROMO").otherwise("TELE")
    )
    out = quality.schedule_request_problems(asked, T.availability(spark, folder), T.specialty_bridge(spark, folder))
    return out.select("visit_id", "problem")


@register(
    "compressed_day",
    with_views("requests windays", """SELECT visit_id, CAST(coalesce(floor((s + (requested_start_minute - s) / greatest(e - s, 1)
            * greatest(c_end - s - duration_minutes, 0)) / 15) * 15, requested_start_minute) AS INT) AS compressed_start_minute,
          CAST(c_end AS INT) AS compressed_window_end
        FROM (SELECT r.*, w.start_minute AS s, w.end_minute AS e,
                least(w.end_minute, w.start_minute + greatest(CAST(floor((w.end_minute - w.start_minute) * CAST(0.35 AS DOUBLE)) AS INT), longest)) AS c_end
              FROM requests r JOIN (SELECT clinic_id, appointment_date, max(duration_minutes) AS longest FROM requests GROUP BY ALL) USING (clinic_id, appointment_date)
              LEFT JOIN windays w ON w.doctor_id = r.doctor_id AND w.appointment_date = r.appointment_date
                AND w.start_minute <= requested_start_minute AND requested_start_minute < w.end_minute)"""),
)
def compressed_day(spark, folder):
    windows = intervals.window_days(T.availability(spark, folder), *T.visit_span(spark, folder))
    out = intervals.compress_day(windows, T.schedule_requests(spark, folder), 0.35)
    return out.select("visit_id", "compressed_start_minute", "compressed_window_end")
