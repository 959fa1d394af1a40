"""Registered queries: schedule scoring, comparison and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import intervals, quality, running, schedule
from wardflow.plans.catalog import register, with_views
from wardflow.sources import sinks, tables as T



def entry_sql(schedule_id: int, spread: int) -> str:
    return f"""SELECT CAST({schedule_id} AS BIGINT) AS schedule_id, clinic_id, appointment_date, visit_id, doctor_id, room_id, s AS start_minute,
        s + duration_minutes AS end_minute, duration_minutes, no_show_probability
        FROM (SELECT *, CAST(ceil(requested_start_minute / 15) * 15 + visit_id % {spread} * 15 AS INT) AS s FROM requests)"""


SCORE_SQL = """SELECT e.schedule_id, e.clinic_id, e.appointment_date, CAST(sum(e.delay) AS BIGINT) AS total_delay_minutes,
    coalesce(max(i.idle), 0) AS total_idle_minutes, CAST(sum(greatest(e.end_minute - close_minute, 0)) AS BIGINT) AS total_overtime_minutes,
    sum(e.delay * (e.w - 1.0)) AS urgency_penalty, coalesce(sum(e.risk) FILTER (WHERE NOT last), 0.0) AS expected_idle_minutes,
    coalesce(max(o.slots), 0) AS overbooked_slots, count(*) AS scheduled_count, max(e.delay) AS max_delay_minutes,
    avg(e.delay) AS mean_delay_minutes
    FROM (SELECT e.*, greatest(e.start_minute - requested_start_minute, 0) AS delay,
            CASE urgency WHEN 'urgent' THEN 3.0 WHEN 'emergency' THEN 8.0 ELSE 1.0 END AS w,
            CAST(r.no_show_probability * r.duration_minutes AS DOUBLE) AS risk,
            row_number() OVER (PARTITION BY e.schedule_id, e.doctor_id, e.appointment_date ORDER BY e.start_minute DESC, visit_id DESC) = 1 AS last
          FROM {entries} e JOIN (SELECT visit_id, requested_start_minute, urgency, no_show_probability, duration_minutes FROM requests) r USING (visit_id)) e
    JOIN clinics USING (clinic_id)
    LEFT JOIN (SELECT schedule_id, clinic_id, appointment_date, CAST(sum(greatest(gap, 0)) AS BIGINT) AS idle FROM (
        SELECT e.schedule_id, e.clinic_id, e.appointment_date, e.start_minute - lag(e.end_minute) OVER (PARTITION BY e.schedule_id, e.doctor_id,
          e.appointment_date, w.start_minute ORDER BY e.start_minute, e.visit_id) AS gap
        FROM {entries} e JOIN windays w ON w.doctor_id = e.doctor_id AND w.appointment_date = e.appointment_date
          AND w.start_minute <= e.start_minute AND e.end_minute <= w.end_minute) GROUP BY ALL) i
      ON i.schedule_id = e.schedule_id AND i.clinic_id = e.clinic_id AND i.appointment_date = e.appointment_date
    LEFT JOIN (SELECT schedule_id, clinic_id, appointment_date, count(*) AS slots FROM (SELECT schedule_id, clinic_id, appointment_date, doctor_id, start_minute
        FROM {entries} GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL) o
      ON o.schedule_id = e.schedule_id AND o.clinic_id = e.clinic_id AND o.appointment_date = e.appointment_date
    GROUP BY e.schedule_id, e.clinic_id, e.appointment_date"""
OBJECTIVE = "(1.0 * total_delay_minutes + {idle} * total_idle_minutes + 3.0 * total_overtime_minutes + 1.0 * urgency_penalty + 60.0 * overbooked_slots)"
BASE = {"base": entry_sql(1, 4), "bscore": SCORE_SQL.format(entries="base")}
CAND = {"cand": entry_sql(2, 3), "cscore": SCORE_SQL.format(entries="cand")}
KEYS_SQL = "schedule_id, clinic_id, CAST(appointment_date AS VARCHAR) AS appointment_date"


def _schedule(spark, folder, schedule_id, spread):
    requests = T.schedule_requests(spark, folder)
    entries = T.schedule_entries(requests, schedule_id, spread)
    windows = intervals.window_days(T.availability(spark, folder), *T.visit_span(spark, folder))
    return entries, requests, windows, T.clinics(spark, folder)


def _scores(spark, folder, schedule_id, spread):
    return schedule.score_schedule(*_schedule(spark, folder, schedule_id, spread))


@register(
    "score_schedule",
    with_views("requests windays clinics", f"""SELECT {KEYS_SQL}, total_delay_minutes, total_idle_minutes, total_overtime_minutes,
          round_even(round(CAST(urgency_penalty AS DOUBLE), 9), 2) AS urgency_penalty, round_even(round(expected_idle_minutes, 9), 2) AS expected_idle_minutes, overbooked_slots,
          scheduled_count, max_delay_minutes, 0 AS unscheduled_count, round_even(round(mean_delay_minutes, 9), 2) AS mean_delay_minutes,
          round_even(round(CAST({OBJECTIVE.format(idle=0.8)} AS DOUBLE), 9), 2) AS objective FROM bscore""", **BASE),
)
def score_schedule(spark, folder):
    return schedule.rounded(_scores(spark, folder, 1, 4))


@register(
    "partial_schedule",
    with_views("requests", """SELECT schedule_id, clinic_id, CAST(appointment_date AS VARCHAR) AS appointment_date, coalesce(placed, 0) AS scheduled_count,
        asked - coalesce(placed, 0) AS unscheduled_count
        FROM (SELECT clinic_id, appointment_date, count(*) AS asked FROM requests GROUP BY ALL)
        LEFT JOIN (SELECT 1::BIGINT AS schedule_id, clinic_id, appointment_date, count(*) AS placed FROM requests
                   WHERE visit_id % 5 <> 0 AND NOT (clinic_id = 3 AND day(appointment_date) % 2 = 0) GROUP BY ALL) USING (clinic_id, appointment_date)"""),
)
def partial_schedule(spark, folder):
    """A schedule that leaves out some requests, and all of some clinic-days."""
    entries, requests, windows, clinics = _schedule(spark, folder, 1, 4)
    kept = entries.filter((F.col("visit_id") % 5 != 0) & ~((F.col("clinic_id") == 3) & (F.dayofmonth("appointment_date") % 2 == 0)))
    scores = schedule.score_schedule(kept, requests, windows, clinics)
    return scores.select("schedule_id", "clinic_id", "appointment_date", "scheduled_count", "unscheduled_count")


@register(
    "doctor_scores",
    with_views("requests windays", """SELECT doctor_id, CAST(e.appointment_date AS VARCHAR) AS appointment_date, count(*) AS visits,
          CAST(sum(e.end_minute - e.start_minute) AS BIGINT) AS booked_minutes, coalesce(max(idle), 0) AS idle_minutes
        FROM base e LEFT JOIN (SELECT doctor_id, appointment_date, CAST(sum(greatest(gap, 0)) AS BIGINT) AS idle FROM (
            SELECT e.doctor_id, e.appointment_date, e.start_minute - lag(e.end_minute) OVER (PARTITION BY e.doctor_id, e.appointment_date, w.start_minute
              ORDER BY e.start_minute, e.visit_id) AS gap FROM base e JOIN windays w ON w.doctor_id = e.doctor_id AND w.appointment_date = e.appointment_date
              AND w.start_minute <= e.start_minute AND e.end_minute <= w.end_minute) GROUP BY ALL) USING (doctor_id, appointment_date)
        GROUP BY doctor_id, e.appointment_date""", base=BASE["base"]),
)
def doctor_scores(spark, folder):
    return schedule.doctor_scores(*_schedule(spark, folder, 1, 4)).select(
        "doctor_id", "appointment_date", "visits", "booked_minutes", "idle_minutes"
    )


IDLE_SQL = """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, CAST(coalesce(sum(greatest(gap, 0)), 0) AS BIGINT) AS idle_minutes FROM (
    SELECT e.doctor_id, e.appointment_date, e.start_minute - lag(e.end_minute) OVER (PARTITION BY e.doctor_id, e.appointment_date, w.start_minute
      ORDER BY e.start_minute, e.visit_id) AS gap
    FROM base e JOIN windays w ON w.doctor_id = e.doctor_id AND w.appointment_date = e.appointment_date
      AND w.start_minute <= e.start_minute AND e.end_minute <= w.end_minute) GROUP BY ALL"""


@register("idle_minutes", with_views("requests windays", IDLE_SQL, base=BASE["base"]))
def idle_minutes(spark, folder):
    entries, _, windows, _ = _schedule(spark, folder, 1, 4)
    return intervals.idle_minutes(entries, windows, ["doctor_id", "appointment_date"])


PCT = "CASE WHEN b.{c} > 0 THEN round_even(round((b.{c} - c.{c}) / b.{c} * 100, 9), 2) ELSE 0.0 END AS {n}"
COMPARE_SQL = "SELECT b.clinic_id, b.appointment_date, " + ", ".join(
    PCT.format(c=c, n=n) for n, c in {
        "delay_pct": "total_delay_minutes", "idle_pct": "total_idle_minutes", "overtime_pct": "total_overtime_minutes",
        "expected_idle_pct": "expected_idle_minutes", "objective_pct": "objective", "mean_delay_pct": "mean_delay_minutes"}.items()
) + """ FROM (SELECT *, {o} AS objective FROM bscore) b JOIN (SELECT *, {o} AS objective FROM cscore) c
    ON b.clinic_id = c.clinic_id AND b.appointment_date = c.appointment_date""".format(o=OBJECTIVE.format(idle=0.8))


def _comparison(spark, folder):
    """Both schedules are scored in one frame and compared by one aggregate."""
    _, requests, windows, clinics = _schedule(spark, folder, 1, 4)
    scores = schedule.score_schedule(T.schedule_plans(requests, {1: 4, 2: 3}), requests, windows, clinics)
    return schedule.compare_within(scores, 1, 2)


@register(
    "compare_schedules",
    with_views("requests windays clinics", "SELECT * REPLACE (CAST(appointment_date AS VARCHAR) AS appointment_date) FROM compared",
               **BASE, **CAND, compared=COMPARE_SQL),
)
def compare_schedules(spark, folder):
    return _comparison(spark, folder)


@register(
    "objective_by_policy",
    with_views("requests windays clinics", f"""SELECT {KEYS_SQL}, 'balanced' AS policy, round_even(round(CAST({OBJECTIVE.format(idle=0.8)} AS DOUBLE), 9), 2) AS objective FROM bscore
        UNION ALL SELECT {KEYS_SQL}, 'patient_first', round_even(round(CAST({OBJECTIVE.format(idle=0.0)} AS DOUBLE), 9), 2) FROM bscore""", **BASE),
)
def objective_by_policy(spark, folder):
    return schedule.reweighted(_scores(spark, folder, 1, 4))


@register(
    "shared_slot_members",
    with_views("requests", f"""SELECT {KEYS_SQL}, doctor_id, start_minute, visit_id, slot_size FROM (SELECT *, count(*) OVER (PARTITION BY
        clinic_id, doctor_id, appointment_date, start_minute) AS slot_size FROM base) WHERE slot_size > 1""", base=BASE["base"]),
)
def shared_slot_members(spark, folder):
    return schedule.shared_slot_members(_schedule(spark, folder, 1, 4)[0])


AUDIT_SQL = """SELECT schedule_id, doctor_id, appointment_date, start_minute, count(*) AS members, CAST(sum(1.0 - no_show_probability) AS DOUBLE) AS expected_attendance
    FROM base GROUP BY ALL HAVING count(*) > 1"""


@register(
    "overbooking_audit",
    with_views("requests", f"""SELECT schedule_id, doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, start_minute, members,
        round(expected_attendance, 6) AS expected_attendance, members > 2 AS too_many, expected_attendance > 1.000000001 AS too_crowded FROM ({AUDIT_SQL})""",
               base=BASE["base"]),
)
def overbooking_audit(spark, folder):
    audit = quality.overbooking_audit(_schedule(spark, folder, 1, 4)[0])
    return audit.withColumn("expected_attendance", F.round("expected_attendance", 6))


@register(
    "overbooking_refusals",
    with_views("requests", f"""SELECT schedule_id, shared_slots, CASE WHEN shared_slots > 0 THEN 'shared_slots:' || shared_slots END AS reason,
          shared_slots > 10 AS over_daily_cap
        FROM (SELECT CAST(1 AS BIGINT) AS schedule_id, count(*) AS shared_slots FROM ({AUDIT_SQL}))""", base=BASE["base"]),
)
def overbooking_refusals(spark, folder):
    return quality.refusal_reasons(_schedule(spark, folder, 1, 4)[0], max_slots=10)


@register(
    "expected_idle",
    with_views("requests", """SELECT doctor_id, CAST(appointment_date AS VARCHAR) AS appointment_date, round(sum(CASE WHEN later IS NOT NULL THEN risk ELSE 0 END), 6) AS expected_idle_minutes
        FROM (SELECT doctor_id, appointment_date, CAST(no_show_probability * duration_minutes AS DOUBLE) AS risk,
                lead(visit_id) OVER (PARTITION BY doctor_id, appointment_date ORDER BY start_minute, visit_id) AS later FROM base) GROUP BY ALL""",
               base=BASE["base"]),
)
def expected_idle(spark, folder):
    scores = schedule.doctor_scores(*_schedule(spark, folder, 1, 4))
    return scores.select("doctor_id", "appointment_date", F.round("expected_idle_minutes", 6).alias("expected_idle_minutes"))


# --- roll-up --------------------------------------------------------------------------
SPREAD_SQL = """round_even(round(avg({m}), 9), 2) AS mean, round_even(round(median({m}), 9), 2) AS median,
    list_sort(list({m}))[CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS INT) + 1] AS p10,
    list_sort(list({m}))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS INT) + 1] AS p90, min({m}) AS min, max({m}) AS max"""


@register(
    "improvement_spread",
    with_views("requests windays clinics", "SELECT count(*) AS n_values, " + SPREAD_SQL.format(m="objective_pct") + " FROM compared",
               **BASE, **CAND, compared=COMPARE_SQL),
)
def improvement_spread(spark, folder):
    return running.spread_summary(_comparison(spark, folder), "objective_pct")


def _load_views() -> dict[str, str]:
    """The compressed requests and windows of every factor, and both schedules of them scored and compared."""
    views = {
        "longest": "SELECT clinic_id, appointment_date, max(duration_minutes) AS longest FROM requests GROUP BY ALL",
        "ofdoctor": """SELECT doctor_id, appointment_date, max(longest) AS longest FROM (SELECT DISTINCT doctor_id, clinic_id, appointment_date FROM requests)
            JOIN longest USING (clinic_id, appointment_date) GROUP BY ALL""",
    }
    for i, factor in enumerate(schedule.LOAD_FACTORS):
        end = f"least({{e}}, {{s}} + greatest(CAST(floor(({{e}} - {{s}}) * CAST({factor} AS DOUBLE)) AS INT), longest))"
        views[f"windays{i}"] = f"""SELECT doctor_id, appointment_date, start_minute, {end.format(s='start_minute', e='end_minute')} AS end_minute
            FROM windays JOIN ofdoctor USING (doctor_id, appointment_date)"""
        views[f"requests{i}"] = f"""SELECT r.* EXCLUDE (s, e, longest) REPLACE (CAST(coalesce(floor((s + (requested_start_minute - s) / greatest(e - s, 1)
                * greatest({end.format(s='s', e='e')} - s - duration_minutes, 0)) / 15) * 15, requested_start_minute) AS INT) AS requested_start_minute)
            FROM (SELECT r.*, w.start_minute AS s, w.end_minute AS e, l.longest FROM requests r JOIN longest l USING (clinic_id, appointment_date)
              LEFT JOIN windays w ON w.doctor_id = r.doctor_id AND w.appointment_date = r.appointment_date
                AND w.start_minute <= requested_start_minute AND requested_start_minute < w.end_minute) r"""
        for side, spread in ((1, 4), (2, 3)):
            views[f"plan{side}_{i}"] = entry_sql(side, spread).replace("FROM requests", f"FROM requests{i}")
            views[f"score{side}_{i}"] = SCORE_SQL.format(entries=f"plan{side}_{i}").replace("FROM requests)", f"FROM requests{i})").replace("JOIN windays w", f"JOIN windays{i} w")
        views[f"compared{i}"] = COMPARE_SQL.replace("bscore", f"score1_{i}").replace("cscore", f"score2_{i}")
        views[f"used{i}"] = f"""SELECT round_even(round(avg(coalesce(busy, 0) / room * 100), 9), 1) AS used FROM
            (SELECT doctor_id, appointment_date, sum(end_minute - start_minute) AS room FROM windays{i} GROUP BY ALL HAVING sum(end_minute - start_minute) > 0)
            LEFT JOIN (SELECT doctor_id, appointment_date, sum(duration_minutes) AS busy FROM plan1_{i} GROUP BY ALL) USING (doctor_id, appointment_date)"""
    return views


@register(
    "improvement_by_load",
    with_views("requests windays clinics", """SELECT factor, count(*) AS days, count(*) FILTER (WHERE objective_pct > 0.01) AS days_better,
          count(*) FILTER (WHERE abs(objective_pct) <= 0.01) AS days_identical, count(*) FILTER (WHERE objective_pct < -0.01) AS days_worse, count(*) >= 5 AS enough_days, """
               + SPREAD_SQL.format(m="objective_pct") + ", max(used) AS mean_utilization_pct FROM ("
               + " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS factor, c.*, used FROM compared{i} c, used{i}" for i, f in enumerate(schedule.LOAD_FACTORS))
               + ") GROUP BY factor", **_load_views()),
)
def improvement_by_load(spark, folder):
    """Days squeezed to every load factor: windows and requested times compressed, both schedules scored again and compared."""
    _, requests, windows, clinics = _schedule(spark, folder, 1, 4)
    plan = lambda asked, keep: T.schedule_plans(asked, {1: 4, 2: 3}, keep=keep)
    return schedule.load_sweep(requests, windows, clinics, plan, 1, 2)


# --- replay ------------------------------------------------------------------------------
RUN_SQL = """SELECT side, doctor_id, appointment_date, rn, visit_id, clinic_id, start_minute, duration_minutes, start_minute AS begin_minute,
      start_minute + duration_minutes AS finish_minute FROM ord WHERE rn = 1
    UNION ALL SELECT o.side, o.doctor_id, o.appointment_date, o.rn, o.visit_id, o.clinic_id, o.start_minute, o.duration_minutes,
      greatest(o.start_minute, r.finish_minute), greatest(o.start_minute, r.finish_minute) + o.duration_minutes
    FROM run r JOIN ord o ON o.side = r.side AND o.doctor_id = r.doctor_id AND o.appointment_date = r.appointment_date AND o.rn = r.rn + 1"""
ORD_SQL = """SELECT *, row_number() OVER (PARTITION BY side, doctor_id, appointment_date ORDER BY start_minute, visit_id) AS rn
    FROM sides WHERE status <> 'no_show'"""
REPLAY = {"sides": "SELECT 0 AS side, * FROM visits WHERE status <> 'cancelled'", "ord": ORD_SQL, "run": RUN_SQL}
WAITS_SQL = """SELECT side, visit_id, clinic_id, doctor_id, appointment_date, begin_minute, finish_minute, begin_minute - start_minute AS wait_minutes FROM run
    UNION ALL SELECT side, visit_id, clinic_id, doctor_id, appointment_date, NULL, NULL, 0 FROM sides WHERE status = 'no_show'"""
SESSION_SQL = """SELECT side, clinic_id, doctor_id, appointment_date, greatest(coalesce(max(finish_minute) - max(close_minute), 0), 0) AS overtime,
    greatest(coalesce(max(finish_minute) - min(begin_minute) - sum(duration_minutes) FILTER (WHERE finish_minute IS NOT NULL), 0), 0) AS idle
    FROM (SELECT w.*, duration_minutes FROM waits w JOIN (SELECT visit_id, duration_minutes FROM visits) USING (visit_id)) JOIN clinics USING (clinic_id)
    GROUP BY side, clinic_id, doctor_id, appointment_date"""


def _sessions(spark, folder):
    live = T.visits(spark, folder).filter(X.occupies())
    return live.withColumn("attends", F.col("status") != "no_show")


@register(
    "queue_replay",
    with_views("visits", """SELECT visit_id, CAST(begin_minute AS BIGINT) AS begin_minute, CAST(finish_minute AS BIGINT) AS finish_minute,
        CAST(wait_minutes AS BIGINT) AS wait_minutes FROM waits""", **REPLAY, waits=WAITS_SQL),
)
def queue_replay(spark, folder):
    out = schedule.queue_replay(_sessions(spark, folder), attends="attends")
    return out.select("visit_id", "begin_minute", "finish_minute", "wait_minutes")


@register(
    "wait_summary",
    with_views("visits clinics", """SELECT clinic_id, visits, mean_wait, median_wait, p90_wait, max_wait, share_over_15, mean_overtime, mean_idle
        FROM (SELECT clinic_id, count(*) AS visits, round_even(round(avg(wait_minutes), 9), 2) AS mean_wait,
                CAST(list_sort(list(wait_minutes))[count(*) // 2 + 1] AS BIGINT) AS median_wait,
                CAST(list_sort(list(wait_minutes))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS INT) + 1] AS BIGINT) AS p90_wait,
                CAST(max(wait_minutes) AS BIGINT) AS max_wait, round_even(round(avg(CAST(wait_minutes > 15 AS INT)), 9), 4) AS share_over_15
              FROM waits GROUP BY 1)
        JOIN (SELECT clinic_id, round_even(round(avg(o), 9), 2) AS mean_overtime, round_even(round(avg(i), 9), 2) AS mean_idle
              FROM (SELECT clinic_id, appointment_date, sum(overtime) AS o, sum(idle) AS i FROM sess GROUP BY ALL) GROUP BY 1) USING (clinic_id)""",
               **REPLAY, waits=WAITS_SQL, sess=SESSION_SQL),
)
def wait_summary(spark, folder):
    replayed = schedule.queue_replay(_sessions(spark, folder), attends="attends")
    return schedule.wait_summary(replayed, T.clinics(spark, folder))


MOVES_SQL = "SELECT min(visit_id) AS visit_id, 900 AS new_start_minute FROM visits WHERE status <> 'cancelled' GROUP BY clinic_id, appointment_date"


@register(
    "moved_visit_impact",
    with_views("visits clinics", """SELECT b.clinic_id, CAST(b.appointment_date AS VARCHAR) AS appointment_date, visit_id, 900 AS new_start_minute,
          CAST(b.wait_minutes AS BIGINT) AS wait_before, CAST(a.wait_minutes AS BIGINT) AS wait_after, mb.m AS clinic_mean_wait_before, ma.m AS clinic_mean_wait_after,
          ob.o AS clinic_overtime_before, oa.o AS clinic_overtime_after
        FROM moves JOIN (SELECT * FROM waits WHERE side = 0) b USING (visit_id) JOIN (SELECT * FROM waits WHERE side = 1) a USING (visit_id)
        JOIN means mb ON mb.side = 0 AND mb.clinic_id = b.clinic_id AND mb.appointment_date = b.appointment_date
        JOIN means ma ON ma.side = 1 AND ma.clinic_id = b.clinic_id AND ma.appointment_date = b.appointment_date
        JOIN overs ob ON ob.side = 0 AND ob.clinic_id = b.clinic_id AND ob.appointment_date = b.appointment_date
        JOIN overs oa ON oa.side = 1 AND oa.clinic_id = b.clinic_id AND oa.appointment_date = b.appointment_date""",
               moves=MOVES_SQL,
               sides="""SELECT 0 AS side, * FROM visits WHERE status <> 'cancelled' UNION ALL
                   SELECT 1, v.* REPLACE (coalesce(new_start_minute, start_minute) AS start_minute) FROM visits v LEFT JOIN moves USING (visit_id) WHERE status <> 'cancelled'""".replace(
                   "v.* REPLACE (coalesce(new_start_minute, start_minute) AS start_minute)",
                   "visit_id, patient_id, doctor_id, clinic_id, room_id, specialty, appointment_date, coalesce(new_start_minute, start_minute), end_minute, "
                   "duration_minutes, status, urgency, no_show_probability"),
               ord=ORD_SQL, run=RUN_SQL, waits=WAITS_SQL, sess=SESSION_SQL,
               means="SELECT side, clinic_id, appointment_date, round_even(round(avg(wait_minutes), 9), 2) AS m FROM waits GROUP BY ALL",
               overs="SELECT side, clinic_id, appointment_date, CAST(sum(overtime) AS BIGINT) AS o FROM sess GROUP BY ALL"),
)
def moved_visit_impact(spark, folder):
    sessions = _sessions(spark, folder)
    moves = sessions.groupBy("clinic_id", "appointment_date").agg(F.min("visit_id").alias("visit_id")).select(
        "visit_id", F.lit(900).alias("new_start_minute")
    )
    return schedule.moved_visit_impact(sessions, moves, T.clinics(spark, folder), attends="attends")


# --- assembly and sinks ----------------------------------------------------------------
@register(
    "enriched_requests",
    with_views("requests", """SELECT visit_id, CAST(CASE WHEN visit_id % 2 = 0 THEN round_even(round(duration_minutes * 1.1::DOUBLE + 0.3, 9), 0) ELSE duration_minutes END AS INT) AS duration_minutes,
        CAST(CASE WHEN visit_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS no_show_probability FROM requests"""),
)
def enriched_requests(spark, folder):
    requests = T.schedule_requests(spark, folder)
    predictions = requests.filter("visit_id % 2 = 0").select(
        "visit_id",
        (F.col("duration_minutes") * F.lit(1.1) + 0.3).alias("predicted_duration_minutes"),
        F.lit(0.5).alias("no_show_probability"),
    )
    out = schedule.enrich_with_predictions(requests, predictions)
    return out.select("visit_id", "duration_minutes", "no_show_probability")


@register(
    "clinic_day_inputs",
    with_views("visits windays bridge rooms clinics", """SELECT visit_id, start_minute AS requested_start_minute, coalesce(n, 0) AS n_windows, held, capacity, open_minute, close_minute
        FROM visits LEFT JOIN (SELECT doctor_id, appointment_date, count(*) AS n FROM windays GROUP BY ALL) USING (doctor_id, appointment_date)
        LEFT JOIN (SELECT doctor_id, string_agg(DISTINCT specialty, ',' ORDER BY specialty) AS held FROM bridge GROUP BY 1) USING (doctor_id)
        LEFT JOIN (SELECT room_id, capacity FROM rooms WHERE is_active) USING (room_id) JOIN clinics USING (clinic_id) WHERE status <> 'cancelled'"""),
)
def clinic_day_inputs(spark, folder):
    out = schedule.assemble_clinic_days(
        T.visits(spark, folder), T.availability(spark, folder), T.specialty_bridge(spark, folder),
        T.rooms(spark, folder), T.clinics(spark, folder),
    )
    return out.select(
        "visit_id", "requested_start_minute", F.coalesce(F.size("windows"), F.lit(0)).cast("long").alias("n_windows"),
        F.array_join("held_specialties", ",").alias("held"), "capacity", "open_minute", "close_minute",
    )


@register(
    "schedule_header",
    with_views("requests windays clinics", f"""SELECT {KEYS_SQL}, 'FEASIBLE' AS solver_status, true AS is_baseline,
        CAST({OBJECTIVE.format(idle=0.8)} AS DECIMAL(12, 3))::DOUBLE AS objective_value, total_delay_minutes AS total_wait_minutes, 0.8::DOUBLE AS idle_weight FROM bscore""", **BASE),
)
def schedule_header(spark, folder):
    header = sinks.schedule_header(_scores(spark, folder, 1, 4), is_baseline=True)
    read = sinks.weights_from_json(header)
    return read.select(
        *schedule.SCHEDULE, "solver_status", "is_baseline", "objective_value", "total_wait_minutes", F.col("weights")["idle"].alias("idle_weight")
    )


@register(
    "schedule_rows",
    with_views("requests", f"""SELECT {KEYS_SQL}, visit_id, doctor_id,
          lpad(CAST(start_minute // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_minute % 60 AS VARCHAR), 2, '0') AS assigned_start,
          lpad(CAST(end_minute // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(end_minute % 60 AS VARCHAR), 2, '0') AS assigned_end,
          greatest(start_minute - requested_start_minute, 0) AS wait_minutes
        FROM base JOIN (SELECT visit_id, requested_start_minute FROM requests) USING (visit_id)""", base=BASE["base"]),
)
def schedule_rows(spark, folder):
    entries, requests, _, _ = _schedule(spark, folder, 1, 4)
    return sinks.schedule_rows(entries, requests)
