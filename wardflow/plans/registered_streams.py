"""Registered queries: streams run to their end, the tables they keep, and tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import intervals, schedule
from wardflow.plans.catalog import register, with_views
from wardflow.plans.registered_operations import CHANGES_SQL, DELTA_SQL, changes_from_visits
from wardflow.plans.registered_schedule import BASE, OBJECTIVE
from wardflow.session import shared_folder
from wardflow.sources import sinks, tables as T
from wardflow.streaming import history, maintain


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "streamed_cells",
    with_views("visits", "SELECT doctor_id, appointment_date, " + ", ".join(
        f"greatest({c}, 0) AS {c}" for c in maintain.MEASURES) + f" FROM ({DELTA_SQL})", changes=CHANGES_SQL),
)
def streamed_cells(spark, folder):
    """The summary kept by a file stream: three sets of change files, each run to its end with the same checkpoint."""
    place = _place(spark, "cells")
    changes = changes_from_visits(T.visits(spark, folder).withColumn("part", F.col("visit_id") % 3))
    for part in range(3):
        changes_from_visits(T.visits(spark, folder).filter(F.col("visit_id") % 3 == part)).write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema(changes.schema).parquet(f"{place}/feed")
        maintain.maintain_utilization(feed, f"{place}/deltas", f"{place}/mark").awaitTermination()
    return maintain.read_maintained(spark, f"{place}/deltas")


# Five days arrive together; some visits of them come with the days after the next five, which is past the watermark.
ARRIVAL = "CAST(floor(({day} - 1) / 5) AS INT) + CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END"


@register(
    "streamed_hourly_demand",
    f"""WITH feed AS (SELECT ts, 's' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) AS specialty, event_type,
            CAST(floor((day(ts) - 1) / 5) AS INT) AS due, {ARRIVAL.format(day='day(ts)')} AS arrived FROM events),
        marks AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM feed WHERE event_type <> 'view')
        SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, specialty, count(*) AS n FROM feed, marks
        WHERE event_type <> 'view' AND arrived = due AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY ALL""",
)
def streamed_hourly_demand(spark, folder):
    """Hourly demand of a file stream in append mode: what comes after the watermark is dropped, hours still open are not given."""
    place = _place(spark, "hourly")
    rows = T.visit_feed(spark, folder, keep=("event_id",)).withColumn("arrived", F.expr(ARRIVAL.format(day="day(ts)")))
    days = rows.agg(F.max("arrived")).first()[0]
    for part in range((days or 0) + 1):
        rows.filter(F.col("arrived") == part).drop("arrived", "event_id").write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema(rows.drop("arrived", "event_id").schema).parquet(f"{place}/feed")
        query = maintain.demand_stream(feed).writeStream.outputMode("append").format("parquet").option("path", f"{place}/hours")
        query.option("checkpointLocation", f"{place}/mark").trigger(availableNow=True).start().awaitTermination()
    hours = spark.read.parquet(f"{place}/hours")
    return hours.select(F.unix_timestamp("hour_start").alias("hour_start"), "specialty", "n")


HISTORY_SQL = """SELECT c.visit_id, count(o.visit_id) AS prior_n, CAST(coalesce(sum(CAST(o.status = 'no_show' AS INT)), 0) AS BIGINT) AS prior_k,
      CAST(date_diff('day', max(o.appointment_date), c.booked_at) AS INT) AS days_since_last
    FROM (SELECT *, appointment_date - 2 AS booked_at FROM visits WHERE status = 'scheduled') c
    LEFT JOIN (SELECT * FROM visits WHERE status IN ('completed', 'no_show') AND visit_id % 11 <> 0) o
      ON o.patient_id = c.patient_id AND o.appointment_date < c.booked_at GROUP BY c.visit_id, c.booked_at"""


def outcome_changes(visits, batch: int):
    """First all visits, some of them still without their outcome; then the late outcomes; then some are deleted."""
    side = lambda status: F.struct("patient_id", "appointment_date", status.alias("status"))
    late = F.col("visit_id") % 7 == 0
    first = F.when(late, "scheduled").otherwise(F.col("status"))
    none = F.lit(None).cast("struct<patient_id: bigint, appointment_date: date, status: string>")
    if batch == 0:
        return visits.select(F.lit("INSERT").alias("op"), none.alias("old"), side(first).alias("new"))
    if batch == 1:
        return visits.filter(late).select(F.lit("UPDATE").alias("op"), side(F.lit("scheduled")).alias("old"), side(F.col("status")).alias("new"))
    return visits.filter("visit_id % 11 = 0").select(F.lit("DELETE").alias("op"), side(F.col("status")).alias("old"), none.alias("new"))


@register("maintained_history", with_views("visits", HISTORY_SQL))
def maintained_history(spark, folder):
    """History of scheduled visits from the kept table, after late outcomes and deletions; the visits are not read again for it."""
    visits, place = T.visits(spark, folder), _place(spark, "history")
    for batch in range(3):
        outcome_changes(visits, batch).write.mode("append").parquet(f"{place}/feed")
        feed = spark.readStream.schema(outcome_changes(visits, batch).schema).parquet(f"{place}/feed")
        history.maintain_history(feed, f"{place}/days", f"{place}/mark").awaitTermination()
    asked = visits.filter("status = 'scheduled'").select("visit_id", "patient_id", F.date_sub("appointment_date", 2).alias("booked_at"))
    return history.asof_maintained(asked, history.read_history(spark, f"{place}/days")).select("visit_id", "prior_n", "prior_k", "days_since_last")


@register(
    "written_schedule",
    with_views("requests windays clinics", f"""SELECT b.schedule_id, b.clinic_id, CAST(b.appointment_date AS VARCHAR) AS appointment_date, b.visit_id, b.doctor_id,
          lpad(CAST(b.start_minute // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b.start_minute % 60 AS VARCHAR), 2, '0') AS assigned_start,
          CAST({OBJECTIVE.format(idle=0.8)} AS DECIMAL(12, 3))::DOUBLE AS objective_value
        FROM base b JOIN bscore s ON s.clinic_id = b.clinic_id AND s.appointment_date = b.appointment_date
        WHERE b.appointment_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'""", **BASE),
)
def written_schedule(spark, folder):
    """A schedule written by date and read back for one week: other dates are not read."""
    place = _place(spark, "schedule")
    requests = T.schedule_requests(spark, folder)
    entries = T.schedule_entries(requests, 1, 4)
    windows = intervals.window_days(T.availability(spark, folder), *T.visit_span(spark, folder))
    scores = schedule.score_schedule(entries, requests, windows, T.clinics(spark, folder))
    sinks.write_schedule(sinks.schedule_header(scores, is_baseline=True), sinks.schedule_rows(entries, requests), place)
    week = F.col("appointment_date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-12").cast("date"))
    header, rows = (spark.read.parquet(f"{place}/{name}").filter(week) for name in ("schedule", "schedule_entry"))
    return rows.join(header.select(*schedule.SCHEDULE, "objective_value"), schedule.SCHEDULE).select(
        *schedule.SCHEDULE, "visit_id", "doctor_id", "assigned_start", "objective_value")


@register(
    "bucketed_utilization",
    with_views("visits doctors windays", """SELECT d.doctor_id, 'Dr. ' || first_name || ' ' || last_name AS doctor_name, count(*) AS n, CAST(sum(duration_minutes) AS BIGINT) AS booked_minutes
        FROM visits v JOIN doctors d USING (doctor_id) WHERE status <> 'cancelled' AND appointment_date IN (SELECT DISTINCT appointment_date FROM visits WHERE status = 'scheduled' AND visit_id % 97 = 0)
        GROUP BY ALL"""),
)
def bucketed_utilization(spark, folder):
    """Booked minutes by doctor from the fact in buckets and date partitions: the join needs no shuffle of it, other dates are pruned."""
    place, name = _place(spark, "buckets"), f"visits_{uuid.uuid4().hex}"
    visits = T.visits(spark, folder)
    sinks.write_bucketed(visits, name, f"{place}/visits", "doctor_id", 8, "appointment_date")
    sinks.write_bucketed(T.doctors(spark, folder), f"doctors_{name}", f"{place}/doctors", "doctor_id", 8)
    days = visits.filter("status = 'scheduled' AND visit_id % 97 = 0").select("appointment_date").distinct()
    fact = spark.table(name).filter(X.occupies()).join(days, "appointment_date", "left_semi")
    named = fact.join(spark.table(f"doctors_{name}"), "doctor_id")
    return named.groupBy("doctor_id", X.doctor_name().alias("doctor_name")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_minutes").alias("booked_minutes"))
