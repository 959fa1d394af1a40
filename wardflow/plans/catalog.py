"""Registry of queries and their independent SQL, plus the SQL views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL text of the projections in ``sources.tables``.
VIEWS = {
    "visits": """
        SELECT event_id AS visit_id, user_id AS patient_id, CAST(k % 16 AS BIGINT) AS doctor_id,
               CAST(k % 4 AS BIGINT) AS clinic_id,
               CASE WHEN k % 9 <> 0 THEN CAST(k % 8 AS BIGINT) END AS room_id,
               's' || CAST(k % 5 AS VARCHAR) AS specialty, CAST(ts AS DATE) AS appointment_date,
               start_minute, start_minute + duration_minutes AS end_minute, duration_minutes,
               CASE event_type WHEN 'error' THEN 'no_show' WHEN 'view' THEN 'cancelled'
                    WHEN 'signup' THEN 'scheduled' ELSE 'completed' END AS status,
               CASE k % 10 WHEN 9 THEN 'emergency' WHEN 8 THEN 'urgent' ELSE 'routine' END AS urgency,
               k / 100.0 AS no_show_probability
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
                     CAST(hour(ts) * 60 + minute(ts) AS INT) AS start_minute,
                     CAST(greatest(5, least(240, floor(value))) AS INT) AS duration_minutes
              FROM events)""",
    "bookings": """
        SELECT o_custkey AS patient_id, l_suppkey AS doctor_id, p_type AS specialty,
               CAST(l_shipdate AS DATE) AS appointment_date,
               CAST(480 + (l_partkey + l_linenumber * 7) % 44 * 15 AS INT) AS start_minute,
               CAST(l_quantity AS INT) AS duration_minutes,
               CASE l_returnflag WHEN 'R' THEN 'no_show' WHEN 'A' THEN 'completed' ELSE 'cancelled' END AS status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'urgent'
                    ELSE 'routine' END AS urgency,
               l_linenumber = 1 AS is_new_patient, CAST(o_orderdate AS DATE) AS booked_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "doctors": """
        SELECT s_suppkey AS doctor_id, split_part(s_name, '#', 1) AS first_name,
               split_part(s_name, '#', 2) AS last_name, s_suppkey % 4 AS clinic_id,
               s_suppkey % 7 <> 6 AS is_active FROM supplier""",
    "patients": """
        SELECT c_custkey AS patient_id, c_name AS last_name, c_mktsegment AS first_name,
               lower(c_name) || '@example.org' AS email FROM customer""",
    "clinics": """
        SELECT CAST(n_nationkey AS BIGINT) AS clinic_id, n_name AS name,
               420 + n_nationkey % 4 * 30 AS open_minute, 1080 + n_nationkey % 4 * 30 AS close_minute FROM nation""",
    "rooms": """
        SELECT CAST(n_nationkey AS BIGINT) AS room_id, CAST(n_nationkey % 4 AS BIGINT) AS clinic_id, n_name AS name,
               1 + n_nationkey % 3 AS capacity, n_nationkey % 6 <> 5 AS is_active FROM nation""",
    "specialties": """
        SELECT DISTINCT p_type AS specialty, 10 + length(p_type) % 4 * 5 AS default_duration_minutes FROM part""",
    "bridge": """
        SELECT DISTINCT l_suppkey AS doctor_id, p_type AS specialty, p_type IN ('ECONOMY', 'PROMO') AS is_primary
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "pattern": """
        SELECT * FROM (VALUES (1, 480, 750), (2, 480, 750), (3, 480, 750), (4, 480, 750), (5, 480, 750),
                              (1, 810, 1140), (2, 810, 1140), (3, 810, 1140), (4, 810, 1140), (5, 810, 1140),
                              (6, 540, 780)) AS t(weekday, start_minute, end_minute)""",
    "availability": """
        SELECT s_suppkey AS doctor_id, weekday, start_minute, end_minute, DATE '1995-01-01' AS effective_from,
               CASE WHEN s_suppkey % 10 = 3 THEN DATE '2024-01-20' END AS effective_to, s_suppkey % 11 <> 10 AS is_active
        FROM supplier JOIN pattern ON weekday < 6 OR s_suppkey % 3 = 0""",
    "requests": """
        SELECT visit_id, clinic_id, appointment_date, doctor_id, room_id, specialty,
               start_minute AS requested_start_minute, duration_minutes, urgency, no_show_probability
        FROM visits WHERE status <> 'cancelled'""",
    "cells": """
        SELECT doctor_id, appointment_date, count(*) FILTER (WHERE status = 'scheduled') AS scheduled_count,
               count(*) FILTER (WHERE status = 'completed') AS completed_count,
               count(*) FILTER (WHERE status = 'cancelled') AS cancelled_count,
               count(*) FILTER (WHERE status = 'no_show') AS no_show_count,
               CAST(coalesce(sum(duration_minutes) FILTER (WHERE status <> 'cancelled'), 0) AS BIGINT) AS booked_minutes
        FROM visits GROUP BY ALL""",
    "past": """
        SELECT *, CAST(start_minute // 60 AS INT) AS hour, CAST(isodow(appointment_date) - 1 AS INT) AS weekday,
               greatest(date_diff('day', booked_at, appointment_date), 0) AS lead_days,
               CAST(status = 'no_show' AS INT) AS no_show
        FROM bookings WHERE status IN ('completed', 'no_show') AND appointment_date < DATE '2001-01-01'""",
    "grid": """
        SELECT s.specialty, d.appointment_date, h.hour_of_day, coalesce(o.n, 0) AS count
        FROM (SELECT DISTINCT specialty FROM visits WHERE status <> 'cancelled') s
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(appointment_date), max(appointment_date), INTERVAL 1 DAY)) AS DATE)
                    AS appointment_date FROM visits WHERE status <> 'cancelled') d
        CROSS JOIN (SELECT CAST(unnest(generate_series(8, 18)) AS INT) AS hour_of_day) h
        LEFT JOIN (SELECT specialty, appointment_date, start_minute // 60 AS hour_of_day, count(*) AS n
                   FROM visits WHERE status <> 'cancelled' GROUP BY ALL) o
          USING (specialty, appointment_date, hour_of_day)""",
    "windays": """
        SELECT doctor_id, CAST(d.day AS DATE) AS appointment_date, start_minute, end_minute
        FROM availability JOIN (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS day) d
          ON isodow(d.day) = weekday AND effective_from <= d.day AND (effective_to IS NULL OR effective_to >= d.day)
        WHERE is_active""",
}
NEEDS = {"requests": ["visits"], "cells": ["visits"], "past": ["bookings"], "grid": ["visits"],
         "availability": ["pattern"], "windays": ["availability"]}


def with_views(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named shared views, then extra views, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, so both engines return like values."""
    out = []
    for name, kind in df.dtypes:
        if kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("decimal"):
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
