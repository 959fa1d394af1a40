"""Registered queries: integrity audits and the structure gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardflow.operators import operations as ops, quality
from wardflow.plans.catalog import register, with_views
from wardflow.session import stored
from wardflow.sources import tables as T


def rules_sql(view: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT ({rule})) AS violations FROM {view}" for name, rule in rules.items()
    )


@register("visit_rules", with_views("visits", rules_sql("visits", quality.VISIT_RULES)))
def visit_rules(spark, folder):
    return quality.row_checks(T.visits(spark, folder), quality.VISIT_RULES)


@register("booking_rules", with_views("bookings", rules_sql("bookings", quality.BOOKING_RULES)))
def booking_rules(spark, folder):
    return quality.row_checks(T.bookings(spark, folder), quality.BOOKING_RULES)


@register(
    "dimension_rules",
    with_views("clinics rooms specialties availability", " UNION ALL ".join([
        rules_sql("clinics", quality.CLINIC_RULES), rules_sql("rooms", quality.ROOM_RULES), rules_sql("specialties", quality.SPECIALTY_RULES),
        rules_sql("availability", quality.WINDOW_RULES)])),
)
def dimension_rules(spark, folder):
    return (
        quality.row_checks(T.clinics(spark, folder), quality.CLINIC_RULES)
        .unionByName(quality.row_checks(T.rooms(spark, folder), quality.ROOM_RULES))
        .unionByName(quality.row_checks(T.specialties(spark, folder), quality.SPECIALTY_RULES))
        .unionByName(quality.row_checks(T.availability(spark, folder), quality.WINDOW_RULES))
    )


@register("cell_rules", with_views("cells", rules_sql("cells", quality.CELL_RULES)))
def cell_rules(spark, folder):
    return quality.row_checks(ops.utilization_cells(T.visits(spark, folder)), quality.CELL_RULES)


@register(
    "visit_violations",
    with_views("visits", """SELECT visit_id, concat_ws(',', CASE WHEN NOT (start_minute >= 360 AND end_minute <= 1320) THEN 'within_outer_hours' END) AS failed
        FROM visits WHERE NOT (start_minute >= 360 AND end_minute <= 1320)"""),
)
def visit_violations(spark, folder):
    found = quality.violations(T.visits(spark, folder), quality.VISIT_RULES)
    return found.select("visit_id", F.array_join("failed_rules", ",").alias("failed"))


@register(
    "orphan_counts",
    with_views("visits doctors rooms", """
        SELECT 'visit_doctor' AS fk, count(*) AS orphans FROM visits WHERE doctor_id NOT IN (SELECT doctor_id FROM doctors WHERE is_active)
        UNION ALL SELECT 'visit_room', count(*) FROM visits WHERE room_id IS NOT NULL AND room_id NOT IN (SELECT room_id FROM rooms WHERE is_active)
        UNION ALL SELECT 'lineitem_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'visit_patient', count(*) FROM visits WHERE patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""),
)
def orphan_counts(spark, folder):
    visits = T.visits(spark, folder)
    checks = {
        "visit_doctor": (visits, "doctor_id", T.doctors(spark, folder).filter("is_active"), "doctor_id"),
        "visit_room": (visits, "room_id", T.rooms(spark, folder).filter("is_active"), "room_id"),
        "lineitem_order": (T.table(spark, folder, "lineitem"), "l_orderkey", T.table(spark, folder, "orders"), "o_orderkey"),
        "order_customer": (T.table(spark, folder, "orders"), "o_custkey", T.table(spark, folder, "customer"), "c_custkey"),
        "visit_patient": (visits, "patient_id", T.table(spark, folder, "customer").filter("c_acctbal > 0"), "c_custkey"),
    }
    out = None
    for name, (child, key, parent, parent_key) in checks.items():
        one = quality.orphans(child.select(key), key, parent, parent_key).agg(F.count(F.lit(1)).alias("orphans"))
        one = one.select(F.lit(name).alias("fk"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return quality.duplicates(T.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "several_primaries",
    with_views("bridge", "SELECT doctor_id, count(*) AS n_primary FROM bridge WHERE is_primary GROUP BY 1 HAVING count(*) > 1"),
)
def several_primaries(spark, folder):
    return quality.several_primaries(T.specialty_bridge(spark, folder))


@register(
    "enough_training_rows",
    with_views("bookings", """SELECT count(*) FILTER (WHERE status IN ('completed', 'no_show')) AS resolved_rows, 2000 AS minimum,
        count(*) FILTER (WHERE status IN ('completed', 'no_show')) >= 2000 AS passed FROM bookings"""),
)
def enough_training_rows(spark, folder):
    return quality.enough_rows(T.training_summary(T.bookings(spark, folder)))


RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
GATE_VIEWS = {
    "lead": f"SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {RANK.format(c='lead_days')} AS rx, {RANK.format(c='no_show')} AS ry FROM past)",
    "buckets": """SELECT b, avg(no_show) AS mean FROM (SELECT no_show, CASE WHEN lead_days <= 0 THEN 0 WHEN lead_days <= 1 THEN 1 WHEN lead_days <= 3 THEN 2
        WHEN lead_days <= 7 THEN 3 WHEN lead_days <= 14 THEN 4 WHEN lead_days <= 21 THEN 5 WHEN lead_days <= 30 THEN 6 WHEN lead_days <= 45 THEN 7
        WHEN lead_days <= 1000 THEN 8 END AS b FROM past) WHERE b IS NOT NULL GROUP BY 1""",
    "trend": f"SELECT corr(rx, ry) AS rho FROM (SELECT {RANK.format(c='b')} AS rx, {RANK.format(c='mean')} AS ry FROM buckets)",
    "ends": "SELECT arg_max(mean, b) / arg_min(mean, b) AS ratio FROM buckets",
    "dayrate": """SELECT max(r) FILTER (WHERE weekday = 0) AS mon, max(r) FILTER (WHERE weekday = 4) AS fri, avg(r) FILTER (WHERE weekday IN (1, 2, 3)) AS mid
        FROM (SELECT weekday, avg(no_show) AS r FROM past GROUP BY 1)""",
    "hourrate": """SELECT avg(r) FILTER (WHERE hour IN (8, 17, 18)) AS edges, avg(r) FILTER (WHERE hour IN (11, 12, 13)) AS middle
        FROM (SELECT hour, avg(no_show) AS r FROM past GROUP BY 1)""",
    "halves": """SELECT avg(no_show) FILTER (WHERE pos < n // 2) AS early, avg(no_show) FILTER (WHERE pos >= n // 2) AS late
        FROM (SELECT patient_id, no_show, count(*) OVER (PARTITION BY patient_id) AS n,
          row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date, start_minute, no_show) - 1 AS pos FROM past) WHERE n >= 6 GROUP BY patient_id""",
    "persist": f"SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {RANK.format(c='early')} AS rx, {RANK.format(c='late')} AS ry FROM halves)",
    "loads": """SELECT isodow(appointment_date) - 1 AS wd, avg(n) AS m FROM (SELECT appointment_date, count(*) AS n FROM bookings WHERE status <> 'cancelled' GROUP BY 1) GROUP BY 1""",
    "split": """SELECT avg(m) FILTER (WHERE wd < 5) AS wk, avg(m) FILTER (WHERE wd > 4) AS we,
        (SELECT wd FROM loads WHERE wd < 5 ORDER BY m DESC, wd LIMIT 1) AS busiest FROM loads""",
    "peaks": """SELECT specialty, arg_min(hour, o) AS peak FROM (SELECT specialty, hour, row_number() OVER (PARTITION BY specialty ORDER BY n DESC, hour) AS o
        FROM (SELECT specialty, start_minute // 60 AS hour, count(*) AS n FROM bookings WHERE status <> 'cancelled' GROUP BY ALL)) GROUP BY 1""",
    "lengths": """SELECT max(m) - min(m) AS spread, min(extra) AS extra FROM (SELECT specialty, avg(duration_minutes) AS m,
        avg(duration_minutes) FILTER (WHERE is_new_patient) - avg(duration_minutes) FILTER (WHERE NOT is_new_patient) AS extra FROM bookings GROUP BY 1)""",
}
T_SQL = "rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-12))"
GATE_SQL = f"""
    SELECT 'lead_time_rho' AS name, rho > 0.05 AND {T_SQL} > 2.576 AS passed, rho AS value FROM lead
    UNION ALL SELECT 'lead_time_ratio', ratio >= 1.5, ratio FROM ends
    UNION ALL SELECT 'lead_buckets_trend', rho >= 0.7, rho FROM trend
    UNION ALL SELECT 'monday_friday_worse', mon > mid AND fri > mid, least(mon, fri) - mid FROM dayrate
    UNION ALL SELECT 'day_edges_worse', edges > middle, edges - middle FROM hourrate
    UNION ALL SELECT 'patients_persist', n >= 30 AND rho > 0.1 AND {T_SQL} > 1.96, rho FROM persist
    UNION ALL SELECT 'weekend_quieter', we < 0.6 * wk, we / wk FROM split
    UNION ALL SELECT 'monday_busiest', busiest = 0, busiest FROM split
    UNION ALL SELECT 'evening_peak', peak >= 15, peak FROM peaks WHERE specialty = 'PROMO'
    UNION ALL SELECT 'morning_peak', peak <= 12, peak FROM peaks WHERE specialty = 'LARGE'
    UNION ALL SELECT 'duration_varies', spread >= 10, spread FROM lengths
    UNION ALL SELECT 'new_patients_longer', extra > 0, extra FROM lengths
    UNION ALL SELECT 'plausible_rate', avg(no_show) BETWEEN 0.08 AND 0.35, avg(no_show) FROM past
    UNION ALL SELECT 'enough_rows', count(*) >= 3000, count(*) FROM past"""


@register(
    "structure_gate",
    with_views("past", f"SELECT name, passed, round(CAST(value AS DOUBLE), 7) AS value FROM ({GATE_SQL})", **GATE_VIEWS),
)
def structure_gate(spark, folder):
    bookings = stored(T.bookings(spark, folder))  # read by three aggregates and, for the days that split a history, once more
    past, every = T.past_and_all(bookings, dt.date(2001, 1, 1))
    gate = quality.structure_gate(
        past, every, {"evening_specialty": "PROMO", "morning_specialty": "LARGE"}, order=("start_minute", "no_show")
    )
    return gate.withColumn("value", F.round("value", 7))
