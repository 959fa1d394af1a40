"""Audits: row rules, keys, overlaps, booking verdicts and the structure gate."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, functions as F

from wardflow.contract import STATUSES, URGENCIES
from wardflow.functions import scalar as X
from wardflow.operators import demand, history, intervals
from wardflow.operators.running import spearman
from wardflow.session import concurrently

# Limits of the row rules.
EARLIEST_START, LATEST_END = 6 * 60, 22 * 60
MAX_DEFAULT_DURATION = 480
MIN_TRAINING_ROWS, MIN_STRUCTURE_ROWS = 2000, 3000

VISIT_RULES = {
    "end_after_start": "end_minute > start_minute",
    "positive_duration": "duration_minutes > 0",
    "within_outer_hours": f"start_minute >= {EARLIEST_START} AND end_minute <= {LATEST_END}",
    "known_status": "status IN ({})".format(", ".join(f"'{s}'" for s in STATUSES)),
    "known_urgency": "urgency IN ({})".format(", ".join(f"'{u}'" for u in URGENCIES)),
}
BOOKING_RULES = {"booked_before_start": "booked_at <= appointment_date"}
CLINIC_RULES = {"closes_after_opens": "close_minute > open_minute"}
ROOM_RULES = {"positive_capacity": "capacity > 0"}
SPECIALTY_RULES = {"sane_default_duration": f"default_duration_minutes BETWEEN 1 AND {MAX_DEFAULT_DURATION}"}
WINDOW_RULES = {
    "end_after_start": "end_minute > start_minute",
    "effective_range": "effective_to IS NULL OR effective_to >= effective_from",
    "weekday_domain": "weekday BETWEEN 1 AND 7",
}
CELL_RULES = {
    "counts_not_negative": "scheduled_count >= 0 AND completed_count >= 0 AND cancelled_count >= 0 AND no_show_count >= 0",
    "minutes_not_negative": "booked_minutes >= 0",
}
FORECAST_RULES = {"hour_domain": "hour_of_day BETWEEN 0 AND 23", "demand_not_negative": "predicted_demand >= 0"}


def row_checks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Violations per rule in one pass; a NULL result passes, as a CHECK does."""
    counted = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return counted.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
        )
    )


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    failed = F.filter(
        F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull()
    )
    return df.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (a NULL key is allowed)."""
    parents = parent.select(F.col(parent_key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(parents, key, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def several_primaries(bridge: DataFrame) -> DataFrame:
    return (
        bridge.filter("is_primary").groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n_primary")).filter("n_primary > 1")
    )


def outside_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Values outside the domain with their frequency."""
    return df.filter(~F.col(column).isin(*domain)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def enough_rows(summary: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    return summary.select("resolved_rows", F.lit(minimum).alias("minimum"), (F.col("resolved_rows") >= minimum).alias("passed"))


# --- booking verdicts -------------------------------------------------------------
def booking_verdicts(
    requests: DataFrame,
    visits: DataFrame,
    *,
    doctors: DataFrame,
    patients: DataFrame,
    clinics: DataFrame,
    rooms: DataFrame,
    bridge: DataFrame,
    availability: DataFrame,
    specialties: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """First failing booking rule of every request, or ``ok``.

    ``requests``: request_id, doctor_id, patient_id, specialty, appointment_date,
    start_minute, duration_minutes (NULL = specialty default), room_id (NULL = none).
    Occupancy arrives as minute profiles of the doctor-day and the room-day.
    """
    live = visits.filter(X.occupies())
    d = doctors.select("doctor_id", F.col("clinic_id").alias("_clinic"), F.col("is_active").alias("_doctor_active"))
    p = patients.select("patient_id", F.lit(True).alias("_patient"))
    c = clinics.select(F.col("clinic_id").alias("_clinic"), F.col("open_minute").alias("_open"), F.col("close_minute").alias("_close"))
    r = rooms.select("room_id", F.col("capacity").alias("_capacity"))
    b = bridge.select("doctor_id", "specialty", F.lit(True).alias("_holds")).distinct()
    s = specialties.select("specialty", F.col("default_duration_minutes").alias("_default"))
    day = "appointment_date"
    rows = (
        requests.join(d, "doctor_id", "left")
        .join(p, "patient_id", "left")
        .join(c, "_clinic", "left")
        .join(r, "room_id", "left")
        .join(b, ["doctor_id", "specialty"], "left")
        .join(s, "specialty", "left")
    )
    rows = rows.withColumn("_length", F.coalesce("duration_minutes", "_default")).withColumn(
        "_end", F.col("start_minute") + F.col("_length")
    )
    has_room = F.col("room_id").isNotNull()
    rows = intervals.with_day_windows(rows, availability)
    before_occupancy = (
        F.when(F.col(day) < F.lit(as_of), "past_date")
        .when(F.col("_doctor_active").isNull(), "unknown_doctor")
        .when(F.col("_length").isNull(), "unknown_specialty")
        .when(F.col("_length") <= 0, "duration_not_positive")
        .when(F.col("_end") >= X.MINUTES_PER_DAY, "past_midnight")
        .when(~F.col("_doctor_active"), "inactive_doctor")
        .when(F.col("_patient").isNull(), "unknown_patient")
        .when(F.col("_open").isNull(), "unknown_clinic")
        .when((F.col("start_minute") < F.col("_open")) | (F.col("_end") > F.col("_close")), "outside_clinic_hours")
        .when(F.col("_holds").isNull(), "specialty_mismatch")
        .when(~intervals.inside_one_window("windows", "start_minute", "_end"), "doctor_unavailable")
        .when(has_room & F.col("_capacity").isNull(), "unknown_room")
    )
    rows = rows.select(*requests.columns, "_end", "_capacity", before_occupancy.alias("_refused"))
    # A profile becomes a number for the rows that need it as soon as it is there: no array goes through the next shuffle.
    for name, frame, resource in (("_in_room", live.filter(F.col("room_id").isNotNull()), "room_id"), ("_with_doctor", live, "doctor_id")):
        profile = intervals.day_profile(frame, [resource, day])
        counted = F.when(F.col("_refused").isNull(), intervals.overlap_count("profile", "start_minute", "_end"))
        rows = rows.join(profile, [resource, day], "left").withColumn(name, counted).drop("profile")
        if name == "_in_room":
            rows = rows.withColumn("_refused", F.when(has_room & (F.col(name) >= F.col("_capacity")), "room_full").otherwise(F.col("_refused")))
    verdict = F.coalesce("_refused", F.when(F.col("_with_doctor") > 0, "slot_taken").otherwise("ok"))
    return rows.select(*requests.columns, verdict.alias("verdict"))


def schedule_request_problems(requests: DataFrame, availability: DataFrame, bridge: DataFrame) -> DataFrame:
    """Problems that make a clinic-day unschedulable, one row per problem."""
    held = bridge.select("doctor_id", "specialty").distinct()
    holds = held.withColumn("_holds", F.lit(True))
    any_held = held.select("doctor_id").distinct().withColumn("_any", F.lit(True))
    rows = (
        intervals.with_day_windows(requests, availability)
        .join(holds, ["doctor_id", "specialty"], "left")
        .join(any_held, "doctor_id", "left")
    )
    no_window = F.coalesce(F.size("windows"), F.lit(0)) <= 0
    fits = F.coalesce(
        F.exists("windows", lambda w: w["end_minute"] - w["start_minute"] >= F.col("duration_minutes")), F.lit(False)
    )
    found = F.array(
        F.when(no_window, F.lit("no_availability")),
        F.when(~no_window & F.col("_any").isNotNull() & F.col("_holds").isNull(), F.lit("specialty_not_held")),
        F.when(~no_window & ~fits, F.lit("no_window_long_enough")),
    )
    return rows.select(
        *requests.columns, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")
    )


def overbooking_audit(entries: DataFrame, *, max_per_slot: int = 2, max_expected: float = 1.0) -> DataFrame:
    """Shared slots with their size, expected attendance and verdicts."""
    shared = (
        entries.groupBy("schedule_id", "doctor_id", "appointment_date", "start_minute")
        .agg(F.count(F.lit(1)).alias("members"), F.sum(1.0 - F.col("no_show_probability")).alias("expected_attendance"))
        .filter("members > 1")
    )
    return shared.withColumn("too_many", F.col("members") > max_per_slot).withColumn(
        "too_crowded", F.col("expected_attendance") > F.lit(max_expected) + 1e-9
    )


def refusal_reasons(entries: DataFrame, max_slots: int | None = None) -> DataFrame:
    """Per schedule: shared slots, and why the plan cannot be written as visits."""
    slots = entries.groupBy("schedule_id", "doctor_id", "appointment_date", "start_minute").agg(
        F.count(F.lit(1)).alias("members")
    )
    per = slots.groupBy("schedule_id").agg(F.count_if(F.col("members") > 1).alias("shared_slots"))
    text = F.format_string("shared_slots:%d", "shared_slots")
    out = per.withColumn("reason", F.when(F.col("shared_slots") > 0, text))
    if max_slots is not None:
        out = out.withColumn("over_daily_cap", F.col("shared_slots") > max_slots)
    return out


# --- structure gate -----------------------------------------------------------------
GATE = {
    "lead_rho": 0.05,
    "lead_ratio": 1.5,
    "trend_rho": 0.70,
    "weekend_share": 0.6,
    "evening_specialty": "dermatology",
    "evening_hour": 15,
    "morning_specialty": "general-practice",
    "morning_hour": 12,
    "duration_spread": 10.0,
    "rate_low": 0.08,
    "rate_high": 0.35,
    "min_rows": MIN_STRUCTURE_ROWS,
    "persistence_rho": 0.10,
    "persistence_patients": 30,
    # |t| limits standing for p < 0.01 and p < 0.05
    "t_01": 2.576,
    "t_05": 1.960,
}


def _t(rho: float | None, n: int | None) -> float | None:
    return None if rho is None else rho * math.sqrt(max(n - 2, 0) / max(1.0 - rho * rho, 1e-12))


def _mean_of_groups(rows: Iterable[tuple]) -> float | None:
    """Mean of the second members, those that are there."""
    values = [v for _, v in rows if v is not None]
    return sum(values) / len(values) if values else None


def _average_ranks(weights: dict) -> dict:
    """Rank of each value, ties (of a weight) sharing the mean of their positions."""
    ranks, before = {}, 0
    for value in sorted(weights):
        ranks[value] = before + (weights[value] + 1) / 2
        before += weights[value]
    return ranks


def _rank_correlation(pairs: list[tuple]) -> tuple[float | None, int]:
    """Spearman's rho of weighted (x, y, weight) rows from a small domain, and the weight."""
    totals: tuple[dict, dict] = ({}, {})
    for *pair, w in pairs:
        for side, value in zip(totals, pair):
            side[value] = side.get(value, 0) + w
    rx, ry = (_average_ranks(side) for side in totals)
    n = sum(w for *_, w in pairs)
    mean = (n + 1) / 2
    cov = sum(w * (rx[x] - mean) * (ry[y] - mean) for x, y, w in pairs)
    var = sum(w * (rx[x] - mean) ** 2 for x, _, w in pairs) * sum(w * (ry[y] - mean) ** 2 for _, y, w in pairs)
    return (cov / math.sqrt(var) if var > 0 else None), n


def _past_cells(past: DataFrame) -> list[Row]:
    """Outcomes by lead time, by weekday and by hour: one aggregate, rows bounded by the calendar."""
    sets = [["lead_days"], ["weekday"], ["hour"]]
    cells = past.groupingSets(sets, "lead_days", "weekday", "hour").agg(
        F.grouping_id().alias("of"), F.count(F.lit(1)).alias("n"), F.sum("no_show").cast("long").alias("k"))
    return cells.collect()


def _calendar_cells(every: DataFrame) -> list[Row]:
    """Visits by date, by specialty and hour, by specialty and first visit: one aggregate, rows bounded by calendar and catalogue."""
    sets = [["appointment_date"], ["specialty", "hour"], ["specialty", "is_new_patient"]]
    cells = every.groupingSets(sets, "appointment_date", "specialty", "hour", "is_new_patient").agg(
        F.grouping_id().alias("of"), F.count_if(X.occupies()).alias("busy"), F.count(F.lit(1)).alias("n"), F.sum("duration_minutes").alias("minutes"))
    return cells.collect()


def structure_gate(past: DataFrame, every: DataFrame, thresholds: dict | None = None,
                   order: Sequence[str] = ("visit_id",)) -> DataFrame:
    """14 checks that the data have the structure the models rely on.

    ``past``: resolved visits with lead_days, weekday, hour, no_show; ``every``:
    all visits with hour. Each is read by one aggregate over grouping sets; the
    two and the rank correlation of the patients' halves run side by side. What
    comes back is bounded by the calendar, the clock and the catalogue.
    """
    g = {**GATE, **(thresholds or {})}
    halves = history.split_half_rates(past, label="no_show", order=order)
    cells, calendar, persist = concurrently(past.sparkSession, [
        lambda: _past_cells(past), lambda: _calendar_cells(every), lambda: spearman(halves, "early_rate", "late_rate").first()])

    # the bits of a grouping id say which columns are aggregated away
    leads = [(r["lead_days"], r["n"], r["k"] or 0) for r in cells if r["of"] == 0b011]
    overall, positives = sum(n for _, n, _ in leads), sum(k for _, _, k in leads)
    known = [(d, n, k) for d, n, k in leads if d is not None]
    lead, lead_n = _rank_correlation([(d, y, w) for d, n, k in known for y, w in ((0, n - k), (1, k)) if w])
    sums: dict[int, list[int]] = {}
    for d, n, k in known:
        bucket = next((i for i, upper in enumerate(demand.LEAD_EDGES[1:]) if d <= upper), None)
        if bucket is not None:
            total = sums.setdefault(bucket, [0, 0])
            total[0], total[1] = total[0] + n, total[1] + k
    buckets = [(b, sums[b][1] / sums[b][0]) for b in sorted(sums)]
    ratio = buckets[-1][1] / buckets[0][1] if buckets and buckets[0][1] > 0 else math.inf
    trend, _ = _rank_correlation([(b, mean, 1) for b, mean in buckets])
    by_day = {r["weekday"]: (r["k"] or 0) / r["n"] for r in cells if r["of"] == 0b101}
    by_hour = {r["hour"]: (r["k"] or 0) / r["n"] for r in cells if r["of"] == 0b110}
    mean_at = lambda rates, keys: _mean_of_groups((i, rates.get(i)) for i in keys)
    monday, friday, midweek = by_day.get(0), by_day.get(4), mean_at(by_day, (1, 2, 3))
    edges, middle = mean_at(by_hour, (8, 17, 18)), mean_at(by_hour, (11, 12, 13))

    loads: dict[int, list[int]] = {}
    for r in calendar:
        if r["of"] == 0b0111 and r["busy"] and r["appointment_date"] is not None:
            loads.setdefault(r["appointment_date"].weekday(), []).append(r["busy"])
    means = {day: sum(v) / len(v) for day, v in loads.items()}
    working, weekend = (_mean_of_groups((d, m) for d, m in means.items() if (d < 5) == w) for w in (True, False))
    busiest = min((d for d in means if d < 5), key=lambda d: (-means[d], d), default=None)
    hours: dict[str, list[tuple]] = {}
    for r in calendar:
        if r["of"] == 0b1001 and r["busy"]:
            hours.setdefault(r["specialty"], []).append((-r["busy"], r["hour"]))
    peak = lambda specialty: min(hours[specialty])[1] if specialty in hours else None
    evening, morning = peak(g["evening_specialty"]), peak(g["morning_specialty"])
    lengths: dict[str, dict] = {}
    for r in calendar:
        if r["of"] == 0b1010:
            lengths.setdefault(r["specialty"], {})[r["is_new_patient"]] = (r["minutes"] or 0, r["n"])
    of_specialty = [sum(m for m, _ in v.values()) / sum(n for _, n in v.values()) for v in lengths.values()]
    extra = [v[True][0] / v[True][1] - v[False][0] / v[False][1] for v in lengths.values() if True in v and False in v]
    rate = positives / overall if overall else None
    minus = lambda x, y: None if x is None or y is None else x - y
    both = [x for x in (monday, friday) if x is not None]
    spread = max(of_specialty) - min(of_specialty) if of_specialty else None
    rho, patients = persist["rho"], persist["n"]

    above = lambda x, limit: x is not None and limit is not None and x > limit
    least = lambda x, limit: x is not None and x >= limit
    checks = [
        ("lead_time_rho", above(lead, g["lead_rho"]) and above(_t(lead, lead_n), g["t_01"]), lead),
        ("lead_time_ratio", ratio >= g["lead_ratio"], ratio),
        ("lead_buckets_trend", least(trend, g["trend_rho"]), trend),
        ("monday_friday_worse", above(monday, midweek) and above(friday, midweek), minus(min(both, default=None), midweek)),
        ("day_edges_worse", above(edges, middle), minus(edges, middle)),
        ("patients_persist", least(patients, g["persistence_patients"]) and above(rho, g["persistence_rho"]) and above(_t(rho, patients), g["t_05"]), rho),
        ("weekend_quieter", working is not None and weekend is not None and weekend < g["weekend_share"] * working,
         weekend / working if working and weekend is not None else None),
        ("monday_busiest", busiest == 0, busiest),
        ("evening_peak", least(evening, g["evening_hour"]), evening),
        ("morning_peak", morning is not None and morning <= g["morning_hour"], morning),
        ("duration_varies", least(spread, g["duration_spread"]), spread),
        ("new_patients_longer", above(min(extra, default=None), 0), min(extra, default=None)),
        ("plausible_rate", rate is not None and g["rate_low"] <= rate <= g["rate_high"], rate),
        ("enough_rows", overall >= g["min_rows"], overall),
    ]
    rows = [(name, bool(passed), None if value is None else float(value)) for name, passed, value in checks]
    return past.sparkSession.createDataFrame(rows, "name string, passed boolean, value double")
