"""Operational aggregates and listings over the visit table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import intervals

CELL = ["doctor_id", "appointment_date"]
COUNTS = ["scheduled_count", "completed_count", "cancelled_count", "no_show_count"]
DEFAULT_PAGE, MAX_PAGE = 50, 200


# --- summary cells and dashboards -----------------------------------------------
def utilization_cells(visits: DataFrame) -> DataFrame:
    """Counts by status and booked minutes per (doctor, date)."""
    return visits.groupBy(*CELL).agg(
        F.count_if(F.col("status") == "scheduled").alias("scheduled_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_count"),
        F.count_if(F.col("status") == "no_show").alias("no_show_count"),
        F.coalesce(F.sum(F.when(X.occupies(), F.col("duration_minutes"))), F.lit(0)).alias("booked_minutes"),
    )


def _between(start, end, day: str = "appointment_date") -> Column:
    return F.col(day).between(F.lit(start), F.lit(end))


def headline_metrics(visits: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Four cards against the window of equal length just before; one scan."""
    span = (end - start).days + 1
    prev_start, prev_end = start - dt.timedelta(days=span), start - dt.timedelta(days=1)
    now, prev = _between(start, end), _between(prev_start, prev_end)

    def counts(window: Column, tag: str) -> list[Column]:
        return [
            F.count_if(window).alias(f"{tag}_total"),
            F.count_if(window & (F.col("status") == "no_show")).alias(f"{tag}_missed"),
            F.count_if(window & (F.col("status") == "cancelled")).alias(f"{tag}_cancelled"),
            F.coalesce(F.sum(F.when(window, F.col("duration_minutes"))), F.lit(0)).alias(f"{tag}_minutes"),
        ]

    one = visits.filter(_between(prev_start, end)).agg(*counts(now, "c"), *counts(prev, "p"))

    def rate(tag: str) -> Column:
        shown_up = F.greatest(F.col(f"{tag}_total") - F.col(f"{tag}_cancelled"), F.lit(1))
        return X.half_even(F.col(f"{tag}_missed") / shown_up * 100, 1, exact=True)

    one = one.withColumn("c_rate", rate("c")).withColumn("p_rate", rate("p"))

    def card(label: str, value: Column, unit, change: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            value.cast("double").alias("value"),
            F.lit(unit).cast("string").alias("unit"),
            change.alias("change_pct"),
        )

    cards = F.array(
        card("Appointments", F.col("c_total"), None, X.percent_change("c_total", "p_total")),
        card("No-show rate", F.col("c_rate"), "%", X.percent_change("c_rate", "p_rate")),
        card("Cancellations", F.col("c_cancelled"), None, X.percent_change("c_cancelled", "p_cancelled")),
        card("Booked hours", X.half_even(F.col("c_minutes") / 60, 1, exact=True), "h", X.percent_change("c_minutes", "p_minutes")),
    )
    return one.select(F.inline(cards))


def demand_by_hour(visits: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    live = visits.filter(X.occupies())
    if start is not None:
        live = live.filter(F.col("appointment_date") >= F.lit(start))
    if end is not None:
        live = live.filter(F.col("appointment_date") <= F.lit(end))
    return live.groupBy(X.hour_of().alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def utilization_by_doctor(doctors: DataFrame, cells: DataFrame, availability: DataFrame, start: dt.date,
                          end: dt.date) -> DataFrame:
    """Every active doctor, idle ones with zeros."""
    totals = cells.filter(_between(start, end)).groupBy("doctor_id").agg(
        *[F.sum(c).alias(c) for c in ["booked_minutes", *COUNTS]]
    )
    available = intervals.available_minutes(availability, start, end).groupBy("doctor_id").agg(
        F.sum("available_minutes").alias("available_minutes")
    )
    joined = doctors.filter("is_active").join(totals, "doctor_id", "left").join(available, "doctor_id", "left")
    for c in ["booked_minutes", "available_minutes", *COUNTS]:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return joined.select(
        "doctor_id",
        X.doctor_name().alias("doctor_name"),
        "booked_minutes",
        "available_minutes",
        X.half_even(X.ratio("booked_minutes", "available_minutes") * 100, 1, exact=True).alias("utilization_pct"),
        *COUNTS,
    )


def utilization_trend(doctors: DataFrame, cells: DataFrame, availability: DataFrame, start: dt.date, end: dt.date,
                      doctor_id: int | None = None, exact: bool = False) -> DataFrame:
    """Booked and available minutes per date.

    By default availability is the truncated daily average over the span of the
    dates found, the same on each date; ``exact`` uses the minutes of each date.
    """
    cells = cells.filter(_between(start, end))
    if doctor_id is not None:
        cells = cells.filter(F.col("doctor_id") == doctor_id)
        rota = availability.filter(F.col("doctor_id") == doctor_id)
    else:
        rota = availability.join(doctors.filter("is_active").select("doctor_id"), "doctor_id", "left_semi")
    daily = cells.groupBy("appointment_date").agg(F.sum("booked_minutes").alias("booked_minutes"))
    bounds = cells.agg(F.min("appointment_date").alias("lo"), F.max("appointment_date").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    minutes = intervals.available_minutes(rota, lo, hi)
    if exact:
        per_day = minutes.groupBy("appointment_date").agg(F.sum("available_minutes").alias("available_minutes"))
        joined = daily.join(per_day, "appointment_date", "left")
    else:
        total = minutes.agg(F.coalesce(F.sum("available_minutes"), F.lit(0)).alias("t"))
        joined = (
            daily.withColumn("_total", total.scalar())
            .withColumn("_span", F.datediff(hi, lo) + 1)
            .withColumn("available_minutes", F.floor(F.col("_total") / F.col("_span")))
        )
    joined = joined.withColumn("available_minutes", F.coalesce("available_minutes", F.lit(0)).cast("long"))
    return joined.select(
        "appointment_date",
        "booked_minutes",
        "available_minutes",
        X.half_even(X.ratio("booked_minutes", "available_minutes") * 100, 1, exact=True).alias("utilization_pct"),
    )


def rank_by_utilization(by_doctor: DataFrame) -> DataFrame:
    """Highest utilisation first; the meter is the percentage clamped to 0..100."""
    meter = F.least(F.greatest(F.col("utilization_pct"), F.lit(0.0)), F.lit(100.0))
    return by_doctor.withColumn("meter_pct", meter).orderBy(F.desc("utilization_pct"), "doctor_id")


def clinic_day_utilization(visits: DataFrame, availability: DataFrame, start, end) -> DataFrame:
    """Mean over doctors of busy / available %, doctors with availability and visits."""
    busy = (
        visits.filter(X.occupies())
        .groupBy("clinic_id", *CELL)
        .agg(F.sum("duration_minutes").alias("busy_minutes"))
    )
    joined = busy.join(intervals.available_minutes(availability, start, end), CELL).filter("available_minutes > 0")
    return joined.groupBy("clinic_id", "appointment_date").agg(
        X.half_even(F.avg(F.col("busy_minutes") / F.col("available_minutes") * 100), 1).alias("utilization_pct")
    )


# --- listings --------------------------------------------------------------------
def listing(visits: DataFrame, *, date_from=None, date_to=None, doctor_id=None, patient_id=None, status=None) -> DataFrame:
    """Filter chain of the listing; each given filter reaches the scan."""
    out = visits
    if date_from is not None:
        out = out.filter(F.col("appointment_date") >= F.lit(date_from))
    if date_to is not None:
        out = out.filter(F.col("appointment_date") <= F.lit(date_to))
    for name, value in (("doctor_id", doctor_id), ("patient_id", patient_id), ("status", status)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def page(filtered: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return (
        filtered.orderBy(F.desc("appointment_date"), "start_minute", "visit_id").offset(offset).limit(limit)
    )


def page_total(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("total"))


def scope_to_caller(visits: DataFrame, role: str, ids: DataFrame | None = None) -> DataFrame:
    """Rows a caller may read: everything for an admin, own rows otherwise."""
    if role == "admin":
        return visits
    key = {"doctor": "doctor_id", "patient": "patient_id"}[role]
    return visits.join(ids.select(key).distinct(), key, "left_semi")


def search_people(people: DataFrame, text: str, columns: Sequence[str] = ("first_name", "last_name", "email"),
                  limit: int = DEFAULT_PAGE) -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` act as wildcards."""
    pattern = F.lit(f"%{text}%")
    hit = None
    for name in columns:
        found = F.ilike(F.col(name), pattern)
        hit = found if hit is None else hit | found
    return people.filter(hit).orderBy("last_name", "patient_id").limit(limit)


def first_per_key(visits: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of each key. Spark keeps at most ``n`` per key before the shuffle."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return visits.withColumn("position", position).filter(F.col("position") <= n)


def my_upcoming(visits: DataFrame, as_of: dt.date, n: int = 50, caller: str = "patient_id") -> DataFrame:
    """The next ``n`` visits of every caller: a top-N listing, for all callers at once."""
    later = visits.filter((F.col("appointment_date") >= F.lit(as_of)) & F.col("status").isin("scheduled", "completed"))
    return first_per_key(later, caller, ["appointment_date", "start_minute", "visit_id"], n)


def doctor_today(visits: DataFrame, as_of: dt.date) -> DataFrame:
    return visits.filter((F.col("appointment_date") == F.lit(as_of)) & X.occupies())


def doctor_upcoming(visits: DataFrame, as_of: dt.date, n: int = 20) -> DataFrame:
    later = visits.filter((F.col("appointment_date") > F.lit(as_of)) & (F.col("status") == "scheduled"))
    return first_per_key(later, "doctor_id", ["appointment_date", "start_minute", "visit_id"], n)


def patient_upcoming(visits: DataFrame, as_of: dt.date) -> DataFrame:
    return visits.filter((F.col("appointment_date") >= F.lit(as_of)) & (F.col("status") == "scheduled"))


def patient_recent(visits: DataFrame, as_of: dt.date, n: int = 20) -> DataFrame:
    past = visits.filter(F.col("appointment_date") < F.lit(as_of))
    return first_per_key(
        past, "patient_id", [F.desc("appointment_date"), F.desc("start_minute"), F.desc("visit_id")], n
    )


def doctor_day_card(visits: DataFrame, as_of: dt.date) -> DataFrame:
    """Visits and hours of the day, and all visits scheduled later."""
    today = doctor_today(visits, as_of).groupBy("doctor_id").agg(
        F.count(F.lit(1)).alias("today"), F.sum("duration_minutes").alias("_minutes")
    )
    ahead = visits.filter((F.col("appointment_date") > F.lit(as_of)) & (F.col("status") == "scheduled"))
    later = ahead.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("upcoming"))
    joined = today.join(later, "doctor_id", "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doctor_id",
        F.coalesce("today", zero).alias("today"),
        X.half_even(F.coalesce("_minutes", zero) / 60, 1, exact=True).alias("booked_hours"),
        F.coalesce("upcoming", zero).alias("upcoming"),
    )


def patient_card(visits: DataFrame, as_of: dt.date) -> DataFrame:
    """Attended and missed among all past visits; NULL share without outcome."""
    counted = visits.filter(F.col("appointment_date") < F.lit(as_of)).groupBy("patient_id").agg(
        F.count_if(F.col("status") == "completed").alias("attended"),
        F.count_if(F.col("status") == "no_show").alias("missed"),
    )
    seen = F.col("attended") + F.col("missed")
    share = F.when(seen > 0, X.half_even(F.col("missed") / seen * 100, 0, exact=True))
    return counted.withColumn("missed_pct", share)


def doctor_calendar(visits: DataFrame, doctor_id: int, start: dt.date, end: dt.date) -> DataFrame:
    return visits.filter((F.col("doctor_id") == doctor_id) & _between(start, end)).orderBy(
        "appointment_date", "start_minute", "visit_id"
    )


def visit_records(visits: DataFrame, doctors: DataFrame, patients: DataFrame, specialties: DataFrame | None = None) -> DataFrame:
    """Denormalised record with embedded doctor and patient, and specialty (``specialty_record``, null if unknown) where the catalogue is given."""
    d = doctors.select("doctor_id", F.struct("doctor_id", X.doctor_name().alias("name"), "clinic_id").alias("doctor"))
    p = patients.select("patient_id", F.struct("patient_id", "first_name", "last_name").alias("patient"))
    records = visits.join(d, "doctor_id").join(p, "patient_id")
    if specialties is None:
        return records
    s = specialties.select("specialty", F.struct("specialty", "default_duration_minutes").alias("specialty_record"))
    return records.join(s, "specialty", "left")


def busiest(visits: DataFrame, key: str, n: int = 1) -> DataFrame:
    return (
        visits.groupBy(key).agg(F.count(F.lit(1)).alias("n_visits")).orderBy(F.desc("n_visits"), key).limit(n)
    )


def recent_weekdays(visits: DataFrame, before: dt.date, n: int = 60) -> DataFrame:
    """The last ``n`` distinct weekdays with activity before a date."""
    return (
        visits.filter(X.occupies() & (X.iso_weekday() < 6) & (F.col("appointment_date") < F.lit(before)))
        .select("appointment_date")
        .distinct()
        .orderBy(F.desc("appointment_date"))
        .limit(n)
    )


def specialties_of_doctors(bridge: DataFrame) -> DataFrame:
    """Held specialties per doctor, sorted (bounded by the specialty catalogue)."""
    return bridge.groupBy("doctor_id").agg(F.array_sort(F.collect_set("specialty")).alias("specialties"))


def holders_of(doctors: DataFrame, bridge: DataFrame, specialty: str) -> DataFrame:
    return doctors.join(bridge.filter(F.col("specialty") == specialty).select("doctor_id"), "doctor_id", "left_semi")


def status_transitions(visits: DataFrame, requested: str = "requested_status", action: str = "action") -> DataFrame:
    """Verdict for each requested cancel, status update or reschedule."""
    verdict = (
        F.when((F.col(action) == "cancel") & (F.col("status") == "completed"), "completed_cannot_be_cancelled")
        .when((F.col(action) == "reschedule") & (F.col("status") != "scheduled"), "only_scheduled_can_move")
        .when((F.col(action) == "set_status") & ~F.col(requested).isin("scheduled", "completed", "cancelled", "no_show"),
              "unknown_status")
        .otherwise("ok")
    )
    new_status = F.when(verdict != "ok", F.col("status")).when(
        F.col(action) == "set_status", F.col(requested)
    ).otherwise("cancelled")
    return visits.withColumn("verdict", verdict).withColumn("new_status", new_status)


def apply_moves(visits: DataFrame, moves: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Move = cancel the old row and add a new one, only where the verdict is ``ok``.

    ``moves``: visit_id, new_visit_id, new_date, new_start, new_duration (NULL
    keeps the booked length). ``verdicts``: visit_id, verdict.
    """
    accepted = moves.join(verdicts.filter("verdict = 'ok'").select("visit_id"), "visit_id", "left_semi")
    asked = accepted.select("visit_id", "new_visit_id", "new_date", "new_start", "new_duration")
    joined = visits.join(asked, "visit_id", "left")
    movable = F.col("new_visit_id").isNotNull() & (F.col("status") == "scheduled")
    kept = joined.withColumn("status", F.when(movable, "cancelled").otherwise(F.col("status"))).select(*visits.columns)
    length = F.coalesce("new_duration", "duration_minutes")
    moved = (
        joined.filter(movable)
        .withColumn("visit_id", F.col("new_visit_id"))
        .withColumn("appointment_date", F.col("new_date"))
        .withColumn("duration_minutes", length)
        .withColumn("start_minute", F.col("new_start"))
        .withColumn("end_minute", F.col("new_start") + F.col("duration_minutes"))
        .select(*visits.columns)
    )
    return kept.unionByName(moved)


def week_calendar(visits: DataFrame, any_day: dt.date, keys: Sequence[str] = ("doctor_id",)) -> DataFrame:
    """Seven day columns of one week as rows; days without visits keep one empty row."""
    monday = any_day - dt.timedelta(days=any_day.weekday())
    live = visits.filter(_between(monday, monday + dt.timedelta(days=6)))
    spine = live.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(monday), F.lit(monday + dt.timedelta(days=6)))).alias("appointment_date"),
    )
    return (
        spine.join(live, [*keys, "appointment_date"], "left")
        .withColumn("day_index", X.weekday0())
        .select(*keys, "day_index", "appointment_date", "visit_id", "start_minute", "end_minute", "status")
    )
