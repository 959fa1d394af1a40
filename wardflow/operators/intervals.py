"""Interval logic over visits of one resource and day.

A day has a bounded number of minutes. Every operator first reduces the visits
of a (resource, day) to its minutes, so windows and arrays are bounded by the
clock and never by the number of visits; results return to the visits through an
equi join. No operator lists pairs of visits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions import scalar as X
from wardflow.operators.running import ID_LEVELS, carried_totals, with_id_digits

RESOURCE_DAY = ("doctor_id", "appointment_date")


def minute_load(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY, start: str = "start_minute",
                end: str = "end_minute") -> DataFrame:
    """Per (keys, minute): how many visits start and how many end there."""
    edges = F.array(
        F.struct(F.col(start).alias("minute"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
        F.struct(F.col(end).alias("minute"), F.lit(0).alias("starts"), F.lit(1).alias("ends")),
    )
    return (
        visits.filter(F.col(start) < F.col(end))
        .select(*keys, F.explode(edges).alias("e"))
        .groupBy(*keys, F.col("e.minute").alias("minute"))
        .agg(F.sum("e.starts").alias("starts"), F.sum("e.ends").alias("ends"))
    )


def day_profile(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    """One row per (keys) with its minute loads as an array (bounded by the clock)."""
    return minute_load(visits, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("minute", "starts", "ends")).alias("profile")
    )


def overlap_count(profile, start, end) -> Column:
    """Visits in ``profile`` overlapping ``[start, end)``.

    A visit overlaps when it starts before ``end`` and does not end by ``start``.
    """
    s, e = X.col(start), X.col(end)
    return F.coalesce(
        F.aggregate(
            X.col(profile),
            F.lit(0).cast("long"),
            lambda acc, m: acc
            + F.when(m["minute"] < e, m["starts"]).otherwise(F.lit(0).cast("long"))
            - F.when(m["minute"] <= s, m["ends"]).otherwise(F.lit(0).cast("long")),
        ),
        F.lit(0).cast("long"),
    )


def overlap_counts(requests: DataFrame, visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY,
                   name: str = "n_overlaps", start: str = "start_minute", end: str = "end_minute") -> DataFrame:
    """Interval-overlap join in count form: every request with the number of visits it hits."""
    profile = day_profile(visits, keys)
    return (
        requests.join(profile, list(keys), "left")
        .withColumn(name, overlap_count("profile", start, end))
        .drop("profile")
    )


def edge_counts(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    """Per (keys) parallel arrays over its edge minutes: starts before the minute, ends up to it."""
    ordered = Window.partitionBy(*keys).orderBy("minute")
    running = minute_load(visits, keys).select(
        *keys,
        "minute",
        F.coalesce(F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("starts"),
        F.sum("ends").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ends"),
    )
    rows = running.groupBy(*keys).agg(F.collect_list(F.struct("minute", "starts", "ends")).alias("_rows"))
    return rows.select(*keys, *[F.col(f"_rows.{c}").alias(f"edge_{c}") for c in ("minute", "starts", "ends")])


def overlap_audit(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    """Non-cancelled visits that overlap another one of the same resource and day.

    Both minutes of a visit are edges of its own day, so the count is two array
    look-ups: starts before its end, minus ends up to its start, minus itself.
    """
    live = visits.filter(X.occupies() & (F.col("start_minute") < F.col("end_minute")))
    at = lambda counts, minute: F.get(counts, F.array_position("edge_minute", F.col(minute)).cast("int") - 1)
    counted = live.join(edge_counts(live, keys), list(keys)).withColumn(
        "n_overlaps", at("edge_starts", "end_minute") - at("edge_ends", "start_minute") - 1
    )
    return counted.filter("n_overlaps > 0").drop("edge_minute", "edge_starts", "edge_ends")


def conflicts_running_max(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY, visit_id: str = "visit_id") -> DataFrame:
    """Non-cancelled visits that overlap an EARLIER one (by start, then id).

    The running maximum of end times is taken over minutes; inside one minute
    every visit but the one with the smallest id overlaps an earlier one.
    """
    keys = list(keys)
    live = visits.filter(X.occupies() & (F.col("start_minute") < F.col("end_minute")))
    minutes = live.groupBy(*keys, "start_minute").agg(
        F.max("end_minute").alias("_last_end"), F.min(visit_id).alias("_first_id")
    )
    before = Window.partitionBy(*keys).orderBy("start_minute").rowsBetween(Window.unboundedPreceding, -1)
    state = minutes.select(
        *keys, "start_minute", "_first_id", F.max("_last_end").over(before).alias("_busy_until")
    )
    return (
        live.join(state, keys + ["start_minute"])
        .filter((F.col("_busy_until") > F.col("start_minute")) | (F.col(visit_id) > F.col("_first_id")))
        .drop("_busy_until", "_first_id")
    )


def concurrency(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    """Load after each minute, ends applied before starts (half-open intervals)."""
    upto = Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return minute_load(visits, keys).withColumn("load", F.sum(F.col("starts") - F.col("ends")).over(upto))


def peak_concurrency(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    return concurrency(visits, keys).groupBy(*keys).agg(F.max("load").alias("peak"))


def capacity_pressure(visits: DataFrame, rooms: DataFrame, day: str = "appointment_date") -> DataFrame:
    """Per room and day: peak load and visits that start above the capacity."""
    keys = ["room_id", day]
    loads = concurrency(visits.filter(X.occupies() & F.col("room_id").isNotNull()), keys)
    over = F.least(F.col("starts"), F.greatest(F.col("load") - F.col("capacity"), F.lit(0).cast("long")))
    return (
        loads.join(rooms.select("room_id", F.col("capacity").cast("long").alias("capacity")), "room_id")
        .groupBy(*keys)
        .agg(F.max("capacity").alias("capacity"), F.max("load").alias("peak"), F.sum(over).alias("above_capacity"))
    )


def merged_busy(visits: DataFrame, keys: Sequence[str] = RESOURCE_DAY) -> DataFrame:
    """Disjoint busy intervals of each (keys), touching intervals joined."""
    keys = list(keys)
    minutes = (
        visits.filter(F.col("start_minute") < F.col("end_minute"))
        .groupBy(*keys, "start_minute")
        .agg(F.max("end_minute").alias("end_minute"))
    )
    ordered = Window.partitionBy(*keys).orderBy("start_minute")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_minute").over(before)
    marked = minutes.withColumn(
        "_new", F.when(reach.isNull() | (F.col("start_minute") > reach), 1).otherwise(0)
    )
    islands = marked.withColumn(
        "_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return islands.groupBy(*keys, "_island").agg(
        F.min("start_minute").alias("start_minute"), F.max("end_minute").alias("end_minute")
    ).drop("_island")


# --- availability ---------------------------------------------------------------
def window_days(availability: DataFrame, start, end) -> DataFrame:
    """Weekly windows expanded over the dates of ``[start, end]`` (both inclusive).

    Each window row generates its own dates (every seventh day from the first
    match), so there is no join with a calendar. ``start`` and ``end`` are dates
    or scalar subqueries.
    """
    lo, hi = (X.col(v) if not isinstance(v, dt.date) else F.lit(v) for v in (start, end))
    bounded = (
        availability.filter("is_active")
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .withColumn("_lo", F.greatest("_lo", "effective_from"))
        .withColumn("_hi", F.least("_hi", F.coalesce("effective_to", "_hi")))
        .withColumn("_first", F.date_add("_lo", F.pmod(F.col("weekday") - X.iso_weekday("_lo"), F.lit(7))))
        .filter(F.col("_first") <= F.col("_hi"))
    )
    return bounded.select(
        "doctor_id",
        F.explode(F.sequence("_first", "_hi", F.expr("interval 7 days"))).alias("appointment_date"),
        "start_minute",
        "end_minute",
    )


def available_minutes(availability: DataFrame, start, end) -> DataFrame:
    return (
        window_days(availability, start, end)
        .groupBy("doctor_id", "appointment_date")
        .agg(F.sum(F.col("end_minute") - F.col("start_minute")).alias("available_minutes"))
    )


def weekly_windows(availability: DataFrame) -> DataFrame:
    """Active windows of a doctor-weekday as one array (a pattern, not a fact)."""
    return (
        availability.filter("is_active")
        .groupBy("doctor_id", "weekday")
        .agg(F.collect_list(F.struct("start_minute", "end_minute", "effective_from", "effective_to")).alias("windows"))
    )


def with_day_windows(visits: DataFrame, availability: DataFrame, day: str = "appointment_date") -> DataFrame:
    """Attach the windows in force on the day of each row as ``windows``."""
    patterns = weekly_windows(availability).withColumnRenamed("weekday", "_weekday")
    joined = visits.withColumn("_weekday", X.iso_weekday(day)).join(patterns, ["doctor_id", "_weekday"], "left")
    in_force = F.filter(
        "windows",
        lambda w: (w["effective_from"] <= F.col(day))
        & (w["effective_to"].isNull() | (w["effective_to"] >= F.col(day))),
    )
    return joined.withColumn("windows", F.coalesce(in_force, F.filter("windows", lambda w: F.lit(False)))).drop("_weekday")


def inside_one_window(windows, start, end) -> Column:
    """Containment in a single window; a break between windows is not covered."""
    return F.coalesce(
        F.exists(X.col(windows), lambda w: (w["start_minute"] <= X.col(start)) & (X.col(end) <= w["end_minute"])),
        F.lit(False),
    )


def covered_by_availability(visits: DataFrame, availability: DataFrame) -> DataFrame:
    return (
        with_day_windows(visits, availability)
        .withColumn("is_covered", inside_one_window("windows", "start_minute", "end_minute"))
        .drop("windows")
    )


def free_slots(availability: DataFrame, visits: DataFrame, start, end, step: int = 15) -> DataFrame:
    """Slot board of every doctor-day in ``[start, end]`` with free or busy.

    Busy time arrives as merged intervals, at most a clock's worth per doctor-day.
    """
    windows = window_days(availability, start, end)
    busy = (
        merged_busy(visits.filter(X.occupies()))
        .groupBy(*RESOURCE_DAY)
        .agg(F.collect_list(F.struct("start_minute", "end_minute")).alias("busy"))
    )
    slots = (
        windows.filter(F.col("end_minute") - F.col("start_minute") >= step)
        .join(busy, list(RESOURCE_DAY), "left")
        .withColumn(
            "slot_start",
            F.explode(F.sequence("start_minute", F.col("end_minute") - step, F.lit(step))),
        )
        .withColumn("slot_end", F.col("slot_start") + step)
    )
    taken = F.coalesce(
        F.exists(
            "busy", lambda b: (b["start_minute"] < F.col("slot_end")) & (F.col("slot_start") < b["end_minute"])
        ),
        F.lit(False),
    )
    return slots.select(
        *RESOURCE_DAY, "slot_start", "slot_end", (~taken).alias("is_free"), F.when(taken, "booked").alias("reason")
    )


def idle_minutes(entries: DataFrame, windows: DataFrame, keys: Sequence[str], visit_id: str = "visit_id", by: Sequence[str] = ()) -> DataFrame:
    """Positive gaps between consecutive visits inside the same window.

    ``windows`` holds ``keys``-compatible (doctor_id, appointment_date,
    start_minute, end_minute) rows, and the columns ``by`` if windows differ by them. Only the last visit of each start minute can
    open a gap, so a window is scanned minute by minute.
    """
    keys, of_windows = list(keys), [*RESOURCE_DAY, *by]
    arrays = windows.groupBy(*of_windows).agg(
        F.collect_set(F.struct("start_minute", "end_minute")).alias("_windows")
    )
    inside = F.filter(
        "_windows",
        lambda w: (F.col("start_minute") >= w["start_minute"]) & (F.col("end_minute") <= w["end_minute"]),
    )
    # A visit inside several (overlapping) windows counts in each of them.
    placed = (
        entries.join(arrays, of_windows)
        .select(*keys, "start_minute", "end_minute", visit_id, F.explode(inside).alias("_w"))
        .groupBy(*keys, "_w", "start_minute")
        .agg(F.max_by("end_minute", visit_id).alias("_leaves"))
    )
    ordered = Window.partitionBy(*keys, "_w").orderBy("start_minute")
    gap = F.col("start_minute") - F.lag("_leaves").over(ordered)
    return (
        placed.withColumn("_gap", F.greatest(gap, F.lit(0)))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("idle_minutes"))
    )


def compressed_end(start, end, factor, longest) -> Column:
    """Where a working window ends that is squeezed to ``factor``, but holds the longest visit of the clinic-day."""
    start, end = X.col(start), X.col(end)
    return F.least(end, start + F.greatest(F.floor((end - start) * factor).cast("int"), X.col(longest)))


def compress_day(windows: DataFrame, requests: DataFrame, factor: float | Column, grid: int = X.GRID_MINUTES,
                 factors: Column | None = None) -> DataFrame:
    """Squeeze each working window to ``factor`` (which may be a column of the requests) and remap the requested times.

    With ``factors``, a generator, each request is repeated with its values as the column ``factor``, after what it needs was looked up.

    Windows never become shorter than the longest visit of the clinic-day; each
    request keeps its relative position, floored to the grid.
    """
    day = ["clinic_id", "appointment_date"]
    longest = requests.groupBy(*day).agg(F.max("duration_minutes").alias("_longest"))
    arrays = windows.groupBy(*RESOURCE_DAY).agg(
        F.array_sort(F.collect_set(F.struct("start_minute", "end_minute"))).alias("_windows")
    )
    joined = requests.join(longest, day).join(arrays, list(RESOURCE_DAY), "left")
    asked = F.col("requested_start_minute")
    holder = F.get(
        F.filter("_windows", lambda w: (w["start_minute"] <= asked) & (asked < w["end_minute"])), F.lit(0)
    )
    staged = joined.withColumn("_w", holder).drop("_windows")
    if factors is not None:
        staged = staged.withColumn("factor", factors)
    o_start, o_end = F.col("_w.start_minute"), F.col("_w.end_minute")
    staged = staged.withColumn("_c_end", compressed_end(o_start, o_end, F.lit(factor), "_longest"))
    position = (asked - o_start) / F.greatest(o_end - o_start, F.lit(1))
    room = F.greatest(F.col("_c_end") - o_start - F.col("duration_minutes"), F.lit(0))
    target = o_start + position * room
    return staged.select(
        *requests.columns,
        *["factor"] * (factors is not None),
        F.coalesce(X.grid_down(target, grid), asked).alias("compressed_start_minute"),
        F.col("_c_end").alias("compressed_window_end"),
    )


def queue_scan(
    attending: DataFrame,
    keys: Sequence[str],
    arrival: str,
    service: str,
    visit_id: str,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Single-server queue: start = max(arrival, previous finish).

    Closed form: with S the running service total,
    ``finish_k = S_k + max over j <= k of (arrival_j - S_(j-1))``. Totals of the
    arrival minutes carry the running total and the running maximum, which a
    minute reaches with its first visit; inside a minute, totals are carried over
    the order columns and the digits of the id, and the rest is a sum inside one block.
    """
    keys = list(keys)
    names = [f"_o{i}" for i in range(len(order))]
    staged = with_id_digits(attending, visit_id).withColumns({"_service": F.col(service), **dict(zip(names, order))})
    minutes = staged.groupBy(*keys, arrival).agg(F.sum("_service").alias("_total"))
    scan = Window.partitionBy(*keys).orderBy(arrival)  # minutes of a day
    before = F.coalesce(F.sum("_total").over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.max(F.col(arrival) - F.col("_before")).over(scan.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    minutes = minutes.withColumn("_before", before).withColumn("_lead", lead).drop("_total")
    levels = [*names, *ID_LEVELS]
    block = [*keys, arrival, *levels]
    carried = carried_totals(staged, [*keys, arrival], levels, ["_service"])
    inside = Window.partitionBy(*block).orderBy(visit_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finished = (
        staged.withColumn("_served", F.sum("_service").over(inside))
        .join(carried, block)
        .join(minutes, [*keys, arrival])
        .withColumn("finish_minute", F.col("_before") + F.col("_c__service") + F.col("_served") + F.col("_lead"))
        .withColumn("begin_minute", F.col("finish_minute") - F.col(service))
    )
    return finished.select(*attending.columns, "begin_minute", "finish_minute")
