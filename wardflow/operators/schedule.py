"""Scoring, comparison and replay of schedules, whatever produced them.

``entries``: schedule_id, clinic_id, appointment_date, visit_id, doctor_id,
start_minute, end_minute. ``requests``: visit_id, clinic_id, appointment_date,
doctor_id, requested_start_minute, duration_minutes, urgency, no_show_probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import intervals
from wardflow.operators.running import attach_totals, ordered_counts, spread_summary, value_at

DAY = ["clinic_id", "appointment_date"]
SCHEDULE = ["schedule_id", *DAY]

# Objective weights of the two policies.
WEIGHTS = {
    "balanced": {"delay": 1.0, "idle": 0.8, "overtime": 3.0, "urgency": 1.0, "overbooking": 60.0},
    "patient_first": {"delay": 1.0, "idle": 0.0, "overtime": 3.0, "urgency": 1.0, "overbooking": 60.0},
}
LOAD_FACTORS = [1.0, 0.6, 0.45, 0.35, 0.28, 0.22]


def objective(w: dict[str, float] | None = None, weight: str | None = None) -> Column:
    """Weighted sum of the terms, from literals or from a struct column of weights."""
    v = (lambda k: F.col(f"{weight}.{k}")) if weight else (lambda k: F.lit(float(w[k])))
    return (
        v("delay") * F.col("total_delay_minutes")
        + v("idle") * F.col("total_idle_minutes")
        + v("overtime") * F.col("total_overtime_minutes")
        + v("urgency") * F.col("urgency_penalty")
        + v("overbooking") * F.col("overbooked_slots")
    )


def shared_slots(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slots held by several visits: (schedule, doctor, start) with the member count."""
    return (
        entries.groupBy(*SCHEDULE, *by, "doctor_id", "start_minute")
        .agg(F.count(F.lit(1)).alias("slot_size"))
        .filter("slot_size > 1")
    )


def shared_slot_members(entries: DataFrame) -> DataFrame:
    """Membership of shared slots in row form: the partners of a visit are the
    other rows with the same slot key. Linear in the visits, whatever the slot size."""
    return entries.join(shared_slots(entries), [*SCHEDULE, "doctor_id", "start_minute"]).select(
        *SCHEDULE, "doctor_id", "start_minute", "visit_id", "slot_size"
    )


def doctor_scores(entries: DataFrame, requests: DataFrame, windows: DataFrame, clinics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All score terms per (schedule, doctor). ``by`` are further keys of all three tables, such as a load.

    Entries that bring ``requested_start_minute`` and ``urgency`` are not joined with their requests.
    """
    by = list(by)
    brought = ["requested_start_minute", "urgency"]
    asked = requests.select(
        "visit_id",
        *by,
        "requested_start_minute",
        F.col("duration_minutes").alias("_length"),
        "urgency",
        "no_show_probability",
    )
    placed = entries.select(*SCHEDULE, *by, "visit_id", "doctor_id", "start_minute", "end_minute")
    if set(brought) <= set(entries.columns):
        rows = entries.select(*placed.columns, *brought, F.col("duration_minutes").alias("_length"), "no_show_probability")
    else:
        rows = placed.join(asked, ["visit_id", *by], "left")
    rows = rows.join(clinics.select("clinic_id", "close_minute"), "clinic_id", "left")
    known = F.col("requested_start_minute").isNotNull()
    delay = F.when(known, F.greatest(F.col("start_minute") - F.col("requested_start_minute"), F.lit(0)))
    risk = F.when(known, F.col("no_show_probability") * F.col("_length")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_delay", delay).withColumn("_risk", risk)
    keys = [*SCHEDULE, *by, "doctor_id"]
    terms = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum(F.col("end_minute") - F.col("start_minute")).alias("booked_minutes"),
        F.count("_delay").alias("matched"),
        F.coalesce(F.sum("_delay"), F.lit(0)).alias("delay_minutes"),
        F.coalesce(F.max("_delay"), F.lit(0)).alias("max_delay"),
        F.coalesce(F.sum(F.col("_delay") * (X.urgency_weight() - 1.0)), F.lit(0.0)).alias("urgency_penalty"),
        F.coalesce(
            F.sum(F.when(known, F.greatest(F.col("end_minute") - F.col("close_minute"), F.lit(0)))), F.lit(0)
        ).alias("overtime_minutes"),
        # everyone but the last visit leaves work behind that a no-show would idle
        (F.sum("_risk") - F.max_by("_risk", F.struct("start_minute", "visit_id"))).alias("expected_idle_minutes"),
    )
    idle = intervals.idle_minutes(entries, windows, keys, by=by)
    slots = shared_slots(entries, by).groupBy(*keys).agg(F.count(F.lit(1)).alias("overbooked_slots"))
    zero = F.lit(0).cast("long")
    return (
        terms.join(idle, keys, "left")
        .join(slots, keys, "left")
        .withColumn("idle_minutes", F.coalesce("idle_minutes", zero))
        .withColumn("overbooked_slots", F.coalesce("overbooked_slots", zero))
    )


def score_schedule(entries: DataFrame, requests: DataFrame, windows: DataFrame, clinics: DataFrame,
                   weights: dict[str, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per schedule with every term and the weighted objective.

    ``entries`` may hold any number of schedules; all are scored in one pass.
    ``by`` are further keys of entries, requests and windows. A clinic-day whose requests were all left out has a row, too, with zeros
    and without a ``schedule_id``.
    """
    per_doctor = doctor_scores(entries, requests, windows, clinics, by)
    rolled = per_doctor.groupBy(*SCHEDULE, *by).agg(
        F.sum("delay_minutes").alias("total_delay_minutes"),
        F.sum("idle_minutes").alias("total_idle_minutes"),
        F.sum("overtime_minutes").alias("total_overtime_minutes"),
        F.sum("urgency_penalty").alias("urgency_penalty"),
        F.sum("expected_idle_minutes").alias("expected_idle_minutes"),
        F.sum("overbooked_slots").alias("overbooked_slots"),
        F.sum("visits").alias("scheduled_count"),
        F.sum("matched").alias("_matched"),
        F.max("max_delay").alias("max_delay_minutes"),
    )
    asked = requests.groupBy(*DAY, *by).agg(F.count(F.lit(1)).alias("_asked"))
    terms = [(c, kind) for c, kind in rolled.dtypes if c not in (*SCHEDULE, *DAY, *by)]
    return (
        rolled.join(asked, [*DAY, *by], "full_outer")
        .withColumns({c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in terms})
        .select(*rolled.columns, "_asked")
        .withColumn("unscheduled_count", F.coalesce(F.col("_asked") - F.col("_matched"), F.lit(0).cast("long")))
        .withColumn("mean_delay_minutes", X.ratio("total_delay_minutes", "_matched"))
        .withColumn("objective", objective(weights or WEIGHTS["balanced"]))
        .drop("_asked", "_matched")
    )


def rounded(scores: DataFrame) -> DataFrame:
    for name in ("urgency_penalty", "expected_idle_minutes", "mean_delay_minutes", "objective"):
        scores = scores.withColumn(name, X.half_even(name, 2))
    return scores


# Percent reductions of a comparison and the terms they are of.
REDUCTIONS = {
    "delay_pct": "total_delay_minutes",
    "idle_pct": "total_idle_minutes",
    "overtime_pct": "total_overtime_minutes",
    "expected_idle_pct": "expected_idle_minutes",
    "objective_pct": "objective",
    "mean_delay_pct": "mean_delay_minutes",
}


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Percent reduction per term of the candidate against the baseline of the same clinic-day."""
    b = baseline.select(*DAY, *[F.col(c).alias(f"_b_{c}") for c in REDUCTIONS.values()])
    joined = candidate.join(b, DAY)
    return joined.select(
        *DAY, *[X.reduction_pct(f"_b_{c}", c).alias(name) for name, c in REDUCTIONS.items()]
    )


def compare_within(scores: DataFrame, baseline: int, candidate: int, by: Sequence[str] = ()) -> DataFrame:
    """The same for two schedules scored in one frame: one aggregate by clinic-day, no join."""
    of = lambda schedule, c: F.max(F.when(F.col("schedule_id") == schedule, F.col(c)))
    sides = scores.groupBy(*by, *DAY).agg(
        *[F.count_if(F.col("schedule_id") == i).alias(f"_has{i}") for i in (baseline, candidate)],
        *[of(i, c).alias(f"_{tag}_{c}") for tag, i in (("b", baseline), ("c", candidate)) for c in REDUCTIONS.values()],
    )
    both = sides.filter((F.col(f"_has{baseline}") > 0) & (F.col(f"_has{candidate}") > 0))
    return both.select(*by, *DAY, *[X.reduction_pct(f"_b_{c}", f"_c_{c}").alias(name) for name, c in REDUCTIONS.items()])


def reweighted(scores: DataFrame, policies: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The objective under each weight policy, without scoring again."""
    policies = policies or WEIGHTS
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("policy"), *[F.lit(v).alias(k) for k, v in w.items()])
            for name, w in policies.items()
        ]
    )
    return (
        scores.withColumn("_w", F.explode(rows))
        .withColumn("policy", F.col("_w.policy"))
        .withColumn("objective", X.half_even(objective(weight="_w"), 2))
        .select(*SCHEDULE, "policy", "objective")
    )


# --- replay ----------------------------------------------------------------------
def queue_replay(visits: DataFrame, keys: Sequence[str] = ("doctor_id", "appointment_date"), *,
                 arrival: str = "start_minute", service: str = "duration_minutes", attends: str | None = None,
                 visit_id: str = "visit_id") -> DataFrame:
    """Begin, finish and wait of every visit; absent patients, and those of whom it is not known, take no time and wait 0."""
    came = F.lit(True) if attends is None else F.coalesce(F.col(attends), F.lit(False))
    present = visits.filter(came)
    served = intervals.queue_scan(present, keys, arrival, service, visit_id).withColumn(
        "wait_minutes", F.col("begin_minute") - F.col(arrival)
    )
    if attends is None:
        return served
    absent = visits.filter(~came).withColumn("wait_minutes", F.lit(0).cast("long"))
    return served.unionByName(absent, allowMissingColumns=True)


def doctor_sessions(replayed: DataFrame, clinics: DataFrame, service: str = "duration_minutes") -> DataFrame:
    """Overtime past the close and idle time (span minus busy) of each doctor-day."""
    day = replayed.groupBy("clinic_id", "doctor_id", "appointment_date").agg(
        F.min("begin_minute").alias("_first"),
        F.max("finish_minute").alias("_last"),
        F.sum(F.when(F.col("finish_minute").isNotNull(), F.col(service))).alias("_busy"),
    )
    zero = F.lit(0)
    return day.join(clinics.select("clinic_id", "close_minute"), "clinic_id").select(
        "clinic_id",
        "doctor_id",
        "appointment_date",
        F.greatest(F.coalesce(F.col("_last") - F.col("close_minute"), zero), zero).alias("overtime_minutes"),
        F.greatest(F.coalesce(F.col("_last") - F.col("_first") - F.col("_busy"), zero), zero).alias("idle_minutes"),
    )


def wait_summary(replayed: DataFrame, clinics: DataFrame, by: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """mean, median, p90, max, share above 15 minutes; mean overtime and idle per clinic-day."""
    by = list(by)
    t, w = F.col("n_total"), F.col("wait_minutes")
    waits = ordered_counts(replayed, "wait_minutes", by).groupBy(*by).agg(
        F.max(t).alias("visits"),
        X.half_even(F.sum(w * F.col("n")) / F.max(t), 2).alias("mean_wait"),
        value_at(F.floor(t / 2), "wait_minutes").alias("median_wait"),
        value_at(F.floor(t * F.lit(0.9)), "wait_minutes").alias("p90_wait"),
        F.max(w).alias("max_wait"),
        X.half_even(F.sum(F.when(w > 15, F.col("n")).otherwise(0)) / F.max(t), 4).alias("share_over_15"),
    )
    per_day = doctor_sessions(replayed, clinics).groupBy("clinic_id", "appointment_date").agg(
        F.sum("overtime_minutes").alias("_o"), F.sum("idle_minutes").alias("_i")
    )
    days = per_day.groupBy(*by).agg(
        X.half_even(F.avg("_o"), 2).alias("mean_overtime"), X.half_even(F.avg("_i"), 2).alias("mean_idle")
    )
    return attach_totals(waits, days, by)


def moved_visit_impact(entries: DataFrame, moves: DataFrame, clinics: DataFrame, *, attends: str | None = None) -> DataFrame:
    """What moving one visit of a clinic-day does to its own wait and to everyone's.

    ``moves``: visit_id, new_start_minute, at most one per clinic-day. Both sides
    are the same deterministic replay.
    """
    moved = entries.join(moves.select("visit_id", "new_start_minute"), "visit_id", "left").withColumn(
        "start_minute", F.coalesce("new_start_minute", "start_minute")
    ).drop("new_start_minute")

    def side(frame: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        replayed = queue_replay(frame, attends=attends)
        mover = replayed.join(moves.select("visit_id", "new_start_minute"), "visit_id").select(
            *DAY, "visit_id", "new_start_minute", F.col("wait_minutes").alias(f"wait_{tag}")
        )
        mean = replayed.groupBy(*DAY).agg(X.half_even(F.avg("wait_minutes"), 2).alias(f"clinic_mean_wait_{tag}"))
        over = doctor_sessions(replayed, clinics).groupBy(*DAY).agg(F.sum("overtime_minutes").alias(f"clinic_overtime_{tag}"))
        return mover, mean.join(over, DAY)

    mover_b, clinic_b = side(entries, "before")
    mover_a, clinic_a = side(moved, "after")
    return (
        mover_b.join(mover_a.select("visit_id", "wait_after"), "visit_id").join(clinic_b, DAY).join(clinic_a, DAY)
    )


# --- benchmark roll-up --------------------------------------------------------------
def improvement_rollup(days: DataFrame, by: Sequence[str] = (), metric: str = "objective_pct", minimum_days: int = 5) -> DataFrame:
    """Spread of an improvement over days, with days better / identical / worse.

    ``enough_days`` marks the load points seen on at least ``minimum_days`` days.
    """
    by = list(by)
    tallies = days.groupBy(*by).agg(
        F.count(metric).alias("days"),
        F.count_if(F.col(metric) > 0.01).alias("days_better"),
        F.count_if(F.abs(F.col(metric)) <= 0.01).alias("days_identical"),
        F.count_if(F.col(metric) < -0.01).alias("days_worse"),
    )
    spread = spread_summary(days, metric, by).drop("n_values")
    return attach_totals(tallies, spread, by).withColumn("enough_days", F.col("days") >= minimum_days)


def compressed_loads(requests: DataFrame, windows: DataFrame, factors: Sequence[float] = LOAD_FACTORS) -> tuple[DataFrame, DataFrame]:
    """Requests and windows of the same days squeezed by every ``factor``, all in one frame each.

    Demand keeps its shape and order while the working windows get shorter.
    """
    exploded = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    asked = intervals.compress_day(windows, requests, F.col("factor"), factors=exploded)
    asked = asked.drop("requested_start_minute", "compressed_window_end").withColumnRenamed("compressed_start_minute", "requested_start_minute")
    longest = requests.groupBy(*DAY).agg(F.max("duration_minutes").alias("_longest"))
    of_doctor = requests.select("doctor_id", *DAY).distinct().join(longest, DAY).groupBy("doctor_id", "appointment_date").agg(F.max("_longest").alias("_longest"))
    squeezed = windows.join(of_doctor, ["doctor_id", "appointment_date"]).withColumn("factor", exploded)
    return asked, squeezed.withColumn("end_minute", intervals.compressed_end("start_minute", "end_minute", F.col("factor"), "_longest")).drop("_longest")


def load_sweep(requests: DataFrame, windows: DataFrame, clinics: DataFrame, plan, baseline: int, candidate: int,
               factors: Sequence[float] = LOAD_FACTORS, minimum_days: int = 5) -> DataFrame:
    """Improvement of a schedule over another at every load, with the load as mean utilisation.

    ``plan(requests, keep)`` gives the entries of both schedules with further columns of the
    requests. All loads and both schedules are scored in one pass and compared in one
    aggregate. If every visit asks once, an entry brings what its request asked for.
    """
    asked, squeezed = compressed_loads(requests, windows, factors)
    unclear = requests.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR visit_id IS NULL")
    entries = plan(asked, ("factor", "requested_start_minute", "urgency") if unclear.isEmpty() else ("factor",))
    scores = score_schedule(entries, asked, squeezed, clinics, by=["factor"])
    rollup = improvement_rollup(compare_within(scores, baseline, candidate, ["factor"]), ["factor"], minimum_days=minimum_days)
    keys = ["factor", "doctor_id", "appointment_date"]
    busy = entries.filter(F.col("schedule_id") == baseline).groupBy(*keys).agg(F.sum("duration_minutes").alias("_busy"))
    room = squeezed.groupBy(*keys).agg(F.sum(F.col("end_minute") - F.col("start_minute")).alias("_room"))
    share = F.coalesce(F.col("_busy"), F.lit(0)) / F.col("_room") * 100
    used = room.filter("_room > 0").join(busy, keys, "left").groupBy("factor").agg(X.half_even(F.avg(share), 1).alias("mean_utilization_pct"))
    return rollup.join(used, "factor")


def enrich_with_predictions(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted length and risk where present, booked length and 0.0 otherwise."""
    p = predictions.select("visit_id", "predicted_duration_minutes", F.col("no_show_probability").alias("_risk"))
    return (
        requests.drop("no_show_probability")
        .join(p, "visit_id", "left")
        .withColumn(
            "duration_minutes",
            F.coalesce(X.half_even("predicted_duration_minutes", 0).cast("int"), "duration_minutes"),
        )
        .withColumn("no_show_probability", F.coalesce("_risk", F.lit(0.0)))
        .drop("_risk", "predicted_duration_minutes")
    )


def assemble_clinic_days(visits: DataFrame, availability: DataFrame, bridge: DataFrame, rooms: DataFrame,
                         clinics: DataFrame) -> DataFrame:
    """Inputs of every clinic-day at once: one row per visit with the windows in
    force, the held specialties, the room capacity and the clinic hours."""
    held = bridge.groupBy("doctor_id").agg(F.array_sort(F.collect_set("specialty")).alias("held_specialties"))
    live = visits.filter(X.occupies())
    return (
        intervals.with_day_windows(live, availability)
        .join(held, "doctor_id", "left")
        .join(rooms.filter("is_active").select("room_id", "capacity"), "room_id", "left")
        .join(clinics.select("clinic_id", "open_minute", "close_minute"), "clinic_id")
        .withColumnRenamed("start_minute", "requested_start_minute")
    )
