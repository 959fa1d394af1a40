"""Interval, schedule and booking invariants with hand-checked numbers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators import intervals, quality, schedule
from wardflow.operators.running import ordered_counts, nearest_rank, prior_totals, spread_summary

DAY = dt.date(2026, 6, 1)  # a Monday


def visits(spark, rows):
    """rows: id, doctor, start, end[, status, room, date]."""
    full = [(r[0], 1, r[1], 1, r[5] if len(r) > 5 else None, r[6] if len(r) > 6 else DAY, r[2], r[3], r[3] - r[2],
             r[4] if len(r) > 4 else "scheduled") for r in rows]
    return spark.createDataFrame(
        full,
        "visit_id long, patient_id long, doctor_id long, clinic_id long, room_id long, appointment_date date, start_minute int, "
        "end_minute int, duration_minutes int, status string",
    )


def test_half_open_overlaps(spark):
    rows = [(1, 1, 540, 570), (2, 1, 570, 600), (3, 1, 560, 580, "cancelled"), (4, 2, 545, 560), (5, 1, 540, 600, "scheduled", None, dt.date(2026, 6, 2))]
    assert intervals.overlap_audit(visits(spark, rows)).count() == 0
    found = {r["visit_id"]: r["n_overlaps"] for r in intervals.overlap_audit(visits(spark, rows + [(6, 1, 569, 571)])).collect()}
    assert found == {1: 1, 2: 1, 6: 2}


def test_conflict_forms_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, 1 if rng.random() < 0.7 else 2, (s := rng.randrange(480, 1100)), s + rng.randrange(5, 60), rng.choice(["completed", "cancelled"])) for i in range(300)]
    frame = visits(spark, rows)
    live = [r for r in rows if r[4] != "cancelled"]
    hits = {a[0]: sum(a[1] == b[1] and a[0] != b[0] and a[2] < b[3] and b[2] < a[3] for b in live) for a in live}
    got = {r["visit_id"]: r["n_overlaps"] for r in intervals.overlap_audit(frame).collect()}
    assert got == {k: v for k, v in hits.items() if v}
    earlier = {a[0] for a in live if any(a[1] == b[1] and (b[2], b[0]) < (a[2], a[0]) and b[3] > a[2] for b in live)}
    assert {r["visit_id"] for r in intervals.conflicts_running_max(frame).collect()} == earlier
    peak = {r["doctor_id"]: r["peak"] for r in intervals.peak_concurrency(frame.filter("status <> 'cancelled'")).collect()}
    for doctor in (1, 2):
        assert peak[doctor] == max(sum(a[1] == doctor and a[2] <= m < a[3] for a in live) for m in range(480, 1200))


def windows(spark, spans=((480, 750), (810, 1080)), doctor=1):
    return spark.createDataFrame([(doctor, DAY, a, b) for a, b in spans], "doctor_id long, appointment_date date, start_minute int, end_minute int")


def availability(spark, rows=((1, 1, 480, 750), (1, 1, 810, 1080)), effective=(dt.date(2026, 1, 1), None), active=True):
    return spark.createDataFrame(
        [(*r, *effective, active) for r in rows],
        "doctor_id long, weekday int, start_minute int, end_minute int, effective_from date, effective_to date, is_active boolean",
    )


def test_break_is_not_covered_and_effective_dates_are_inclusive(spark):
    frame = visits(spark, [(1, 1, 720, 780), (2, 1, 720, 750), (3, 1, 810, 840)])
    covered = lambda a: {r["visit_id"] for r in intervals.covered_by_availability(frame, a).filter("is_covered").collect()}
    assert covered(availability(spark)) == {2, 3}
    assert covered(availability(spark, effective=(DAY, DAY))) == {2, 3}
    assert covered(availability(spark, effective=(dt.date(2026, 1, 1), dt.date(2026, 5, 31)))) == set()
    assert covered(availability(spark, active=False)) == set()


def test_available_minutes_counts_only_matching_weekdays(spark):
    out = intervals.available_minutes(availability(spark), dt.date(2026, 6, 1), dt.date(2026, 6, 14)).collect()
    assert {(r["appointment_date"].day, r["available_minutes"]) for r in out} == {(1, 540), (8, 540)}


def test_booking_takes_two_quarter_hour_slots(spark):
    board = lambda v: intervals.free_slots(availability(spark), v, DAY, DAY).filter("is_free").count()
    empty = board(visits(spark, [(1, 2, 540, 570)]))
    assert empty == 18 + 18
    assert board(visits(spark, [(1, 1, 540, 570)])) == empty - 2
    assert board(visits(spark, [(1, 1, 540, 570, "cancelled")])) == empty


def test_idle_excludes_the_break_and_the_edges(spark):
    frame = visits(spark, [(1, 1, 540, 570), (2, 1, 600, 630), (3, 1, 720, 750), (4, 1, 810, 840), (5, 1, 840, 870)])
    assert intervals.idle_minutes(frame, windows(spark), ["doctor_id", "appointment_date"]).first()["idle_minutes"] == 30 + 90


def test_merged_busy_intervals(spark):
    out = intervals.merged_busy(visits(spark, [(1, 1, 540, 600), (2, 1, 550, 560), (3, 1, 600, 620), (4, 1, 700, 710)])).collect()
    assert sorted((r["start_minute"], r["end_minute"]) for r in out) == [(540, 620), (700, 710)]


def _replay(rows):
    free, out = {}, {}
    for i, doctor, start, end, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        begin = max(start, free.get(doctor, 0))
        free[doctor] = begin + end - start
        out[i] = (begin, free[doctor], begin - start)
    return out


def test_queue_replay_equals_sequential_replay(spark):
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.6 else 2, (s := rng.randrange(480, 700, 5)), s + rng.randrange(0, 50)) for i in range(250)]
    out = schedule.queue_replay(visits(spark, rows)).collect()
    assert {r["visit_id"]: (r["begin_minute"], r["finish_minute"], r["wait_minutes"]) for r in out} == _replay(rows)


def test_six_visits_at_two_spacings(spark):
    waits = lambda gap: [
        r["wait_minutes"] for r in schedule.queue_replay(visits(spark, [(i, 1, 480 + gap * i, 510 + gap * i) for i in range(6)])).orderBy("visit_id").collect()
    ]
    assert waits(45) == [0] * 6
    assert waits(15) == [0, 15, 30, 45, 60, 75]


def test_absent_patients_take_no_time(spark):
    frame = visits(spark, [(1, 1, 480, 540), (2, 1, 480, 510), (3, 1, 500, 530)]).withColumn("attends", F.col("visit_id") != 1)
    got = {r["visit_id"]: (r["begin_minute"], r["wait_minutes"]) for r in schedule.queue_replay(frame, attends="attends").collect()}
    assert got == {1: (None, 0), 2: (480, 0), 3: (510, 10)}


def requests(spark, rows):
    """rows: id, start, duration, urgency, risk."""
    return spark.createDataFrame(
        [(r[0], 1, DAY, 1, r[1], r[2], r[3], r[4]) for r in rows],
        "visit_id long, clinic_id long, appointment_date date, doctor_id long, requested_start_minute int, duration_minutes int, "
        "urgency string, no_show_probability double",
    )


def entries(spark, rows, schedule_id=1):
    return spark.createDataFrame(
        [(schedule_id, 1, DAY, i, 1, s, e) for i, s, e in rows],
        "schedule_id long, clinic_id long, appointment_date date, visit_id long, doctor_id long, start_minute int, end_minute int",
    )


def clinic(spark):
    return spark.createDataFrame([(1, 480, 1080)], "clinic_id long, open_minute int, close_minute int")


def test_score_terms(spark):
    asked = requests(spark, [(1, 540, 30, "emergency", 0.5), (2, 540, 30, "routine", 0.1), (3, 1050, 45, "urgent", 0.2), (4, 600, 30, "routine", 0.0)])
    plan = entries(spark, [(1, 555, 585), (2, 540, 570), (3, 1050, 1095)])
    row = schedule.score_schedule(plan, asked, windows(spark), clinic(spark)).first()
    assert (row["total_delay_minutes"], row["max_delay_minutes"], row["total_overtime_minutes"]) == (15, 15, 15)
    assert row["urgency_penalty"] == 15 * 7
    assert row["expected_idle_minutes"] == pytest.approx(0.1 * 30 + 0.5 * 30)
    assert (row["scheduled_count"], row["unscheduled_count"], row["overbooked_slots"]) == (3, 1, 0)
    assert row["mean_delay_minutes"] == pytest.approx(5.0)
    assert row["objective"] == pytest.approx(15 + 0.8 * row["total_idle_minutes"] + 3 * 15 + 105)


def test_risky_visits_late_lower_expected_idle(spark):
    asked = requests(spark, [(1, 540, 30, "routine", 0.9), (2, 540, 30, "routine", 0.0)])
    idle = lambda plan: schedule.score_schedule(entries(spark, plan), asked, windows(spark), clinic(spark)).first()["expected_idle_minutes"]
    assert idle([(2, 540, 570), (1, 570, 600)]) < idle([(1, 540, 570), (2, 570, 600)])


def test_shared_slot_counts_once_and_zero_baseline_improves_nothing(spark):
    asked = requests(spark, [(1, 540, 30, "routine", 0.4), (2, 540, 30, "routine", 0.3), (3, 540, 30, "routine", 0.1)])
    plan = entries(spark, [(1, 540, 570), (2, 540, 570), (3, 570, 600)])
    score = schedule.score_schedule(plan, asked, windows(spark), clinic(spark))
    assert score.first()["overbooked_slots"] == 1
    assert {(r["visit_id"], r["slot_size"]) for r in schedule.shared_slot_members(plan).collect()} == {(1, 2), (2, 2)}
    base = score.withColumn("total_delay_minutes", F.lit(0).cast("long"))
    assert schedule.compare(base, score).first()["delay_pct"] == 0.0
    audit = quality.overbooking_audit(plan.join(asked.select("visit_id", "no_show_probability"), "visit_id")).first()
    assert (audit["members"], round(audit["expected_attendance"], 6), audit["too_many"], audit["too_crowded"]) == (2, 1.3, False, True)


def test_booking_verdicts_in_order(spark):
    dims = dict(
        doctors=spark.createDataFrame([(1, 1, True), (2, 1, False)], "doctor_id long, clinic_id long, is_active boolean"),
        patients=spark.createDataFrame([(1,)], "patient_id long"),
        clinics=clinic(spark),
        rooms=spark.createDataFrame([(1, 1)], "room_id long, capacity int"),
        bridge=spark.createDataFrame([(1, "a"), (2, "a")], "doctor_id long, specialty string"),
        availability=availability(spark),
        specialties=spark.createDataFrame([("a", 30)], "specialty string, default_duration_minutes int"),
        as_of=DAY,
    )
    held = visits(spark, [(1, 1, 540, 570, "scheduled", 1), (2, 1, 600, 630, "cancelled", 1), (3, 9, 660, 690, "scheduled", 1)])
    asked = [
        ("ok", 1, 1, "a", DAY, 570, None, None), ("slot_taken", 1, 1, "a", DAY, 560, 20, None), ("ok", 1, 1, "a", DAY, 600, 30, 1),
        ("room_full", 1, 1, "a", DAY, 670, 10, 1), ("past_date", 1, 1, "a", dt.date(2026, 5, 31), 570, 30, None),
        ("unknown_doctor", 5, 1, "a", DAY, 570, 30, None), ("inactive_doctor", 2, 1, "a", DAY, 570, 30, None),
        ("unknown_patient", 1, 8, "a", DAY, 570, 30, None), ("past_midnight", 1, 1, "a", DAY, 1430, 30, None),
        ("outside_clinic_hours", 1, 1, "a", DAY, 470, 30, None), ("specialty_mismatch", 1, 1, "b", DAY, 570, 30, None),
        ("doctor_unavailable", 1, 1, "a", DAY, 740, 80, None), ("unknown_room", 1, 1, "a", DAY, 570, 30, 77),
        ("unknown_specialty", 1, 1, "zz", DAY, 570, None, None), ("duration_not_positive", 1, 1, "a", DAY, 570, 0, None),
    ]
    frame = spark.createDataFrame(
        [(i, *a[1:]) for i, a in enumerate(asked)],
        "request_id long, doctor_id long, patient_id long, specialty string, appointment_date date, start_minute int, duration_minutes int, room_id long",
    )
    got = {r["request_id"]: r["verdict"] for r in quality.booking_verdicts(frame, held, **dims).collect()}
    assert [got[i] for i in range(len(asked))] == [a[0] for a in asked]


def test_no_array_of_a_request_goes_through_a_join(spark):
    """Minute profiles and windows become a number or a flag before the requests are shuffled again."""
    kinds = "request_id long, doctor_id long, patient_id long, specialty string, appointment_date date, start_minute int, duration_minutes int, room_id long"
    dims = dict(
        doctors=spark.createDataFrame([(1, 1, True)], "doctor_id long, clinic_id long, is_active boolean"),
        patients=spark.createDataFrame([(1,)], "patient_id long"), clinics=clinic(spark), rooms=spark.createDataFrame([(1, 1)], "room_id long, capacity int"),
        bridge=spark.createDataFrame([(1, "a")], "doctor_id long, specialty string"), availability=availability(spark),
        specialties=spark.createDataFrame([("a", 30)], "specialty string, default_duration_minutes int"), as_of=DAY,
    )
    asked = spark.createDataFrame([(1, 1, 1, "a", DAY, 560, 20, 1)], kinds)
    plan = quality.booking_verdicts(asked, visits(spark, [(1, 1, 540, 570)]), **dims)._jdf.queryExecution().optimizedPlan()
    carried, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        waiting += children
        if node.nodeName() == "Join":
            columns = [children[0].output().apply(i) for i in range(children[0].output().size())]
            carried.append([c.name() for c in columns if c.dataType().typeName() == "array"])
    assert len(carried) >= 8 and not any(carried)


def test_compressed_day_keeps_the_longest_visit(spark):
    asked = requests(spark, [(1, 480, 30, "routine", 0.0), (2, 700, 60, "routine", 0.0), (3, 780, 30, "routine", 0.0)])
    got = {r["visit_id"]: (r["compressed_start_minute"], r["compressed_window_end"]) for r in intervals.compress_day(windows(spark), asked, 0.1).collect()}
    assert got[1] == (480, 540)
    assert got[2] == (480, 540)
    assert got[3] == (780, None)


def test_ordered_counts_and_quantiles_equal_brute_force(spark):
    rng = random.Random(9)
    values = [round(rng.gauss(0, 1), rng.choice([0, 6])) for _ in range(900)]
    groups = [0 if rng.random() < 0.7 else 1 for _ in values]
    frame = spark.createDataFrame(list(zip(groups, values)), "g int, v double")
    for small in (True, False):
        got = {(r["g"], r["v"]): (r["n"], r["n_before"], r["n_total"]) for r in ordered_counts(frame, "v", ["g"], small=small).collect()}
        for g, v in set(zip(groups, values)):
            mine = [x for h, x in zip(groups, values) if h == g]
            assert got[(g, v)] == (mine.count(v), sum(x < v for x in mine), len(mine))
    q = {r["g"]: r["q"] for r in nearest_rank(frame, "v", {"q": 0.9}, ["g"]).collect()}
    for g in (0, 1):
        mine = sorted(x for h, x in zip(groups, values) if h == g)
        assert q[g] == mine[int(len(mine) * 0.9)]
    row = spread_summary(spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double"), "v").first()
    assert (row["mean"], row["median"], row["p10"], row["p90"], row["min"], row["max"]) == (2.5, 2.5, 1.0, 4.0, 1.0, 4.0)


def test_prior_totals_across_id_blocks(spark):
    frame = spark.range(100).select((F.col("id") * 400_000).alias("id"), F.lit(1).alias("k"), (F.col("id") % 3).alias("v"))
    frame = frame.withColumn("block", F.shiftright("id", 20))
    got = [r["before"] for r in prior_totals(frame, ["k"], ["block"], ["id"], {"before": F.col("v")}).orderBy("id").collect()]
    assert got == [sum(j % 3 for j in range(i)) for i in range(100)]


def test_entries_bring_what_their_requests_asked_for(spark):
    """A sweep of loads joins entries with requests only where a visit asks more than once; both ways give the same scores."""
    rows = [(1, 480, 30, "routine", 0.1), (2, 500, 60, "urgent", 0.2), (3, 780, 30, "routine", 0.3)]
    asked, kept = requests(spark, rows), []

    def plan(frame, keep):
        kept.append(keep)
        placed = [frame.select(F.lit(i).cast("long").alias("schedule_id"), "clinic_id", "appointment_date", "visit_id", "doctor_id", start.cast("int").alias("start_minute"),
                               (start + F.col("duration_minutes")).cast("int").alias("end_minute"), "duration_minutes", "no_show_probability", *keep)
                  for i, start in ((1, F.col("requested_start_minute") + 15), (2, F.col("requested_start_minute")))]
        return placed[0].unionByName(placed[1])

    sweep = lambda frame: schedule.load_sweep(frame, windows(spark), clinic(spark), plan, 1, 2, factors=[1.0, 0.5]).orderBy("factor").collect()
    assert len(sweep(asked)) == 2 and len(sweep(asked.unionByName(asked))) == 2
    assert [len(k) for k in kept] == [3, 1]
    squeezed, _ = schedule.compressed_loads(asked, windows(spark), [1.0, 0.5])
    of = lambda keep: schedule.doctor_scores(plan(squeezed, keep), squeezed, windows(spark).withColumn("factor", F.lit(1.0)), clinic(spark), ["factor"])
    once, joined = of(("factor", "requested_start_minute", "urgency")), of(("factor",))
    assert sorted(once.select(joined.columns).collect()) == sorted(joined.collect())
