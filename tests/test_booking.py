"""A batch of bookings against requests taken one at a time."""

import datetime as dt
import random
import re

from wardflow.operators import booking
from wardflow.operators.booking import book_batch

MONDAY = dt.date(2024, 3, 4)
REQUEST = "request_id long, doctor_id long, patient_id long, specialty string, appointment_date date, start_minute int, duration_minutes int, room_id long, moves_visit_id long"
VISIT = "visit_id long, doctor_id long, patient_id long, room_id long, specialty string, appointment_date date, start_minute int, end_minute int, duration_minutes int, status string"
CAPACITY = {0: 1, 1: 2, 2: 3}


def context(spark):
    frame = spark.createDataFrame
    windows = [(d, w, a, b, dt.date(2020, 1, 1), None, True) for d in range(3) for w in range(1, 8) for a, b in ((480, 720), (720, 1080))]
    return dict(
        doctors=frame([(d, "a", "b", 0, d != 3) for d in range(4)], "doctor_id long, first_name string, last_name string, clinic_id long, is_active boolean"),
        patients=frame([(p,) for p in range(5)], "patient_id long"),
        clinics=frame([(0, "c", 480, 1080)], "clinic_id long, name string, open_minute int, close_minute int"),
        rooms=frame([(r, 0, "r", c, True) for r, c in CAPACITY.items()], "room_id long, clinic_id long, name string, capacity int, is_active boolean"),
        bridge=frame([(d, "x", True) for d in range(4)], "doctor_id long, specialty string, is_primary boolean"),
        availability=frame(windows, "doctor_id long, weekday int, start_minute int, end_minute int, effective_from date, effective_to date, is_active boolean"),
        specialties=frame([("x", 25)], "specialty string, default_duration_minutes int"),
        as_of=dt.date(2024, 1, 1),
    )


def one_at_a_time(requests, visits):
    live = {v[0]: v for v in visits if v[9] != "cancelled"}
    status, moved, verdicts = {v[0]: v[9] for v in visits}, set(), {}
    for i, doctor, patient, specialty, day, start, length, room, moves in sorted(requests):
        end = start + (length or 25)
        if moves is not None and moves not in status:
            verdicts[i] = "unknown_visit"
        elif moves is not None and status[moves] != "scheduled":
            verdicts[i] = "only_scheduled_can_move"
        elif doctor == 3:
            verdicts[i] = "inactive_doctor"
        elif start < 480 or end > 1080:
            verdicts[i] = "outside_clinic_hours"
        elif start < 720 < end:
            verdicts[i] = "doctor_unavailable"
        elif moves in moved:
            verdicts[i] = "only_scheduled_can_move"
        else:
            meets = [v for k, v in live.items() if k != moves and v[5] == day and v[6] < end and start < v[7]]
            if room is not None and sum(v[3] == room for v in meets) >= CAPACITY[room]:
                verdicts[i] = "room_full"
            elif any(v[1] == doctor for v in meets):
                verdicts[i] = "slot_taken"
            else:
                verdicts[i] = "ok"
                if moves is not None:
                    moved.add(moves)
                    del live[moves]
                live[("new", i)] = (None, doctor, patient, room, specialty, day, start, end, end - start, "scheduled")
    return verdicts


def test_a_batch_is_booked_as_if_one_came_after_the_other(spark):
    pick = random.Random(4)
    slot = lambda: (pick.choice((465, 480, 495, 510, 540, 600, 690, 720, 735, 1060)), pick.choice((15, 30, 45)))
    visits = []
    for i in range(40):
        start, length = slot()
        visits.append((i, pick.randrange(3), 0, pick.choice((None, 0, 1, 2)), "x", MONDAY + dt.timedelta(days=pick.randrange(2)), start, start + length, length,
                       pick.choice(("scheduled", "scheduled", "completed", "cancelled"))))
    requests = []
    for i in range(160):
        start, length = slot()
        moves = pick.choice((None, None, pick.randrange(43)))
        doctor, day = pick.randrange(4), MONDAY + dt.timedelta(days=pick.randrange(2))
        if moves is not None and moves < 40 and pick.random() < 0.6:  # a little later the same day, over its own old slot
            doctor, day, start = visits[moves][1], visits[moves][5], visits[moves][6] + 5
        requests.append((1000 - 3 * i, doctor, 1, "x", day, start, pick.choice((None, length)), pick.choice((None, 0, 1, 2)), moves))
    got = book_batch(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(visits, VISIT), **context(spark))
    want = one_at_a_time(requests, visits)
    assert {r["request_id"]: r["verdict"] for r in got.collect()} == want
    assert {"ok", "slot_taken", "room_full", "only_scheduled_can_move", "unknown_visit", "doctor_unavailable"} <= set(want.values())


def test_the_second_request_for_a_slot_is_refused_and_an_empty_batch_has_no_verdicts(spark):
    visits = spark.createDataFrame([(7, 0, 0, None, "x", MONDAY, 600, 630, 30, "scheduled")], VISIT)
    ask = lambda i, start, moves: (i, 0, 1, "x", MONDAY, start, 30, None, moves)
    requests = [ask(1, 480, None), ask(2, 500, None), ask(3, 610, None), ask(4, 615, 7), ask(5, 600, None), ask(6, 585, None), ask(7, 800, 7)]
    frame = spark.createDataFrame(requests, REQUEST)
    got = {r["request_id"]: r["verdict"] for r in book_batch(frame, visits, **context(spark)).collect()}
    assert got == {1: "ok", 2: "slot_taken", 3: "slot_taken", 4: "ok", 5: "slot_taken", 6: "ok", 7: "only_scheduled_can_move"}
    assert book_batch(frame.filter("false"), visits, **context(spark)).collect() == []


def test_requests_that_cannot_be_accepted_are_not_waited_for(spark, monkeypatch):
    """A crowd that asks for the same hour takes a few rounds, not one each, and is told the same reasons."""
    pick, rounds, plain = random.Random(8), [], booking._round
    monkeypatch.setattr(booking, "_round", lambda *a: rounds.append(1) or plain(*a))
    visits = [(i, i % 3, 0, i % 3, "x", MONDAY, 600 + 10 * i, 630 + 10 * i, 30, "scheduled") for i in range(6)]
    requests = [(i, pick.randrange(3), 1, "x", MONDAY, pick.choice((480, 490, 500, 600, 610, 640)), 30, pick.choice((0, 1, 2)), pick.choice((None, None, pick.randrange(6))))
                for i in range(120)]
    got = book_batch(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(visits, VISIT), **context(spark))
    want = one_at_a_time(requests, visits)
    assert {r["request_id"]: r["verdict"] for r in got.collect()} == want
    assert {"ok", "slot_taken", "room_full", "only_scheduled_can_move"} <= set(want.values()) and len(rounds) <= 12


def test_no_row_for_a_request_or_a_claimed_minute_is_broadcast(spark, monkeypatch):
    """Such rows compress well, so they look small enough, and the driver builds the table that is broadcast."""
    plans, plain = [], booking.stored

    def seen(frame):
        frame.collect()
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame)

    monkeypatch.setattr(booking, "stored", seen)
    visits = spark.createDataFrame([(7, 0, 0, None, "x", MONDAY, 600, 630, 30, "scheduled")], VISIT)
    requests = spark.createDataFrame([(1, 0, 1, "x", MONDAY, 480, 30, 1, None), (2, 0, 1, "x", MONDAY, 500, 30, 1, 7)], REQUEST)
    got = {r["request_id"]: r["verdict"] for r in book_batch(requests, visits, **context(spark)).collect()}
    assert got == {1: "ok", 2: "slot_taken"}
    joins = [keys for plan in plans for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)]
    assert joins and not [keys for keys in joins if re.search(r"\bminute#|request_id#", keys)]
