"""Booking a batch of requests with the result they would have one at a time.

Requests compete for doctors, rooms and the visits they move, so the verdict of
one depends on those before it. A request waits only for earlier undecided ones
that claim one of its minutes (or the visit it moves); all others are decided in
the same round. Claims are minutes of a resource-day, so a round is made of
aggregates by (resource, day, minute) and equi joins on (resource, day), never of pairs of requests.

A request that meets something no earlier request can move away is lost: it is
refused in any case, so nobody waits for it, and why it is refused is told at the
end, from what the requests before it got. So the rounds follow chains of requests
that may still be accepted, not all that ask for a crowded hour. Visits nobody asks
to move are counted once; a round reads the open requests, the visits they may move
and what was accepted.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import intervals, quality
from wardflow.session import drop_stored, stored

DAY = "appointment_date"


def _shuffled(frame: DataFrame) -> DataFrame:
    """``frame`` to be joined by a shuffle: a row for each request looks small when compressed, and a broadcast of it is built on the driver."""
    return frame.hint("merge")


def _with_waits(able: DataFrame) -> DataFrame:
    """``able`` with ``_wait_<kind>``: whether an earlier request claims the visit it moves or a minute of the slots it may take or give back.

    The claims of a resource-day become one row, its minutes in order with the first
    request of each. A request claims all minutes of its slots, so they are a slice there.
    """
    f = F.col
    rows = able
    for kind in ("doctor", "room"):
        slots = [[f"{prefix}{c}" for c in (f"{kind}_id", DAY, "start_minute", "end_minute")] for prefix in ("", "old_")]
        claims = reduce(DataFrame.unionByName, [
            able.filter(f(resource).isNotNull() & f(day).isNotNull() & f(start).isNotNull()).select(
                f(resource).cast("long").alias("_resource"), f(day).alias("_day"), "request_id",
                F.explode(F.when(f(end) > f(start), F.sequence(f(start), f(end) - 1)).otherwise(F.array(start))).alias("minute"))
            for resource, day, start, end in slots])
        first = claims.groupBy("_resource", "_day", "minute").agg(F.min("request_id").alias("first"))
        minutes = first.groupBy("_resource", "_day").agg(F.sort_array(F.collect_list(F.struct("minute", "first"))).alias("_m"))
        minutes = _shuffled(minutes.select("_resource", "_day", f("_m.minute").alias("_minutes"), f("_m.first").alias("_firsts")))
        waits = F.lit(False)
        for i, (resource, day, start, end) in enumerate(slots):
            own = F.slice("_firsts", F.array_position("_minutes", f(start)).cast("int"), F.greatest(f(end) - f(start), F.lit(1)).cast("int"))
            rows = rows.withColumn("_resource", f(resource).cast("long")).withColumn("_day", f(day)).join(minutes, ["_resource", "_day"], "left")
            rows = rows.withColumn(f"_wait_{i}", F.coalesce(F.array_min(own) < f("request_id"), F.lit(False))).drop("_resource", "_day", "_minutes", "_firsts")
            waits = waits | f(f"_wait_{i}")
        rows = rows.withColumn(f"_wait_{kind}", waits).drop("_wait_0", "_wait_1")
    movers = able.filter(f("moves_visit_id").isNotNull()).groupBy(f("moves_visit_id").alias("visit_id")).agg(F.min("request_id").alias("_first"))
    return _of_moved(rows, movers).withColumn("_wait_visit", F.coalesce(f("_first") < f("request_id"), F.lit(False))).drop("_first")


def _of_moved(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """``rows`` with what ``frame`` says of the visit they move; requests that move none are spread by their own number, not all sent to one task."""
    moves = F.col("moves_visit_id")
    keyed = rows.withColumn("_moves", moves.isNotNull()).withColumn("_moved", F.coalesce(moves.cast("long"), F.col("request_id").cast("long")))
    of_visit = frame.withColumn("_moves", F.lit(True)).withColumn("_moved", F.col("visit_id").cast("long")).drop("visit_id")
    return keyed.join(_shuffled(of_visit), ["_moves", "_moved"], "left").drop("_moves", "_moved")


def _overlaps(rows: DataFrame, held: DataFrame, tag: str) -> DataFrame:
    """``rows`` with ``_doctor_<tag>`` and ``_room_<tag>``: how many of ``held`` their slot meets."""
    for kind in ("doctor", "room"):
        of_kind = held.filter(F.col(f"{kind}_id").isNotNull())
        rows = intervals.overlap_counts(rows, of_kind, [f"{kind}_id", DAY], f"_{kind}_{tag}")
    return rows


def _own(resource: str):
    """1 if the moved visit, in its old slot, would be in the way of its own move."""
    f = F.col
    meets = (f(f"old_{DAY}") == f(DAY)) & (f("old_start_minute") < f("end_minute")) & (f("start_minute") < f("old_end_minute"))
    return F.coalesce((f("moves_visit_id").isNotNull() & meets & (f(f"old_{resource}") == f(resource))).cast("int"), F.lit(0))


def _round(pending: DataFrame, held: DataFrame) -> DataFrame:
    """``pending`` with the verdicts that can be given now, or ``lost``; the others are null.

    ``held``: accepted slots and those of visits that may be, but were not yet moved.
    """
    f = F.col
    movable = pending.select(f("moves_visit_id").alias("visit_id")).filter("visit_id IS NOT NULL").distinct()
    firm = held.join(movable, "visit_id", "left_anti")  # occupied whatever is still to be decided
    has_room = f("room_id").isNotNull()
    rows = _overlaps(pending, firm, "firm")
    lost = (f("_doctor_fixed") + f("_doctor_firm") > 0) | (has_room & (f("_room_fixed") + f("_room_firm") >= f("capacity")))
    rows = stored(rows.withColumn("_lost", F.coalesce(lost, F.lit(False))).drop("_doctor_firm", "_room_firm"))

    able = rows.filter("NOT _lost")
    there = held.select("visit_id", F.lit(True).alias("_there")).filter("visit_id IS NOT NULL").distinct()
    able = _overlaps(_of_moved(_with_waits(able), there), held, "held")
    # A moved visit still stands in its old slot, but not in its own way.
    count = lambda kind: f(f"_{kind}_fixed") + f(f"_{kind}_held") - _own(f"{kind}_id")
    verdict = (
        F.when(f("_wait_visit"), None)
        .when(f("moves_visit_id").isNotNull() & f("_there").isNull(), "only_scheduled_can_move")
        .when(has_room & f("_wait_room"), None)
        .when(has_room & (count("room") >= f("capacity")), "room_full")
        .when(f("_wait_doctor"), None)
        .when(count("doctor") > 0, "slot_taken")
        .otherwise("ok")
    )
    judged = able.select(*pending.columns, verdict.alias("verdict"))
    return judged.unionByName(rows.filter("_lost").select(*pending.columns, F.lit("lost").alias("verdict")))


def _refusals(lost: DataFrame, movable: DataFrame, accepted: DataFrame) -> DataFrame:
    """Why requests that could not be accepted were refused, given what earlier ones got: ``request_id, verdict``."""
    f = F.col
    movers = accepted.filter("moves_visit_id IS NOT NULL").groupBy("moves_visit_id").agg(F.min("request_id").alias("_mover"))
    slot = ["room_id", DAY, "start_minute", "end_minute"]
    freed = movable.join(movers, movable["visit_id"] == movers["moves_visit_id"]).select(f("_mover").alias("request_id"), *slot, F.lit(-1).alias("_change"))
    changes = accepted.select("request_id", *slot, F.lit(1).alias("_change")).unionByName(freed).filter("room_id IS NOT NULL AND start_minute < end_minute")
    of_room = changes.groupBy("room_id", DAY).agg(
        F.collect_list(F.struct(f("request_id").alias("id"), f("start_minute").alias("s"), f("end_minute").alias("e"), f("_change").alias("n"))).alias("_changes"))
    before = F.filter("_changes", lambda c: (c["id"] < f("request_id")) & (c["s"] < f("end_minute")) & (f("start_minute") < c["e"]))
    changed = F.coalesce(F.aggregate(before, F.lit(0), lambda total, c: total + c["n"]), F.lit(0))
    rows = intervals.overlap_counts(lost, movable.filter("room_id IS NOT NULL"), ["room_id", DAY], "_room_held")
    rows = rows.join(of_room, ["room_id", DAY], "left").withColumn("_room_changed", changed).drop("_changes").join(movers, "moves_visit_id", "left")
    in_room = f("_room_fixed") + f("_room_held") + f("_room_changed") - _own("room_id")
    verdict = (
        F.when(f("_mover") < f("request_id"), "only_scheduled_can_move")
        .when(f("room_id").isNotNull() & (in_room >= f("capacity")), "room_full")
        .otherwise("slot_taken")
    )
    return rows.select("request_id", verdict.alias("verdict"))


def book_batch(
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
    """Verdicts of requests decided in the order of ``request_id``: ``request_id, verdict``.

    ``requests`` is as for :func:`quality.booking_verdicts`, with an optional
    ``moves_visit_id``: the request then asks to move that visit. What an earlier
    request got is taken for the later ones; an accepted move gives the old slot
    back, and the old slot is never in the way of its own move. Rules that do
    not depend on other bookings come first, in their usual order.

    * a visit that is not there gives ``unknown_visit``, one that is not scheduled, or was moved by an earlier request, ``only_scheduled_can_move``.
    * rounds go on until all are decided: as many as the longest chain of requests that may be accepted and wait for one another.
    * without requests there are no rows.
    """
    if "moves_visit_id" not in requests.columns:
        requests = requests.withColumn("moves_visit_id", F.lit(None).cast("long"))
    context = dict(doctors=doctors, patients=patients, clinics=clinics, rooms=rooms, bridge=bridge, availability=availability, specialties=specialties, as_of=as_of)
    alone = quality.booking_verdicts(requests, visits.filter(F.lit(False)), **context)
    old = visits.select(F.col("visit_id").alias("moves_visit_id"), F.col("status").alias("_status"),
                        *[F.col(c).alias(f"old_{c}") for c in ("doctor_id", "room_id", DAY, "start_minute", "end_minute")])
    verdict = (
        F.when(F.col("moves_visit_id").isNotNull() & F.col("_status").isNull(), "unknown_visit")
        .when(F.col("_status") != "scheduled", "only_scheduled_can_move")
        .otherwise(F.col("verdict"))
    )
    length = F.coalesce("duration_minutes", "default_duration_minutes")
    judged = stored(
        alone.join(old, "moves_visit_id", "left")
        .join(specialties.select("specialty", "default_duration_minutes"), "specialty", "left")
        .join(rooms.select("room_id", "capacity"), "room_id", "left")
        .select("request_id", "doctor_id", "room_id", DAY, "start_minute", (F.col("start_minute") + length).alias("end_minute"), "capacity", "moves_visit_id",
                *[f"old_{c}" for c in ("doctor_id", "room_id", DAY, "start_minute", "end_minute")], verdict.alias("verdict"))
    )
    decided = [judged.filter("verdict <> 'ok'").select("request_id", "verdict")]
    asking = judged.filter("verdict = 'ok' AND request_id IS NOT NULL").drop("verdict")
    live = visits.filter(X.occupies()).select("visit_id", "doctor_id", "room_id", DAY, "start_minute", "end_minute")
    to_move = asking.select(F.col("moves_visit_id").alias("visit_id")).filter("visit_id IS NOT NULL").distinct()
    movable = stored(live.join(to_move, "visit_id", "left_semi"))
    pending, held = stored(_overlaps(asking, live.join(to_move, "visit_id", "left_anti"), "fixed")), movable
    lost, accepted = [pending.limit(0)], [pending.limit(0)]
    while not pending.isEmpty():
        judged = stored(_round(pending, held))
        decided.append(judged.filter("verdict <> 'lost'").select("request_id", "verdict"))
        lost.append(judged.filter("verdict = 'lost'").drop("verdict"))
        accepted.append(judged.filter("verdict = 'ok'").drop("verdict"))
        freed = accepted[-1].select(F.col("moves_visit_id").alias("visit_id")).filter("visit_id IS NOT NULL")
        added = accepted[-1].select(F.lit(None).cast("long").alias("visit_id"), "doctor_id", "room_id", DAY, "start_minute", "end_minute")
        now_held = stored(held.join(freed, "visit_id", "left_anti").unionByName(added))
        if held is not movable:
            drop_stored(held)
        pending, held = judged.filter("verdict IS NULL").drop("verdict"), now_held
    together = lambda frames: reduce(DataFrame.unionByName, frames)
    return together([*decided, _refusals(together(lost), movable, together(accepted))])
