"""Command line of the batch jobs: python -m wardflow.plans.jobs <job> --data DIR --out DIR"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.operators import operations, quality, splits
from wardflow.plans import evaluate as ev
from wardflow.plans.train import NotEnoughData, train
from wardflow.session import materialize, tune
from wardflow.sources import sinks, tables
from wardflow.streaming import maintain


def run_gate(frame: DataFrame, as_of: dt.date, out: str | None = None, **thresholds) -> bool:
    """Structure gate; True when every check passes."""
    past, every = tables.past_and_all(frame, as_of)
    order = [c for c in ("start_minute", "no_show", "visit_id") if c in past.columns]
    result = quality.structure_gate(past, every, thresholds, order=order)
    if out:
        sinks.write_report(result, f"{out}/structure_gate")
        result = result.sparkSession.read.json(f"{out}/structure_gate")
    return result.filter("NOT passed").isEmpty()


def run_evaluation(frame: DataFrame, out: str, *, trees: int | None = None, minimum_rows: int = quality.MIN_TRAINING_ROWS,
                   **fold_settings) -> bool:
    """All three evaluations and the gate report; True when the gates pass."""
    if tables.training_summary(frame).first()["resolved_rows"] < minimum_rows:
        raise NotEnoughData(f"fewer than {minimum_rows} resolved visits")
    folds = splits.rolling_origin_folds(frame, **fold_settings)
    results = {
        "no_show": ev.evaluate_no_show(frame, folds),
        "demand": ev.evaluate_demand(frame, folds, trees=trees),
        "duration": ev.evaluate_duration(frame, folds, trees=trees),
    }
    for name, parts in results.items():
        for part, df in parts.items():
            if isinstance(df, DataFrame):
                sinks.write_report(df, f"{out}/{name}_{part}")
    gate = ev.gates(results["no_show"]["summary"], results["demand"]["summary"], results["duration"]["summary"])
    sinks.write_report(gate, f"{out}/gates")
    return gate.sparkSession.read.json(f"{out}/gates").filter("NOT passed").isEmpty()


def run_reconcile(summary: DataFrame, visits: DataFrame, *, as_of: dt.date, report_to: str, days: int = 30, repair_to: str | None = None) -> dict:
    """Compare a stored summary with a recount of the last ``days`` days.

    The comparison is made once. All drifted fields are written to
    ``report_to``. A repair writes the corrected dates only; the other date
    partitions stay.
    """
    since = as_of - dt.timedelta(days=days)
    compared = materialize(maintain.drift(summary, visits, since))
    sinks.write_report(maintain.drift_rows(compared), report_to)
    checked, drifted = compared.agg(F.count(F.lit(1)), F.count_if(maintain.differs())).first()
    if repair_to and drifted:
        wrong = compared.filter(maintain.differs()).select("appointment_date").distinct()
        sinks.write_by_date(maintain.recounted(compared).join(wrong, "appointment_date", "left_semi"), repair_to)
    return {"checked_cells": checked, "drift_count": drifted, "repaired": bool(repair_to and drifted), "report": report_to, "days": days}


def run_stream_reconcile(spark: SparkSession, folder: str, visits: DataFrame, *, as_of: dt.date, report_to: str, days: int = 30,
                         repair: bool = False) -> dict:
    """The same for the summary that :func:`maintain.maintain_utilization` keeps.

    A repair appends one correcting delta batch; what the streams wrote stays.
    """
    since = as_of - dt.timedelta(days=days)
    compared = materialize(maintain.drift(maintain.read_deltas(spark, folder), visits, since))
    floored = maintain.floored(compared)
    sinks.write_report(maintain.drift_rows(floored), report_to)
    checked, drifted = floored.agg(F.count(F.lit(1)), F.count_if(maintain.differs())).first()
    if repair and drifted:
        maintain.write_correction(compared.filter(maintain.differs()), folder)
    return {"checked_cells": checked, "drift_count": drifted, "repaired": bool(repair and drifted), "report": report_to, "days": days}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["gate", "train", "evaluate", "backfill", "reconcile"])
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    parser.add_argument("--summary", help="reconcile: folder of the maintained summary")
    parser.add_argument("--days", type=int, default=30, help="reconcile: days to look back")
    parser.add_argument("--repair", action="store_true", help="reconcile: append a correcting batch")
    args = parser.parse_args(argv)
    spark = tune(SparkSession.builder.appName(f"wardflow-{args.job}").getOrCreate())
    if args.job == "backfill":
        cells = operations.utilization_cells(tables.visits(spark, args.data))
        sinks.write_by_date(cells.withColumn("updated_on", F.lit(args.as_of)), args.out, "appointment_date", "doctor_id")
        return 0
    if args.job == "reconcile":
        if not args.summary:
            parser.error("reconcile needs --summary")
        visits = tables.visits(spark, args.data)
        found = run_stream_reconcile(
            spark, args.summary, visits, as_of=args.as_of, report_to=f"{args.out}/drift", days=args.days, repair=args.repair
        )
        print(found)
        return 0 if not found["drift_count"] or found["repaired"] else 1
    frame = tables.bookings(spark, args.data)
    if args.job == "gate":
        return 0 if run_gate(frame, args.as_of, args.out) else 1
    try:
        if args.job == "train":
            train(frame, args.out)
            return 0
        return 0 if run_evaluation(frame, args.out) else 1
    except NotEnoughData as exc:
        print(exc, file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
