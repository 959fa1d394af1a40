"""Tables that are kept and written: patient history from a change feed, buckets and date partitions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardflow.operators.history import asof_history
from wardflow.sources import sinks, tables
from wardflow.streaming import history

SIDE = "struct<patient_id: bigint, appointment_date: date, status: string>"
CHANGE = f"op string, old {SIDE}, new {SIDE}"
FOLDER = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def states(df):
    return sorted((r["i"], r["prior_n"], r["prior_k"], r["days_since_last"]) for r in df.collect())


def test_kept_history_equals_that_of_the_visits_after_late_outcomes(spark, tmp_path):
    pick, folder = random.Random(6), str(tmp_path / "days")
    draw = lambda: (pick.choice((1, 1, 1, 2, 3, 1 << 50)), DAY + dt.timedelta(days=pick.randrange(12)), pick.choice(("completed", "no_show", "scheduled", "cancelled")))
    visits: dict[int, tuple] = {}
    numbers = iter(range(10**6))
    asked = spark.createDataFrame([(i, p, DAY + dt.timedelta(days=d)) for i, (p, d) in enumerate((p, d) for p in (1, 2, 3, 1 << 50, 99, None) for d in range(-1, 14))],
                                  "i int, patient_id long, booked_at date")
    for batch in range(4):
        changes = []
        for _ in range(40):
            if visits and pick.random() < 0.5:
                i = pick.choice(sorted(visits))
                old = visits.pop(i)
                if pick.random() < 0.7:
                    visits[i] = draw()
                    changes.append(("UPDATE", old, visits[i]))
                else:
                    changes.append(("DELETE", old, None))
            else:
                visits[next(numbers)] = new = draw()
                changes.append(("INSERT", None, new))
        frame = spark.createDataFrame(changes, CHANGE)
        history.update_history(frame, folder, batch)
        if batch % 2:
            history.update_history(frame, folder, batch)  # a replayed batch replaces itself
        outcomes = spark.createDataFrame([(*v, int(v[2] == "no_show")) for v in visits.values() if v[2] in ("completed", "no_show")],
                                         "patient_id long, appointment_date date, status string, label int")
        want = asof_history(asked, outcomes)
        assert states(history.asof_maintained(asked, history.read_history(spark, folder))) == states(want)


def test_history_without_changes_or_after_all_is_deleted(spark, tmp_path):
    folder = str(tmp_path / "days")
    asked = spark.createDataFrame([(0, 1, DAY + dt.timedelta(days=5))], "i int, patient_id long, booked_at date")
    none = spark.createDataFrame([], CHANGE)
    history.update_history(none, folder, 0)
    assert states(history.asof_maintained(asked, history.read_history(spark, folder))) == [(0, 0, 0, None)]
    history.update_history(spark.createDataFrame([("INSERT", None, (1, DAY, "no_show"))], CHANGE), folder, 1)
    assert states(history.asof_maintained(asked, history.read_history(spark, folder))) == [(0, 1, 1, 5)]
    history.update_history(spark.createDataFrame([("DELETE", (1, DAY, "no_show"), None)], CHANGE), folder, 2)
    assert states(history.asof_maintained(asked, history.read_history(spark, folder))) == [(0, 0, 0, None)]


def test_only_touched_buckets_are_written_and_newest_versions_read(spark, tmp_path):
    folder = str(tmp_path / "days")
    many = [("INSERT", None, (p, DAY, "completed")) for p in range(300)]
    history.update_history(spark.createDataFrame(many, CHANGE), folder, 0)
    history.update_history(spark.createDataFrame([("INSERT", None, (7, DAY, "no_show"))], CHANGE), folder, 1)
    table = spark.read.parquet(folder)
    assert table.filter("version = 1").select("bucket").distinct().count() == 1
    files = history.read_history(spark, folder).inputFiles()
    assert len(table.inputFiles()) > 0 and history.read_history(spark, folder).filter("patient_id = 7").select("n", "k").first() == (2, 1)
    plan = history.read_history(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "version" in plan and files


def test_buckets_join_without_a_shuffle_and_days_are_pruned(spark, tmp_path):
    visits, doctors = tables.visits(spark, FOLDER), tables.doctors(spark, FOLDER)
    sinks.write_bucketed(visits, "test_fact", str(tmp_path / "fact"), "doctor_id", 4, "appointment_date")
    sinks.write_bucketed(doctors, "test_doctors", str(tmp_path / "doctors"), "doctor_id", 4)
    sinks.write_bucketed(visits.groupBy("appointment_date").agg(F.count("*").alias("n")), "test_days", str(tmp_path / "days"), "appointment_date", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("test_fact").join(spark.table("test_doctors"), "doctor_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == visits.join(doctors, "doctor_id").count()
    some = spark.table("test_fact").join(spark.table("test_days").filter("n > 30"), "appointment_date")
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
    one = spark.table("test_fact").filter("appointment_date = DATE '2024-01-03'")
    assert "PartitionFilters: [isnotnull(appointment_date" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == visits.filter("appointment_date = DATE '2024-01-03'").count()


def test_a_bucketed_table_is_opened_again(spark, tmp_path):
    visits = tables.visits(spark, FOLDER)
    sinks.write_bucketed(visits, "test_once", str(tmp_path / "fact"), "doctor_id", 4, "appointment_date")
    spark.sql("DROP TABLE test_once")
    again = sinks.open_bucketed(spark, "test_again", str(tmp_path / "fact"), "doctor_id", 4, "appointment_date")
    assert again.count() == visits.count() and set(again.columns) == set(visits.columns)
    assert again.agg(F.sum("duration_minutes")).first() == visits.agg(F.sum("duration_minutes")).first()


def test_a_schedule_is_written_by_date_and_read_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, DAY + dt.timedelta(days=d), 10 + d, 2) for d in range(3)], "schedule_id long, clinic_id long, appointment_date date, visit_id long, doctor_id long")
    header = rows.select("schedule_id", "clinic_id", "appointment_date", F.lit(1.5).alias("objective_value"))
    for _ in range(2):  # writing again replaces the dates
        sinks.write_schedule(header, rows, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "schedule_entry")).filter(F.col("appointment_date") == F.lit(DAY))
    assert [r["visit_id"] for r in back.collect()] == [10]
    assert "PartitionFilters: [isnotnull(appointment_date" in back._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(str(tmp_path / "schedule")).count() == 3
