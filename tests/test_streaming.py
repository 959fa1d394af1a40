"""Incremental maintenance equals a recount; the live feed drops what is too late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from wardflow.operators.operations import CELL, utilization_cells
from wardflow.plans import jobs
from wardflow.sources import sinks, tables
from wardflow.streaming import maintain

SIDE = "struct<doctor_id: bigint, appointment_date: date, status: string, duration_minutes: int>"
SCHEMA = f"op string, old {SIDE}, new {SIDE}"
A, B = dt.date(2026, 6, 1), dt.date(2026, 6, 2)


def change(op, old=None, new=None):
    return (op, old, new)


def rows(df):
    return {(r["doctor_id"], r["appointment_date"]): tuple(r[c] for c in maintain.MEASURES) for r in df.collect()}


def test_move_touches_two_cells(spark):
    feed = [
        change("INSERT", None, (1, A, "scheduled", 30)),
        change("INSERT", None, (1, A, "completed", 45)),
        change("UPDATE", (1, A, "scheduled", 30), (2, B, "no_show", 20)),
        change("UPDATE", (1, A, "completed", 45), (1, A, "cancelled", 45)),
        change("INSERT", None, (3, A, "scheduled", 15)),
        change("DELETE", (3, A, "scheduled", 15), None),
    ]
    got = rows(maintain.accumulate(maintain.utilization_deltas(spark.createDataFrame(feed, SCHEMA))))
    assert got == {(1, A): (0, 0, 1, 0, 0), (2, B): (0, 0, 0, 1, 20), (3, A): (0, 0, 0, 0, 0)}


def test_stream_equals_recount_and_survives_replay(spark, tmp_path):
    """Three files of changes, one micro-batch each, against a recount of the final rows."""
    visits = tables.visits(spark, "/root/testdata/sf0.001")
    side = F.struct("doctor_id", "appointment_date", "status", "duration_minutes").cast(SIDE)
    later = F.struct(
        ((F.col("doctor_id") + 1) % 16).alias("doctor_id"), F.date_add("appointment_date", 1).alias("appointment_date"),
        F.lit("completed").alias("status"), F.col("duration_minutes"),
    ).cast(SIDE)
    none = F.lit(None).cast(SIDE)
    inserts = visits.select(F.lit("INSERT").alias("op"), none.alias("old"), side.alias("new"))
    moves = visits.filter("visit_id % 3 = 0").select(F.lit("UPDATE").alias("op"), side.alias("old"), later.alias("new"))
    deletes = visits.filter("visit_id % 3 = 1").select(F.lit("DELETE").alias("op"), side.alias("old"), none.alias("new"))
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    for part in (inserts, moves, deletes):
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        maintain.maintain_utilization(stream, out, mark).awaitTermination(120)
    kept = visits.filter("visit_id % 3 = 2").unionByName(
        visits.filter("visit_id % 3 = 0")
        .withColumn("doctor_id", (F.col("doctor_id") + 1) % 16)
        .withColumn("appointment_date", F.date_add("appointment_date", 1))
        .withColumn("status", F.lit("completed"))
    )
    want = rows(utilization_cells(kept))
    summary = maintain.read_maintained(spark, out)
    got = {k: v for k, v in rows(summary).items() if any(v)}
    assert got == want
    assert maintain.drift_rows(maintain.drift(summary, kept)).count() == 0
    # the same micro-batch written again replaces itself
    once = spark.read.parquet(out).filter("batch = 1")
    again = [tuple(r) for r in once.collect()]
    spark.createDataFrame(again, once.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch").parquet(out)
    assert {k: v for k, v in rows(maintain.read_maintained(spark, out)).items() if any(v)} == want


def test_update_mode_stream(spark, tmp_path):
    feed = [change("INSERT", None, (1, A, "scheduled", 30)), change("INSERT", None, (1, A, "no_show", 10))]
    frame = spark.createDataFrame(feed, SCHEMA)
    frame.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "feed"))
    query = (
        maintain.accumulate(maintain.utilization_deltas(stream)).writeStream.outputMode("update").format("memory")
        .queryName("cells_live").trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert rows(spark.table("cells_live")) == {(1, A): (1, 0, 0, 1, 40)}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("specialty", T.StringType()), T.StructField("status", T.StringType())])
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [(at(8, 10), "a", "completed"), (at(8, 40), "a", "cancelled"), (at(9, 5), "a", "scheduled")],
        [(at(12, 0), "a", "completed")],
        [(at(8, 20), "a", "completed"), (at(15, 0), "a", "completed")],
    ]
    folder = str(tmp_path / "live")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = (
            maintain.demand_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        )
        query.awaitTermination(60)
    out = {r["hour_start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[8] == 1 and out[9] == 1 and out[12] == 1


def test_reconcile_job_reports_and_repairs(spark, tmp_path):
    visits = tables.visits(spark, "/root/testdata/sf0.001")
    stored = str(tmp_path / "summary")
    cells = utilization_cells(visits)
    broken = cells.withColumn("booked_minutes", F.col("booked_minutes") + F.when(F.col("doctor_id") == 3, 30).otherwise(0))
    sinks.write_by_date(broken, stored, "appointment_date", "doctor_id")
    as_of = dt.date(2024, 1, 30)
    read = lambda: spark.read.parquet(stored)
    run = lambda **kw: jobs.run_reconcile(read(), visits, as_of=as_of, report_to=str(tmp_path / "drift"), **{"days": 10, **kw})
    report = run()
    assert report["drift_count"] > 0 and not report["repaired"]
    found = spark.read.json(report["report"]).collect()
    assert len(found) == report["drift_count"] and all(r["field"] == "minutes" and r["actual"] - r["expected"] == 30 for r in found)
    assert run(repair_to=stored)["repaired"]
    spark.catalog.refreshByPath(stored)
    assert run()["drift_count"] == 0
    # older dates were not part of the job and stay as they were
    assert run(days=60)["drift_count"] > 0
    assert read().count() == cells.select(*CELL).count()


def start(spark, frame, folder, feed, mark, **settings):
    frame.write.mode("append").parquet(feed)
    maintain.maintain_utilization(spark.readStream.schema(frame.schema).parquet(feed), folder, mark, **settings).awaitTermination(120)


def test_second_checkpoint_keeps_the_first_streams_counts(spark, tmp_path):
    one = spark.createDataFrame([change("INSERT", None, (1, A, "scheduled", 30))], SCHEMA)
    two = spark.createDataFrame([change("INSERT", None, (1, A, "completed", 20)), change("INSERT", None, (2, B, "no_show", 10))], SCHEMA)
    out = str(tmp_path / "out")
    start(spark, one, out, str(tmp_path / "f1"), str(tmp_path / "m1"))
    start(spark, two, out, str(tmp_path / "f2"), str(tmp_path / "m2"))
    want = {(1, A): (1, 1, 0, 0, 50), (2, B): (0, 0, 0, 1, 10)}
    assert rows(maintain.read_maintained(spark, out)) == want
    start(spark, one, out, str(tmp_path / "f3"), str(tmp_path / "m3"), stream_id="mine")
    with pytest.raises(ValueError, match="another checkpoint"):
        start(spark, one, out, str(tmp_path / "f3"), str(tmp_path / "m4"), stream_id="mine")
    # compaction keeps the sums, and a stream goes on in the new folder
    target = str(tmp_path / "compacted")
    maintain.compact(spark, out, target)
    assert rows(maintain.read_maintained(spark, target)) == rows(maintain.read_maintained(spark, out))
    start(spark, one, target, str(tmp_path / "f1"), str(tmp_path / "m1"))
    assert rows(maintain.read_maintained(spark, target))[1, A] == (3, 1, 0, 0, 110)


def test_reconcile_repairs_a_streamed_table(spark, tmp_path):
    visits = tables.visits(spark, "/root/testdata/sf0.001")
    side = F.struct("doctor_id", "appointment_date", "status", "duration_minutes").cast(SIDE)
    none = F.lit(None).cast(SIDE)
    missed = visits.filter("visit_id % 7 <> 0").select(F.lit("INSERT").alias("op"), none.alias("old"), side.alias("new"))
    twice = visits.filter("visit_id % 11 = 0").select(F.lit("DELETE").alias("op"), side.alias("old"), none.alias("new"))
    out = str(tmp_path / "out")
    start(spark, missed.unionByName(twice).unionByName(twice), out, str(tmp_path / "feed"), str(tmp_path / "mark"))
    run = lambda repair: jobs.run_stream_reconcile(
        spark, out, visits, as_of=dt.date(2024, 1, 30), report_to=str(tmp_path / "drift"), days=400, repair=repair
    )
    assert run(False)["drift_count"] > 0
    assert run(True)["repaired"] and run(False)["drift_count"] == 0
    assert {k: v for k, v in rows(maintain.read_maintained(spark, out)).items() if any(v)} == {k: v for k, v in rows(utilization_cells(visits)).items() if any(v)}
