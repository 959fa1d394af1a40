"""Utilisation summary kept from a change feed, and its reconciliation.

A change is ``(op, old STRUCT, new STRUCT)`` with doctor_id, appointment_date,
status and duration_minutes on both sides.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardflow.functions import scalar as X
from wardflow.operators.operations import CELL, COUNTS, utilization_cells

MEASURES = [*COUNTS, "booked_minutes"]
FIELDS = {"scheduled": "scheduled_count", "completed": "completed_count", "cancelled": "cancelled_count",
          "no_show": "no_show_count", "minutes": "booked_minutes"}


def _contribution(side: str, sign: int) -> Column:
    status = F.col(f"{side}.status")
    one = lambda value: F.when(status == value, sign).otherwise(0).cast("long")
    return F.struct(
        F.col(f"{side}.doctor_id").alias("doctor_id"),
        F.col(f"{side}.appointment_date").alias("appointment_date"),
        one("scheduled").alias("scheduled_count"),
        one("completed").alias("completed_count"),
        one("cancelled").alias("cancelled_count"),
        one("no_show").alias("no_show_count"),
        F.when(X.occupies(status), F.col(f"{side}.duration_minutes") * sign).otherwise(0).cast("long").alias("booked_minutes"),
    )


def utilization_deltas(changes: DataFrame) -> DataFrame:
    """-old and +new per change, each on its own (doctor, date). Batch or stream."""
    minus = F.when(F.col("op").isin("UPDATE", "DELETE"), _contribution("old", -1))
    plus = F.when(F.col("op").isin("UPDATE", "INSERT"), _contribution("new", 1))
    both = F.filter(F.array(minus, plus), lambda d: d.isNotNull())
    return changes.select(*[c for c in ("changed_at",) if c in changes.columns], F.explode(both).alias("d")).select(
        *[c for c in ("changed_at",) if c in changes.columns], "d.*"
    )


def accumulate(deltas: DataFrame) -> DataFrame:
    """Sum per cell, floored at 0. As a stream it runs in update or complete mode."""
    return deltas.groupBy(*CELL).agg(
        *[F.greatest(F.sum(c), F.lit(0).cast("long")).alias(c) for c in MEASURES]
    )


def _has(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def maintain_utilization(changes: DataFrame, folder: str, checkpoint: str, *, stream_id: str | None = None, available_now: bool = True):
    """Start the maintenance stream: one aggregated delta file set per micro-batch.

    A replayed batch overwrites its own ``stream_id=S/batch=N`` partition, so a
    restart after a lost driver or executor never counts a change twice. The
    id is that of the checkpoint folder if none is given; several streams may
    write to one folder. A new checkpoint cannot take over an id that already
    has batches there, as its batch numbers would start again.
    """
    spark = changes.sparkSession
    name = stream_id or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    if _has(spark, f"{folder}/stream_id={name}") and not _has(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"stream {name} has written to {folder} with another checkpoint: continue that one, or give a new stream_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_deltas(utilization_deltas(batch).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in MEASURES]), folder, name, batch_id)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def _write_deltas(deltas: DataFrame, folder: str, stream_id: str, batch: int) -> None:
    (
        deltas.select(*CELL, *MEASURES)
        .withColumn("stream_id", F.lit(stream_id))
        .withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stream_id", "batch")
        .parquet(folder)
    )


def read_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """The sum of all batches per cell, not floored."""
    return spark.read.parquet(folder).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in MEASURES])


def read_maintained(spark: SparkSession, folder: str) -> DataFrame:
    return accumulate(spark.read.parquet(folder))


def write_correction(compared: DataFrame, folder: str) -> None:
    """Append what is missing to the recount as a batch of its own."""
    delta = compared.select(*CELL, *[(F.col(f"e_{c}") - F.col(f"a_{c}")).alias(c) for c in MEASURES])
    _write_deltas(delta, folder, f"correction-{uuid.uuid4().hex}", 0)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Sum all batches into one in a new folder.

    Run it while no stream writes; the streams then go on with their own
    checkpoints in ``target``, where their later batches are added to the sum.
    """
    _write_deltas(read_deltas(spark, folder), target, f"base-{uuid.uuid4().hex}", 0)


def drift(summary: DataFrame, visits: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Recount against the stored summary, both sides kept; expected/actual per field."""
    if since is not None:
        visits = visits.filter(F.col("appointment_date") >= F.lit(since))
        summary = summary.filter(F.col("appointment_date") >= F.lit(since))
    expected = utilization_cells(visits).select(*CELL, *[F.col(c).alias(f"e_{c}") for c in MEASURES])
    actual = summary.select(*CELL, *[F.col(c).alias(f"a_{c}") for c in MEASURES])
    zero = F.lit(0).cast("long")
    joined = expected.join(actual, CELL, "full_outer")
    for c in MEASURES:
        joined = joined.withColumn(f"e_{c}", F.coalesce(f"e_{c}", zero)).withColumn(f"a_{c}", F.coalesce(f"a_{c}", zero))
    return joined


def differs() -> Column:
    """True for a compared cell with any field that differs."""
    out = F.lit(False)
    for c in MEASURES:
        out = out | (F.col(f"e_{c}") != F.col(f"a_{c}"))
    return out


def floored(compared: DataFrame) -> DataFrame:
    """A comparison with the stored side floored at 0, as readers see it."""
    return compared.withColumns({f"a_{c}": F.greatest(f"a_{c}", F.lit(0).cast("long")) for c in MEASURES})


def recounted(compared: DataFrame) -> DataFrame:
    """The cells of a comparison with their recounts."""
    return compared.select(*CELL, *[F.col(f"e_{c}").alias(c) for c in MEASURES])


def drift_rows(compared: DataFrame) -> DataFrame:
    """One row per (cell, field) that differs."""
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(f"e_{c}").alias("expected"), F.col(f"a_{c}").alias("actual"))
            for name, c in FIELDS.items()
        ]
    )
    return compared.select(*CELL, F.inline(fields)).filter("expected <> actual")


def repaired(summary: DataFrame, visits: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Summary with every drifted cell set to its recount.

    As in the stored procedure, a summary cell without visits is set to zeros.
    """
    compared = drift(summary, visits, since)
    fresh = recounted(compared)
    if since is None:
        return fresh
    return summary.filter(F.col("appointment_date") < F.lit(since)).select(*CELL, *MEASURES).unionByName(fresh)


def demand_stream(visits: DataFrame, event_time: str = "ts", lateness: str = "1 hour", width: str = "1 hour",
                  keys: tuple[str, ...] = ("specialty",)) -> DataFrame:
    """Visits per hour on a live feed; rows later than the watermark are dropped.

    The time column is cast to a zoned timestamp first: a watermark is not
    allowed on a timestamp without zone.
    """
    return (
        visits.withColumn(event_time, F.col(event_time).cast("timestamp"))
        .filter(X.occupies())
        .withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour_start"), *keys, "n")
    )
