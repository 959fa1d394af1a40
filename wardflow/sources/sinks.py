"""Parquet and JSON sinks of the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.functions import scalar as X
from wardflow.operators.quality import duplicates
from wardflow.operators.schedule import SCHEDULE, WEIGHTS

FORECAST_KEY = ["clinic_id", "specialty", "appointment_date", "hour_of_day", "model_version"]


def schedule_header(scores: DataFrame, solver_status: str = "FEASIBLE", is_baseline: bool = False,
                    weights: dict[str, float] | None = None) -> DataFrame:
    """Header row per schedule, the weights as JSON."""
    w = weights or WEIGHTS["balanced"]
    pairs = [x for name, value in w.items() for x in (F.lit(name), F.lit(float(value)))]
    return scores.select(
        *SCHEDULE,
        F.lit(solver_status).alias("solver_status"),
        F.lit(is_baseline).alias("is_baseline"),
        F.col("objective").cast("decimal(12,3)").alias("objective_value"),
        F.col("total_delay_minutes").alias("total_wait_minutes"),
        "total_idle_minutes",
        "total_overtime_minutes",
        F.col("urgency_penalty").cast("decimal(12,3)").alias("urgency_penalty"),
        F.to_json(F.create_map(*pairs)).alias("weights"),
    )


def schedule_rows(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per assignment; the wait is one-sided, 0 for an unknown request."""
    asked = requests.select("visit_id", "requested_start_minute")
    requested = F.coalesce("requested_start_minute", "start_minute")
    return entries.join(asked, "visit_id", "left").select(
        *SCHEDULE,
        "visit_id",
        "doctor_id",
        X.wall_clock("start_minute").alias("assigned_start"),
        X.wall_clock("end_minute").alias("assigned_end"),
        F.greatest(F.col("start_minute") - requested, F.lit(0)).alias("wait_minutes"),
    )


def weights_from_json(header: DataFrame) -> DataFrame:
    return header.withColumn("weights", F.from_json("weights", "map<string,double>"))


def write_by_date(df: DataFrame, folder: str, day: str = "appointment_date", *sort: str) -> None:
    """Date partitions, each written by few tasks and sorted inside for row-group skipping.

    Rows are spread by (date, first sort column), so one heavy date does not land
    in a single writer.
    """
    out = df.repartition(day, *sort[:1])
    if sort:
        out = out.sortWithinPartitions(day, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def write_schedule(header: DataFrame, rows: DataFrame, folder: str) -> None:
    write_by_date(header, f"{folder}/schedule")
    write_by_date(rows, f"{folder}/schedule_entry", "appointment_date", "doctor_id")


def write_bucketed(df: DataFrame, table: str, folder: str, key: str, buckets: int, day: str | None = None) -> None:
    """A Parquet table in buckets of ``key``, sorted inside, and in partitions of ``day`` if one is given.

    Tables of the same key and number of buckets join on it without a shuffle,
    and a join with some days reads their partitions only. The catalogue knows
    the table as ``table``; :func:`open_bucketed` tells it again in a later session.
    """
    out = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", folder)
    if day:
        out = out.partitionBy(day)
    out.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def open_bucketed(spark: SparkSession, table: str, folder: str, key: str, buckets: int, day: str | None = None) -> DataFrame:
    """A table of :func:`write_bucketed` in a session whose catalogue does not know it."""
    columns = ", ".join(f"`{name}` {kind}" for name, kind in spark.read.parquet(folder).dtypes)
    parted = f"PARTITIONED BY (`{day}`)" if day else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {parted} CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    if day:
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def write_forecast(cells: DataFrame, folder: str, model_version: str, clinic_id: int = 0) -> None:
    """Forecast cells of one model version; refuses cells that are not unique."""
    out = cells.withColumn("model_version", F.lit(model_version))
    if "clinic_id" not in cells.columns:
        out = out.withColumn("clinic_id", F.lit(clinic_id).cast("long"))
    if not duplicates(out, FORECAST_KEY).isEmpty():
        raise ValueError("forecast cells are not unique")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(folder)


def write_report(metrics: DataFrame, folder: str) -> None:
    metrics.write.mode("overwrite").json(folder)
