"""Projection of star-schema tables to the visit contract, and the entity readers.

The raw tables are read as they are; each function is a lazy projection, so
column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardflow.functions import scalar as X
from wardflow.operators import history


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, partition_column: str, lower, upper,
               partitions: int, properties: dict | None = None) -> DataFrame:
    """Partitioned read of a transactional database (one range per task)."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


# --- visits from the event table (time of day, unique key) --------------------
def visits(spark: SparkSession, folder: str, *, first_visit_flag: bool = False) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    duration = F.greatest(F.lit(5), F.least(F.lit(240), F.floor("value"))).cast("int")
    start = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    out = events.withColumn("k", k).select(
        F.col("event_id").alias("visit_id"),
        F.col("user_id").alias("patient_id"),
        (F.col("k") % 16).cast("long").alias("doctor_id"),
        (F.col("k") % 4).cast("long").alias("clinic_id"),
        F.when(F.col("k") % 9 != 0, F.col("k") % 8).cast("long").alias("room_id"),
        F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("specialty"),
        F.col("ts").cast("date").alias("appointment_date"),
        start.alias("start_minute"),
        (start + duration).alias("end_minute"),
        duration.alias("duration_minutes"),
        F.when(F.col("event_type") == "error", "no_show")
        .when(F.col("event_type") == "view", "cancelled")
        .when(F.col("event_type") == "signup", "scheduled")
        .otherwise("completed")
        .alias("status"),
        F.when(F.col("k") % 10 == 9, "emergency")
        .when(F.col("k") % 10 == 8, "urgent")
        .otherwise("routine")
        .alias("urgency"),
        (F.col("k") / 100.0).alias("no_show_probability"),
    )
    return history.flag_first_visit(out) if first_visit_flag else out


def visit_feed(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event time, specialty and status of each visit: the live-feed projection."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "view", "cancelled").otherwise("completed")
    return table(spark, folder, "events").select(
        "ts", F.concat(F.lit("s"), (k % 5).cast("string")).alias("specialty"), status.alias("status"), *keep
    )


# --- bookings from the order tables (booking date, so lead time and history) --
def bookings(spark: SparkSession, folder: str) -> DataFrame:
    # Only what a booking needs is joined, days as dates: the joins shuffle every row.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("_booked"))
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    items = table(spark, folder, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(part, items.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_suppkey").alias("doctor_id"),
            F.col("p_type").alias("specialty"),
            F.col("l_shipdate").alias("appointment_date"),
            (F.lit(480) + (F.col("l_partkey") + F.col("l_linenumber") * 7) % 44 * 15)
            .cast("int")
            .alias("start_minute"),
            F.col("l_quantity").cast("int").alias("duration_minutes"),
            F.when(F.col("l_returnflag") == "R", "no_show")
            .when(F.col("l_returnflag") == "A", "completed")
            .otherwise("cancelled")
            .alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "emergency")
            .when(F.col("o_orderpriority") == "2-HIGH", "urgent")
            .otherwise("routine")
            .alias("urgency"),
            (F.col("l_linenumber") == 1).alias("is_new_patient"),
            F.col("_booked").alias("booked_at"),
        )
    )


# --- dimensions ---------------------------------------------------------------
def doctors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("doctor_id"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        (F.col("s_suppkey") % 4).alias("clinic_id"),
        (F.col("s_suppkey") % 7 != 6).alias("is_active"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("patient_id"),
        F.col("c_name").alias("last_name"),
        F.col("c_mktsegment").alias("first_name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
    )


def clinics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("clinic_id"),
        F.col("n_name").alias("name"),
        (F.lit(420) + F.col("n_nationkey") % 4 * 30).alias("open_minute"),
        (F.lit(1080) + F.col("n_nationkey") % 4 * 30).alias("close_minute"),
    )


def rooms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("room_id"),
        (F.col("n_nationkey") % 4).cast("long").alias("clinic_id"),
        F.col("n_name").alias("name"),
        (F.lit(1) + F.col("n_nationkey") % 3).alias("capacity"),
        (F.col("n_nationkey") % 6 != 5).alias("is_active"),
    )


def specialties(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "part")
        .select(F.col("p_type").alias("specialty"))
        .distinct()
        .withColumn("default_duration_minutes", F.lit(10) + F.length("specialty") % 4 * 5)
    )


def specialty_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (doctor, specialty) pairs with a primary flag."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    return (
        items.join(part, items.l_partkey == part.p_partkey)
        .select(F.col("l_suppkey").alias("doctor_id"), F.col("p_type").alias("specialty"))
        .distinct()
        .withColumn("is_primary", F.col("specialty").isin("ECONOMY", "PROMO"))
    )


# The weekly pattern (weekdays, start minute, end minute).
WEEKLY_PATTERN = [
    ((1, 2, 3, 4, 5), 480, 750),
    ((1, 2, 3, 4, 5), 810, 1140),
    ((6,), 540, 780),
]


def availability(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly windows of every doctor: morning, afternoon, and some Saturdays."""
    pattern = F.array(
        *[
            F.struct(F.lit(day).alias("weekday"), F.lit(start).alias("start_minute"), F.lit(end).alias("end_minute"))
            for days, start, end in WEEKLY_PATTERN
            for day in days
        ]
    )
    doctor = F.col("s_suppkey")
    return (
        table(spark, folder, "supplier")
        .select(doctor.alias("doctor_id"), F.explode(pattern).alias("w"))
        .select("doctor_id", "w.*")
        .filter((F.col("weekday") < 6) | (F.col("doctor_id") % 3 == 0))
        .withColumn("effective_from", F.lit(dt.date(1995, 1, 1)))
        .withColumn("effective_to", F.when(F.col("doctor_id") % 10 == 3, F.lit(dt.date(2024, 1, 20))))
        .withColumn("is_active", F.col("doctor_id") % 11 != 10)
    )


def visit_span(spark: SparkSession, folder: str) -> tuple[Column, Column]:
    """First and last date of the visits, as scalars of one subquery."""
    day = F.to_date(F.col("ts"))
    bounds = spark.read.parquet(f"{folder}/events.parquet").agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("b"))
    return bounds.scalar()["lo"], bounds.scalar()["hi"]


# --- readers over the contract --------------------------------------------------
def load_visits(frame: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                day: str = "appointment_date") -> DataFrame:
    """Whole fact frame, optionally between two inclusive dates."""
    if start is not None:
        frame = frame.filter(F.col(day) >= F.lit(start))
    if end is not None:
        frame = frame.filter(F.col(day) <= F.lit(end))
    return frame


def load_active(frame: DataFrame, *order: str) -> DataFrame:
    return frame.filter("is_active").orderBy(*order)


def doctor_windows(frame: DataFrame, doctor_id: int | None = None, on: dt.date | None = None) -> DataFrame:
    out = frame.filter("is_active")
    if doctor_id is not None:
        out = out.filter(F.col("doctor_id") == doctor_id)
    if on is not None:
        out = out.filter(X.effective_on(F.lit(on)))
    return out.orderBy("doctor_id", "weekday", "start_minute")


def past_and_all(frame: DataFrame, as_of: dt.date | Column) -> tuple[DataFrame, DataFrame]:
    """(resolved visits before ``as_of``, every visit), with the derived columns."""
    every = frame.withColumn("hour", X.hour_of()).withColumn("weekday", X.weekday0())
    past = every.filter((F.col("appointment_date") < F.lit(as_of)) & X.resolved())
    past = past.withColumn("no_show", X.outcome())
    if "booked_at" in frame.columns:
        past = past.withColumn("lead_days", X.lead_days())
    return past, every


def history_of(frame: DataFrame, keys: DataFrame, key: str = "patient_id") -> DataFrame:
    """All visits of the patients in ``keys``.

    The key side is reduced to distinct keys before the join; the fact side is
    only probed, so a patient holding a large share of the rows splits in AQE.
    """
    return frame.join(keys.select(key).distinct(), key, "left_semi")


def training_summary(frame: DataFrame) -> DataFrame:
    """Size, dates and rates of a training frame, read once.

    Rows are reduced to one per (patient, specialty) first; the two exact
    distinct counts then run over those rows.
    """
    part = frame.groupBy("patient_id", "specialty").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(X.resolved()).alias("_resolved"),
        F.sum(X.outcome()).alias("_missed"),
        F.min("appointment_date").alias("_first"),
        F.max("appointment_date").alias("_last"),
    )
    return part.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("_resolved"), F.lit(0)).alias("resolved_rows"),
        X.half_even(F.sum("_missed") / F.nullif(F.sum("_resolved"), F.lit(0)), 4, exact=True).alias("no_show_rate"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct("specialty").alias("specialties"),
    )

def schedule_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-cancelled visit as a request for the time it was booked at."""
    live = visits(spark, folder).filter(X.occupies())
    return live.select(
        "visit_id",
        "clinic_id",
        "appointment_date",
        "doctor_id",
        "room_id",
        "specialty",
        F.col("start_minute").alias("requested_start_minute"),
        "duration_minutes",
        "urgency",
        "no_show_probability",
    )


def schedule_plans(requests: DataFrame, spreads: dict[int, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """Schedules, by id, that delay each request by 0..spread-1 grid steps; all in one frame."""
    plans = F.array(*[F.struct(F.lit(i).cast("long").alias("schedule_id"), F.lit(n).alias("spread")) for i, n in spreads.items()])
    rows = requests.select("*", F.inline(plans))
    start = X.grid_up("requested_start_minute") + (F.col("visit_id") % F.col("spread") * X.GRID_MINUTES).cast("int")
    return rows.select(
        "schedule_id",
        "clinic_id",
        "appointment_date",
        "visit_id",
        "doctor_id",
        "room_id",
        start.alias("start_minute"),
        (start + F.col("duration_minutes")).alias("end_minute"),
        "duration_minutes",
        "no_show_probability",
        *keep,
    )


def schedule_entries(requests: DataFrame, schedule_id: int, spread: int) -> DataFrame:
    """One schedule, see :func:`schedule_plans`."""
    return schedule_plans(requests, {schedule_id: spread})
