"""Patient history kept from a change feed, so that scoring does not read the visits again.

The table holds one row per patient and day with an outcome: the counts of the day
and the running counts up to it. It is divided into buckets of patients; an update
writes the buckets it touches as a new version, and readers take the newest version
of each bucket. A replayed update writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKETS = 64
ROW = "patient_id long, day date, n long, k long, upto_n long, upto_k long"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("patient_id"), F.lit(BUCKETS)).cast("int")


def outcome_deltas(changes: DataFrame) -> DataFrame:
    """``patient_id, day, n, k``: what a batch of changes adds to the outcomes and no-shows of a day.

    A change is ``(op, old STRUCT, new STRUCT)`` with patient_id,
    appointment_date and status on both sides; only resolved visits count.
    """
    def side(name: str, sign: int) -> Column:
        status = F.col(f"{name}.status")
        return F.when(status.isin("completed", "no_show"), F.struct(
            F.col(f"{name}.patient_id").cast("long").alias("patient_id"), F.col(f"{name}.appointment_date").alias("day"),
            F.lit(sign).cast("long").alias("n"), F.when(status == "no_show", sign).otherwise(0).cast("long").alias("k")))

    minus = F.when(F.col("op").isin("UPDATE", "DELETE"), side("old", -1))
    plus = F.when(F.col("op").isin("UPDATE", "INSERT"), side("new", 1))
    both = F.filter(F.array(minus, plus), lambda d: d.isNotNull())
    return changes.select(F.inline(both)).groupBy("patient_id", "day").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_history(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest rows of every bucket, of versions below ``before``. Only the files of these versions are read."""
    empty = spark.createDataFrame([], ROW).withColumn("bucket", F.lit(0)).filter("false")
    if not _exists(spark, folder):
        return empty
    table = spark.read.schema(f"{ROW}, version int, bucket int").parquet(folder)
    # Versions and buckets are folder names: at most BUCKETS rows come back.
    parts = table.filter(F.lit(True) if before is None else F.col("version") < before).groupBy("bucket").agg(F.max("version").alias("version"))
    newest: dict[int, list[int]] = {}
    for r in parts.collect():
        if buckets is None or r["bucket"] in buckets:
            newest.setdefault(r["version"], []).append(r["bucket"])
    if not newest:
        return empty
    wanted = F.lit(False)
    for version, of in newest.items():
        wanted = wanted | ((F.col("version") == version) & F.col("bucket").isin(of))
    return table.filter(wanted).drop("version")


def update_history(changes: DataFrame, folder: str, version: int) -> None:
    """Apply a batch of changes as ``version``, which must grow from batch to batch.

    Days that change move the running counts of all later days of the patient,
    so the rows of a touched bucket are added up again; other buckets stay.
    """
    spark = changes.sparkSession
    deltas = outcome_deltas(changes).filter("patient_id IS NOT NULL AND day IS NOT NULL").withColumn("bucket", _bucket())
    touched = sorted(r["bucket"] for r in deltas.select("bucket").distinct().collect())
    if not touched:
        return
    before = read_history(spark, folder, version, touched).select("bucket", "patient_id", "day", "n", "k")
    daily = before.unionByName(deltas.select("bucket", "patient_id", "day", "n", "k")).groupBy("bucket", "patient_id", "day").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")).filter("n <> 0 OR k <> 0")
    upto = Window.partitionBy("bucket", "patient_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # days of a calendar
    rows = daily.withColumn("upto_n", F.sum("n").over(upto)).withColumn("upto_k", F.sum("k").over(upto)).withColumn("version", F.lit(version))
    # A bucket that has become empty still needs its new version: one row without a patient.
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        "bucket", F.lit(None).cast("long").alias("patient_id"), F.lit(None).cast("date").alias("day"),
        *[F.lit(0).cast("long").alias(c) for c in ("n", "k", "upto_n", "upto_k")], F.lit(version).alias("version"))
    out = rows.unionByName(marks).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(folder)


def maintain_history(changes: DataFrame, folder: str, checkpoint: str):
    """Start the stream that keeps the table; a micro-batch is a version."""
    return changes.writeStream.foreachBatch(lambda batch, number: update_history(batch, folder, number)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asof_maintained(candidates: DataFrame, history: DataFrame, query_day: str = "booked_at") -> DataFrame:
    """``candidates`` with ``prior_n, prior_k, days_since_last`` of the outcomes dated before their query day.

    The same as :func:`history.asof_history`, from the kept rows of the
    candidates' patients: the last one before the day has the running counts.
    """
    day = F.to_date(query_day)
    asked = candidates.select("patient_id", day.alias("day")).filter("patient_id IS NOT NULL AND day IS NOT NULL").distinct()
    kept = history.filter("n > 0").join(asked.select("patient_id").distinct(), "patient_id", "left_semi")
    seen = kept.select("patient_id", "day", F.struct("upto_n", "upto_k", "day").alias("_state"), F.lit(False).alias("_asked"))
    both = seen.unionByName(asked.select("patient_id", "day", F.lit(None).cast(seen.schema["_state"].dataType).alias("_state"), F.lit(True).alias("_asked")))
    # On its own day a question comes before the outcomes.
    before = Window.partitionBy("patient_id").orderBy("day", F.desc("_asked")).rowsBetween(Window.unboundedPreceding, -1)
    state = both.withColumn("_last", F.last("_state", ignorenulls=True).over(before)).filter("_asked").select("patient_id", F.col("day").alias("_day"), "_last")
    zero = F.lit(0).cast("long")
    return candidates.withColumn("_day", day).join(state, ["patient_id", "_day"], "left").select(
        *candidates.columns, F.coalesce("_last.upto_n", zero).alias("prior_n"), F.coalesce("_last.upto_k", zero).alias("prior_k"),
        F.datediff("_day", "_last.day").alias("days_since_last"))
