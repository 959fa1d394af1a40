"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardflow.session import materialize

# The letters that ASCII lower-casing maps.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of one Arrow batch sent to a Python worker, so that a run of very long texts does not fill its memory.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever other columns the table has.

    A name is matched exactly, else without regard to case; columns that
    differ from another one only by case, or repeat its name, are no obstacle.
    """
    columns = df.columns
    where = []
    for name in names:
        exact = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not exact:
            raise ValueError(f"column {name} is missing, there are {columns}")
        where.append(exact[0])
    by_place = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return by_place.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(where, names)])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does the same on pure ASCII and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once a row.

    Projections are merged by the optimizer, which would otherwise repeat the
    value inside a lambda for every element; a lambda's own variable is not
    repeated.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    materialize_folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if materialize_folder.isEmpty():
        materialize(spark.range(1))
        materialize_folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{materialize_folder.get()}/corpus-{uuid.uuid4().hex}"


#: Removes the shuffle files of a job when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage and survives lost executors.

    The shuffle files behind it are of no more use then, and are removed.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once nothing reads it any more. Frames that are no stored table are left alone."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if folder.getName().startswith("corpus-"):
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def byte_values(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the n + 1 bounds of its rows."""
    values = byte_values(column)
    bounds = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return np.frombuffer(b"".join(values), np.uint8), bounds


def groups_of_bytes(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``most`` bytes, a longer text standing alone."""
    for batch in batches:
        sizes = np.array([len(v) for v in byte_values(batch.column("text"))], np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of ``a``, ``b``: rows (``node``, ``root``), the root being the smallest node.

    Large-star and small-star rounds: each links every node to the smallest
    one it knows of, first for larger then for smaller neighbours, until no
    edge changes. A round is made of equi joins and aggregates on edges; no
    component is ever gathered, and the joins with a hot centre can be split.
    Self-loops and repeated edges are no obstacle; no edges give no rows.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def ranks(df: DataFrame, key: str, order: list[str], block_rows: int = 50_000) -> DataFrame:
    """``df`` with ``rank``, counted from 0 within ``key`` and no task holding a whole hot key.

    Rows are dealt to blocks by a hash of ``order``; block counts are added
    up per key, and a window numbers the rows inside a block. The order of
    rows of a key is thus fixed by their values, but it is not sorted.
    """
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = dealt.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_block")) - F.col("_n")).drop("_n")
    inside = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1)
    return inside.join(before, [key, "_block"]).withColumn("rank", F.col("_before") + F.col("_row")).drop("_block", "_before", "_row")
