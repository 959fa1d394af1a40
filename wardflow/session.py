"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Only behaviour, never sizes: executor memory and the number of shuffle
# partitions belong to the cluster. AQE picks the partition count at run time,
# splits skewed join partitions and turns a join into a broadcast once a side
# has been measured to be below the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Actions submitted at once; each is a sequence of jobs that leaves part of a cluster idle.
CONCURRENT_JOBS = 4


def concurrently(spark: SparkSession, tasks: Iterable[Callable[[], object]]) -> list:
    """Results of independent actions, in order. Their jobs are submitted from several threads, which Spark runs side by side."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(CONCURRENT_JOBS) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def local_session(cores: int = 8, name: str = "wardflow", memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables.

    It is the one the cluster names, which driver and executors share. A
    folder of this machine is taken only where they are one process.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wardflow-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df):
    """Cut a lineage that is read many times (model fitting, iterative jobs).

    Uses the reliable checkpoint in the shared folder, so a lost executor costs
    a re-read and not a recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back; :func:`drop_stored` deletes it when it is of no more use."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder behind a table that :func:`stored` returned."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if not folder.getName().startswith("table-"):
        raise ValueError(f"{folder.getName()} is no stored table")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
