"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "censemble", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by the cluster in ``spark.checkpoint.dir``.

    A temporary folder is only made for a local master, where driver and executors are one
    process; anywhere else a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="censemble-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    Used where rows must not be worked out twice, because later steps read them several times or
    rely on every reader seeing the same placement. Losing executors does not lose the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _stored_paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stored_paths: list[str] = []


def clear_stored(spark: SparkSession) -> int:
    """Delete what ``stored`` has written in this process; results built on it end with it.

    Called when the process ends, if its session is still there. Returns the number of folders.
    """
    fs_of = spark._jvm.org.apache.hadoop.fs.Path
    done = 0
    while _stored_paths:
        path = fs_of(_stored_paths.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


@atexit.register
def _clear_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_stored(spark)
