"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "wickerloom") -> SparkSession:
    """A session for tests and the bench on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WICKERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir where the cluster names one.

    Only a local master without that setting gets a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="wickerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning for later readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wickerloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, for costly work on rows of a small table; a larger one is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def release(spark: SparkSession) -> None:
    """Delete what materialise wrote; results that still read it become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/wickerloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
