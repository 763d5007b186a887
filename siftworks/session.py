"""Session settings and the two helpers every operator shares: table reads and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "siftworks", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which need not have it on their path. Call it for a session of your own."""
    if any(f.endswith("/siftworks.zip") for f in spark.sparkContext.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="siftworks-ship-"), "siftworks"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, redistributed by key before per-row work that costs more than the shuffle.
    Large inputs have more splits than cores and pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where nothing is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftworks-ckpt-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which every executor can reach."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The rows as a table written to the shared folder: survives the loss of any executor, and later readers take only
    the columns they need. Rows with long arrays are read in smaller batches where a row group has at most ``group_rows``."""
    path = shared_folder(df.sparkSession, "cut")
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
