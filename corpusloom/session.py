"""Session construction for scripts, tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session with the settings that the library's plans assume (AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a local session (tests) that names none gets a temporary one, a cluster an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))


def work_folder(spark: SparkSession) -> str:
    """The name of a new folder that the driver and all executors see, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpusloom-{uuid4().hex}"


#: Inputs up to this size are dealt out anew if they come in fewer pieces than there are cores.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame, small: int = SMALL_INPUT) -> DataFrame:
    """A small input over all cores, as a few files (or one row group) would keep the others idle; larger inputs stay as they are.

    Only rows move, results do not change; the shuffle is bounded by ``small``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= small and df.rdd.getNumPartitions() < cores else df
