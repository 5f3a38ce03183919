"""Session helpers for the library's own use."""

from __future__ import annotations

import gc
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster whose workers do not see that folder, install the package there or pass it
    with ``--py-files``."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets where checkpoints go: the session's ``spark.checkpoint.dir``, which all executors share.

    Only a local master may go without that setting (tests): it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: iterations need a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parlance-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referred to.

    Spark removes them when the driver's garbage is collected, which a driver with little to
    do may put off until disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(master)
        .appName("parlance")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARLANCE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    ship(spark)
    return spark
