"""Session defaults for tests and local benches. A cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("goodsledger")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, a temporary one only where none is named.

    Iterative jobs call this before ``DataFrame.checkpoint``. On a cluster ``spark.checkpoint.dir``
    points at shared storage, so a lost executor does not lose the state.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder before running this job on {master}")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet below the checkpoint folder and read back.

    Joins on one key run in one stage, and each keeps memory for two sorts in every task: a long chain of them is cut
    here, and what several tables are made of is worked out once.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Put this package on the Python workers' path, once per Spark application.

    Python functions are pickled by reference, so workers must be able to import them wherever the
    driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_goodsledger_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "goodsledger_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._goodsledger_shipped = True
