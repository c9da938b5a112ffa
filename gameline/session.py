"""Session settings."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading

from pyspark.sql import SparkSession

PIECES_A_CORE = 4
_shipped: set[str] = set()
_shipping = threading.Lock()

# Settings a long-running batch job wants; all of them are runtime SQL settings.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where a later operator would have to shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to an existing session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gameline",
                  memory: str = "8g") -> SparkSession:
    """A session on one machine, for tests and bench runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    return tune(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once per application."""
    app = spark.sparkContext.applicationId
    with _shipping:  # fits run side by side, and Spark takes a file of this name once
        if app not in _shipped:
            package = os.path.dirname(os.path.abspath(__file__))
            bundle = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "gameline-bundle"), "zip",
                                         os.path.dirname(package), os.path.basename(package))
            spark.sparkContext.addPyFile(bundle)
            _shipped.add(app)
    return spark


def pieces(spark: SparkSession) -> int:
    """The most pieces of a frame that many jobs go over: every core is busy, and what tasks report does not grow with the rows."""
    return max(32, PIECES_A_CORE * spark.sparkContext.defaultParallelism)


def use_checkpoint_folder(spark: SparkSession) -> bool:
    """Set the folder for checkpoints that the session names; says whether there is one."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return True
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    return bool(folder)


def cut(df):
    """Cut a long lineage: a reliable checkpoint where the cluster names a folder for it.

    Without such a folder the frame keeps its lineage, which is always recoverable.
    """
    return df.checkpoint() if use_checkpoint_folder(df.sparkSession) else df
