"""Session defaults, lineage cutting and shared scratch space."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "unitscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Pass further settings as keywords with ``__`` for ``.``, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder; a cluster without it is refused,
    because a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="unitscope-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/unitscope/{uuid.uuid4().hex}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more: all that came of it has been cut or written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which an idle driver puts off for
    long while the files of finished steps fill the executors' disks.
    """
    for _ in range(2):  # what the first round frees may hold other things
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
