"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "voxelkeel", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; cluster values win where already set."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that lineage is cut in and intermediate tables are written to.

    It is what the session names in ``spark.checkpoint.dir``. Where nothing is named, a session whose
    executors run in the driver takes a temporary folder, removed at exit; a cluster must name one,
    since its executors would not see the driver's disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """A new path in the shared checkpoint folder, for tables a job writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    For intermediate results several later steps read: the work before is done once and
    survives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def unsized(df):
    """``df`` kept out of broadcasts, for tables that grow with the data.

    The planner takes what an explode, a grouping of exploded rows or Python makes for about as
    large as what was read, so it would send millions of rows through the driver.
    """
    return df.hint("merge")


def spread(df, *keys: str):
    """Hash ``df`` by ``keys`` over all shuffle partitions before work that grows its rows or runs Python.

    Such inputs are small in bytes, so adaptive coalescing would put them into one task; a
    repartition to a stated number is left as it is, and a following grouping on ``keys``
    reuses it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
