"""Session helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings the operators assume. AQE turns a shuffled join into a broadcast
# only after it has *measured* the small side, and splits skewed partitions.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files (per-customer tables, pinned rank partitions) are
    # removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rfmlens") -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster the master and shuffle partitions come from spark-submit;
    locally we default to ``local[*]`` with one shuffle partition per core.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a one-process local session (not
    ``local-cluster``) without the setting gets a fresh folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="rfmlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for files of one run; they go when the
    driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rfmlens-{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath.getParent())
    return path


def small_side(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (a shuffled
    join). The rows are read once, ``rows`` + 1 at most, and a small table is made of them, so nothing stays cached."""
    found = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if len(found) <= rows else df
