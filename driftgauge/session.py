"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SINGLE_TASK_ROWS = "spark.driftgauge.singleTaskRows"
DEFAULT_SINGLE_TASK_ROWS = 500_000


def local_session(cores: str = "*", app: str = "driftgauge") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def single_task_rows(spark: SparkSession) -> int:
    """Most rows of one key that may be ordered inside one task."""
    return int(spark.conf.get(SINGLE_TASK_ROWS, str(DEFAULT_SINGLE_TASK_ROWS)))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; local sessions without one get a fresh temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="driftgauge-ckpt-")


def settled(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder, so later reads see the same rows after a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same in Parquet: much smaller than a checkpoint, read by column, and its size is known, so that a small frame is broadcast."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
