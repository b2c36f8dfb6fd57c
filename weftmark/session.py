"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "weftmark") -> SparkSession:
    """A local session for tests and the bench. Cluster jobs bring their own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("WEFTMARK_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or the context's)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured shared folder; create a local one only for ``local[...]`` sessions (tests).

    On any other master a folder of one machine is not seen by the others, so a missing
    ``spark.checkpoint.dir`` is an error there.
    """
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
    d = tempfile.mkdtemp(prefix="weftmark-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for stage tables and stream sinks."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/weftmark/{name}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; the folder goes when the application ends."""
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its unfinished tasks, not the stages before. The
    result is a plain scan, so a join of it can split a skewed key.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input, as the source counts them, for one partition of pages.
PARTITION_BYTES = 64 << 20


def size_partitions(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for an exchange of ``df``: the bytes of its inputs over ``each``, and at least ``spark.sql.shuffle.partitions``.

    The bytes are the optimizer's for the tables that the plan reads, such as the sizes of files. Inputs
    whose size it does not know, such as rows given by the driver, count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 16, -(-size // each)))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
