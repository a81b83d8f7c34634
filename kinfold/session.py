"""Session construction and lineage helpers.

Every job leans on adaptive query execution: the runtime broadcast switch
checks the real size of a shuffled side before broadcasting it, and the
skew-join rule splits a hot partition of a join into several tasks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of the library runs with.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partition counts as skewed above 4x the median and 64 MB.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # Runtime (measured) broadcast bound for data-dependent sides.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "kinfold",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if master and master.startswith("local"):
        # Local runs: the driver is the executor too.
        conf["spark.driver.memory"] = os.environ.get("KINFOLD_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when the
    session has none (local tests) fall back to a fresh scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = configured
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = fallback or tempfile.mkdtemp(prefix="kinfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of an executor, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Materialize a frame that several branches of a plan read (a fork in
    the lineage), so the shared upstream runs once and the logical plan
    stays small (an aggregate joined back onto its own input references it
    twice, so chained steps would otherwise double the plan each time).

    ``kinfold.materialize=table`` (default): write parquet under the shared
    ``spark.checkpoint.dir`` and read it back -- survives executor loss,
    keeps column pruning and filter pushdown for the readers.
    ``checkpoint``: reliable ``DataFrame.checkpoint``.
    ``persist``: MEMORY_AND_DISK cache only (does not shorten the plan).
    """
    spark = df.sparkSession
    mode = spark.conf.get("kinfold.materialize", "table")
    if mode == "table":
        base = ensure_checkpoint_dir(spark)
        path = f"{base.rstrip('/')}/kinfold-tables/{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    if mode == "checkpoint":
        return cut_lineage(df)
    if mode == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table below the shared ``spark.checkpoint.dir`` and read it
    back; the path is the caller's, who drops it when nothing reads it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinfold-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made."""
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(hadoop).delete(at, True)
