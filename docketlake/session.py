"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are tuned for.  All of them may also be set
# cluster-wide; nothing here fixes a partition count for a large cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "docketlake", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **RUNTIME_CONF,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        # Small inputs still use all local cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors can reach.

    Uses ``spark.checkpoint.dir`` as the cluster names it.  Only a local master
    may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        base = current
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="docketlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows over all cores, whatever their size: for rows of a few bytes that take long, which a small file holds in one task.

    Dealt in turn, a task sorts its rows first; ``by`` columns that tell them apart, none is sorted.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


BATCH_BYTES = "4m"


def batches_by_bytes(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, since a batch of long texts by rows may be tens of MB in every task.

    A session setting; a value that the caller has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)
