"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketlake.session import batches_by_bytes as batches_by_bytes
from docketlake.session import work_dir


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir`` and read it back.

    Later stages then depend on files all executors can reach, so a lost executor
    costs the tasks that were running and nothing that was finished.
    """
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
