"""Cutting a plan where several reports read one expensive frame."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """A frame that is worked out once, however many reports read it.

    Where the session names a shared folder (`spark.checkpoint.dir`), the frame is written there
    and read back: readers load only their columns and a lost executor costs a re-read. Elsewhere
    it is kept by the executors as it is first read, and parts that are lost are worked out anew;
    nothing is written to a folder of one machine. `spark.catalog.clearCache()` lets go of it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
