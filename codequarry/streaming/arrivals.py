"""The per-file analysis over files as they arrive.

Analysing a file looks at no other file, so the batch operator runs unchanged on a
stream; nothing is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.analysis import analyse_files


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """files(project, path, content) from Parquet files dropped into a folder."""
    return spark.readStream.schema("project string, path string, content string").parquet(folder)


def analyse_arrivals(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the analysis of everything present now to ``out``; run again for later files."""
    rows = analyse_files(files).drop("content")
    return (rows.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
