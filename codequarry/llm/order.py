"""Places in a sorted order, found without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.shared import partitions, sized, stage

#: Bits of `monotonically_increasing_id` below the partition's number.
_ROW_BITS = 33
#: Names that no input column may have.
_AT, _PART, _SALT, _FIRST = "_at", "_part", "_salt", "_first"


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df, staged, with `idx`, the row's place in its group from 0, and `n`, the rows of the group.

    Group columns may not be null; nulls of order columns come first. The rows are dealt by ranges
    of group and order and sorted inside each task, so a group of any size is spread over many
    tasks; only its count per task meets in a window. Rows that tie in every column are spread too.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    spread = (df.withColumn(_SALT, F.rand(0))
              .repartitionByRange(partitions(df.sparkSession), *keys, F.col(_SALT))
              .sortWithinPartitions(*keys).drop(_SALT)
              .withColumn(_AT, F.monotonically_increasing_id()))
    rows = stage(spread).withColumn(_PART, F.shiftright(_AT, _ROW_BITS))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = sized(stage(
        rows.groupBy(_PART, *group).agg(F.min(_AT).alias(_FIRST), F.count("*").alias("_rows"))
        .select(_PART, *group, F.sum("_rows").over(whole).alias("n"),
                (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col(_FIRST)).alias("_shift"))))
    return (rows.join(parts, [_PART, *group])
            .select(*df.columns, (F.col(_AT) + F.col("_shift")).alias("idx"), "n"))
