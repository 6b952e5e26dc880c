"""Joins and orders on keys that a large share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.plans.stage import stage

#: Rows of one key that may meet in one task of a join.
KEY_ROWS = 10_000
#: Rows of the other side that may be broadcast for the keys beyond; there are fewer such keys
#: than rows / KEY_ROWS.
BROADCAST_ROWS = 500_000
#: Bits of `marked`, a multiple of 2**15.
MARK_BITS = 1 << 26


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it meets the other by a shuffle.

    Spark takes a worked-out text for 20 bytes and a Parquet file for its packed size, so it would
    send sides of any size through the driver to every executor.
    """
    return df.hint("merge")


def sized(df: DataFrame) -> DataFrame:
    """A staged frame, marked for broadcast if it has few enough rows, else for a shuffle."""
    df = stage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


def marked(df: DataFrame, on: list[str], ids: DataFrame, mark: str) -> DataFrame:
    """df with `mark`, which is true of all rows whose columns `on` are among those of the ids, and of few others.

    The ids travel as bits at places that their hashes choose, of which the driver holds MARK_BITS at most.
    """
    def placed(rows: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(*on), F.lit(MARK_BITS))
        return rows.withColumn("_row", F.shiftright(slot, 15)).withColumn("_at", slot.bitwiseAND(F.lit((1 << 15) - 1)).cast("int"))

    # dealt before they are put together: a task's rows of bits would be far larger than its ids
    bits = (placed(ids.select(*on)).select("_row", "_at").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row")
            .groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = placed(df).join(F.broadcast(bits), "_row", "left")
    return found.select(*df.columns, F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7))) == 1, F.lit(False)).alias(mark))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """An inner join with a table that has each key once.

    Keys with many rows on the left are joined where those rows are, as their few partners are
    broadcast; the others meet by a shuffle. `left` is read three times: pass a staged frame.
    """
    many = left.groupBy(*on).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > key_rows).select(*on)
    hot = stage(right.join(many, on, "left_semi"))
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return left.join(shuffled(right), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(shuffled(right), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def split_join(left: DataFrame, right: DataFrame, on: list[str], size: int = KEY_ROWS) -> DataFrame:
    """An inner join in which both sides may repeat a key as often as they like.

    The rows of a key beyond `size` are cut into blocks on either side, and each pair of blocks is
    a key of its own. Both sides are read several times: pass staged frames.
    """
    counts = [df.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(c)) for df, c in ((left, "n_i"), (right, "n_j"))]
    many = stage(counts[0].join(shuffled(counts[1]), on).where("n_i > 1 OR n_j > 1"))
    if not 0 < many.count() <= BROADCAST_ROWS:
        return left.join(shuffled(right), on)
    many = F.broadcast(many)

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        row = F.pmod(F.xxhash64(*[c for c in df.columns if c not in on]), F.col(f"n_{own}")).cast("int")
        return df.join(many, on).withColumn(own, row).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_i", "n_j")

    few = left.join(many, on, "left_anti").join(shuffled(right), on)
    return few.unionByName(cut(left, "i", "j").join(shuffled(cut(right, "j", "i")), [*on, "i", "j"]).drop("i", "j"))


def dealt(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """df with `block`: the rows of each group in order, `size` to a block.

    Ranges of group and order are sorted task by task; only their row counts meet in a window. A
    block ends where a task's rows end, so it may be smaller.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)))
    starts = rows.groupBy(group, "task").agg(F.min("place").alias("start"), F.count("*").alias("n_rows"))
    blocks = F.ceil(F.col("n_rows") / size)
    before = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(group, "task", "start", F.coalesce(F.sum(blocks).over(before), F.lit(0)).alias("before"))
    # a row per task and group: few enough not to send all rows once more
    return rows.join(sized(starts), [group, "task"]).withColumn(
        "block", (F.col("before") + F.floor((F.col("place") - F.col("start")) / size)).cast("int")).drop(
            "place", "task", "start", "before")
