"""The trie of conversation openings, by ROLLUP over positional turn-id columns.

A conversation becomes rows of BLOCK turn ids, t1 to t8; one ROLLUP over these columns gives every
prefix of every conversation, `grouping_id` its depth. A longer conversation goes on in further
rows that are grouped by the node which its earlier block ends in. A second ROLLUP over the nodes
found adds up what lies below each of them; totals of blocks are first added to the blocks above
them by pointer doubling, in as many rounds as the logarithm of the longest conversation's blocks.

A turn id is 16 bytes of the SHA-256 of role and text, and the number of words. A node is known by
128 bits, the exclusive or of two hashes of its turn ids and their places, so that the node a block
starts from needs no chain of jobs: 2**-128 per pair that two different ones agree.

No task holds a whole group: turns are placed by `numbered`, ROLLUP adds up before it shuffles,
joins on nodes with many children broadcast those few nodes, and the ids that end in one node are
digested as a stream of pieces.

Null roles and texts are empty. Turns come in the order of `turn`, null first, those that tie in
the order of their ids. Rows without a conv_id belong to no conversation and are left out. Rows that
repeat are turns of their own. A table without conversations has no nodes, not even a root. Extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.order import numbered
from codequarry.llm.shared import sized, stage

#: Turn-id columns of a block.
BLOCK = 8
#: Rows of one key that meet in one task: more are cut into pieces or sent to no task at all.
PIECE = 4_096
WORD = r"[^\x20\x09-\x0D]+"
_ID_BYTES = 16
_NODE = ["f1", "f2", "depth"]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) and 4 that hold the number of words."""
    role, text = (F.coalesce(x.cast("string"), F.lit("")) for x in (role, text))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0")
    return F.concat(F.unhex(F.substring(told, 1, 2 * _ID_BYTES)), F.unhex(words))


def words_of(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, _ID_BYTES + 1, 4)), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, n, t): the turns of each conversation in order; n: how many it has."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(F.col("role"), F.col("text")).alias("t"))
    return stage(numbered(rows, ["conv_id"], ["turn", "t"]).select("conv_id", "idx", "n", "t"))


def kept_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (placed, sizes), see `prefix_trie`."""
    return (turns.select("conv_id", F.col("idx").alias("pos"), F.col("n").alias("size"), "t"),
            turns.where("idx = 0").select("conv_id", F.col("n").alias("size")))


def regrown_turns(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `head` turns (`most` at most) are those of the conversation `base`.

    base and head are expressions of conv_id. A base that is absent gives no turns, one with fewer
    turns all it has; a conversation's own turns follow from its number `head` on.
    """
    sizes = turns.where("idx = 0").select("conv_id", "n")
    wanted = sizes.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least("head", F.coalesce("base_n", F.lit(0)))
    plan = stage(wanted.join(bases, "base", "left").select(
        "conv_id", "n", "base", "head", lead.alias("lead"),
        (lead + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size")))
    heads = turns.where(F.col("idx") < most).select(F.col("conv_id").alias("base"), F.col("idx").alias("pos"), "t")
    led = (plan.where("lead > 0").join(heads, "base").where("pos < lead").select("conv_id", "pos", "size", "t"))
    piece = (F.col("idx") / PIECE).cast("long")
    pieces = plan.where("n > head").withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / PIECE).cast("long"))))
    own = (turns.select("conv_id", piece.alias("piece"), "idx", "t")
           .join(pieces.select("conv_id", "piece", "head", "lead", "size"), ["conv_id", "piece"])
           .where("idx >= head")
           .select("conv_id", (F.col("lead") + F.col("idx") - F.col("head")).alias("pos"), "size", "t"))
    return led.unionByName(own), plan.select("conv_id", "size")


def _marks(pos: Column, turn: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at a place; zero where there is none."""
    return tuple(F.when(turn.isNotNull(), F.xxhash64(F.lit(seed), pos, turn)).otherwise(F.lit(0).cast("long"))
                 for seed in (1, 2))


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _turns(block: int) -> list[str]:
    return [f"t{i}" for i in range(1, block + 1)]


def _inside(block: int) -> tuple[Column, Column]:
    """The hashes of all turns of a row."""
    both = [_marks(F.col("block") * block + i, F.col(t)) for i, t in enumerate(_turns(block), 1)]
    return _xor([a for a, _ in both]), _xor([b for _, b in both])


def blocks_of(placed: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(conv_id, size, block, p1, p2, t1, ..): rows of `block` turns and the node each starts from."""
    at = F.col("pos") % block
    rows = (placed.withColumn("block", (F.col("pos") / block).cast("long"))
            .groupBy("conv_id", "block")
            .agg(F.max("size").alias("size"),
                 *(F.max(F.when(at == i, F.col("t"))).alias(t) for i, t in enumerate(_turns(block)))))
    none = [F.lit(None).cast("binary").alias(t) for t in _turns(block)]
    rows = stage(rows.unionByName(sizes.where("size = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), "size", *none)))
    x1, x2 = _inside(block)
    zero = F.lit(0).cast("long")
    # exclusive or of all earlier blocks, first inside pieces, then over the pieces
    slim = (rows.where(F.col("size") > block)
            .select("conv_id", "block", (F.col("block") / PIECE).cast("long").alias("piece"),
                    x1.alias("x1"), x2.alias("x2")))
    before = Window.partitionBy("conv_id", "piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = (slim.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
             .select("conv_id", "piece", *(F.coalesce(F.bit_xor(x).over(above), zero).alias(f"w{x}") for x in ("x1", "x2"))))
    starts = (slim.select("conv_id", "piece", "block",
                          *(F.coalesce(F.bit_xor(x).over(before), zero).alias(x) for x in ("x1", "x2")))
              .join(whole, ["conv_id", "piece"])
              .select("conv_id", "block", F.col("x1").bitwiseXOR(F.col("wx1")).alias("p1"),
                      F.col("x2").bitwiseXOR(F.col("wx2")).alias("p2")))
    first = rows.where("block = 0").select("*", zero.alias("p1"), zero.alias("p2"))
    return stage(first.unionByName(rows.where("block > 0").join(starts, ["conv_id", "block"])))


def _rollup(rows: DataFrame, block: int, measures: str) -> DataFrame:
    """The measures of every prefix of t1, t2, ..; d: its length inside the block."""
    turns = ", ".join(_turns(block))
    found = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {turns}, {block} - bit_count(grouping_id()) AS d, {measures} "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({turns})", rows=rows)
    # a conversation that ends inside the block has no longer prefixes; the node a block starts
    # from belongs to the block before
    last = F.coalesce(*(F.when(F.col("d") == i, F.col(t)) for i, t in enumerate(_turns(block), 1)))
    return found.withColumn("last", last).where("last IS NOT NULL OR d = 0 AND block = 0")


def _nodes(rows: DataFrame, block: int) -> DataFrame:
    x1, x2 = _inside(block)
    depth = F.col("block") * block + F.col("d")
    y1, y2 = _marks(depth, F.col("last"))
    f1, f2 = F.col("p1").bitwiseXOR(x1), F.col("p2").bitwiseXOR(x2)
    words = F.coalesce(words_of(F.col("last")), F.lit(0))
    return stage(_rollup(rows, block, "min(conv_id) AS conv_id, count(*) AS n_convs").select(
        "block", "p1", "p2", *_turns(block), "d", depth.alias("depth"), f1.alias("f1"), f2.alias("f2"),
        f1.bitwiseXOR(y1).alias("g1"), f2.bitwiseXOR(y2).alias("g2"), "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * words).alias("saved")))


def _hot_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame) -> DataFrame:
    """An inner join on keys unique in `right`; counts: (keys, rows) of `left`.

    The few keys with many rows are joined where the rows are, the others by a shuffle.
    """
    hot = sized(stage(right.join(counts.where(F.col("rows") > PIECE), on, "left_semi")))
    rest = left.join(hot, on, "left_anti").join(right, on)
    return left.join(hot, on).unionByName(rest)


def _below(values: DataFrame, links: DataFrame) -> DataFrame:
    """(block, p1, p2, saved, leaves): all that lies below the nodes which later blocks start from.

    values: what each block holds itself; links: (block, p1, p2) and the block (q1, q2) above it.
    """
    key = ["block", "p1", "p2"]
    totals = stage(values.where("block > 0").join(links, key, "left"))
    step = 1
    while True:
        up = totals.where(F.col("block") > step).select(
            (F.col("block") - step).alias("block"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
            F.col("block").alias("from"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), "saved", "leaves")
        if up.isEmpty():
            return totals.select(*key, "saved", "leaves")
        added = stage(up.groupBy(*key).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"),
                                           F.count("*").alias("rows")))
        higher = _hot_join(up, totals.select(*key, "q1", "q2"), key, added.select(*key, "rows")).select(
            F.col("from").alias("block"), F.col("r1").alias("p1"), F.col("r2").alias("p2"), "q1", "q2")
        totals = stage(
            totals.select(*key, "saved", "leaves").join(added, key, "left").join(higher, key, "left")
            .select(*key, (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                    (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), "q1", "q2"))
        step *= 2


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces, which come in order."""
    def row(key, told) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in key] + [pa.array([told.hexdigest()], pa.string())],
            [*_NODE, "ends_sha256"])

    key, told = None, None
    for batch in batches:
        for *now, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            if now != key:
                if told:
                    yield row(key, told)
                key, told = now, hashlib.sha256()
            else:
                told.update(b",")
            told.update(ids.as_py().encode())
    if told:
        yield row(key, told)


def ends(rows: DataFrame, block: int) -> DataFrame:
    """(f1, f2, depth, ends_sha256) of the nodes that conversations end in."""
    x1, x2 = _inside(block)
    last = (F.greatest(F.col("size") - 1, F.lit(0)) / block).cast("long")
    done = rows.where(F.col("block") == last).select(
        F.col("p1").bitwiseXOR(x1).alias("f1"), F.col("p2").bitwiseXOR(x2).alias("f2"),
        F.col("size").alias("depth"), "conv_id")
    pieces = stage(
        numbered(done, _NODE, ["conv_id"])
        .groupBy(*_NODE, (F.col("idx") / PIECE).cast("long").alias("piece"))
        .agg(F.max("n").alias("n"),
             F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids")))
    one = pieces.where(F.col("n") <= PIECE).select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))
    more = (pieces.where(F.col("n") > PIECE).repartition(*_NODE).sortWithinPartitions(*_NODE, "piece")
            .select(*_NODE, "ids").mapInArrow(_streamed, "f1 long, f2 long, depth long, ends_sha256 string"))
    return one.unionByName(more)


def prefix_trie(placed: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct opening of the conversations: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    placed: (conv_id, pos, size, t), the turns from 0 on; sizes: (conv_id, size), also of
    conversations without turns. A node is named by its smallest member and its depth.
    saved_tokens adds up, over a node's subtree, the words of each last turn times its members but
    one; ends_sha256 digests the ids of the conversations that end in the node.
    """
    rows = blocks_of(placed, sizes, block)
    nodes = _nodes(rows, block)
    up = (F.col("depth") - 1).alias("depth")
    kids = nodes.where("depth > 0").select(F.col("g1").alias("f1"), F.col("g2").alias("f2"), up,
                                           F.col("f1").alias("k1"), F.col("f2").alias("k2"))
    counts = stage(kids.groupBy(*_NODE).agg(F.count("*").alias("rows")))
    parents = _hot_join(kids, nodes.select(*_NODE, F.col("conv_id").alias("parent_conv_id")), _NODE, counts).select(
        F.col("k1").alias("f1"), F.col("k2").alias("f2"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    full = stage(
        nodes.join(counts.withColumnRenamed("rows", "n_children"), _NODE, "left")
        .join(parents, _NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long")))

    key = ["block", "p1", "p2"]
    values = full.where("d > 0").groupBy(*key).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    links = full.where((F.col("d") == block) & (F.col("n_children") > 0)).select(
        (F.col("block") + 1).alias("block"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
        F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    below = _below(values, links).select(
        F.col("p1").alias("f1"), F.col("p2").alias("f2"), (F.col("block") * block).alias("depth"),
        F.col("saved").alias("more"), F.col("leaves").alias("more_leaves"))
    whole = full.join(below, _NODE, "left").select(
        *key, *_turns(block), "d", F.struct(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children").alias("own"),
        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
    # of all rows under a prefix, the node itself is the shortest
    found = _rollup(whole.withColumnRenamed("d", "own_d"), block,
                    "min_by(own, own_d) AS own, sum(saved) AS saved_tokens, sum(leaves) AS n_leaves")
    none = hashlib.sha256(b"").hexdigest()
    return (found.select("own.*", "saved_tokens", "n_leaves").join(ends(rows, block), _NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
