"""A Merkle manifest of a table of documents, by sibling-shift self-joins.

Every row is a leaf, the digest of its columns. Leaves of one language ascend by id; every FANOUT
consecutive nodes of a level become their parent, until one node, the subroot, remains. Subroots,
ordered by language, form one more tree above, whose last node is the root.

A level is a table of nodes (tree, idx, digest). Its siblings are at computed places: idx XOR 1 if
the fan-out is two, else the other slots of the run of FANOUT places. For each slot offset the
level is shifted onto the place of its sibling and equijoined with itself; rows of slot zero then
emit the parents. Going down again, a node's path is its own siblings followed by its parent's
path, so a leaf carries all it needs to be folded to the root.

Rows without a language are the first tree. Rows without an id come first in their tree; rows that
tie in id are ordered by their leaf, so equal rows may change places freely; they get proofs of
places of their own, in either order. Null texts are told from empty ones. Extra columns do not
matter. An empty table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.order import numbered
from codequarry.llm.shared import stage

#: Nodes that share a parent.
FANOUT = 8
#: Columns of a document that its leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in bytes before it; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256, as bytes, of the parts one after another."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(digests: Column) -> Column:
    """Digests, one or several in a row, as lowercase hexadecimal text."""
    return F.lower(F.hex(digests))


def leaf_of(values: dict[str, Column]) -> Column:
    return digest(*(field(values[c]) for c in COVERED))


def lowered(docs: DataFrame) -> tuple[Column, Column]:
    """(who, text) of the stated tampering: where 3 divides the CRC-32 of the id, A-Z are lower-cased."""
    who = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return who, F.translate(docs["text"], ascii_uppercase, ascii_lowercase)


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes with `before` and `after`: their siblings' digests, those of earlier and of later slots."""
    slot = F.col("idx") % fanout
    out = nodes
    for shift in range(1, fanout):
        place = (F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2
                 else F.col("idx") - slot + (slot + fanout - shift) % fanout)
        # h1 is the digest of the next slot, counted around the run, h2 of the one after that
        out = out.join(nodes.select("tree", place.alias("idx"), F.col("h").alias(f"h{shift}")),
                       ["tree", "idx"], "left")

    # the slots after a node's own are the first shifts, those before it are the last
    found = {s: F.coalesce(f"h{s}", F.lit(b"")) for s in range(1, fanout)}
    return out.select(
        "tree", "idx", "n", "h",
        F.concat(*(F.when(slot >= fanout - s, h).otherwise(F.lit(b"")) for s, h in found.items())).alias("before"),
        F.concat(*(F.when(slot < fanout - s, h).otherwise(F.lit(b"")) for s, h in found.items())).alias("after"))


def climb(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all trees, from (tree, idx, n, h) leaves up: staged nodes with their siblings.

    n is the number of nodes of the tree on that level; where it is 1 the node is the subroot and
    has no parent.
    """
    levels = []
    most = leaves.agg(F.max("n")).first()[0]
    nodes = leaves
    while most is not None:
        level = stage(_with_siblings(nodes, fanout))
        levels.append(level)
        if most <= 1:
            break
        nodes = (level.where((F.col("idx") % fanout == 0) & (F.col("n") > 1))
                 .select("tree", (F.col("idx") / fanout).cast("long").alias("idx"),
                         F.ceil(F.col("n") / fanout).alias("n"),
                         digest(shown(F.concat("h", "after"))).alias("h")))
        most = -(-most // fanout)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, idx, path, subroot, root) per leaf; tops: (tree, path, subroot, root) of the single nodes.

    The path lists (before, after) of a leaf and of its ancestors, upwards.
    """
    known = None
    for level in reversed(levels):
        paths = level.where("n = 1").join(tops, "tree").select("tree", "idx", "path", "subroot", "root")
        if known is not None:
            up = known.select("tree", F.col("idx").alias("up"), F.col("path").alias("above"), "subroot", "root")
            own = F.array(F.struct("before", "after"))
            paths = paths.unionByName(
                level.where("n > 1").withColumn("up", (F.col("idx") / fanout).cast("long"))
                .join(up, ["tree", "up"])
                .select("tree", "idx", F.concat(own, "above").alias("path"), "subroot", "root"))
        known = stage(paths)
    return known


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one digest."""
    parts = F.transform(path, lambda s: F.concat(s["before"], s["after"]))
    joined = F.aggregate(parts, F.lit(""), lambda a, s: F.concat(a, shown(s)))
    return F.sha2(joined, 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root, in hexadecimal, that a leaf and the siblings on its path give."""
    return F.aggregate(path, shown(leaf),
                       lambda a, s: F.sha2(F.concat(shown(s["before"]), a, shown(s["after"])), 256))


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered=lowered) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of documents.

    `tampered` takes the documents and gives (condition, text): rows that meet the condition are
    verified with that text in place of their own; folded_root is what their leaf then leads to.
    """
    rows = docs.select(*COVERED)
    who, text = tampered(rows)
    own = {c: F.col(c) for c in COVERED}
    leaves = numbered(
        rows.select(F.concat(F.lit("="), "lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                    leaf_of(own).alias("h"),
                    F.when(who, leaf_of(own | {"text": text})).alias("changed"))
        .select(F.coalesce("tree", F.lit("")).alias("tree"), "doc_id", "h",
                F.when(F.col("changed") != F.col("h"), F.col("changed")).alias("changed")),
        ["tree"], ["doc_id", "h"])
    leaves = stage(leaves)
    levels = climb(leaves.select("tree", "idx", "n", "h"), fanout)
    if not levels:
        return _proven(leaves.withColumn("path", F.lit(None).cast("array<struct<before:binary,after:binary>>"))
                       .withColumn("subroot", F.lit(None).cast("binary")).withColumn("root", F.lit(None).cast("binary")))

    single = reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "h") for x in levels])
    forest = stage(numbered(single, [], ["tree"]))
    upper = climb(forest.select(F.lit("").alias("tree"), "idx", "n", "h"), fanout)
    # above the root there is nothing; its own step has no siblings and is left out
    top = upper[-1].where("n = 1").select(
        "tree", F.array().cast("array<struct<before:binary,after:binary>>").alias("path"),
        F.col("h").alias("subroot"), F.col("h").alias("root"))
    above = descend(upper, top, fanout).select("idx", "path", "root")
    tops = stage(forest.select(F.col("tree"), "idx", F.col("h").alias("subroot")).join(above, "idx")
                 .select("tree", "path", "subroot", "root"))
    paths = descend(levels, tops, fanout)
    return _proven(leaves.join(paths, ["tree", "idx"]))


def _proven(leaves: DataFrame) -> DataFrame:
    out = leaves.select(
        "doc_id", shown(F.col("h")).alias("leaf"), shown(F.col("subroot")).alias("subroot"),
        shown(F.col("root")).alias("root"), proof(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
