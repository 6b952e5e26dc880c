"""Similar files by TF-IDF cosine, as an exact filtered self-join on terms.

Files with equal term counts can never be in the result (their cosine is 1), so they are one
class. Terms are ordered rarest first; a pair above the threshold shares a term while both
remaining norms still exceed it, so only that prefix of each vector is indexed. The index lists
blocks of classes, not classes: blocks that share an indexed term are multiplied as sparse matrices,
and only pairs above the threshold leave the task. Neighbouring blocks are sent together, as tiles:
each two tiles that hold such blocks are a task of its own, so a vector is sent once per tile, not
once per block. A block is sent as one row, its entries by term and compressed: counts of terms, from
which the task works out the weights, and no term that only one file has. Classes are put into blocks in the order of their most common and rarest terms, so
that those of one language and subject are neighbours and other blocks need not meet.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.operators.rollup import top_k
from codequarry.operators.spread import dealt, sized
from codequarry.plans.stage import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLACK = 1e-9
#: Classes of one block, and terms of its matrix that are multiplied at a time.
BLOCK, TERMS = 1024, 2048
#: Products of one term in two blocks from which on they are taken as a matrix; below, one by one,
#: this many at a time.
DENSE, PRODUCTS = 20_000, 2_000_000
#: Blocks whose meetings are marked at once, squared.
_SQUARE = 4096
#: Bytes of the packed entries of one tile, and tiles of the project with the most blocks, if it has so many.
TILE_BYTES, TILES = 64 << 20, 8
#: Files of one class that are spelled out in one task.
_MEMBERS = 4096


def term_counts(files: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(project, path, term, tf), counted inside each row."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{2,}+"), F.lit(0))
    rows = files.select("project", "path", F.inline(X.word_counts(words)))
    stop = C.STOPWORDS if stopwords is None else stopwords
    return rows.where(~F.col("word").isin(stop)).select(
        "project", "path", F.col("word").alias("term"), F.col("cnt").alias("tf"))


def vocabulary(terms: DataFrame, files: DataFrame, max_terms: int | None = None) -> DataFrame:
    """(project, term, df, idf, n) of each project, n its files. ``max_terms`` keeps only the most frequent ones."""
    n = files.groupBy("project").agg(F.count("*").alias("n"))
    kept = terms.groupBy("project", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if max_terms is not None:
        kept = top_k(kept, ["project"], [F.desc("total"), F.asc("term")], max_terms)
    return kept.join(n, "project").select(
        "project", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "n")


def vectors(files: DataFrame, stopwords: list[str] | None = None,
            max_terms: int | None = None) -> DataFrame:
    """(project, path, sig, total, ids, dfs, tfs): the terms of each file, rarest first, in how many of the
    project's `total` files they are and how often in this one; equal ``sig`` = equal vector. A term's id is
    a hash of 64 bits. `_weights` makes unit vectors of them."""
    terms = stage(term_counts(files, stopwords))
    vocab = vocabulary(terms, files, max_terms).select("project", "term", "df", F.xxhash64("term").alias("id"), F.col("n").alias("total"))
    entries = terms.join(vocab, ["project", "term"]).groupBy("project", "path").agg(
        F.any_value("total").alias("total"), F.sort_array(F.collect_list(F.struct("df", "id", "tf"))).alias("v"))
    return entries.select(
        "project", "path",
        F.md5(F.array_join(F.transform("v", lambda e: F.concat_ws(
            ":", e["id"].cast("string"), e.tf.cast("string"))), ",")).alias("sig"), "total",
        F.transform("v", lambda e: e["id"]).alias("ids"), F.transform("v", lambda e: e["df"]).alias("dfs"),
        F.transform("v", lambda e: e["tf"].cast("long")).alias("tfs"))


def vector_classes(vectors_: DataFrame) -> DataFrame:
    """(project, sig, cid, n, first, total, ids, dfs, tfs): one row per distinct vector, ``n`` files having
    it, ``first`` the first of them."""
    distinct = vectors_.groupBy("project", "sig").agg(
        F.count("*").alias("n"), F.min("path").alias("first"),
        *(F.any_value(c).alias(c) for c in ("total", "ids", "dfs", "tfs")))
    return stage(distinct.withColumn("cid", F.xxhash64("project", "sig")))


def _ramps(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ..., n numbers each, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)


def _weights(total: int, df: np.ndarray, tf: np.ndarray) -> np.ndarray:
    return tf * (np.log((1 + total) / (1 + df)) + 1)


def _packed(above: float):
    """One row for a block: its classes with the norms of their vectors, the terms the block is indexed under, and
    its entries by term: each term with its number of files and of entries, then rows and counts of the entries."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = {c: rows.column(c).combine_chunks() for c in ("ids", "dfs", "tfs")}
        size = pa.compute.list_value_length(lists["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)
        term, df, tf = (pa.compute.list_flatten(x).to_numpy(zero_copy_only=False) for x in lists.values())
        total = rows.column("total")[0].as_py()
        row, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        squares = _weights(total, df, tf) ** 2
        norm = np.sqrt(np.add.reduceat(squares, begin))
        squares /= (norm ** 2)[row]
        # of each entry and those after it: what stays within the threshold is not indexed
        after = np.cumsum(squares[::-1])[::-1]
        rest = after - np.append(after, 0)[begin + size][row]
        shared = df > 1
        index = np.unique(term[shared & (np.sqrt(np.maximum(rest, 0)) > above - _SLACK)])
        term, df, tf, row = term[shared], df[shared], tf[shared], row[shared]
        order = np.lexsort((row, term))
        term, row, tf, df = term[order], row[order], tf[order], df[order]
        start = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(term)))
        numbers = [term[start], df[start], count, row, tf]
        raw = np.array([len(start), len(row)]).tobytes() + b"".join(
            np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in numbers)
        out = {c: rows.column(c)[:1] for c in ("project", "block", "total")}
        out |= {c: pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in (("cid", pa.int64()), ("n", pa.int64()), ("first", pa.string()))}
        return pa.table(out | {"norm": pa.array([norm], pa.list_(pa.float64())), "index": pa.array([index], pa.list_(pa.int64())),
                               "size": pa.array([len(raw)], pa.int64()), "entries": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})
    return run


_BLOCK = ("project string, block int, total long, cid array<long>, n array<long>, first array<string>, "
          "norm array<double>, index array<long>, size long, entries binary")


def _meeting(rows: pa.Table) -> pa.Table:
    """(project, i, j), i <= j: the blocks that share a term of the rows (project, block, id)."""
    _, term = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    blocks, block = np.unique(rows.column("block").to_numpy(), return_inverse=True)
    order = np.argsort(term, kind="stable")
    term, block = term[order], block[order]
    found = [np.zeros((2, 0), np.int64)]
    for a in range(0, len(blocks), _SQUARE):
        for b in range(a, len(blocks), _SQUARE):
            met = np.zeros((min(_SQUARE, len(blocks) - a), min(_SQUARE, len(blocks) - b)), bool)
            for low in range(0, int(term[-1]) + 1, TERMS):
                here = slice(*np.searchsorted(term, (low, low + TERMS)))
                sides = []
                for at, n in ((a, met.shape[0]), (b, met.shape[1])):
                    side = np.zeros((TERMS, n), np.float32)
                    mine = (block[here] >= at) & (block[here] < at + n)
                    side[term[here][mine] - low, block[here][mine] - at] = 1
                    sides.append(side)
                met |= sides[0].T @ sides[1] > 0
            i, j = np.nonzero(met)
            found.append(np.stack((i + a, j + b)))
    i, j = np.concatenate(found, axis=1)
    i, j = blocks[i[i <= j]], blocks[j[i <= j]]
    return pa.table({"project": pa.array([rows.column("project")[0].as_py()] * len(i), pa.string()),
                     "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())})


def block_pairs(cut: DataFrame, above: float) -> DataFrame:
    """(project, i, j), i <= j: the blocks that share an indexed term."""
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = cut.select("project", "block", F.explode("index").alias("id"))
    return index.groupBy("project", F.pmod("id", F.lit(n)).alias("part")).applyInArrow(
        _meeting, "project string, i int, j int").distinct()


class _Block:
    """The classes of one block, and their entries (row, weight) by term."""

    def __init__(self, blocks: pa.Table, at: int):
        get = lambda c: blocks.column(c)[at]
        self.classes = {c: get(c).values for c in ("cid", "n", "first")}
        raw = pa.decompress(get("entries").as_buffer(), get("size").as_py(), "zstd", asbytes=True)
        n_terms, n = np.frombuffer(raw, np.int64, 2).tolist()
        numbers, low = [], 16
        for size in (n_terms, n_terms, n_terms, n, n):
            planes = np.frombuffer(raw, np.uint8, 8 * size, low).reshape(8, size)
            numbers.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
            low += 8 * size
        self.terms, df, self.count, self.row, tf = numbers
        self.n = len(self.classes["cid"])
        self.start = np.cumsum(self.count) - self.count
        norm = get("norm").values.to_numpy()
        self.weight = _weights(get("total").as_py(), np.repeat(df, self.count), tf) / norm[self.row]

    def entries(self, terms: np.ndarray) -> np.ndarray:
        return _ramps(self.start[terms], self.count[terms])

    def matrix(self, terms: np.ndarray) -> np.ndarray:
        out, mine = np.zeros((self.n, len(terms))), self.entries(terms)
        out[self.row[mine], np.repeat(np.arange(len(terms)), self.count[terms])] = self.weight[mine]
        return out


def _sum_products(one: _Block, two: _Block) -> np.ndarray:
    """All dot products of the vectors of two blocks."""
    n1, n2 = one.n, two.n
    found = np.zeros((n1, n2))
    _, a, b = np.intersect1d(one.terms, two.terms, assume_unique=True, return_indices=True)
    many = one.count[a] * two.count[b] > DENSE
    for low in range(0, int(many.sum()), TERMS):
        part = np.flatnonzero(many)[low:low + TERMS]
        found += one.matrix(a[part]) @ two.matrix(b[part]).T
    a, b = a[~many], b[~many]
    few, partners, begin = one.entries(a), np.repeat(two.count[b], one.count[a]), np.repeat(two.start[b], one.count[a])
    edge = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(partners) // PRODUCTS)) + 1, [len(few)]))
    for low, high in zip(edge[:-1], edge[1:]):
        k = partners[low:high]
        left, right = np.repeat(few[low:high], k), _ramps(begin[low:high], k)
        found += np.bincount(one.row[left] * n2 + two.row[right], one.weight[left] * two.weight[right], minlength=n1 * n2).reshape(n1, n2)
    return found


def _close(group: pa.Table, above: float, below: float):
    """(one, two, a, b, scores) for each pair of blocks that meet: both, and the rows
    whose product is between the thresholds."""
    meet = group.filter(pa.compute.is_valid(group.column("meets"))).sort_by([("block", "ascending"), ("meets", "ascending")])
    rows = group.filter(pa.compute.is_null(group.column("meets"))).combine_chunks()
    place = {number: at for at, number in enumerate(rows.column("block").to_pylist())}
    last, one = None, None
    for i, j in zip(meet.column("block").to_pylist(), meet.column("meets").to_pylist()):
        if i != last:  # one block is kept spelled out, so that a task needs little more than its tiles
            last, one = i, _Block(rows, place[i])
        two = one if i == j else _Block(rows, place[j])
        found = np.round(_sum_products(one, two), 9)
        a, b = np.nonzero((found > above) & (found < below))
        if i == j:
            a, b = a[a < b], b[a < b]
        yield one, two, a, b, found[a, b]


def _products(above: float, below: float):
    """The pairs of classes whose product is between the thresholds."""
    def run(group: pa.Table) -> pa.Table:
        project, out = group.column("project")[0].as_py(), []
        for one, two, a, b, scores in _close(group, above, below):
            found = {"project": pa.array([project] * len(a), pa.string()), "score": pa.array(scores, pa.float64())}
            for n, part, pick in ((1, one, a), (2, two, b)):
                for c in ("cid", "n", "first"):
                    found[f"{c}{n}"] = part.classes[c].take(pa.array(pick, pa.int64()))
            out.append(pa.table({c: found[c] for c in _PAIR}))
        return pa.concat_tables(out)
    return run


def _counts(above: float, below: float):
    """How many pairs of files the pairs of classes stand for."""
    def run(group: pa.Table) -> pa.Table:
        pairs = 0
        for one, two, a, b, _ in _close(group, above, below):
            pairs += int((one.classes["n"].to_numpy()[a] * two.classes["n"].to_numpy()[b]).sum())
        return pa.table({"project": pa.array([group.column("project")[0].as_py()], pa.string()), "pairs": pa.array([pairs], pa.int64())})
    return run


_PAIR = ("project", "cid1", "cid2", "n1", "n2", "first1", "first2", "score")


def _cut(classes: DataFrame, above: float) -> tuple[DataFrame, int]:
    """The classes in blocks, a row each, and how many neighbouring blocks make a tile: as many as TILE_BYTES
    hold, but not so many that a project has fewer than TILES."""
    placed = classes.withColumn("common", F.element_at("ids", -1)).withColumn("rare", F.get("ids", 0))
    cut = stage(dealt(placed.where(F.size("ids") > 0), "project", ["common", "rare", "cid"], BLOCK)
                .select("project", "block", "cid", "n", "first", "total", "ids", "dfs", "tfs")
                .groupBy("project", "block").applyInArrow(_packed(above), _BLOCK))
    most, mean = cut.groupBy("project").agg(F.count("*").alias("n"), F.avg(F.octet_length("entries")).alias("size")).agg(
        F.max("n"), F.max("size")).first()
    if not most:
        return cut, 1
    return cut, max(1, min(int(TILE_BYTES / mean), most // TILES))


def _tiled(cut: DataFrame, pairs: DataFrame, tile: int) -> DataFrame:
    """The classes of each two tiles that meet, and, as rows with `meets`, the pairs of blocks that do."""
    of = lambda c: F.floor(F.col(c) / tile).cast("int")
    meet = pairs.withColumn("ti", of("i")).withColumn("tj", of("j"))
    tiles = stage(meet.select("project", "ti", "tj").distinct())
    rows = cut.drop("index").withColumn("meets", F.lit(None).cast("int"))
    one = rows.withColumn("ti", of("block")).join(tiles, ["project", "ti"])
    two = rows.withColumn("tj", of("block")).join(tiles.where("ti < tj"), ["project", "tj"])
    marks = meet.select("project", "ti", "tj", F.col("i").alias("block"), F.col("j").alias("meets"))
    return one.unionByName(two).unionByName(marks, allowMissingColumns=True).groupBy("project", "ti", "tj")


def similar_classes(classes: DataFrame, above: float = C.SIMILAR_ABOVE,
                    below: float = C.SIMILAR_BELOW) -> DataFrame:
    """(project, cid1, cid2, n1, n2, first1, first2, score) for every pair of classes between the
    thresholds."""
    cut, tile = _cut(classes, above)
    return _tiled(cut, stage(block_pairs(cut, above)), tile).applyInArrow(
        _products(above, below), "project string, cid1 long, cid2 long, n1 long, n2 long, "
                                 "first1 string, first2 string, score double")


def similar_counts(files: DataFrame, enough: int, stopwords: list[str] | None = None, max_terms: int | None = None,
                   above: float = C.SIMILAR_ABOVE, below: float = C.SIMILAR_BELOW) -> DataFrame:
    """(project, pairs): how many pairs `similar_files` has, or, where these are more than `enough`,
    some number above it.

    Each block is compared with itself first. Projects that have more than `enough` pairs there are
    settled; all blocks of the others are compared.
    """
    cut, tile = _cut(vector_classes(stage(vectors(files, stopwords, max_terms))), above)
    same = cut.select("project", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
    counted = lambda cut, pairs, tile: _tiled(cut, pairs, tile).applyInArrow(
        _counts(above, below), "project string, pairs long").groupBy("project").agg(F.sum("pairs").alias("pairs"))
    within = stage(counted(cut, same, 1))
    rest = cut.join(within.where(F.col("pairs") > enough), "project", "left_anti")
    between = counted(rest, stage(block_pairs(rest, above).where("i < j")), tile)
    return within.unionByName(between).groupBy("project").agg(F.sum("pairs").alias("pairs"))


def _blocks(n: Column) -> Column:
    """How many blocks a class of ``n`` files is split into."""
    return F.ceil(n / _MEMBERS).cast("int")


def _block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def similar_representatives(files: DataFrame, stopwords: list[str] | None = None,
                            max_terms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (project, file1, file2, similarity) of the first files of classes with equal term
    counts, and the members (project, path, first) of all classes."""
    vectors_ = stage(vectors(files, stopwords, max_terms))
    classes = vector_classes(vectors_)
    pairs = similar_classes(classes).select(
        "project", F.least("first1", "first2").alias("file1"), F.greatest("first1", "first2").alias("file2"),
        X.py_round(F.col("score"), 2).alias("similarity"))
    return pairs, _members(vectors_, classes)


def _members(vectors_: DataFrame, classes: DataFrame) -> DataFrame:
    return vectors_.select("project", "sig", "path").join(
        classes.select("project", "sig", "first"), ["project", "sig"]).select("project", "path", "first")


def class_members(files: DataFrame, stopwords: list[str] | None = None, max_terms: int | None = None) -> DataFrame:
    """The members (project, path, first) of all classes, as `similar_representatives` gives them, but
    without blocks and pairs being looked for."""
    vectors_ = stage(vectors(files, stopwords, max_terms).select("project", "sig", "path"))
    return _members(vectors_, vectors_.groupBy("project", "sig").agg(F.min("path").alias("first")))


def similar_files(files: DataFrame, stopwords: list[str] | None = None,
                  max_terms: int | None = None) -> DataFrame:
    """(project, file1, file2, similarity) of all file pairs between the thresholds.

    A class with many files is spread over blocks before its pairs are spelled out.
    """
    vectors_ = stage(vectors(files, stopwords, max_terms))
    classes = vector_classes(vectors_)
    # classes of one file have it at hand, and their pairs need not be shuffled
    members = sized(vectors_.select("project", "sig", "path").join(
        classes.where("n > 1").select("project", "sig", "cid", "n"), ["project", "sig"]).select(
            "cid", "path", _block_of(F.col("path"), _blocks(F.col("n"))).alias("block")))
    side = lambda n, path: members.select(F.col("cid").alias(f"cid{n}"), F.col("path").alias(path), F.col("block").alias(f"block{n}"))
    over = lambda n: F.explode(F.sequence(F.lit(0), _blocks(F.col(f"n{n}")) - 1))
    pairs = similar_classes(classes).withColumn("block1", over(1)).withColumn("block2", over(2))
    a, b = F.coalesce("a", "first1"), F.coalesce("b", "first2")
    return pairs.join(side(1, "a"), ["cid1", "block1"], "left").join(side(2, "b"), ["cid2", "block2"], "left").select(
        "project", F.least(a, b).alias("file1"), F.greatest(a, b).alias("file2"),
        X.py_round(F.col("score"), 2).alias("similarity"))
