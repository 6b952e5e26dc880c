"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

Sets of word shingles whose Jaccard similarity reaches a threshold differ in at most k elements,
k following from the larger set's size. The feature domain is cut into n1 first-level partitions
of three parts each, n1 > k/2, so that one first-level partition of a linked pair differs in at
most one element, and two of its three parts are equal: every set signs each two-part subset of
every first-level partition, once per band of sizes that a partner may have. Up to three
differences are spread over one partition of k + 3 parts, and its subsets of three parts signed.
Linked sets share a signature for certain. Of the sets that share one, those whose elements,
counted in 64 buckets, differ by more than k are apart for certain; the others are verified on
the exact sets.

Signatures travel as byte planes per bucket, so a hot signature costs a few bytes per set. Sets
equal within a batch sign once. Groups of sets under one signature are never expanded into pairs: each
member is compared with the smallest of a group first, which joins most copies. Families of sets
that share signatures but are then still apart are compared block by block, and a block hands on
only links between components that it has not joined yet.

Null and empty texts have no shingles and no links. Ties and repeated rows fall into one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.blobs import gather, scatter
from codequarry.llm.shared import ID_ROWS, components, partitions, stage, text_rows
from codequarry.llm.words import U64, mix, shingle_set
from codequarry.operators.spread import marked

#: Ratio of the largest to the smallest size of a band; 1.3 gives the fewest signatures per set.
BAND_RATIO = 1.3
#: Signatures that a task holds before it hands them on.
FLUSH = 500_000
#: Bytes of a signature that travel. A chance match costs one comparison, never a wrong link.
SIGNATURE_BYTES = 6
#: Differences up to which one partition is enumerated in full, and seeds to sign under.
SMALL_K, SEEDS = 3, 12
#: Sets and shingles of a block, about. Larger blocks repeat fewer texts, and fill a task.
BLOCK_SETS, BLOCK_SHINGLES = 2_000, 1_500_000


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Band(NamedTuple):
    """Sizes low to high, and how their sets are partitioned."""

    low: int
    high: int
    k: int
    n1: int  # first-level partitions
    spare: int  # how many more of them agree, up to k2 elements each, than one
    n2: int  # parts of each
    subsets: list[tuple[int, ...]]  # of n2 - k2 parts
    cuts: np.ndarray


class Bands:
    """Bands of set sizes with the partitions of each."""

    def __init__(self, percent: int):
        self.percent, self.bands = percent, []

    def _add(self) -> None:
        low = self.bands[-1].high + 1 if self.bands else 1
        high = max(low, int(low * BAND_RATIO))
        k = 2 * high * (100 - self.percent) // (100 + self.percent)
        # few differences: one partition, all subsets that leave out k parts; else two levels
        n1, k2, n2 = (1, k, k + 3) if k <= SMALL_K else (k // 2 + 1, 1, 3)
        # more partitions than needed: sets with few empty subsets then sign under one seed only
        spare = -(-n1 * (100 - self.percent) // 200) if n1 > 2 else 0
        n1 += spare
        cuts = np.array([(i << 64) // (n1 * n2) for i in range(1, n1 * n2)], dtype=U64)
        self.bands.append(Band(low, high, k, n1, spare, n2, list(combinations(range(n2), n2 - k2)), cuts))

    def of(self, size: int) -> list[int]:
        """The bands that hold the size of a possible partner, not smaller, of a set."""
        top = size * 100 // self.percent
        while not self.bands or self.bands[-1].high < top:
            self._add()
        # k = 0 leaves equal sets only, and those are one class already
        return [i for i, b in enumerate(self.bands) if b.high >= size and b.low <= top and b.k > 0]


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a sorted set.

    More than `spare` first-level partitions of two linked sets agree on a subset. A set with at
    most `spare` partitions that hold an empty subset therefore shares one that is not empty, and
    need not sign the empty ones, which any set may have. A set with more signs under the next
    seed as well: its partner does too, or has signed enough. What is left after the last seed
    signs its empty subsets.
    """
    found = []
    for i in bands.of(len(features)):
        band = bands.bands[i]
        for seed in range(SEEDS):
            own = features if not seed else np.sort(mix(features ^ U64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)))
            sums = np.zeros(len(own) + 1, dtype=U64)
            np.cumsum(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
            edge = np.concatenate(([0], np.searchsorted(own, band.cuts), [len(own)]))
            part = (sums[edge[1:]] - sums[edge[:-1]]).reshape(band.n1, band.n2)
            count = np.diff(edge).reshape(band.n1, band.n2)
            both = np.stack([part[:, c].sum(axis=1, dtype=U64) for c in map(list, band.subsets)])
            none = np.stack([count[:, c].sum(axis=1) for c in map(list, band.subsets)]) == 0
            salt = mix(np.arange(both.size, dtype=U64) + U64((i * SEEDS + seed) << 32)).reshape(both.shape)
            signed = mix(both + salt)
            enough = none.any(axis=0).sum() <= band.spare
            found.append(signed[~none] if enough or seed < SEEDS - 1 else signed.ravel())
            if enough:
                break
    return np.concatenate(found) if found else np.empty(0, dtype=U64)


def fingerprint(features: np.ndarray) -> bytes:
    return np.array([mix(features).sum(dtype=U64), (features * features).sum(dtype=U64)],
                    dtype=U64).tobytes()


def sketch(features: np.ndarray) -> bytes:
    """Elements in 64 buckets, 255 at most: two sets differ in as many as their sketches at least."""
    return np.minimum(np.bincount((features & U64(63)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints, sketches = [], [], []
            for text in batch.column(1):
                features = shingle_set(text.as_py(), size)
                counts.append(len(features))
                prints.append(fingerprint(features) if len(features) else None)
                sketches.append(sketch(features))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(sketches, pa.binary())], ["id", "n_shingles", "print", "sketch"])
    return run


def _postings(size: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, ids, seen, total = Bands(percent), [], [], set(), 0

        def flush() -> pa.RecordBatch:
            signed = np.concatenate(held)
            owner = np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in held])
            return scatter((signed >> U64(16)) % U64(buckets), buckets, [signed, owner], [SIGNATURE_BYTES, 8])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                features = shingle_set(text.as_py(), size)
                if key is None or not len(features):
                    continue
                same = fingerprint(features)
                if same in seen:
                    continue
                seen.add(same)
                signed = signatures(features, bands)
                if len(signed):
                    held.append(signed)
                    ids.append(key)
                    total += len(signed)
                if total >= FLUSH:
                    yield flush()
                    held, ids, seen, total = [], [], set(), 0
        if total:
            yield flush()
    return run


def _shared(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, id) of the signatures that several ids have; equal groups once."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(first, len(keys)))
    name = np.add.reduceat(mix(ids), first) + length.astype(U64)
    many = np.flatnonzero(length > 1)
    _, once = np.unique(name[many], return_index=True)
    many = many[once]
    size = length[many]
    at = np.repeat(first[many] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.repeat(name[many], size).view(np.int64), ids[at].view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of ids under one signature, bucket by bucket as the rows are sorted."""
    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, members = _shared(*gather(iter(held), [SIGNATURE_BYTES, 8]))
        for i in range(0, len(groups), 1 << 18):
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups[i:i + (1 << 18)]), pa.array(members[i:i + (1 << 18)])], ["grp", "id"])

    held, last = [], None
    for batch in batches:
        buckets = np.asarray(batch.column(0))
        edge = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True])))
        for s, e in zip(edge[:-1], edge[1:]):
            if held and buckets[s] != last:
                yield from rows(held)
                held = []
            last = buckets[s]
            held.append(batch.slice(s, e - s).select([1, 2]))
    if held:
        yield from rows(held)


def clusters(sizes: np.ndarray, sketches: np.ndarray, percent: int) -> Iterator[list[int]]:
    """Members of a group that a chain of pairs joins which sketches and sizes cannot tell apart."""
    left = np.arange(len(sizes))
    while len(left) > 1:
        found, open_ = [left[0]], [left[0]]
        left = left[1:]
        while open_ and len(left):
            x = open_.pop()
            apart = np.abs(sketches[left] - sketches[x]).sum(axis=1)
            near = apart * (100 + percent) <= (sizes[left] + sizes[x]) * (100 - percent)
            near &= 100 * np.minimum(sizes[left], sizes[x]) >= percent * np.maximum(sizes[left], sizes[x])
            hit = left[near].tolist()
            left = left[~near]
            found += hit
            open_ += hit
        if len(found) > 1:
            yield found


def _clusters(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names, members = [], []

        def settle(held: list[pa.RecordBatch]) -> None:
            group = pa.Table.from_batches(held)
            ids, sizes = group.column(1).to_numpy(), group.column(2).to_numpy()
            counts = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int16)
            for found in clusters(sizes, counts, percent):
                own = np.unique(ids[found])
                name = int((mix(own.view(U64)).sum(dtype=U64) + U64(len(own))).view(np.int64))
                if name not in seen:
                    seen.add(name)
                    names.append(np.full(len(own), name))
                    members.append(own)

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["grp", "id"])
            names.clear()
            members.clear()
            return out

        held, last = [], None
        for batch in batches:
            groups = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
            for s, e in zip(edge[:-1], edge[1:]):
                if held and groups[s] != last:
                    settle(held)
                    held = []
                last = groups[s]
                held.append(batch.slice(s, e - s))
            if names:
                yield rows()
        if held:
            settle(held)
        if names:
            yield rows()
    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            b_ids = batch.column(1).to_pylist()
            for i, (b, text, other) in enumerate(zip(b_ids, batch.column(2), batch.column(3))):
                if left is None or b != last:
                    last, left = b, shingle_set(other.as_py(), size)
                right = shingle_set(text.as_py(), size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if linked(common, len(left), len(right), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def _used(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids, to be joined with them. Where the ids are many, a few other texts are among these."""
    ids = stage(ids.select("id").distinct())
    if ids.count() <= ID_ROWS:
        return texts.join(F.broadcast(ids), "id", "left_semi")
    return marked(texts, ["id"], ids, "used").where("used").drop("used")


def _compare(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The staged pairs (a, b) that are linked."""
    used = _used(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = (pairs.join(used.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(used.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))
    return stage(both.mapInArrow(_verified(size, percent), "a long, b long"))


class Forest:
    """Which components are joined, by their smallest known member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _block_links(parts: list[int], sides: np.ndarray, sets: list[np.ndarray],
                 percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links join; sets of side 0 with those of side 1, or of side 2 with each other."""
    sizes = np.array([len(x) for x in sets])
    left = np.flatnonzero(sides != 1)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    if not len(left) or not len(right):
        return []
    owner = np.repeat(np.arange(len(left)), sizes[left])
    features = np.concatenate([sets[i] for i in left])
    order = np.argsort(features, kind="stable")
    features, owner = features[order], owner[order]
    forest, links = Forest(), []
    for i in right:
        low = np.searchsorted(features, sets[i], side="left")
        count = np.searchsorted(features, sets[i], side="right") - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(left))
        near = np.flatnonzero((100 * common >= percent * (sizes[i] + sizes[left] - common)) & (left != i))
        for j in left[near]:
            if forest.join(parts[i], parts[j]):
                links.append((parts[i], parts[j]))
    return links


def _blocks(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("side", "ascending"), ("id", "ascending")])
        family, sides = table.column("family").to_numpy(), table.column("side").to_numpy()
        parts = table.column("component").to_pylist()
        sets = [shingle_set(t.as_py(), size) for t in table.column("text")]
        edge = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1], [True])))
        links = []
        for s, e in zip(edge[:-1], edge[1:]):
            links += _block_links(parts[s:e], sides[s:e], sets[s:e], percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _family_links(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Linked components (a, b) of the families (family, id, component, n), block by block.

    A family is cut into blocks of bounded size, and each of its sets goes to every pair of blocks
    that holds its own; small families share groups.
    """
    buckets = 4 * partitions(texts.sparkSession)
    count = members.groupBy("family").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = (members.join(count, "family")
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
              .withColumn("side", F.when(F.col("low") == F.col("high"), 2).when(F.col("own") == F.col("low"), 0).otherwise(1))
              .withColumn("part", F.when(F.col("blocks") == 1, F.struct(
                  F.pmod(F.xxhash64("family"), F.lit(buckets)).alias("f"), F.lit(-1).alias("l"), F.lit(-1).alias("h")))
                  .otherwise(F.struct(F.col("family").alias("f"), F.col("low").alias("l"), F.col("high").alias("h"))))
              .select("id", "part.*", "family", "side", "component"))
    return stage(placed.join(_used(texts, members), "id").groupBy("f", "l", "h")
                 .applyInArrow(_blocks(size, percent), "a long, b long"))


def link_components(texts: DataFrame, groups: DataFrame, sizes: DataFrame, size: int,
                    percent: int) -> DataFrame:
    """(id, component) over all links between ids that share a group (grp, id); sizes: (id, n).

    First each id is compared with the smallest id of its groups. Then ids are families, joined by
    the groups whose members are still in different components; all sets of a family are compared,
    but only links between components count, so no link that would join two is missed.
    """
    least = groups.groupBy("grp").agg(F.min("id").alias("b"))
    pairs = stage(groups.join(least, "grp").where("id != b").groupBy(F.col("id").alias("a")).agg(F.min("b").alias("b")))
    links = _compare(texts, pairs, size, percent)
    known = stage(groups.select("id").distinct().join(components(links), "id", "left")
                  .select("id", F.coalesce("component", "id").alias("component")))
    placed = groups.join(known, "id")
    mixed = (placed.groupBy("grp").agg(F.min("id").alias("b"), F.min("component").alias("c"),
                                       F.max("component").alias("d")).where("c != d").select("grp", "b"))
    family = components(placed.join(mixed, "grp").select(F.col("id").alias("a"), "b"))
    members = family.withColumnRenamed("component", "family").join(known, "id")
    # a family of two is done if its one pair has been compared: the larger id may have met another id only
    ends = stage(members.groupBy("family").agg(F.count("*").alias("n"), F.max("id").alias("a"), F.min("id").alias("b")))
    done = ends.where("n = 2").join(pairs, ["a", "b"], "left_semi").select("family")
    members = stage(members.join(done, "family", "left_anti").join(sizes, "id"))
    joined = components(_family_links(texts, members, size, percent))
    return (known.join(joined.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left")
            .select("id", F.coalesce("c", "component").alias("component")))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id), one row per document.

    `size` words make a shingle; two documents link when 100 * |A and B| >= percent * |A or B|.
    class_id is the smallest id with the same shingle set. Rows with a null id come back alone.
    """
    texts = text_rows(docs, id_col, text_col)
    spark = docs.sparkSession
    sets = stage(texts.mapInArrow(_sets(size), "id long, n_shingles long, print binary, sketch binary"))
    classes = (sets.where("print is not null and id is not null").groupBy("print")
               .agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1"))
    member = stage(sets.join(classes.select("print", "class_id"), "print")
                   .select("id", "class_id").distinct())
    buckets = 4 * partitions(spark)
    groups = (texts.mapInArrow(_postings(size, percent, buckets),
                               "bucket int, c0 binary, c1 binary")
              .repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
              .mapInArrow(_groups, "grp long, id long"))
    groups = stage(groups)
    groups = (groups.join(member, "id", "left")
              .select("grp", F.coalesce("class_id", "id").alias("id")).distinct())
    sketches = sets.select("id", F.col("n_shingles").alias("n"), "sketch").distinct()
    groups = stage(groups.join(sketches, "id").select("grp", "id", "n", "sketch")
                   .repartition(partitions(spark), "grp").sortWithinPartitions("grp")
                   .mapInArrow(_clusters(percent), "grp long, id long").distinct())
    sizes = sets.groupBy("id").agg(F.max("n_shingles").alias("n"))
    found = link_components(texts, groups, sizes, size, percent)
    return (sets.select("id", "n_shingles").join(member, "id", "left")
            .withColumn("class_id", F.coalesce("class_id", "id"))
            .join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
            .select("id", "n_shingles", "class_id",
                    F.coalesce("component", "class_id").alias("component_id")))
