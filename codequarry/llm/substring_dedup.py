"""Removing word windows that an earlier document has, by level-wise doubling.

Level 1 looks at windows of half the length, and only at those that are the smallest of their
neighbourhood, so that every full window holds one of them at the same place in each copy.
Windows that two documents share at one length are extended to the next, at most twice as long;
the others are never looked at again. The last level has the wanted length, and there a window
that starts in a document with a smaller id marks its words.

At each level a batch settles what repeats within it and hands on, per fingerprint, only the
places of its smallest document: all others are known to be repeats. So a window that is in a
third of all documents meets itself as often as there are batches.

Null ids keep all their words, and no window starts in them. Null and empty texts have none. Rows
that repeat an id keep or lose words by their own text: a window counts as starting in a smaller id
if any row of such an id holds it, and rows of one id never remove each other's words. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.blobs import gather, scatter
from codequarry.llm.order import numbered
from codequarry.llm.shared import partitions, sized, small_batches, stage
from codequarry.llm.words import U64, hash_words, mix, spans, text_bytes, windows, word_hashes

#: Windows that a task holds before it settles them.
FLUSH = 1_500_000
#: Bytes of runs that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: A place holds the row's part above these bits, and the word's number below.
PLACE_BITS = 32


def lengths(window: int, levels: int = 2) -> list[int]:
    """The window lengths of the levels; each at most twice the one before."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Places that hold the leftmost smallest value of some run of `span` values."""
    found = []
    for i in range(0, len(values) - span + 1, 1 << 18):
        part = values[i:i + (1 << 18) + span - 1]
        at = np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1)
        at += np.arange(i, i + len(at))
        found.append(at[np.concatenate(([True], at[1:] != at[:-1]))])
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sorted intervals [low, high), those that touch joined; two columns."""
    reach = np.maximum.accumulate(high)
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
    return np.stack((low[new], reach[last]), axis=1)


def covered(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the intervals hold."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.clip(found[:, 0], 0, n), 1)
    np.add.at(steps, np.clip(found[:, 1], 0, n), -1)
    return np.cumsum(steps[:n]) > 0


def settle(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, later: bool):
    """(marked, first): places of repeated windows, and those of each window's smallest document.

    `later`: only documents after the smallest are marked.
    """
    order = np.lexsort((ids, keys))
    keys, ids, at = keys[order], ids[order], at[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(start, len(keys)))
    least = np.repeat(ids[start], size)
    after = ids != least
    marked = after if later else np.repeat(ids[start + size - 1] != ids[start], size)
    return (ids[marked], at[marked]), (keys[~after], ids[~after], at[~after])


def _level(prev: int, size: int, last: bool, buckets: int, home: int):
    """Windows of a batch: what it settles goes home by document, the rest by fingerprint.

    Rows (kind, bucket, c0, c1, c2); kind 0 is settled, 1 is to be compared with other batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, ids, at = (np.concatenate(x) for x in zip(*held))
            (mark_id, mark_at), (keys, ids, at) = settle(keys, ids, at, last)
            for kind, bucket, columns in ((0, home_of(mark_id, mark_at, home), [mark_id, mark_at, mark_at[:0]]),
                                          (1, keys % U64(buckets), [keys, ids, at])):
                if not len(bucket):
                    continue
                n = buckets if kind else home
                if kind == 0:
                    out = scatter(bucket, n, columns[:2])
                    out = out.append_column("c2", pa.nulls(out.num_rows, pa.binary()))
                else:
                    out = scatter(bucket, n, columns)
                yield out.append_column("kind", pa.array([kind] * out.num_rows, pa.int32()))

        for batch in batches:
            places = batch.column(3) if prev else None
            ids_parts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            for i, (key, part, text) in enumerate(ids_parts):
                if key is None:
                    continue
                words = word_hashes(text.as_py())
                if not prev:
                    keys = windows(words, size[0])
                    at = smallest(keys, size[1] - size[0] + 1)
                else:
                    keys = windows(words, size)
                    at = np.flatnonzero(covered(
                        np.frombuffer(places[i].as_py(), dtype=np.int64).reshape(-1, 2), len(keys)))
                if len(at):
                    held.append((keys[at], np.full(len(at), key, dtype=np.int64), at + (part << PLACE_BITS)))
                    total += len(at)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()
    return run


def home_of(ids: np.ndarray, at: np.ndarray, home: int) -> np.ndarray:
    """The bucket of each row; the parts of an id that many rows repeat are spread."""
    part = mix((at >> PLACE_BITS).astype(np.int64).view(U64))
    return (mix(ids.astype(np.int64).view(U64) ^ part) % U64(home)).astype(np.int64)


def _compare(last: bool, home: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, open_ = [], []
        for batch in batches:
            kind = np.asarray(batch.column(0))
            for k, row in zip(kind, range(batch.num_rows)):
                (open_ if k else settled).append(batch.slice(row, 1).select([2, 3, 4]))
        if settled:
            ids, at = gather(iter(settled), [8, 8])
            yield scatter(home_of(ids.view(np.int64), at.view(np.int64), home), home, [ids, at])
        if open_:
            keys, ids, at = gather(iter(open_), [8, 8, 8])
            (ids, at), _ = settle(keys, ids.view(np.int64), at.view(np.int64), last)
            if len(ids):
                yield scatter(home_of(ids, at, home), home, [ids, at])
    return run


def _by_document(before: int, after: int):
    """(id, part, runs): each place p of a row becomes [p - before, p + after)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at = (x.view(np.int64) for x in gather(batches, [8, 8]))
        if not len(ids):
            return
        order = np.lexsort((at, ids))
        ids, at = ids[order], at[order]
        part, at = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
        start = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]))))
        end = np.append(start[1:], len(ids))
        found = [runs(np.maximum(at[s:e] - before, 0), at[s:e] + after).tobytes()
                 for s, e in zip(start, end)]
        for i in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[start[i:i + 10_000]]), pa.array(part[start[i:i + 10_000]]),
                 pa.array(found[i:i + 10_000], pa.binary())],
                ["id", "part", "runs"])
    return run


def _sized(found: DataFrame) -> DataFrame:
    total = found.agg(F.sum(F.octet_length("runs") + 32)).first()[0] or 0
    return F.broadcast(found) if total <= BROADCAST_BYTES else found


def parted(texts: DataFrame) -> DataFrame:
    """texts with `part`: the number of the text among the different ones of its id, from 0."""
    known = texts.where("id is not null")
    again = sized(stage(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")))
    if again.isEmpty():
        return texts.withColumn("part", F.lit(0).cast("long"))
    named = texts.withColumn("body", F.xxhash64("text"))
    bodies = named.join(again, "id", "left_semi").select("id", "body").distinct()
    parts = sized(stage(numbered(bodies, ["id"], ["body"]).select("id", "body", F.col("idx").alias("part"))))
    return (named.join(parts, ["id", "body"], "left").drop("body")
            .withColumn("part", F.coalesce("part", F.lit(0).cast("long"))))


def repeated_runs(texts: DataFrame, window: int, levels: int = 2) -> DataFrame:
    """(id, part, runs) of the rows (id, part, text) that lose words; runs: int64 pairs [first, end)."""
    spark, steps = texts.sparkSession, lengths(window, max(2, levels))
    n = partitions(spark)
    found = None
    for i, size in enumerate(steps):
        last = i == len(steps) - 1
        if found is None:
            source = texts.select("id", "part", "text")
            level = _level(0, (size, steps[1]), False, 4 * n, 4 * n)
        else:
            source = texts.join(_sized(found), ["id", "part"]).select("id", "part", "text", "runs")
            level = _level(steps[i - 1], size, last, 4 * n, 4 * n)
        # a window of the next length holds one of this length at p, at the first level at any
        # of its places, later at its first and so at its last one too
        before = steps[1] - steps[0] if i == 0 and not last else 0
        after = size if last else 1
        found = stage(
            source.mapInArrow(level, "bucket int, c0 binary, c1 binary, c2 binary, kind int")
            .select("kind", "bucket", "c0", "c1", "c2").repartition(n, "bucket")
            .mapInArrow(_compare(last, 4 * n), "bucket int, c0 binary, c1 binary")
            .repartition(n, "bucket").select("c0", "c1")
            .mapInArrow(_by_document(before, after), "id long, part long, runs binary"))
        if found.isEmpty():
            break
    return found


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, found in zip(batch.column(1), batch.column(2)):
            data = text_bytes(text.as_py())
            starts, ends = spans(data)
            counts.append(len(starts))
            if found.as_py() is not None:
                keep = ~covered(np.frombuffer(found.as_py(), dtype=np.int64).reshape(-1, 2), len(starts))
                starts, ends = starts[keep], ends[keep]
            removed.append(counts[-1] - len(starts))
            steps = np.zeros(len(data) + 2, dtype=np.int8)
            steps[starts] = 1
            steps[ends + 1] -= 1
            line = np.append(data, np.uint8(0x20))
            line[ends] = 0x20
            kept.append(line[np.cumsum(steps[:-1], dtype=np.int8) > 0][:-1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string(), safe=False), *batch.columns[3:]],
            ["id", "n_words", "n_removed", "kept", *batch.schema.names[3:]])


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id",
                   text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): the words left of each document, joined by one space.

    A word goes if a run of `window` words that holds it also starts in a document with a smaller
    id; runs are judged on the input, not on what is left. With `carry` each row also has the
    document's own row, as a struct `row`.
    """
    small_batches(docs.sparkSession)
    row = [F.struct("*").alias("row")] if carry else []
    texts = parted(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row))
    found = repeated_runs(texts, window)
    schema = "id long, n_words long, n_removed long, kept string"
    if carry:
        schema += f", row {docs.schema.simpleString()}"
    return (texts.join(_sized(found), ["id", "part"], "left")
            .select("id", "text", "runs", *(["row"] if carry else []))
            .mapInArrow(_kept, schema))
