"""Numbers that travel between tasks as byte planes, one row per bucket of a batch.

A row of a few numbers costs Spark's shuffle some thirty bytes. Packed by bucket and byte plane
the same numbers cost their significant bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from codequarry.llm.words import U64, pack, unpack


def scatter(bucket: np.ndarray, buckets: int, columns: list[np.ndarray],
            keep: list[int] | None = None) -> pa.RecordBatch:
    """One row (bucket, c0, c1, ...) for each bucket that has numbers."""
    keep = keep or [8] * len(columns)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
    keys = np.flatnonzero(edge[1:] > edge[:-1])
    packed = [[pack(c[order[edge[b]:edge[b + 1]]], k) for b in keys]
              for c, k in zip(columns, keep)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)],
        ["bucket", *(f"c{i}" for i in range(len(columns)))])


def gather(batches: Iterator[pa.RecordBatch], keep: list[int]) -> list[np.ndarray]:
    """All numbers of the rows (c0, c1, ...) of a task."""
    found: list[list[np.ndarray]] = [[] for _ in keep]
    for batch in batches:
        for i, k in enumerate(keep):
            found[i] += [unpack(x.as_py(), k) for x in batch.column(i)]
    return [np.concatenate(x) if x else np.empty(0, dtype=U64) for x in found]
