"""Removing byte strings that an earlier document has, by suffix arrays.

Suffixes are put in order by the difference-cover algorithm: the triples at two of three places are
sorted and named, the names are put in order by the same algorithm, the remaining suffixes are
sorted by their first symbol and the order of what follows, and both are merged. Neighbours in that
order are then compared: those with the same first `window` bytes are one string, and all but the
ones of its smallest document are marked.

The work is dealt out so that equal strings meet: a string of `window` bytes belongs to the smallest
hash of the grams in it. Neighbouring strings mostly share it, so they travel as one piece of text.
Grams that only one document has are found first, and their pieces stay where they are. What repeats
inside a batch is settled there: a piece goes on once, with its smallest document. Grams that very
many documents have are split up: their strings travel one by one, dealt by their own hash. Each
task then orders the suffixes of the pieces it got, some megabytes at a time; recursion ends where
the names stand for `window` bytes. Pieces without a string whose hash a piece of another document
has are left aside before, and so are pieces that equal one of a smaller document: they lose all.

One array over the whole corpus would give the same rows, but each of its sorts shuffles a place and
a name, 9 bytes at least, per byte of text.

Texts are UTF-8 bytes and may be cut inside a character. Null texts are empty. Rows without an id
keep all and repeat for nobody. Rows that repeat an id are judged each by its own text and never
against each other, equal rows alike. Texts of any length are read whole, as one row; those shorter
than `window` lose nothing. An empty table has no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.blobs import scatter
from codequarry.llm.order import numbered
from codequarry.llm.shared import partitions, sized, small_batches, stage
from codequarry.llm.substring_dedup import covered, runs
from codequarry.llm.words import U64, mix, unpack, windows

#: Bytes of the grams that deal out the strings.
GRAM = 20
#: Documents of a gram from which on its strings are dealt one by one.
HOT_DOCUMENTS = 10_000
#: Slots that mark such grams; a gram that shares the slot of one is treated alike.
HOT_SLOTS = 1 << 20
#: Grams, and bytes of distinct pieces, that a task holds before it settles them.
FLUSH, FLUSH_BYTES = 1_500_000, 24 << 20
#: Slices of a bucket of pieces, and bytes of slices whose suffixes are ordered at a time.
SLICES, SLICE_BYTES = 256, 384 << 10
#: Bytes of marks that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Highest bytes of a gram's hash that travel; where they agree by chance a piece travels in vain.
KEY_BYTES = 6


# suffix arrays

def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row, in the order of the rows."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return key


def _ranks(key: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of numbers: equal ones have one rank."""
    top = int(key.max(initial=0)) + 1
    if top <= 4 * len(key) + 1024:
        seen = np.zeros(top, dtype=np.int32)
        seen[key] = 1
        return np.cumsum(seen, dtype=np.int32)[key]
    order = np.argsort(key)
    step = key[order]
    out = np.empty(len(key), dtype=np.int32)
    out[order] = np.cumsum(np.concatenate(([True], step[1:] != step[:-1])), dtype=np.int32)
    return out


def _sorted_by(values: np.ndarray, limit: int) -> np.ndarray:
    """A stable argsort of numbers from 0 to `limit`, sixteen bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if limit >= 1 << 16:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _before(sorted_: list[np.ndarray], asked: list[np.ndarray]) -> np.ndarray:
    """How many rows of `sorted_` are less than each asked one; both in order, columns first to last."""
    n = len(sorted_[0])
    key = _packed([np.concatenate(c) for c in zip(sorted_, asked)])
    # rows equal as far as the order goes may stand in any order
    return np.searchsorted(np.maximum.accumulate(key[:n]), np.maximum.accumulate(key[n:]))


def suffix_order(text: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """The places of the suffixes of `text`, in order as far as `depth` bytes tell.

    text: symbols from 1 on, below 2**31; each stands for `reach` bytes. Suffixes that agree in
    more bytes stand next to each other in any order.
    """
    n = len(text)
    limit = int(text.max(initial=0))
    if reach >= depth or n < 2:
        return _sorted_by(text, limit)
    s = np.concatenate((text, np.zeros(3, dtype=text.dtype))).astype(np.int32)
    # the cover: places 1 and 2 of each three; the empty suffix too where it parts both halves
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)))
    names = _ranks(_packed([s[sample], s[sample + 1], s[sample + 2]]))
    most = int(names.max(initial=0))
    order = _sorted_by(names, most) if most == len(names) else suffix_order(names, depth, 3 * reach)
    chosen = sample[order]
    rank = np.zeros(n + 3, dtype=np.int32)
    rank[chosen] = np.arange(1, len(chosen) + 1, dtype=np.int32)

    # the rest stand by their first symbol, then as the suffixes after them
    kind = chosen % 3
    rest = chosen[kind == 1] - 1
    rest = rest[_sorted_by(s[rest], limit)]
    real = chosen < n
    ones, twos = chosen[(kind == 1) & real], chosen[kind == 2]
    place = (np.arange(len(rest))
             + _before([s[ones], rank[ones + 1]], [s[rest], rank[rest + 1]])
             + _before([s[twos], s[twos + 1], rank[twos + 2]], [s[rest], s[rest + 1], rank[rest + 2]]))
    out = np.empty(n, dtype=np.int32)
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = rest
    out[free] = chosen[real]
    return out


def same_as_next(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at a place equal those at the next place of the list."""
    a, b = places[:-1], places[1:]
    same = np.ones(len(a), dtype=bool)
    if length < 8:
        for i in range(length):
            same &= data[a + i] == data[b + i]
        return same
    eight = np.ndarray((len(data) - 7,), dtype=np.uint64, buffer=data, strides=(1,))
    for i in [*range(0, length - 7, 8), length - 8]:
        same &= eight[a + i] == eight[b + i]
    return same


def repeats_in(pieces: bytes, lengths: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, end): the bytes of each piece in strings that a piece of a smaller id has too."""
    # every piece is followed by a symbol below all bytes
    total = int(lengths.sum()) + len(lengths)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    data = np.zeros(total, dtype=np.uint8)
    inside = np.ones(total, dtype=bool)
    inside[ends - 1] = False
    data[inside] = np.frombuffer(pieces, dtype=np.uint8)
    # bytes that do not occur need no symbol
    seen = np.zeros(256, dtype=np.int32)
    seen[data[inside]] = 1
    text = (np.cumsum(seen) + 1)[data].astype(np.int32)
    text[ends - 1] = 1
    order = suffix_order(text, window)
    del text
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    places = order[order + window < ends[owner[order]]]
    if not len(places):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    new = np.concatenate(([True], ~same_as_next(data, places, window)))
    of = ids[owner[places]]
    least = np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1]
    marked = np.sort(places[of > least])
    if not len(marked):
        return marked, marked, marked
    found = runs(marked, marked + window)
    piece = owner[found[:, 0]]
    return piece, found[:, 0] - starts[piece], found[:, 1] - starts[piece]


def _ramps(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., n numbers each, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def meeting(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which pieces, of these lengths, hold a string of `window` bytes that has the hash of one in a piece of another id."""
    hashes = windows(data.astype(U64) + U64(1), window)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:len(hashes)]
    whole = np.flatnonzero(np.arange(window, window + len(hashes)) <= np.cumsum(lengths)[owner])
    out = np.zeros(len(lengths), dtype=bool)
    if len(whole):
        order = whole[np.argsort(hashes[whole])]
        hashes, owner = hashes[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        of = ids[owner]
        several = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        out[owner[np.repeat(several, np.diff(np.append(start, len(owner))))]] = True
    return out


# dealing out

def least_grams(data: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For the string of `window` bytes at each place, the smallest hash of the grams in it."""
    out, span = windows(data.astype(U64) + U64(1), gram), window - gram + 1
    width = 1
    while width < span:
        step = min(width, span - width)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def stretches(least: np.ndarray) -> np.ndarray:
    """First places of the stretches of strings that share their smallest gram."""
    return np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))) if len(least) else np.empty(0, np.int64)


def _settled(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared, first, documents): entries of keys that several ids have, those of each key's
    smallest id, and for the latter the number of ids, written at one entry of the key."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    fresh = new | np.concatenate(([True], i[1:] != i[:-1]))
    count = np.add.reduceat(fresh.astype(np.int64), start)
    first = i == np.repeat(i[start], size)
    counts = np.zeros(len(k), dtype=np.int64)
    counts[start] = count
    return order[np.repeat(count > 1, size)], order[first], counts[first]


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(U64)) % U64(buckets)).astype(np.int64)


def _row(kind: int, bucket: np.ndarray, buckets: int, columns: list[np.ndarray], keep: list[int], width: int) -> pa.RecordBatch:
    """Numbers by bucket, as rows (kind, bucket, c0, ...) of `width` binary columns."""
    out = scatter(bucket, buckets, columns, keep)
    for i in range(len(columns), width):
        out = out.append_column(f"c{i}", pa.nulls(out.num_rows, pa.binary()))
    return out.append_column("kind", pa.array([kind] * out.num_rows, pa.int32()))


def _schema(width: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(width)) + ", kind int"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other; rows come sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield held


def _columns(rows: list[dict], keep: list[int], first: int = 0) -> list[np.ndarray]:
    return [np.concatenate([unpack(r[f"c{first + i}"], k) for r in rows]) for i, k in enumerate(keep)]


class _Gathered:
    """Numbers on their way to their documents; the first column is the id."""

    def __init__(self, buckets: int, keep: list[int]):
        self.buckets, self.keep, self.held, self.size = buckets, keep, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= FLUSH:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(c) for c in zip(*self.held)]
            yield _row(0, _home(columns[0].view(np.int64), self.buckets), self.buckets, columns, self.keep, len(self.keep))
        self.held, self.size = [], 0


#: Highest bytes kept of: key, id, number of the row among those of its id, stretch, documents.
_GRAM_KEEP = [KEY_BYTES, 8, 4, 5, 4]


def _tall(values: np.ndarray, keep: int) -> np.ndarray:
    """Small numbers moved into the highest bytes, which alone are packed."""
    return values.astype(np.int64).view(U64) << U64(8 * (8 - keep))


def _low(values: np.ndarray, keep: int) -> np.ndarray:
    return (values >> U64(8 * (8 - keep))).view(np.int64)


def _grams(window: int, gram: int, buckets: int):
    """Rows of kind 0: stretches whose gram two documents of the batch have; kind 1: all others to be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, ids, no, at = (np.concatenate(x) for x in zip(*held))
            shared, first, documents = _settled(keys, ids)
            if len(shared):
                yield _row(0, _home(ids[shared], buckets), buckets,
                           [ids[shared].view(U64), _tall(no[shared], 4), _tall(at[shared], 5)], [8, 4, 5], 5)
            keys = keys[first]
            yield _row(1, (mix(keys) % U64(buckets)).astype(np.int64), buckets,
                       [keys, ids[first].view(U64), _tall(no[first], 4), _tall(at[first], 5), _tall(documents, 4)],
                       _GRAM_KEEP, 5)

        for batch in batches:
            for key, no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                if key is None or len(data) < window:
                    continue
                least = least_grams(data, window, gram)
                # only the bytes that travel tell grams apart
                starts = stretches(least)
                keys = (least[starts] >> U64(8 * (8 - KEY_BYTES))) << U64(8 * (8 - KEY_BYTES))
                n = len(starts)
                held.append((keys, np.full(n, key, np.int64), np.full(n, no, np.int64), np.arange(n)))
                total += n
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()
    return run


def _shared_grams(hot: int, buckets: int):
    """Stretches of grams that several documents have, to their document (kind 0); slots of hot grams (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = _Gathered(buckets, [8, 4, 5])
        for rows in _by_bucket(batches):
            settled, opened = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
            if settled:
                yield from home.add(_columns(settled, [8, 4, 5]))
            if not opened:
                continue
            keys, ids, no, at, documents = _columns(opened, _GRAM_KEEP)
            order = np.argsort(keys, kind="stable")
            step = keys[order]
            start = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
            many = np.add.reduceat(_low(documents, 4)[order], start)
            slots = np.unique((step[start[many > hot]] >> U64(40)).astype(np.int64) % HOT_SLOTS)
            if len(slots):
                yield _row(2, np.zeros(len(slots), np.int64), 1, [slots.view(U64)], [8], 3)
            shared, _, _ = _settled(keys, ids.view(np.int64))
            if len(shared):
                yield from home.add([ids[shared], no[shared], at[shared]])
        yield from home.rows()
    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, no, marks): per row of documents a bit for each stretch, set where it is shared."""
    for rows in _by_bucket(batches):
        ids, no, at = _columns(rows, [8, 4, 5])
        ids, no, at = ids.view(np.int64), _low(no, 4), _low(at, 5)
        order = np.lexsort((at, no, ids))
        ids, no, at = ids[order], no[order], at[order]
        start = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (no[1:] != no[:-1]))))
        out = []
        for a, b in zip(start, np.append(start[1:], len(ids))):
            bits = np.zeros(at[b - 1] + 1, dtype=np.uint8)
            bits[at[a:b]] = 1
            out.append(np.packbits(bits).tobytes())
        for i in range(0, len(out), 10_000):
            part = start[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(no[part]), pa.array(out[i:i + 10_000], pa.binary())],
                                             ["id", "no", "marks"])


class _Held:
    """Distinct pieces of a batch: each with its smallest id and that id's places."""

    def __init__(self):
        self.pieces: dict[bytes, list] = {}
        self.later: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, piece: bytes, slot: int, key: int, no: int, at: int) -> None:
        have = self.pieces.get(piece)
        if have is None:
            self.pieces[piece] = [slot, key, [(no, at)]]
            self.size += len(piece) + 100
        elif key == have[1]:
            have[2].append((no, at))
        elif key > have[1]:
            self.later.append((key, no, at, at + len(piece)))
        else:
            self.later += [(have[1], n, a, a + len(piece)) for n, a in have[2]]
            have[1], have[2] = key, [(no, at)]

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if self.later:
            ids, no, first, end = (np.array(c, dtype=np.int64) for c in zip(*self.later))
            yield _row(0, _home(ids, buckets), buckets,
                       [ids.view(U64), _tall(no, 4), _tall(first, 5), _tall(end, 5)], [8, 4, 5, 5], 7)
        dealt: dict[int, list] = {}
        for piece, (slot, key, places) in self.pieces.items():
            dealt.setdefault(slot // SLICES, []).append((piece, slot % SLICES, key, places))
        for bucket, found in dealt.items():
            sizes = np.array([(len(p), s, k, len(w)) for p, s, k, w in found], dtype=np.int64).T
            places = np.array([x for *_, w in found for x in w], dtype=np.int64).T
            columns = [np.ascontiguousarray(c).tobytes() for c in (*sizes, *places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), *(pa.array([c], pa.binary()) for c in columns),
                 pa.array([b"".join(p for p, *_ in found)], pa.binary()), pa.array([1], pa.int32())],
                ["bucket", *(f"c{i}" for i in range(7)), "kind"])


def _pieces(window: int, gram: int, hot: np.ndarray, buckets: int):
    """Rows of kind 0: bytes that an earlier document of the batch has; kind 1: distinct pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for key, no, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                            batch.column(2), batch.column(3)):
                buffer = text.as_buffer()
                data = np.frombuffer(buffer, dtype=np.uint8)
                least = least_grams(data, window, gram)
                starts = stretches(least)
                shared = np.unpackbits(np.frombuffer(marks.as_buffer(), dtype=np.uint8))[:len(starts)]
                chosen = np.flatnonzero(shared)
                ends = np.append(starts[1:], len(least))
                top = least[starts[chosen]] >> U64(8 * (8 - KEY_BYTES)) << U64(8 * (8 - KEY_BYTES))
                alone = hot[(top >> U64(40)).astype(np.int64) % HOT_SLOTS] if len(hot) else np.zeros(len(chosen), bool)
                slots = (mix(top) % U64(buckets * SLICES)).astype(np.int64).tolist()
                raw = data.tobytes()
                for a, b, slot, one in zip(starts[chosen].tolist(), ends[chosen].tolist(), slots, alone.tolist()):
                    if one:
                        keys = windows(data[a:b - 1 + window].astype(U64) + U64(1), window) % U64(buckets * SLICES)
                        for i, k in enumerate(keys.tolist(), a):
                            held.add(raw[i:i + window], k, key, no, i)
                    else:
                        held.add(raw[a:b - 1 + window], slot, key, no, a)
                if held.size + 40 * len(held.later) >= FLUSH_BYTES:
                    yield from held.rows(buckets)
                    held = _Held()
        yield from held.rows(buckets)
    return run


def equal_to_earlier(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which pieces, of these lengths, equal one of a smaller id."""
    raw, ends, first = data.tobytes(), np.cumsum(lengths), {}
    same = np.fromiter((first.setdefault(raw[a:b], i) for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist()))),
                       np.int64, len(lengths))
    least = ids.copy()
    np.minimum.at(least, same, ids)
    return ids > least[same]


def _opened(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All pieces of a bucket, and [lengths, slices, ids, counts, no, at]."""
    return (np.frombuffer(b"".join(r["c6"] for r in rows), dtype=np.uint8),
            [np.concatenate([np.frombuffer(r[f"c{i}"], dtype=np.int64) for r in rows]) for i in range(6)])


def _sliced(data: np.ndarray, columns: list[np.ndarray], gone: np.ndarray, window: int) -> Iterator[tuple[bytes, list[np.ndarray]]]:
    """(pieces, [lengths, ids, counts, no, at]) of a few slices of a bucket after the other: those that
    are not gone and meet others."""
    lengths, slices, ids, counts, no, at = columns
    load = np.cumsum(np.bincount(slices, weights=np.where(gone, 0, lengths), minlength=SLICES)) // SLICE_BYTES
    of = load.astype(np.int64)[slices]
    order = np.flatnonzero(~gone)
    order = order[np.argsort(of[order], kind="stable")]
    begin, first = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
    edge = np.concatenate(([0], np.flatnonzero(np.diff(of[order])) + 1, [len(order)]))
    for a, b in zip(edge[:-1], edge[1:]):
        mine = order[a:b]
        text = data[_ramps(begin[mine], lengths[mine])]
        met = meeting(text, lengths[mine], ids[mine], window)
        if not met.any():
            continue
        text, mine = text[np.repeat(met, lengths[mine])], mine[met]
        which = _ramps(first[mine], counts[mine])
        yield text.tobytes(), [lengths[mine], ids[mine], counts[mine], no[which], at[which]]


def _ordered(window: int, buckets: int):
    """The repeated bytes of each document, from the suffix arrays of the pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = _Gathered(buckets, [8, 4, 5, 5])
        for rows in _by_bucket(batches):
            settled, opened = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
            if settled:
                yield from home.add(_columns(settled, [8, 4, 5, 5]))
            if not opened:
                continue
            # a piece that another batch has too loses all, but in its smallest document
            data, columns = _opened(opened)
            lengths, _, ids, counts, no, at = columns
            gone = equal_to_earlier(data, lengths, ids)
            many = counts[gone]
            which = _ramps((np.cumsum(counts) - counts)[gone], many)
            yield from home.add([np.repeat(ids[gone], many).view(U64), _tall(no[which], 4), _tall(at[which], 5),
                                 _tall(at[which] + np.repeat(lengths[gone], many), 5)])
            for pieces, (lengths, ids, counts, no, at) in _sliced(data, columns, gone, window):
                piece, first, end = repeats_in(pieces, lengths, ids, window)
                if not len(piece):
                    continue
                # every place of the piece loses the same bytes
                many = counts[piece]
                which = _ramps((np.cumsum(counts) - counts)[piece], many)
                shift = at[which]
                yield from home.add([np.repeat(ids[piece], many).view(U64), _tall(no[which], 4),
                                     _tall(np.repeat(first, many) + shift, 5), _tall(np.repeat(end, many) + shift, 5)])
        yield from home.rows()
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, no, runs): the removed bytes of each row of documents, as int64 pairs [first, end)."""
    for rows in _by_bucket(batches):
        ids, no, first, end = _columns(rows, [8, 4, 5, 5])
        ids, no, first, end = ids.view(np.int64), _low(no, 4), _low(first, 5), _low(end, 5)
        order = np.lexsort((first, no, ids))
        ids, no, first, end = ids[order], no[order], first[order], end[order]
        start = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (no[1:] != no[:-1]))))
        found = [runs(first[a:b], end[a:b]).tobytes() for a, b in zip(start, np.append(start[1:], len(ids)))]
        for i in range(0, len(found), 10_000):
            part = start[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(no[part]), pa.array(found[i:i + 10_000], pa.binary())],
                                             ["id", "no", "runs"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        kept = []
        for text, found in zip(batch.column(2), batch.column(3)):
            data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
            cut = np.empty((0, 2), np.int64) if found.as_py() is None else np.frombuffer(found.as_py(), dtype=np.int64).reshape(-1, 2)
            left = data[~covered(cut, len(data))] if len(cut) else data
            counts.append((len(data), len(data) - len(left), len(cut)))
            kept.append(left.tobytes())
        numbers = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in numbers), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _sized(found: DataFrame, column: str) -> DataFrame:
    total = found.agg(F.sum(F.octet_length(column) + 40)).first()[0] or 0
    return F.broadcast(found) if total <= BROADCAST_BYTES else found


def _with_numbers(texts: DataFrame) -> DataFrame:
    """(id, no, text): no tells the different texts of one id apart; mostly 0."""
    hashed = texts.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("h"))
    several = hashed.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("id")
    of_several = hashed.join(sized(stage(several)), "id", "left_semi").distinct()
    more = sized(stage(numbered(of_several, ["id"], ["h"]).where("idx > 0").select("id", "h", F.col("idx").alias("no"))))
    return (texts.withColumn("h", F.xxhash64("text")).join(more, ["id", "h"], "left")
            .select("id", F.coalesce("no", F.lit(0).cast("long")).alias("no"), "text"))


def repeated_bytes(texts: DataFrame, window: int, gram: int = GRAM, hot: int = HOT_DOCUMENTS) -> DataFrame:
    """(id, no, runs) of the rows (id, no, text) that lose bytes; text: binary, runs: int64 pairs [first, end)."""
    n = partitions(texts.sparkSession)
    buckets, gram = 2 * n, min(gram, window)

    def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select("kind", "bucket", *columns).repartition(n, "bucket").sortWithinPartitions("bucket")

    three, four, five, seven = ([f"c{i}" for i in range(k)] for k in (3, 4, 5, 7))
    shared = stage(dealt(texts.mapInArrow(_grams(window, gram, buckets), _schema(5)), five)
                   .mapInArrow(_shared_grams(hot, buckets), _schema(3)))
    # at most HOT_SLOTS numbers
    slots = [unpack(r.c0).view(np.int64) for r in shared.where("kind = 2").select("c0").distinct().collect()]
    flags = np.zeros(HOT_SLOTS if slots else 0, dtype=bool)
    for x in slots:
        flags[x] = True
    marks = stage(dealt(shared.where("kind = 0"), three).mapInArrow(_marks, "id long, no long, marks binary"))
    pieces = texts.join(_sized(marks, "marks"), ["id", "no"]).select("id", "no", "text", "marks")
    found = (dealt(pieces.mapInArrow(_pieces(window, gram, flags, buckets), _schema(7)), seven)
             .mapInArrow(_ordered(window, buckets), _schema(4)))
    return stage(dealt(found, four).mapInArrow(_runs, "id long, no long, runs binary"))


def remove_repeated_bytes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                          gram: int = GRAM, hot: int = HOT_DOCUMENTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row: the bytes left, and how many runs went.

    A byte goes if a string of `window` bytes that holds it also starts in a document with a
    smaller id; strings are judged on the input, not on what is left.
    """
    small_batches(docs.sparkSession)
    texts = _with_numbers(docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text")))
    found = repeated_bytes(texts, window, gram, hot)
    return (texts.join(_sized(found, "runs"), ["id", "no"], "left").select("id", "no", "text", "runs")
            .mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary"))
