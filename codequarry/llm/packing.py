"""Packing documents into sequences of a fixed number of tokens, with certified bin counts.

Documents are dealt to groups of bounded size, and each group is packed best fit decreasing.
Dual feasible functions give each group a lower bound for its number of bins; a group that meets
its bound is done. The others keep their full bins and hand the emptiest ones over: these are
dealt anew, to fewer groups, and packed again, until all are certified or one group is left.

Only a document longer than a sequence is cut. Null texts are empty; every document ends with one
end token, so none is without a piece. Rows that repeat an id are pieces of their own.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import stage, text_rows

CAPACITY = 2048
#: Pieces that one group packs.
GROUP_PIECES = 40_000
#: Words a worker remembers the ids of, twice over, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 48

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Punctuation that ends a word: a letter before, one that stays a letter in lower case, a space after.
_ENDS_WORD = re.compile(r"[.,](?<=[^\W\d_\u0130].)(?= )")


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds(dict):
    """The ids of a stretch without white space, as unsigned 32-bit little-endian bytes.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its
    stretches, one after the other. It also lower-cases letters one by one and takes punctuation
    after a letter by itself, so such forms of a word are put together from its plain one, and plain
    words of Latin letters, which are one piece each, go to its model directly. Words seen of late
    are remembered; a full memory becomes the older one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.of(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def of(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and is_latin(word):
            pieces = self.model.tokenize(word if word.isascii() else word.translate(self.spelt))
            return b"".join([self.packed[p.id] for p in pieces])
        if word.isprintable() and "<|" not in word:  # special tokens are looked for before all else
            base = word.rstrip(punctuation)
            if base and len(base) < len(word) and base[-1].lower()[-1].isalpha():
                return self[base] + self[word[len(base):]]
            if is_latin(word) and word.lower() != word:
                return self[word.lower()]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def text(self, text: str) -> bytes:
        if "<|" not in text and is_latin(text):
            text = text.lower()
        words = _ENDS_WORD.sub(r" \g<0>", text.replace("\n", " ")).split(" ")
        return b"".join(map(self.__getitem__, words))


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    many, total = np.cumsum(count), np.cumsum(count * size)
    # f(x) = capacity above capacity - t, 0 below t, x between
    t = np.arange(1, capacity // 2 + 1)
    best = -(-int(total[-1]) // capacity)
    between = total[capacity - t] - total[t - 1]
    best = max(best, int((-(-(between + capacity * (many[-1] - many[capacity - t])) // capacity)).max()))
    # u(x) = x where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) / k
    for k in range(1, 33):
        steps, rest = np.divmod((k + 1) * size, capacity)
        worth = np.where(rest == 0, k * size, steps * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) per item, lengths sorted downwards, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, rooms = [], 0  # rooms: bit r is set if some bin has room r
    for i, need in enumerate(lengths.tolist()):
        fits = rooms >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = open_[left].pop()
            if not open_[left]:
                rooms ^= 1 << left
        else:
            left, at = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = at, capacity - left
        left -= need
        room[at] = left
        if left:
            open_[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(room, dtype=np.int64)


def handed_over(room: np.ndarray, gap: int, capacity: int) -> np.ndarray:
    """Which bins go on: the emptiest, until their room is that of twice the missing bins."""
    order = np.argsort(-room, kind="stable")
    before = np.cumsum(room[order]) - room[order]
    out = np.zeros(len(room), dtype=bool)
    out[order[(before < 2 * gap * capacity) & (room[order] > 0)]] = True
    return out


def _pack(turn: int, capacity: int, final: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                               ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        more = handed_over(room, gap, capacity) if gap and not final else np.zeros(len(room), bool)
        sequence = (turn << 56) + (group << 24) + bins
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column(
            "sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())).append_column("more", pa.array(more[bins]))
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to staged pieces (doc_id, piece, start, length, ids_crc32)."""
    done, turn, before = [], 0, None
    while True:
        groups = -(-pieces.count() // group_pieces) or 1
        # what is handed over shrinks fast; should it not halve, another exchange gains little
        final = groups == 1 or before is not None and groups > before // 2
        grp = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(turn)), F.lit(groups))
        packed = stage(pieces.withColumn("grp", grp).groupBy("grp").applyInArrow(
            _pack(turn, capacity, final), PIECE + ", sequence_id long, offset long, more boolean"))
        done.append(packed.where("not more").drop("more"))
        if final:
            break
        pieces = packed.where("more").drop("more", "sequence_id", "offset")
        before, turn = groups, turn + 1
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    texts = text_rows(docs, id_col, text_col)
    return pack_pieces(stage(texts.mapInArrow(_pieces(tokenizer, capacity, end), PIECE)), capacity)
