"""Packing: ids as the tokenizer gives them, gapless sequences, bounds that hold."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codequarry.llm import packing as P
from codequarry.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, piece int, length string, grp int"


def pieces_of(text, capacity=P.CAPACITY):
    ids = Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]
    return [(i // capacity, i, len(ids[i:i + capacity]),
             zlib.crc32(np.array(ids[i:i + capacity], dtype="<u4").tobytes())) for i in range(0, len(ids), capacity)]


def check_places(rows, capacity):
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_ids_and_places(spark):
    texts = {1: None, 2: "", 3: "It's  the\n\tend of Ünïcode  don't <|endoftext|>x<|startoftext|> 12,5 ΑΣ. ΑΣ'α",
             4: "é ́x", 5: "word " * 5000, 6: "y" * 20_000, 7: " \n ", 8: "the clown " * 300, None: "no id"}
    df = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in texts.items()] + [(3, texts[3], 1, "x", 2)], DOCS)
    rows = P.pack_documents(df, tokenizer_path()).collect()
    check_places(rows, P.CAPACITY)
    for k, t in texts.items():
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        assert got == sorted(pieces_of(t) * (2 if k == 3 else 1)), k
    assert len({r.sequence_id for r in rows}) == P.lower_bound(np.array([r.length for r in rows]), P.CAPACITY)


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []


def best(lengths, capacity):
    """The fewest bins, by trying all ways."""
    def place(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(lengths):
            least = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        place(i + 1, bins + [lengths[i]])

    lengths, least = sorted(lengths, reverse=True), len(lengths) + 1
    place(0, [])
    return least


def test_bounds_hold():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        lengths = np.array(sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True))
        fewest = best(lengths.tolist(), capacity)
        bins, offsets, room = P.best_fit_decreasing(lengths, capacity)
        assert P.lower_bound(lengths, capacity) <= fewest <= len(room)
        assert (room == capacity - np.bincount(bins, weights=lengths)).all()
    assert P.lower_bound(np.array([11] * 5), 20) == 5 and P.lower_bound(np.array([], dtype=int), 20) == 0


@pytest.mark.parametrize("group", [50, 400])
def test_exchange_closes_gaps(spark, group):
    rng = random.Random(group)
    lengths = [rng.choice([rng.randrange(1, 2049), rng.randrange(600, 1100)]) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], P.PIECE)
    rows = P.pack_pieces(pieces, group_pieces=group).collect()
    check_places(rows, P.CAPACITY)
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(lengths))
    alone = 0
    for part in np.array_split(np.array(lengths), -(-len(lengths) // group)):
        alone += len(P.best_fit_decreasing(np.sort(part)[::-1], P.CAPACITY)[2])
    assert len({r.sequence_id for r in rows}) < alone
