"""Byte removal against a dictionary of all byte strings, suffix orders against sorting."""

import random

import numpy as np
import pytest

from codequarry.llm import suffix_dedup as S

DOCS = "doc_id long, text string, id string, no int, kept string"


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_order_equals_sorting(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 50, 51, 52, 400]:
        text = np.array([rng.randrange(1, letters + 1) for _ in range(n)], dtype=np.int64)
        want = sorted(range(n), key=lambda i: text[i:].tolist())
        assert S.suffix_order(text, n + 1).tolist() == want


@pytest.mark.parametrize("depth", [1, 3, 10, 50])
def test_suffix_order_tells_as_far_as_its_depth(depth):
    rng = random.Random(depth)
    passages = [[rng.randrange(1, 3) for _ in range(60)] for _ in range(3)]
    text = np.array(sum((rng.choice(passages)[rng.randrange(20):] for _ in range(40)), []), dtype=np.int64)
    order = S.suffix_order(text, depth).tolist()
    assert sorted(order) == list(range(len(text)))
    heads = [text[i:i + depth].tolist() for i in order]
    assert heads == sorted(heads)


def brute(rows, window):
    texts = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(t) - window + 1):
            first.setdefault(t[p:p + window], k)
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1 if k is not None else 0):
            if first[t[p:p + window]] < k:
                gone[p:p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(t), sum(gone), spans, kept))
    return sorted(out, key=str)


def run(spark, rows, window, **more):
    df = spark.createDataFrame([(k, t, "a", 1, "b") for k, t in rows], DOCS)
    got = S.remove_repeated_bytes(df, window, **more).collect()
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


def made(window, seed):
    rng = random.Random(seed)

    def text(n, letters="abcdefgh é"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [text(rng.randrange(window, 4 * window)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += [text(rng.randrange(3 * window)), rng.choice(passages)[rng.randrange(4):]]
        rows.append((i * 3, "".join(parts)))
    rows += [(7, None), (8, ""), (10, " "), (None, rows[4][1]), (11, rows[4][1]), (13, "x" * 20_000), (14, "x" * 90),
             (16, "ab" * 500), (17, "ab" * 400), (3, rows[8][1]), (3, rows[9][1]), (3, rows[9][1]), (500, passages[0] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, hot", [(50, 10_000), (50, 2), (12, 3)])
def test_equals_all_strings(spark, window, hot):
    rows = made(window, window + hot)
    assert run(spark, rows, window, hot=hot) == brute(rows, window)


def test_rows_of_one_id_are_judged_apart(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, b)]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, [], 50) == []


def test_only_pieces_that_meet_are_ordered(monkeypatch):
    rng = random.Random(4)
    held, ordered = S._Held(), []
    gram, passage = b"a gram that many have", b"a passage of sixty bytes that two of the documents have: both"
    texts = [bytes(rng.choices(range(97, 123), k=30)) + gram + bytes(rng.choices(range(97, 123), k=30)) for _ in range(500)]
    texts[7] += passage
    texts[400] += passage
    for i, t in enumerate(texts):
        held.add(t, 0, i, 0, 0)
    held.add(b"x" * 120, 0, 900, 0, 0)  # repeats only itself
    own = S.suffix_order
    monkeypatch.setattr(S, "suffix_order", lambda text, depth, reach=1: (ordered.append(len(text)) if reach == 1 else None, own(text, depth, reach))[1])
    again = S._Held()  # of another batch
    for i, t in enumerate(texts[:7]):
        again.add(t, 0, 1000 + i, 0, 5)
    batches = [b for h in (held, again) for b in h.rows(4)]
    out = [r for b in S._ordered(50, 4)(batches) for r in b.to_pylist()]
    assert sum(ordered) == len(texts[7]) + len(texts[400]) + 2  # all 507 before
    ids, _, first, end = S._columns(out, [8, 4, 5, 5])
    got = sorted(zip(ids.tolist(), S._low(first, 5).tolist(), S._low(end, 5).tolist()))
    assert got == [(400, 81, 81 + len(passage)), *((1000 + i, 5, 5 + 81) for i in range(7))]
    lengths, ids = np.array([len(t) for t in texts]), np.arange(500)
    assert np.flatnonzero(S.meeting(np.frombuffer(b"".join(texts), np.uint8), lengths, ids, 50)).tolist() == [7, 400]
    assert not S.meeting(np.zeros(0, np.uint8), lengths[:0], ids[:0], 50).any()
