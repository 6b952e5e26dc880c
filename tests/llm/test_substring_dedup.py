"""Window removal against a dictionary of all windows."""

import random
import re

import pytest

from codequarry.llm import substring_dedup as S

DOCS = "doc_id long, text string, id string, runs int, kept string"


def brute(rows, window):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if k is not None else 0):
            if first[tuple(w[p:p + window])] < k:
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), kept))
    return sorted(out, key=str)


def run(spark, rows, window, **more):
    df = spark.createDataFrame([(k, t, "a", 1, "b") for k, t in rows], DOCS)
    return S.remove_repeats(df, window, **more)


@pytest.mark.parametrize("window", [2, 9, 50])
def test_equals_all_windows(spark, monkeypatch, window):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(400)}" for _ in range(rng.randrange(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(2 * window))]
            words += rng.choice(passages)[rng.randrange(3):]
        rows.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(words) + rng.choice(["", " ", "\n"])))
    rows += [(7, None), (8, ""), (10, "  "), (None, rows[4][1]), (11, rows[4][1]), (13, "é " * 200), (14, "é " * 120),
             (16, "x" * 5000)]
    rng.shuffle(rows)
    monkeypatch.setattr(S, "FLUSH", 300)
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in run(spark, rows, window).collect()), key=str)
    assert got == brute(rows, window)


def test_rows_of_one_id_keep_their_own_words(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (2, f"{c} {a}"), (2, None), (2, ""), (3, f"{b} {c}"), (None, a), (None, b),
            (-(1 << 62), c[:20]), (5, c), (5, "x " + a), (1, "y " + b)]
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in run(spark, rows, 50).collect()), key=str)
    assert got == brute(rows, 50)
    assert (2, 60, 0, b) not in got and (2, 60, 60, "") in got
    few = sorted(((r.id, r.kept) for r in run(spark, [(1, a), (2, a), (2, b)], 50).collect()))
    assert few == [(1, a), (2, ""), (2, b)]


def test_many_texts_of_one_id(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(rng.choice([3, 3, 3, 9, None, rng.randrange(20)]), " ".join(
        words[(low := rng.randrange(250)):low + rng.randrange(40)])) for _ in range(300)]
    monkeypatch.setattr(S, "FLUSH", 200)
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in run(spark, rows, 6).collect()), key=str)
    assert got == brute(rows, 6)


def test_rows_can_be_carried(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.id: r for r in run(spark, [(1, text), (2, "new " + text)], 50, carry=True).collect()}
    assert got[1].row.text == text and got[1].n_removed == 0
    assert got[2].kept == "new" and got[2].row.kept == "b" and got[2].n_removed == 60


def test_empty_table(spark):
    assert run(spark, [], 50).collect() == []


def test_lengths_double():
    assert S.lengths(50) == [25, 50] and S.lengths(50, 3) == [13, 25, 50] and S.lengths(1) == [1]
