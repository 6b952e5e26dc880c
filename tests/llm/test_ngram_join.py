"""The n-gram join against all pairs of sets."""

import itertools
import random
import re

import numpy as np
import pytest

from codequarry.llm import ngram_join as J
from codequarry.llm import shared
from codequarry.llm.words import pack, shingle_set, unpack
from codequarry.operators import spread

DOCS = "doc_id long, text string, id long, component string, print string, n int"


def sets_of(rows, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        n = min(size, len(w))
        out.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    up = {k: k for k, _ in rows if k is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(list(enumerate(sets)), 2):
        if rows[i][0] is None or rows[j][0] is None or not a or not b:
            continue
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = root(rows[i][0]), root(rows[j][0])
            up[max(x, y)] = min(x, y)
    return sorted(((k, len(s), None if k is None else root(k)) for (k, _), s in zip(rows, sets)), key=str)


def run(spark, rows, size, percent):
    df = spark.createDataFrame([(k, t, 1, "x", "y", 2) for k, t in rows], DOCS)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in
                   J.ngram_components(df, size, percent).collect()), key=str)


def family(seed, n, words, edits, start=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((start + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("size,percent,edits", [(4, 85, 8), (5, 80, 9)])
def test_equals_all_pairs(spark, monkeypatch, size, percent, edits):
    monkeypatch.setattr(J, "BLOCK_SETS", 7)  # several blocks per family
    rows = family(1, 60, 120, edits) + family(2, 30, 400, 4 * edits, 100) + family(3, 20, 9, 1, 200)
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "ONE two"), (305, "one"),
             (306, "É b c d e"), (307, "é b c d e"), (0, rows[5][1]), (None, rows[0][1]), (0, rows[0][1])]
    rows += [(400 + i, rows[3][1].upper()) for i in range(5)]
    random.Random(5).shuffle(rows)
    # an id on rows with different texts belongs to the groups of both
    got, want = run(spark, rows, size, percent), brute(rows, size, percent)
    assert {(k, n) for k, n, _ in got} == {(k, n) for k, n, _ in want}
    once = [r for r in rows if r[0] != 0]
    assert run(spark, once, size, percent) == brute(once, size, percent)


def test_chains_of_three(spark):
    # ends that only a middle text links, which has the largest, the middle or the smallest id of the three
    rows = []
    for words in range(6, 61):
        for trial in range(9):
            base = [f"c{words}x{trial}y{i}" for i in range(words)]
            ends = [["e1", *base[1:]], [*base[:-1], "e2"]]
            for _ in range(trial // 3 * words // 20):  # more words at each end
                ends = [["e1", *ends[0][:-1]], [*ends[1][1:], "e2"]]
            three = [*ends, base] if trial % 3 == 0 else [ends[0], base, ends[1]] if trial % 3 == 1 else [base, *ends]
            rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(three)]
    assert run(spark, rows, 5, 80) == brute_by_word(rows, 5, 80)


def brute_by_word(rows, size, percent):
    """brute() on each three rows: the chains share no word but those at their ends."""
    return sorted((x for i in range(0, len(rows), 3) for x in brute(rows[i:i + 3], size, percent)), key=str)


def test_empty_table(spark):
    assert run(spark, [], 5, 80) == []


def test_signatures_are_shared_at_the_threshold():
    rng = np.random.default_rng(3)
    for trial in range(300):
        percent = (85, 80)[trial % 2]
        n = int(rng.integers(7, 900))
        base = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        n = len(base)
        most = n - -(-percent * n // 100)  # elements that may go
        other = np.sort(np.delete(base, rng.choice(n, most, replace=False)))
        if most == 0:
            continue
        bands = J.Bands(percent)
        a, b = J.signatures(base, bands), J.signatures(other, bands)
        assert J.linked(len(other), n, len(other), percent)
        assert np.intersect1d(a, b).size


def test_small_sets_share_signatures():
    rng = np.random.default_rng(8)
    for trial in range(4000):
        percent = (85, 80)[trial % 2]
        base = np.unique(rng.integers(0, 2 ** 63, int(rng.integers(5, 60))).astype(np.uint64))
        gone = rng.random(len(base)) < 0.1
        extra = rng.integers(0, 2 ** 63, int(rng.integers(0, 3))).astype(np.uint64)
        other = np.unique(np.concatenate((base[~gone], extra)))
        common = np.intersect1d(base, other).size
        if len(other) and J.linked(common, len(base), len(other), percent) and common < max(len(base), len(other)):
            assert np.intersect1d(J.signatures(base, bands := J.Bands(percent)), J.signatures(other, bands)).size


def test_unrelated_sets_share_none():
    rng = np.random.default_rng(9)
    seen = {}
    bands = J.Bands(80)
    for i in range(3000):
        for sig in J.signatures(np.sort(rng.integers(0, 2 ** 63, int(rng.integers(6, 60))).astype(np.uint64)), bands).tolist():
            seen.setdefault(sig, set()).add(i)
    assert sum(len(x) > 1 for x in seen.values()) < 60


def test_whole_texts_count():
    long = " ".join(str(i) for i in range(300_000))
    assert len(shingle_set(long, 4)) == 299_997
    assert len(shingle_set("x" * 3_000_000 + " b", 4)) == 1


def test_planes_round_trip():
    values = np.array([0, 1, 2 ** 40 + 7, 2 ** 63 + 5], dtype=np.uint64)
    assert (unpack(pack(values)) == values).all()
    assert (unpack(pack(values, 6), 6) == values & ~np.uint64(0xFFFF)).all()


def test_many_ids_travel_as_bits(spark, monkeypatch):
    rows = family(1, 60, 120, 9) + family(2, 30, 400, 36, 100)
    monkeypatch.setattr(J, "ID_ROWS", 0)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)

    monkeypatch.undo()
    texts = spark.range(300_000).selectExpr("id", "cast(id AS string) AS text")
    used = J._used(texts, texts.where("id % 2 = 0"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "bitmap_construct_agg" in plan  # the driver gets bits, not 150,000 ids
    found = {r.id for r in used.collect()}
    assert len(found) < 152_000 and found >= set(range(0, 300_000, 2))


def test_rows_of_many_ids_are_taken_out(spark, monkeypatch):
    docs = spark.range(50_000).selectExpr("id", "id % 7 AS body", "cast(id AS string) AS text")
    gone = shared.stage(docs.where("id % 3 = 0").select("id", "body"))
    want = sorted(r.id for r in docs.where("id % 3 != 0").collect())
    for rows in (0, 100_000):
        monkeypatch.setattr(shared, "ID_ROWS", rows)
        left = shared.without(docs, gone)
        assert left.columns == docs.columns and sorted(r.id for r in left.collect()) == want
    monkeypatch.setattr(shared, "ID_ROWS", 0)
    monkeypatch.setattr(spread, "MARK_BITS", 1 << 15)  # most rows share a bit with some id
    assert sorted(r.id for r in shared.without(docs, gone).collect()) == want
    assert shared.without(docs, gone.limit(0)).count() == 50_000
