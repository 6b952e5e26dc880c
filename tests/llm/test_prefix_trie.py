"""Tries against dictionaries of all prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codequarry.llm import prefix_trie as T
from codequarry.llm.queries import rebuilt

ROWS = "conv_id long, turn long, role string, text string, t int, block string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2) for r in rows], ROWS)


def ids(role, text):
    """The order of turns that tie."""
    role, text = role or "", text or ""
    words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + words.to_bytes(4, "big")


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, ids(role, text), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def regrow(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # the remainder has the sign of c, as in SQL
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, in_ in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(in_) - 1) * words
    out = []
    for node, in_ in members.items():
        end = ",".join(str(c) for c in sorted(c for c in in_ if len(convs[c]) == len(node)))
        out.append((min(in_), len(node), min(members[node[:-1]]) if node else None, len(in_), children[node],
                    leaves[node], saved[node], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        at = rng.choice([0, 0, 20, -40]) + c
        for turn in range(rng.randrange(1, most)):
            rows.append((at, turn, rng.choice(["user", "user", None, "assistant"]), rng.choice(["a", "a b", "", None, "é ü  x"])))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **more):
    got = T.prefix_trie(*T.kept_turns(T.ordered_turns(frame(spark, rows))), **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block", [2, 8])
def test_equals_all_prefixes(spark, block):
    rows = made(40, 12, block)
    assert run(spark, rows, block=block) == brute(ordered(rows))


def test_long_conversations_share_blocks(spark):
    rng = random.Random(3)
    stem = [("user", f"s{i} s") for i in range(40)]
    rows = []
    for c in range(12):
        turns = stem[:rng.choice([7, 8, 16, 17, 40])] + [("assistant", rng.choice(["x y", "z"])) for _ in range(rng.randrange(30))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    assert run(spark, rows, block=4) == brute(ordered(rows))


def test_regrown_conversations(spark):
    rows = made(60, 7, 9) + [(61, 0, "user", "alone")]
    got = sorted((tuple(r) for r in rebuilt(frame(spark, rows)).collect()), key=str)
    assert got == brute(regrow(ordered(rows)))


def test_ties_nulls_repeats_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    rows = [(None, 0, "user", "no conversation"), (5, None, "user", "first"), (5, 1, "user", "b"), (5, 1, "user", "a"),
            (5, 1, "user", "a"), (6, 0, "user", "x " * 100_000)]
    rows += [(c, t, "user", "same") for c in range(10, 30) for t in range(2)]
    assert run(spark, rows) == brute(ordered(rows))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_turn_id_holds_its_words(spark):
    df = frame(spark, [(1, 0, "user", " a\tbb\x0bc \n"), (1, 1, None, None)])
    got = df.select(T.words_of(T.turn_id(F.col("role"), F.col("text")))).collect()
    assert [r[0] for r in got] == [3, 0]
