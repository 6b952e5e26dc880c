"""Manifests against trees built node by node."""

import hashlib
import random
import zlib

import pytest

from codequarry.llm import merkle as M

DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx int, tree string, h string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes, fanout):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree, i, fanout):
    for level in tree[:-1]:
        run = level[i // fanout * fanout:(i // fanout + 1) * fanout]
        yield run[:i % fanout], run[i % fanout + 1:]
        i //= fanout


def brute(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r, leaf(r)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    built = {k: levels([h for _, h in trees[k]], fanout) for k in names}
    top = levels([built[k][-1][0] for k in names], fanout)
    out = []
    for place, name in enumerate(names):
        for i, (r, h) in enumerate(trees[name]):
            steps = [*path(built[name], i, fanout), *path(top, place, fanout)]
            key, text = r[0], r[4]
            if key is not None and text is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf((*r[:4], text))
            for before, after in steps:
                folded = H("".join(before) + folded + "".join(after))
            out.append((key, h, built[name][-1][0], top[-1][0], H("".join("".join(b + a) for b, a in steps)),
                        folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, fanout=M.FANOUT):
    df = spark.createDataFrame([(*r, i, "t", "h") for i, r in enumerate(rows)], DOCS)
    return sorted((tuple(r) for r in M.manifest(df, fanout).collect()), key=str)


def made(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice([None, 3, -i]) if i % 7 == 0 else i, rng.choice([None, "a", "é"]),
             rng.choice([None, "", "en", "zz", "Ä"]), rng.choice([None, 5]),
             rng.choice([None, "", "Ab c", "éÉ XX", "no capitals"])) for i in range(n)]


@pytest.mark.parametrize("n, fanout", [(150, 8), (20, 2)])
def test_equals_trees_built_node_by_node(spark, n, fanout):
    rows = made(n, n)
    assert run(spark, rows, fanout) == brute(rows, fanout)


def test_a_lone_leaf_is_the_root(spark):
    rows = [(3, "s", None, 4, "Text")]
    got = run(spark, rows)
    assert got == brute(rows, 8)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")


def test_a_run_of_one_still_gets_a_parent(spark):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(9)]
    assert run(spark, rows) == brute(rows, 8)


def test_repeated_rows_and_long_texts(spark):
    rows = [(7, "s", "en", 1, "Same")] * 20 + [(8, "s", "en", 1, "X" * 3_000_000)]
    assert run(spark, rows) == brute(rows, 8)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_numbered_places_ties_and_groups(spark):
    from codequarry.llm.order import numbered

    rows = [("a", i % 5) for i in range(100)] + [("b", None), ("b", 1)]
    got = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    for g in "ab":
        mine = sorted((r.idx, -1 if r.v is None else r.v, r.n) for r in got if r.g == g)
        size = len(mine)
        assert [r[0] for r in mine] == list(range(size)) and {r[2] for r in mine} == {size}
        assert [r[1] for r in mine] == sorted(r[1] for r in mine)
