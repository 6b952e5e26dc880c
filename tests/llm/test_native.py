"""Decontamination and licence scans against plain Python."""

import hashlib
import random
import re

import pytest

from codequarry.llm import decontaminate as D
from codequarry.llm import licenses as L

DOCS = "doc_id long, text string, n_hit int, print string, unit string, id int"
ITEMS = "item_id long, text string, size int, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    runs = {}
    for key, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            runs.setdefault(tuple(w[i:i + n]), set()).add(str(key))
    sizes = {len(r) for r in runs}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in runs:
                    hit |= set(range(i, i + n))
                    found |= runs[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def contaminated(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1, "p", "u", 3) for k, t in docs], DOCS)
    i = spark.createDataFrame([(k, t, 1, "k") for k, t in items], ITEMS)
    return sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(d, i).collect()), key=str)


def some_text(rng, n):
    return rng.choice([" ", ", ", "\n"]).join(rng.choice(["aa", "Bb", "cé", "É1", "d"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_equals_all_runs(spark, short):
    rng = random.Random(short)
    items = [(i, some_text(rng, rng.randrange(10, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "-- !"), (5, None)]
    items += [(33, items[3][1].upper()), (34, "same " * 14)]
    if short:
        items += [(40, "aa1 bb2 cé3"), (41, "aa1"), (42, "Zz9 aa1 aa1"), (43, some_text(rng, 9)), (44, some_text(rng, 9))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "same " * 40), (4, "AA1 b Zz9 aa1 AA1"), (5, "x " * 20_000)]
    for i in range(6, 80):
        w = some_text(rng, rng.randrange(40)).split()
        for _ in range(rng.randrange(3)):
            item = words(items[rng.randrange(len(items))][1])
            low = rng.randrange(len(item) + 1)
            w += ["É" + x if rng.random() < 0.02 else x.title() if rng.random() < 0.2 else x
                  for x in item[low:low + rng.randrange(8, 30)]]
        docs.append((i, " ".join(w)))
    docs.append((80, docs[30][1]))
    assert contaminated(spark, docs, items) == brute(docs, items)


def test_decontamination_of_little(spark):
    assert contaminated(spark, [], [(1, "a " * 12)]) == []
    assert contaminated(spark, [(1, "a b"), (None, "c")], []) == [(1, 2, 0, []), (None, 1, 0, [])]


def test_rows_are_judged_by_their_own_text(spark):
    passage, clean = " ".join(f"p{i}" for i in range(12)), " ".join(f"c{i}" for i in range(30))
    docs = [(1, passage), (1, clean), (1, None), (None, passage), (None, clean), (None, None), (1, passage), (2, clean)]
    for items in ([(7, passage)], [(7, passage), (8, "p3 p4"), (9, "c1"), (8, "c2 c3")]):
        assert contaminated(spark, docs, items) == brute(docs, items)
    got = contaminated(spark, docs, [(7, passage)])
    assert got.count((1, 12, 12, ["7"])) == 2 and (1, 30, 0, []) in got and (None, 12, 12, ["7"]) in got


def test_long_runs_of_one_fingerprint(spark):
    docs = [(1, "same " * 300 + "other " * 30), (2, "same " * 9 + "x"), (3, ("a b c " * 40) + "d")]
    items = [(1, "same " * 11), (2, "b c a " * 5), (3, "same other " * 6)]
    assert contaminated(spark, docs, items) == brute(docs, items)


def test_carried_rows(spark):
    d = spark.createDataFrame([(1, "a " * 12, 5, "p", "u", 3), (None, None, 5, "p", "u", 4)], DOCS)
    i = spark.createDataFrame([(1, "a " * 10, 1, "k")], ITEMS)
    got = {r.row.id: r for r in D.contamination(d, i, carry=True).collect()}
    assert got[3].row.n_hit == 5 and got[3].n_hit == 12 and got[4].row.text is None and got[4].n_hit == 0


def test_words_of_short_items_are_hit_once(spark):
    assert contaminated(spark, [(1, "a b a b a b x")], [(7, "a b a"), (8, "b A b")]) == [(1, 7, 6, ["7", "8"])]


def grams(text):
    w = words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def licences(text, percent):
    best = {}
    units = [] if text is None else text.split("\n") + re.split(r"\n[ \t\r]*\n", text) + [text]
    for unit in units:
        u = grams(unit)
        for name, template in L.TEMPLATES.items():
            t = grams(template)
            n = len(u & t)
            if u and 200 * n >= percent * (len(u) + len(t)):
                best[name] = max(best.get(name, 0), round(2 * n / (len(u) + len(t)), 6))
    first = min(best, key=lambda k: (-best[k], k), default=None)
    return sorted(best), first, best.get(first, 0.0)


def scanned(spark, docs, percent=L.PERCENT):
    d = spark.createDataFrame([(k, t, 1, "p", "u", 3) for k, t in docs], DOCS)
    return sorted(((r.id, r.licenses, r.best, r.dice) for r in L.scan(d, percent=percent).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 60])
def test_licences_equal_all_templates(spark, percent):
    rng = random.Random(percent)
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "License"), (4, "the license " * 30_000)]
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        lines = re.sub(r"\s+", " ", text)
        docs += [(100 + i, f"Some words first.\n\n{lines.upper()}\n\nlast"), (200 + i, f"Intro line\n{lines}\nmore"),
                 (300 + i, text)]
        w = lines.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "other"
        docs += [(400 + i, " ".join(w)), (500 + i, f"{lines}\n{lines}\nReleased under the MIT License.")]
    docs.append((None, docs[8][1]))
    assert scanned(spark, docs, percent) == sorted(((k, *licences(t, percent)) for k, t in docs), key=str)


def runs(text, percent):
    """licences() over all runs of lines."""
    best, lines = {}, text.split("\n")
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            for name, dice in run_hits("\n".join(lines[i:j + 1]), percent).items():
                best[name] = max(best.get(name, 0), dice)
    first = min(best, key=lambda k: (-best[k], k), default=None)
    return sorted(best), first, best.get(first, 0.0)


def run_hits(unit, percent):
    u, found = grams(unit), {}
    for name, template in L.TEMPLATES.items():
        t = grams(template)
        n = len(u & t)
        if u and 200 * n >= percent * (len(u) + len(t)):
            found[name] = round(2 * n / (len(u) + len(t)), 6)
    return found


@pytest.mark.parametrize("percent", [80, 60])
def test_licences_within_long_texts(spark, percent):
    docs = []
    for i, text in enumerate(L.TEMPLATES.values()):
        w = text.split()
        third = [w[:len(w) // 3], w[len(w) // 3:2 * len(w) // 3], w[2 * len(w) // 3:]]
        prose = [" ".join(f"p{i}q{k}r{x}" for x in range(12)) for k in range(24)]
        split = "\n\n".join(" ".join(x) for x in third)  # blank lines in the middle of the notice
        wrapped = "\n".join(" ".join(w[k:k + 4]) for k in range(0, len(w), 4))  # nothing blank around it
        docs += [(10 * i, "\n\n".join([*prose[:12], split, *prose[12:]])), (10 * i + 1, "\n".join([*prose[:12], wrapped, *prose[12:]]))]
    found = scanned(spark, docs, percent)
    assert found == sorted(((k, *runs(t, percent)) for k, t in docs), key=str)
    assert all(dice == 1 for *_, dice in found)


def test_no_documents(spark):
    assert scanned(spark, []) == []


def test_marks_are_needed_to_reach_a_template():
    marks = set(L.marks(L.TEMPLATES, 80))
    for text in L.TEMPLATES.values():
        t = grams(text)
        plain = {g for g in t if not set(g.split()) & marks}
        assert 2 * len(plain) / (len(plain) + len(t)) < 0.8
    assert L.marks({"x": "to be or not to be"}, 80) is None


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_texts_are_cut_into_words_once(spark):
    """A filter on sizes would be pushed below the fingerprints, and work them out again."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l " * 3), (2, "a"), (3, None), (4, "")], "id long, text string")
    prints = D.winnowed(docs, ["id"], 10, 5)
    assert prints._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(lower(") == 1
    assert {r.id for r in prints.collect()} == {1}


def test_texts_without_marked_letters_are_not_cut(spark):
    docs = spark.createDataFrame([(1, "some prose"), (2, "PERMISSION is hereby granted " * 40)], "id long, text string")
    near = L.reachable_texts(docs, L.TEMPLATES, 80)
    assert "contains(" in near._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.id for r in near.collect()] == [2]


def test_carried_rows_do_not_blow_the_plan_up(spark, monkeypatch):
    """A filter pushed below the folding repeats the texts' words hundreds of times."""
    sizes, write = [], D.stage

    def stage(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df)

    monkeypatch.setattr(D, "stage", stage)
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "Before it " + text), (2, "other words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    found = D.contamination(docs, items, carry=True)
    sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 50_000
    assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == [(1, 32, 30, ["7"]), (2, 2, 0, []), (3, 0, 0, [])]
