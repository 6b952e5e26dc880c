"""Search, similarity and copy joins against brute force."""

import difflib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.operators import ask as A
from codequarry.operators import copies as CP
from codequarry.operators import links as L
from codequarry.operators import rollup as R
from codequarry.operators import search as SE
from codequarry.operators import similarity as SI
from codequarry.operators.analysis import analyse_files

RNG = random.Random(7)
WORDS = ["load", "item", "get_size", "x", "os.path", "é", "unit12", "secretkey", "A" * 30, "read me"]


def texts(n):
    return [" ".join(RNG.choices(WORDS, k=RNG.randint(0, 12))) + "\n" + RNG.choice(WORDS) * 2 for _ in range(n)]


def test_content_hits(spark, make_files):
    files = make_files(*[(f"p{i % 2}", f"f{i}", t) for i, t in enumerate(texts(40) + ["q" * 2500 + "zend"])])
    needles = ["load", "oad item", "secret", "zend", "x", "é", "t1", "me\n", "nothing", "aaaaaaa", "item get_size"]
    n = spark.createDataFrame([(f"p{i}", x) for i in (0, 1) for x in needles], "project string, needle string")
    want = {(r.project, r.path, x) for r in files.collect() for x in needles if x in r.content.lower()}
    assert {tuple(r) for r in SE.content_hits(files, n).collect()} == want
    few = n.where("needle = 'oad item'")
    assert {tuple(r) for r in SE.content_hits(files, few).collect()} == {w for w in want if w[2] == "oad item"}


def test_blank_needles_are_in_no_text(spark, make_files):
    files = make_files(("p", "a", "some text with  blanks"))
    n = spark.createDataFrame([("p", x) for x in ("", " ", "\n")], "project string, needle string")
    assert not SE.content_hits(files, n).collect() and not SE.word_hits(files, n).collect()
    names = spark.createDataFrame([("p", "x")], "project string, hid string")
    assert not SE.substring_pairs(names, n).collect()


def test_substring_pairs(spark):
    names = [("p", n) for n in ["helper12", "get_helper1", "x", "from a import b", "h" * 1500 + "elper"]]
    needles = ["helper1", "x", "er12", "a import", "elper", "zz", "hhhhhh"]
    h = spark.createDataFrame(names, "project string, hid string")
    n = spark.createDataFrame([("p", x) for x in needles], "project string, needle string")
    want = {("p", t, x) for _, t in names for x in needles if x in t}
    assert {tuple(r) for r in SE.substring_pairs(h, n).collect()} == want


def test_names_that_all_end_alike(spark):
    """The last gram is on every name; it is neither chosen nor, where it must be, left to one task."""
    names = [("p", f"{i}_number_handler") for i in range(300)]
    h = spark.createDataFrame(names, "project string, hid string")
    needles = ["handler", "ndler", "r", "7_number_handler", "12_number_handler", "99_num", "handlers"]
    n = spark.createDataFrame([("p", x) for x in needles], "project string, needle string")
    want = {("p", t, x) for _, t in names for x in needles if x in t}
    assert {tuple(r) for r in SE.substring_pairs(h, n, split=7).collect()} == want


def test_split_join_equals_join(spark):
    from codequarry.operators.spread import split_join

    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("a", 1), ("a", 2), ("x", 1)], "k string, v int").persist()
    right = spark.createDataFrame([("hot", i) for i in range(9)] + [("a", 5), ("a", 6), ("y", 1)], "k string, w int").persist()
    want = sorted(tuple(r) for r in left.join(right, ["k"]).collect())
    assert sorted(tuple(r) for r in split_join(left, right, ["k"], 4).collect()) == want and len(want) == 364


def test_word_hits(spark, make_files):
    files = make_files(("p", "a", "load item\nloaded item load\nLoad\nunload load2"), ("p", "b", "none"))
    n = spark.createDataFrame([("p", "load"), ("p", "load item")], "project string, needle string")
    got = {(r.path, r.needle, r.line) for r in SE.word_hits(files, n).collect()}
    assert got == {("a", "load", 1), ("a", "load", 2), ("a", "load", 3), ("a", "load item", 1)}


def cosine_pairs(files):
    by = {}
    for p, path, text in files:
        by.setdefault(p, []).append((path, text))
    out = set()
    for p, rows in by.items():
        tf = {path: Counter(w for w in re.findall(r"(?u)\b\w\w+\b", t.lower()) if w not in C.STOPWORDS) for path, t in rows}
        total, df = Counter(), Counter()
        for c in tf.values():
            total.update(c)
            df.update(c.keys())
        vocab = sorted(total)
        n = len(rows)
        vec = {}
        for path, c in tf.items():
            v = {w: c[w] * (math.log((1 + n) / (1 + df[w])) + 1) for w in vocab if c[w]}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vec[path] = {w: x / norm for w, x in v.items()}
        paths = sorted(vec)
        for i, a in enumerate(paths):
            for b in paths[i + 1:]:
                s = round(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()), 9)
                if 0.7 < s < 0.99:
                    out.add((p, a, b, round(s, 2)))
    return out


def test_similar_files_against_all_pairs(make_files, monkeypatch):
    monkeypatch.setattr(SI, "BLOCK", 4)  # several blocks and parts of matrices here as well
    monkeypatch.setattr(SI, "TERMS", 7)
    monkeypatch.setattr(SI, "DENSE", 4)
    monkeypatch.setattr(SI, "PRODUCTS", 5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        base = random.Random(i // 6).choices(words, k=12)
        rows.append((f"p{i % 2}", f"f{i:02}", " ".join(base + RNG.choices(words, k=RNG.randint(0, 5)))))
    rows += [("p0", "copy1", rows[0][2]), ("p0", "copy2", rows[0][2]), ("p0", "blank", "a b"), ("solo", "s", "w1")]
    want = cosine_pairs(rows)
    got = {tuple(r) for r in SI.similar_files(make_files(*rows)).collect()}
    assert got == want and len(want) > 20


def test_similar_files_of_several_tiles(make_files, monkeypatch):
    """Blocks travel once per tile that their tile meets, not once per block."""
    monkeypatch.setattr(SI, "BLOCK", 4)
    monkeypatch.setattr(SI, "TILES", 2)
    rows = []
    for i in range(60):
        base = random.Random(i // 12).choices([f"w{i}" for i in range(30)], k=12)
        rows.append(("p", f"f{i:02}", " ".join([*base, f"x{i % 7}"])))
    sent = []
    run = SI._tiled
    monkeypatch.setattr(SI, "_tiled", lambda cut, pairs, tile: sent.append((cut, tile)) or run(cut, pairs, tile))
    got = {tuple(r) for r in SI.similar_files(make_files(*rows)).collect()}
    assert got == cosine_pairs(rows) and len(got) > 20
    cut, tile = sent[0]
    assert 1 < tile == cut.select("block").distinct().count() // 2


def test_blocks_travel_packed(make_files, monkeypatch):
    """A block is one row, without the terms that only one file has, and its vectors can be worked out from it."""
    monkeypatch.setattr(SI, "BLOCK", 16)
    words = [f"w{i}" for i in range(40)]
    rows = [("p", f"f{i:02}", " ".join([*random.Random(i // 4).choices(words, k=14), *[f"only{i}x{k}" for k in range(1 + i % 3)]])) for i in range(60)]
    sent = []
    run = SI._tiled
    monkeypatch.setattr(SI, "_tiled", lambda cut, pairs, tile: sent.append((cut, pairs)) or run(cut, pairs, tile))
    got = {tuple(r) for r in SI.similar_files(make_files(*rows)).collect()}
    assert got == cosine_pairs(rows) and len(got) > 20
    cut, pairs = sent[0]
    table = cut.toArrow()
    assert table.num_rows == cut.select("block").distinct().count() < 10
    blocks = [SI._Block(table.combine_chunks(), i) for i in range(table.num_rows)]
    assert sum(b.n for b in blocks) == 60 and len(set(np.concatenate([b.terms for b in blocks]).tolist())) <= 40
    assert all((np.bincount(b.row, b.weight ** 2, b.n) < 1).all() for b in blocks)  # norms count all terms
    # blocks that share an indexed term meet, however many are marked at once
    index = {(b, t) for b, ts in zip(table["block"].to_pylist(), table["index"].to_pylist()) for t in ts}
    want = sorted({(i, j) for i, t in index for j, u in index if t == u and i <= j})
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    monkeypatch.setattr(SI, "_SQUARE", 2)
    monkeypatch.setattr(SI, "TERMS", 3)
    assert sorted((r.i, r.j) for r in SI.block_pairs(cut, 0.7).collect()) == want


def test_similar_counts_stop_where_enough_is_found(make_files, monkeypatch):
    monkeypatch.setattr(SI, "BLOCK", 4)
    words = [f"w{i}" for i in range(30)]
    rows = [("few", f"f{i:02}", " ".join(random.Random(i).choices(words, k=12))) for i in range(30)]
    rows += [("few", "copy", rows[3][2] + " w1"), ("few", "same1", rows[5][2] + " w2"), ("few", "same2", rows[5][2] + " w2"), ("none", "a", "w1")]
    rows += [("many", f"f{i:02}", " ".join(words[:20] + words[20:20 + i % 9])) for i in range(40)]
    want = Counter(r[0] for r in cosine_pairs(rows))
    assert 0 < want["few"] < 12 < want["many"]
    exact = {r.project: r.pairs for r in SI.similar_counts(make_files(*rows), enough=10**6).collect()}
    assert exact == {"few": want["few"], "many": want["many"], "none": 0}
    some = {r.project: r.pairs for r in SI.similar_counts(make_files(*rows), enough=12).collect()}
    assert some["few"] == want["few"] and some["none"] == 0 and 12 < some["many"] < want["many"]


def test_copies_against_all_pairs(spark, make_files):
    sentences = [" ".join(RNG.choices(["alpha", "beta", "gamma", "delta", "eps-ilon", "zeta"], k=9)) for _ in range(30)]
    sources = [(i, f"Start {sentences[i]}. And {sentences[(i * 7) % 30]} end") for i in range(30)] + [(99, "Tiny words")]
    openings = [s[2:-3] for s in sentences[:20]] + ["iny wor", "alpha", "ot here at all today", "", "  ", "ta\nbeta", "Tiny words"]
    files = make_files(*[(f"f{i}", o) for i, o in enumerate(openings)])
    src = spark.createDataFrame(sources, "source int, text string")

    def first(o):
        q = " ".join(o.splitlines()[:10]).lower()
        return min([i for i, t in sources if q.strip() and q in t.lower()], default=None)

    report = {r.path: r for r in CP.copy_report(files, src, exact=True, opening_lines=10).collect()}
    texts_by = dict(sources)
    for i, o in enumerate(openings):
        r = report[f"f{i}"]
        assert r.source == first(o) and r.found == (first(o) is not None)
        want = int(difflib.SequenceMatcher(None, texts_by[r.source], o).ratio() * 100) if r.found else 0
        assert r.percent_copied == want


def all_copied_windows(files, sources, least):
    """Every window of words with its first place in the smallest other source."""
    def placed(text):
        return [(w, n) for n, line in enumerate(text.splitlines(), 1) for w in re.findall(r"\w+", line.lower())]

    held = {}
    for source, text in sorted(sources):
        words = placed(text)
        for i in range(len(words) - least + 1):
            run = words[i:i + least]
            held.setdefault(tuple(w for w, _ in run), {}).setdefault(source, (i, run[0][1], run[-1][1]))
    out = set()
    for path, text, own in files:
        words = placed(text)
        for i in range(len(words) - least + 1):
            run = words[i:i + least]
            others = [(s, *p) for s, p in held.get(tuple(w for w, _ in run), {}).items() if s != own]
            if others:
                out.add((path, i, run[0][1], run[-1][1], *min(others)))
    return out


@pytest.mark.parametrize("least", [1, 4, 10])
def test_copied_windows_against_all_windows(spark, least):
    rng = random.Random(least)
    words = [f"w{i}" for i in range(300)]
    passages = [rng.choices(words, k=rng.randint(least, 3 * least + 4)) for _ in range(8)]

    def text():
        parts = [rng.choices(words, k=rng.randint(0, 15)) for _ in range(3)] + rng.choices(passages, k=2)
        rng.shuffle(parts)
        return "\n".join(" ".join(p) for p in parts).replace("w1 ", "W1, ")

    sources = [(i, text()) for i in range(25)] + [(30, ""), (31, "one two")]
    files = [(f"s{i}", t, i) for i, t in sources] + [(f"f{i}", "\n" * 12 + text(), None) for i in range(15)]
    df = spark.createDataFrame([("p", *f) for f in files], "project string, path string, content string, own int")
    src = spark.createDataFrame(sources, "source int, text string")
    found = CP.copied_windows(df, src, least).persist()
    got = {(r.path, r["at"], r["first"], r["last"], r.source, r.source_at, r.source_first, r.source_last) for r in found.collect()}
    assert got == all_copied_windows(files, sources, least) and got
    places = {(path, i + j) for path, i, *_ in got for j in range(least)}
    for r in CP.copied_words(found, least).collect():
        mine = [g for g in got if g[0] == r.path]
        assert r.source == min(g[4] for g in mine) and r.n_copied == len([p for p in places if p[0] == r.path])


def test_a_copy_far_down_is_one_passage(spark, make_files):
    body = [f"line {i} says {i * 7} and {i * 11}" for i in range(40)]
    src = spark.createDataFrame([(1, "\n".join(["head"] + body)), (2, "\n".join(body[10:20]))], "source int, text string")
    files = make_files(("copy.txt", "\n".join(["new " * 3] * 25 + body[5:30] + ["tail"])), ("own.txt", "nothing of it"))
    got = CP.copied_passages(CP.copied_windows(files, src)).collect()
    assert [tuple(r) for r in got] == [("p", "copy.txt", 1, 26, 50, 7, 31, 25 * 6)]


def test_hot_keys_join_like_others(spark):
    from codequarry.operators.spread import hot_join

    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("none", 3)], "k string, v int").persist()
    right = spark.createDataFrame([("hot", 10), ("a", 20), ("b", 30), ("other", 40)], "k string, w int")
    want = sorted(tuple(r) for r in left.join(right, ["k"]).collect())
    assert sorted(tuple(r) for r in hot_join(left, right, ["k"], key_rows=5).collect()) == want and len(want) == 52


def test_edges(make_files):
    rows = [("a/x.py", "from b.y import z\nfrom utils import k\n"), ("b/y.py", "from x import q\n"), ("b/utils.py", ""),
            ("c/utils.py", "v = 1\n"), ("c/z.js", "import m from './x';\n"), ("main.py", "from c import thing\n")]
    analysed = analyse_files(make_files(*[r for r in rows if r[1]])).persist()
    paths = analysed.select("project", "path")
    assert paths.count() == 5
    got = {(r.src, r.dst) for r in L.file_edges(analysed).collect()}
    assert got == {("a/x.py", "b/y.py"), ("a/x.py", "c/utils.py"), ("b/y.py", "a/x.py"), ("a/x.py", "c/z.js")}
    comp = {(r.source, r.target) for r in L.component_edges(analysed).collect()}
    assert comp == {("a", "b"), ("a", "c"), ("b", "a"), ("root", "c")}
    analysed.unpersist()


def test_class_edges_take_the_last_file(make_files):
    rows = [("a.py", "class P: pass\nclass Q: pass\nclass C(P): pass\n"), ("b.py", "class C(Q, Z): pass\n"),
            ("c.py", "class C: pass\n")]
    got = {(r.child, r.parent) for r in L.class_edges(analyse_files(make_files(*rows))).collect()}
    assert got == {("C", "Q")}


def test_components_and_naming(make_files):
    rows = [(f"d{i}/f{j}.py", f"def f{i}_{j}(): pass\n") for i in range(12) for j in range(2 + (i == 3))]
    analysed = analyse_files(make_files(*rows)).persist()
    parts = R.components(analysed).orderBy("component_rank").collect()
    assert len(parts) == 10 and parts[0].name == "d3" and parts[0].file_count == 3
    assert parts[1].name == "d0" and parts[0].files == ["f0.py", "f1.py", "f2.py"]
    row = R.inconsistent_naming(R.project_totals(analysed)).first()
    assert row.snake == 25 and row.inconsistent
    analysed.unpersist()


def test_questions(spark, make_files):
    files = make_files(("a.py", "# loads things\n# from disk\ndef load(a, b):\n    if a:\n        return b\n\nclass Box:\n    def put(self): pass\n"),
                       ("b.py", "import a\nx = load(1, 2)\n"))
    analysed = analyse_files(files).persist()
    asked = ["What does load do?", "how does load work?", "where is load used?", "where is Box?", "why does load exist",
             "why is load?", "list all classes", "explain disk", "compare load with box", "hello", "what is zzz?"]
    q = spark.createDataFrame([(i, "p", t) for i, t in enumerate(asked)], "qid bigint, project string, text string")
    got = {r.qid: (r.intent, r.answer) for r in A.answer_all(q, analysed, files).collect()}
    assert got[0] == ("what", "Function 'load' is defined in a.py at line 3 with parameters: a, b.")
    assert got[1][1] == "Function 'load' has 3 lines, 1 branches, 0 loops and 1 returns."
    assert got[2][1] == "'load' is found in 2 locations:"
    assert got[3][1] == "'box' is located in a.py at line 7."
    assert got[4][1] == "I don't have enough information to explain why 'load exist' is implemented this way."
    assert got[5][1] == "The code documentation suggests: loads things from disk"
    assert got[6][1] == "Found 1 classes:"
    assert got[7][1] == ("Here's an explanation of 'disk':\n\nBased on the code, this appears to be "
                         "a function or method related to disk.")
    assert got[8][1] == "Cannot compare load (function) with box (class) as they are different types."
    assert got[9][0] == "generic" and got[10][1] == "I couldn't find any information about 'zzz' in the code."
    analysed.unpersist()


def test_scores_stay_in_range(make_files):
    bad = "import hashlib\n" + "hashlib.md5(x)\n" * 30
    row = analyse_files(make_files(("a.py", bad))).first()
    assert row.quality_score == 0 and len(row.suggestions) == 30
    assert [s.line for s in row.security_issues] == list(range(2, 32))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_are_not_broadcast(spark):
    """Spark takes a worked-out content for 20 bytes, so it would send all of them to every task."""
    files = spark.range(2000).selectExpr("'p' AS project", "concat('f', id, '.py') AS path",
                                         "concat('needle', id, repeat(' filler', 500)) AS content")
    subjects = spark.range(50).selectExpr("'p' AS project", "concat('needle', id) AS subject")
    hits = files.selectExpr("project", "path", "split(content, ' ')[0] AS needle")
    found = A.file_mentions(files, subjects, 1, 1, {}, hits)
    assert "BroadcastHashJoin" not in _plan(found)
    assert found.count() == 50


def test_matching_blocks_are_found_by_their_text(monkeypatch):
    letters = ["ab", "abc de", "abcdefghijklm nopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    pairs = [("", "abc"), ("abc", "")]
    for n in range(120):
        a = "".join(RNG.choices(letters[n % 4], k=RNG.choice([1, 40, 199, 200, 201, 500])))
        at = RNG.randrange(len(a))
        pairs.append((a, RNG.choice([a[at:] + a[:at], a[:at] + "".join(RNG.choices(letters[n % 4], k=30)) + a[at + 7:]])))
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    assert [CP.n_matched(a, b) for a, b in pairs] == want
    # difflib's own search goes through 500 x 500 equal characters for each of the blocks
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    words = ["".join(RNG.choices("etaoin shr" * 9 + "dlcumwfg", k=8)) for _ in range(6000)]
    assert 0 < CP.n_matched(" ".join(words), " ".join(reversed(words))) < 54_000


def test_words_are_cut_as_text(monkeypatch):
    texts_ = ["", "One two\r\nthree\rfour_4\u2028five\n\nONE", "\n", "é ß² İx x\x85y ٣ 中文 a-b", "\r", "\none", "x" * 300 + " x", "ab ba"]
    hashes, size, lines = CP._words_of(texts_)
    want = [[(w, n) for n, line in enumerate(t.lower().splitlines(), 1) for w in re.findall(r"\w+", line)] for t in texts_]
    assert size.tolist() == [len(ws) for ws in want]
    flat = [wn for ws in want for wn in ws]
    assert lines.tolist() == [n for _, n in flat]
    by_word = {w: h for (w, _), h in zip(flat, hashes.tolist())}
    assert [by_word[w] for w, _ in flat] == hashes.tolist() and len(set(by_word.values())) == len(by_word)


def test_windows_are_cut_outside_the_jvm(spark, make_files):
    """The hashes of words and runs are worked out on whole arrays, not value by value in expressions."""
    files = make_files(("f0", "One two three four\nfive six"), ("f1", None), ("f2", ""), ("f3", "a b"))
    cut = CP._stretches(files, ["project", "path"], 4)
    assert "MapInArrow" in cut._jdf.queryExecution().toString()
    rows = cut.orderBy("at").collect()
    assert {r.path for r in rows} == {"f0"} and [r.at for r in rows[1:]] == [r.until for r in rows[:-1]]
    assert rows[0].at == 0 and rows[-1].until == 3
    spelt = CP._windows(files, cut, ["project", "path"], 4).orderBy("at").collect()
    assert [(r.at, r["first"], r["last"]) for r in spelt] == [(0, 1, 1), (1, 1, 2), (2, 1, 2)]
    assert len({r.run for r in spelt}) == 3


def test_classes_need_no_pairs(spark, make_files, monkeypatch):
    rows = [("p", f"f{i}", t) for i, t in enumerate(["alpha beta", "beta alpha", "gamma", "alpha beta beta", "gamma!", ""])]
    want = SI.similar_representatives(make_files(*rows))[1].collect()
    monkeypatch.setattr(SI, "block_pairs", None)
    got = SI.class_members(make_files(*rows)).collect()
    assert sorted(got) == sorted(want) and {r.path: r.first for r in got}["f4"] == "f2"


def test_openings_against_all_texts(spark, make_files, monkeypatch):
    monkeypatch.setattr(CP, "BROADCAST_ROWS", 7)
    rng = random.Random(5)
    words = ["Alpha", "beta", "der", "d", "ÉTÉ", "𝔘x𝔘", "a-b", "|", "日本", "İs"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", ", "]) for _ in range(rng.choice((3, 40, 200)))) for _ in range(60)]
    texts += [texts[7], "ab" * 300, "x" * 400 + "y", "ab" * 200 + "a\n", "tail " + texts[9]]
    sources = [(None if i == 3 else i % 62, t) for i, t in enumerate(texts)] + [(70, None), (71, "")]
    asked = [t[k:k + n] for t in texts for k, n in ((0, 1000), (1, 95), (2, 94), (3, 63), (5, 7), (4, 2), (30, 170))]
    asked += [t[:100] + "#" + t[101:] for t in texts] + ["", " \t ", " ", "x" * 300, "x" * 402, "ab" * 301]
    files = make_files(*[(f"f{i}", o) for i, o in enumerate(asked)])
    src = spark.createDataFrame(sources, "source int, text string").repartition(3)
    lower = {r.t: r.q for r in spark.createDataFrame([(t,) for t in {*asked, *texts}], "t string").selectExpr(
        "t", "lower(t) AS q").collect()}
    want = {}
    for i, o in enumerate(asked):
        q = " ".join(lower[o].splitlines()[:10])
        held = [s for s, t in sources if s is not None and t and q.strip(" \t\n\x0b\f\r") and q in lower[t]]
        want |= {f"f{i}": min(held)} if held else {}
    got = {r.path: r.source for r in CP.copy_hits(files, src, opening_lines=10).collect()}
    assert got == want and len(set(want.values())) > 20


def test_openings_that_all_texts_hold_make_no_pairs(spark):
    src = spark.createDataFrame([(i, f"the end of der tag {i}") for i in range(400)], "source int, content string").repartition(4)
    asked = ["the", "end of", "nd of d", "der tag", "f der t"]
    signed = CP._signed(spark.createDataFrame(list(enumerate(asked)), "key int, q string"), ["key"])
    rows = CP._holding_short(src, signed.select("half", "run", "size").toArrow()).groupBy("run").agg(
        F.count("*").alias("n"), F.min("source").alias("first")).collect()
    assert len(rows) == len(asked) and all(r.n <= 8 and r.first == 0 for r in rows)


def test_copied_windows_travel_packed(spark, make_files, monkeypatch):
    """No row per print or window and no text is shuffled, files that are sources are cut once, and sources may have any names."""
    words = [f"w{i}" for i in range(40)]
    sources = [(f"s{i % 29}", " ".join(RNG.choices(words, k=6) * 4)) for i in range(30)] + [(None, " ".join(words))]
    files = [(f"f{i}", t + " end", None) for i, (_, t) in enumerate(sources)] + [(f"o{i}", t, s) for i, (s, t) in enumerate(sources)]
    df = spark.createDataFrame([("p", *f) for f in files], "project string, path string, content string, own string")
    src = spark.createDataFrame(sources, "source string, text string")
    cut, seen = CP._dealt, []
    monkeypatch.setattr(CP, "_dealt", lambda texts, *more: cut(seen.append(texts.count()) or texts, *more))
    found = CP.copied_windows(df, src).persist()
    got = {(r.path, r["at"], r["first"], r["last"], r.source, r.source_at, r.source_first, r.source_last) for r in found.collect()}
    named = [s for s in sources if s[0]]
    want = {w for w in all_copied_windows(files, named, 10) if w[0] != "o29"}
    assert {w for w in got if w[0] != "o29"} == want and got
    # 31 files that are no source, and those whose source has two texts, or none
    assert seen == [len(named) + 31 + 3]
    assert sorted(CP.passages(df, src).collect()) == sorted(CP.copied_passages(found).collect())
    assert sorted(CP.copy_hits(df, src).collect()) == sorted(CP.copied_words(found).collect())
