"""Reading, admitting and storing."""

from pyspark.sql import functions as F

from codequarry.operators.analysis import analyse_files
from codequarry.operators import rollup as R
from codequarry.operators.search import suffix_matches
from codequarry.sources import intake, results, tree


def test_scan_tree(spark, tmp_path):
    files = {"one/__init__.py": b"x = 1\n", "one/.hidden.py": b"y = 2\r\nz = 3\r", "two/a.js": b"var a;\xff",
             "two/deep/er/b.go": b"package b", "two/bin.py": b"\x00\x01", "two/empty.py": b"",
             "two/note.zip": b"text", "top.md": "é".encode()}
    for name, raw in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)
    for tasks in (1, 2, 50):
        assert {r.path for r in tree.list_tree(spark, str(tmp_path), tasks).collect()} == set(files)
    got = {r.path: (r.project, r.content, r.size) for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"one/__init__.py": ("one", "x = 1\n", 6), "one/.hidden.py": ("one", "y = 2\nz = 3\n", 13),
                   "two/deep/er/b.go": ("two", "package b", 9), "top.md": ("top.md", "é", 2)}


def test_binary_cut_inside_a_character(spark):
    rows = [("a" * 7999 + "é").encode(), ("a" * 7998 + "é").encode(), b"ok", b"a" * 8000 + b"\x00"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, bytes binary")
    assert {r.i for r in intake.drop_binary(df, 8000).collect()} == {1, 2, 3}
    assert {r.i for r in intake.drop_binary(df).collect()} == {0, 1, 2}


def test_decode(spark):
    raws = [b"a\r\nb\rc", b"\xff\xfe", b"\xe2\x82", b"\xc3\xa9\xc3", b"\xf0\x9f\x98", b"\xed\xa0\x80"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, bytes binary")
    got = [r.t for r in df.select("i", intake.decode_text(F.col("bytes")).alias("t")).orderBy("i").collect()]
    assert got == [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raws]


def test_admit_upload(spark):
    mb = 1024 * 1024
    rows = [("a", i, f"f{i}.py", mb // 2) for i in range(150)]
    rows += [("b", i, f"f{i}.go", 4 * mb) for i in range(40)] + [("b", 5, "x.txt", 1), ("b", 6, "big.py", 6 * mb)]
    df = spark.createDataFrame(rows, "project string, ord int, name string, size bigint")
    got = {r.project: r["count"] for r in intake.admit_upload(df).groupBy("project").count().collect()}
    assert got == {"a": 100, "b": 25}


def test_repo_urls(spark):
    urls = ["https://github.com/a/b", "https://github.com/a/b.git", "git@github.com:a/b.git", "https://x.org/a/b",
            "https://github.com/a"]
    known, bad = intake.repo_catalog(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert [tuple(r) for r in known.collect()] == [("a", "b", 3)]
    assert {r.url for r in bad.collect()} == set(urls[3:])


def test_suffix_matches_against_all_pairs(spark):
    paths = ["a/b.py", "b.py", "py", "src/main/long_name.py", "name.py", "x"]
    asks = ["b.py", "/root/a/b.py", "y", "y/x", "e.py", "zz", "long_name.py", "p"]
    p = spark.createDataFrame([("p", v) for v in paths], "project string, path string")
    r = spark.createDataFrame([("p", v) for v in asks], "project string, request string")
    got = {(x.request, x.path) for x in suffix_matches(p, r).collect()}
    assert got == {(a, b) for a in asks for b in paths if a.endswith(b) or b.endswith(a)}


def test_results_round_trip(spark, make_files, tmp_path):
    analysed = analyse_files(make_files(("p", "a.py", "import os\n"), ("q", "b.js", "var a = 1;\n"))).drop("content")
    results.write_results(analysed, R.project_summary(analysed), str(tmp_path), "r1")
    files, summary = results.read_results(spark, str(tmp_path), "r1", "p")
    assert [r.path for r in files.collect()] == ["a.py"] and summary.count() == 1
    assert files.first().elements[0].name == "os"


def test_a_run_analyses_what_changed(spark, make_files, tmp_path):
    path = str(tmp_path)
    first = [("p", "a.py", "x = 1\n"), ("p", "b.py", "y = 1\n"), ("q", "c.go", "z = 1\n"), ("q", "empty.py", "")]
    then = [("p", "a.py", "x = 1\n"), ("p", "b.py", "y = 2\nw = 3\n"), ("p", "new.py", "n = 1\n")]
    seen = []

    def analyse(files):
        seen.append(sorted(r.path for r in files.collect()))
        return analyse_files(files)

    results.write_run(make_files(*first), path, "r1", analyse=analyse)
    results.write_run(make_files(*then), path, "r2", previous="r1", analyse=analyse)
    results.write_run(make_files(*then), path, "r3", previous="r2", analyse=analyse)
    assert seen == [["a.py", "b.py", "c.go", "empty.py"], ["b.py", "new.py"], []]
    rows = lambda run, *more: {(r.path, r.line_count, r.stored) for r in results.read_run(spark, path, run, *more).collect()}
    assert rows("r1") == {("a.py", 1, "r1"), ("b.py", 1, "r1"), ("c.go", 1, "r1")}
    assert rows("r2") == rows("r3") == {("a.py", 1, "r1"), ("b.py", 2, "r2"), ("new.py", 1, "r2")}
    assert rows("r1", "q") == {("c.go", 1, "r1")} and rows("r2", "q") == set()
    assert [tuple(r) for r in results.read_summary(spark, path, "r3").select("project", "file_count", "total_lines").collect()] == [("p", 3, 4)]


def test_looked_up_paths_are_not_broadcast(spark):
    """Spark takes a worked-out path for 20 bytes, so it would send all paths to every task."""
    paths = spark.range(3000).selectExpr("'p' AS project", "concat('src/', repeat('deep/', 30), id, '.py') AS path")
    wanted = spark.range(40).selectExpr("'p' AS project", "concat('/', id, '.py') AS request")
    found = intake.content_lookup(paths, wanted)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40
