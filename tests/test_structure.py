"""Extraction rules on hand-made files, and the two Python modes against each other."""

from pyspark.sql import functions as F

from codequarry import fixtures as FX
from codequarry.functions.pyfacts import syntax_facts
from codequarry.operators import structure as S
from codequarry.operators.analysis import analyse_files


def shape(row):
    return [(e.type, e.name, e.line) for e in row.elements]


def test_python_shapes(make_files):
    code = ('def outer(a, b=1, *c, d, **e):\n    def inner(x, /, y): pass\n    return inner\n'
            'class A(B, m.C, metaclass=M):\n    def f(self): pass\n    if True:\n        def g(self): pass\n'
            '    async def h(self): pass\nx = y = 1\nx: int = 2\np, q = 1, 2\n')
    row = S.with_elements(make_files(("a.py", code))).first()
    assert shape(row) == [("function", "outer", 1), ("function", "inner", 2), ("class", "A", 4),
                          ("function", "g", 7), ("variable", "x", 9), ("variable", "y", 9)]
    assert row.elements[0].params == ["a", "b"] and row.elements[1].params == ["y"]
    assert row.elements[2].bases == ["B"] and row.elements[2].methods == ["f"]


def test_syntax_error_falls_back(make_files):
    row = S.with_elements(make_files(("a.py", "def broken(:\nimport os\nx = 1\n"))).first()
    assert row.parse_ok is False
    assert shape(row) == [("function", "broken", 1), ("import", "import", 2), ("variable", "x", 3)]


def test_javascript(make_files):
    code = ("import a from 'x';\nimport 'y.css';\nvar q = require('z');\nconst r = require('no');\n"
            "class V extends W {\n}\nconst Comp = (p) => {\n};\nvar f = function(a) {};\nfunction g(b) {}\n"
            "o = { k: function() {} };\n")
    row = S.with_elements(make_files(("a.js", code))).first()
    # lines are those of the first mention: "f" and "k" occur before their definitions
    assert shape(row) == [("import", "x", 1), ("function", "f", 1), ("import", "y.css", 2),
                          ("import", "z", 3), ("class", "V", 5), ("component", "Comp", 7),
                          ("function", "g", 10), ("function", "k", 11)]


def test_java(make_files):
    code = "package a.b;\nimport c.D;\nimport static c.E;\nfinal class X extends Y implements P, Q {\n int m(int a) { }\n}\n"
    row = S.with_elements(make_files(("X.java", code))).first()
    # "m" is first mentioned in "import" on line 2
    assert shape(row) == [("package", "a.b", 1), ("import", "c.D", 2), ("method", "m", 2),
                          ("class", "X", 4)]
    cls = next(e for e in row.elements if e.type == "class")
    assert (cls.extends, cls.implements) == ("Y", ["P", " Q "])


def test_generic_variables(make_files):
    code = "".join(f"v{i} = {i}\n" for i in range(15)) + "w=1\nfunctional thing\n"
    row = S.with_elements(make_files(("a.go", code))).first()
    assert [e.name for e in row.elements if e.type == "variable"] == [f"v{i}" for i in range(15)]
    few = make_files(("a.go", code)).select(S.generic_elements(F.col("content"), 10).alias("elements")).first()
    assert [e.name for e in few.elements if e.type == "variable"] == [f"v{i}" for i in range(10)]
    assert ("function", "al", 0) in shape(row)


def test_native_equals_exact(spark):
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").createOrReplaceTempView("part")
    files = spark.sql(FX.FILES).where("path like '%.py'").repartition(8).persist()
    pick = lambda mode: S.with_elements(files, mode).select(
        "project", "path", "parse_ok", "wide_functions", F.sort_array(F.transform("elements", lambda e: F.struct(
            e.line, e.type, e["name"], e.params, e.bases, e.methods))).alias("e"))
    both = pick("exact").alias("a").join(pick("native").alias("b"), ["project", "path"])
    assert both.count() > 100 and both.where("not a.parse_ok").count() > 10
    assert both.where("a.e <> b.e or a.wide_functions <> b.wide_functions or a.parse_ok <> b.parse_ok").count() == 0
    files.unpersist()


HARD = [
    "from os import \\\n    path, sep\nx = 1\n",
    "def f(a,\n      b=2):\n    return a\n",
    "s = 'def g(: ['\nt = \"class (\"\n# def h(:\ndef real(a): pass\n",
    "class A(B,\n        C):\n    def m(self): pass\n",
    "def f(:\n    pass\n", "class A\nx = 1\n", "x = (1,\nimport os\n", "def f(a)\n    pass\n", "d = {'a': [1}\n",
]


def test_native_equals_exact_on_hard_texts(make_files):
    files = make_files(*[(f"{i}.py", t) for i, t in enumerate(HARD)])
    pick = lambda mode: {r.path: r for r in S.with_elements(files, mode).collect()}
    exact, native = pick("exact"), pick("native")
    for i, text in enumerate(HARD):
        a, b = exact[f"{i}.py"], native[f"{i}.py"]
        assert a.parse_ok == b.parse_ok, text
        assert shape(a) == shape(b), text


def test_parser_does_not_enter_expressions(monkeypatch):
    import ast

    from codequarry.functions.pyfacts import syntax_facts
    text = ("try:\n    import a\nexcept E:\n    def f(x): pass\nelse:\n    from b import c\nfinally:\n    class D(B):\n"
            "        def m(self): pass\nmatch q:\n    case 1 if (lambda: 0):\n        def g(a, b, c, d, e, f): pass\n"
            "x = y = [lambda v: v for _ in z]\nasync def h():\n    with w as u:\n        import d\n")
    monkeypatch.setattr(ast, "iter_child_nodes", None)  # it hands on every expression
    facts = syntax_facts(text)
    assert [(e["line"], e["type"], e["name"]) for e in facts["elements"]] == [
        (2, "import", "a"), (4, "function", "f"), (6, "import", "from b import c"), (8, "class", "D"),
        (12, "function", "g"), (13, "variable", "x"), (13, "variable", "y"), (16, "import", "d")]
    assert [w["name"] for w in facts["wide"]] == ["g"]


def test_quality_and_advice_read_only_what_they_need(spark, make_files):
    from codequarry.operators import rollup as R
    from codequarry.operators.analysis import analyse_files
    from codequarry.plans.review import QUALITY, review_advice, review_analysed
    whole = analyse_files(make_files(("p", "a/x.py", "import os\npassword = 'very-secret'\nif 1:\n    y = 2000\n"),
                                     ("p", "a/y.js", "// n\nfunction f(a) { return 1234; }\n"), ("q", "z.go", "package main\n")))
    few = whole.select("project", "path", *QUALITY)
    full = {r.project: r for r in review_analysed(whole).collect()}
    for r in R.quality_assessment(few).collect():
        assert r.asDict() == {"project": r.project, **full[r.project].code_quality.asDict()}
    assert {r.project: r.quality_score for r in R.ai_quality(few).collect()} == {
        p: r.ai_summary.quality_score for p, r in full.items()}
    advice = review_advice(whole.select("project", "path", "language", "elements", "line_count", *QUALITY))
    assert {r.project: r.recommendations for r in advice.collect()} == {p: r.recommendations for p, r in full.items()}


def test_only_texts_with_a_wide_function_need_the_parser(make_files):
    def args(n, between=", "):
        return between.join(f"a{i}" for i in range(n))

    texts = [f"def f({args(n)}):\n    pass\n" for n in (5, 6, 7)] + [
        f"x, y = 1, 2\ndef\tf({args(6, ',\n')}): pass", f"undef f({args(9)})", f"def f(a): pass\n# {args(3)}\ndef g({args(6)}): return 1",
        f"def \\\n  f({args(6)}): pass", f"def g(a, b): return [{args(9)}]", f"class A:\n    def f(self, {args(5)}): pass", f"def\u2003f({args(6)}): pass",
        f"async def f({args(6)}): pass", "def a(x) { step }", "", "# def\n" * 50 + "a, b, c, d, e, f", f"(def f({args(6)})", f"{args(9)} def f(a)"]
    files = make_files(*[(f"f{i}{end}", t) for i, t in enumerate(texts) for end in (".py", ".xyz")])
    want = {f"f{i}{end}": [(w["name"], w["args"]) for w in syntax_facts(t)["wide"]] for i, t in enumerate(texts) for end in (".py", ".xyz") if t}
    whole = {r.path: r for r in analyse_files(files).collect()}
    few = analyse_files(files, elements=False)
    assert "elements" not in few.columns and "summary" not in few.columns
    for r in few.collect():
        assert [(w.name, w.args) for w in r.wide_functions] == want[r.path] == [(w.name, w.args) for w in whole[r.path].wide_functions]
        assert r.quality_score == whole[r.path].quality_score and r.code_smells == whole[r.path].code_smells
    assert sum(map(bool, want.values())) >= 12
