"""Elements of each file: imports, classes, functions, variables, methods, components.

Everything here is a function of one row, so a corpus of any size is analysed in
the scan stage without a shuffle, however uneven the projects are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.functions.memo import per_context
from codequarry.functions.pyfacts import ELEMENT, python_facts

_ELEMENTS = f"array<{ELEMENT}>"


def language_of(path: Column, extra: dict[str, str] | None = None) -> Column:
    """Language by extension; ``extra`` adds extensions to the fixed table."""
    table = {**C.LANGUAGES, **(extra or {})}
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, X.extension(path)), F.lit("Unknown"))


def rule_set(language: Column) -> Column:
    """Which extraction rules a language uses."""
    return (F.when(language == "Python", "python")
            .when(language.isin("JavaScript", "TypeScript"), "javascript")
            .when(language == "Java", "java")
            .otherwise("generic"))


def _element(kind: str, name: Column, line: Column, extends: Column | None = None,
             implements: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        line.cast("int").alias("line"), F.lit(0).alias("ord"), F.lit(kind).alias("type"),
        name.alias("name"), none.cast("array<string>").alias("params"),
        none.cast("array<string>").alias("bases"), none.cast("array<string>").alias("methods"),
        (none.cast("string") if extends is None else extends).alias("extends"),
        (none.cast("array<string>") if implements is None else implements).alias("implements"))


def _in_line_order(elements: Column) -> Column:
    """Number the elements as found, then sort by line keeping that order."""
    numbered = F.transform(elements, lambda e, i: F.struct(
        e.line.alias("line"), i.alias("ord"), e.type.alias("type"), e["name"].alias("name"),
        e.params.alias("params"), e.bases.alias("bases"), e.methods.alias("methods"),
        e.extends.alias("extends"), e.implements.alias("implements")))
    return F.sort_array(numbered).cast(_ELEMENTS)


def _named(kind: str, names: Column, text: Column, prefix: str = "") -> Column:
    return F.transform(names, lambda n: _element(
        kind, n, X.first_line_of(text, F.concat(F.lit(prefix), n) if prefix else n)))


def _present(names: Column) -> Column:
    return F.filter(names, lambda n: n != "")


def generic_elements(content: Column, variable_limit: int | None = None) -> Column:
    """Rules for any language without its own; an import is named by its keyword. All variables
    count, or the first ``variable_limit`` matches."""
    cls = X.jvm_regex(C.GENERIC_CLASS, multiline=True)
    fun = X.jvm_regex(C.GENERIC_FUNCTION, multiline=True)
    imp = X.jvm_regex(C.GENERIC_IMPORT, multiline=True)
    var = X.jvm_regex(C.GENERIC_VARIABLE, multiline=True)

    def keyword_then_name(kind: str, pattern: str, text: Column) -> Column:
        pairs = F.arrays_zip(X.matches(content, pattern, 1).alias("k"),
                             X.matches(content, pattern, 2).alias("n"))
        return F.transform(pairs, lambda p: _element(
            kind, p["n"], X.first_line_of(text, F.concat_ws(" ", p["k"], p["n"]))))

    def build(text: Column) -> Column:
        found = X.matches(content, var)
        variables = F.transform(
            found if variable_limit is None else F.slice(found, 1, variable_limit),
            lambda n: _element("variable", n, X.first_line_of(text, F.concat(n, F.lit(" =")))))
        return _in_line_order(F.concat(
            _named("import", X.matches(content, imp), text),
            keyword_then_name("class", cls, text),
            keyword_then_name("function", fun, text),
            F.filter(variables, lambda v: v.line > 0)))

    return X.let(X.line_text(content), build)


def javascript_elements(content: Column) -> Column:
    """ES6 and CommonJS imports, classes, four function forms, leftover components."""
    js = [X.jvm_regex(p, multiline=True) for p in C.JS_IMPORTS]
    fun = [X.jvm_regex(p, multiline=True) for p in C.JS_FUNCTIONS]
    cls = X.jvm_regex(C.JS_CLASS, multiline=True)
    comp = X.jvm_regex(C.JS_COMPONENT, multiline=True)

    def build(text: Column) -> Column:
        classes = F.arrays_zip(X.matches(content, cls, 1), X.matches(content, cls, 2))
        functions = F.concat(*[_present(X.matches(content, p)) for p in fun])
        return X.let(functions, lambda fs: _in_line_order(F.concat(
            _named("import", F.concat(*[_present(X.matches(content, p)) for p in js]), text),
            F.transform(classes, lambda c: _element(
                "class", c["0"], X.first_line_of(text, F.concat(F.lit("class "), c["0"])),
                extends=F.nullif(c["1"], F.lit("")))),
            _named("function", fs, text),
            _named("component", F.filter(
                X.matches(content, comp),
                lambda n: ~F.array_contains(fs, n)
                & ~F.array_contains(X.matches(content, cls, 1), n)), text))))

    return X.let(X.line_text(content), build)


def java_elements(content: Column) -> Column:
    """Package, imports, classes with parents, and everything shaped like a method."""
    cls, met = X.jvm_regex(C.JAVA_CLASS), X.jvm_regex(C.JAVA_METHOD)
    package = F.slice(X.matches(content, X.jvm_regex(C.JAVA_PACKAGE)), 1, 1)

    def build(text: Column) -> Column:
        classes = F.arrays_zip(*[X.matches(content, cls, g) for g in (1, 2, 3)])
        return _in_line_order(F.concat(
            _named("package", package, text, "package "),
            _named("import", X.matches(content, X.jvm_regex(C.JAVA_IMPORT)), text, "import "),
            F.transform(classes, lambda c: _element(
                "class", c["0"], X.first_line_of(text, F.concat(F.lit("class "), c["0"])),
                extends=F.nullif(c["1"], F.lit("")),
                implements=F.when(c["2"] == "", F.array().cast("array<string>"))
                .otherwise(F.split(c["2"], ",", -1)))),
            _named("method", X.matches(content, met), text)))

    return X.let(X.line_text(content), build)


# --- Python without the parser --------------------------------------------------

def python_statements(content: Column) -> Column:
    """array<struct<line, indent, code>> of the code lines.

    Triple-quoted strings are emptied and a line break before a closing bracket is
    undone, so a statement stands on the line where it begins.
    """
    numbered = F.array_join(F.transform(
        X.lines(content), lambda l, i: F.concat((i + 1).cast("string"), F.lit("\x02"), l)), "\n")
    emptied = F.regexp_replace(numbered, "(?s)(\"\"\"|''').*?\\1", "\"\"")
    emptied = F.regexp_replace(emptied, "\\\\\\n\\d+\\x02\\s*", " ")
    joined = F.regexp_replace(
        emptied, "\\n\\d+\\x02\\s*(?=[^()\\[\\]{}]*[)\\]}])", " ")
    shape = "^(\\d+)\\x02(\\s*)(.*)"
    rows = F.transform(F.split(joined, "\n", -1), lambda r: F.struct(
        F.regexp_extract(r, shape, 1).cast("int").alias("line"),
        F.length(F.regexp_extract(r, shape, 2)).alias("indent"),
        F.regexp_replace(F.regexp_extract(r, shape, 3), "\\s+#[^'\"]*$", "").alias("code")))
    return F.filter(rows, lambda r: (r.code != "") & ~F.startswith(r.code, F.lit("#")))


def plausible_python(content: Column) -> Column:
    """Whether brackets match in number outside strings and comments, and every class and
    function header is whole. What is not is left to the generic rules, as the parser would."""
    strings = ("(?s)(\"\"\"|\'\'\').*?\\1|\"(?:[^\"\\\\\\n]|\\\\.)*+\"|\'(?:[^\'\\\\\\n]|\\\\.)*+\'|#[^\\n]*+")
    bare = F.regexp_replace(content, strings, "")

    def balanced(text: Column) -> Column:
        count = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
        return (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))

    def whole(s: Column) -> Column:
        return (~s.code.rlike("^(class|def)\\s") | s.code.rlike(_DEF + "[^:]*:") | s.code.rlike(_CLASS + "\\s*:"))

    return X.let(bare, balanced) & F.forall(python_statements(content), whole)


def enclosing_headers(statements: Column) -> Column:
    """Class and function headers with the block that directly holds each.

    The block of a line is the latest earlier block opener with a smaller indent;
    one pass with a stack finds it. -> array<struct<line, code, at, owner, in_class>>,
    ``at``/``owner`` being statement positions (-1: module).
    """
    frame = "struct<indent:int,at:int,is_class:boolean>"
    header = "struct<line:int,code:string,at:int,owner:int,in_class:boolean>"
    openers = F.filter(
        F.transform(statements, lambda s, i: F.struct(
            s.line.alias("line"), s.indent.alias("indent"), s.code.alias("code"), i.alias("at"))),
        lambda s: s.code.rlike("^(class|def)\\s") | s.code.rlike(":\\s*$"))
    start = F.struct(F.array().cast(f"array<{frame}>").alias("stack"),
                     F.array().cast(f"array<{header}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        above = F.filter(acc["stack"], lambda f: f.indent < s.indent)
        return X.let(above, lambda st: F.struct(
            F.concat(st, F.array(F.struct(
                s.indent.alias("indent"), s["at"].alias("at"),
                F.startswith(s.code, F.lit("class ")).alias("is_class")))).alias("stack"),
            F.when(s.code.rlike("^(class|def)\\s"), F.concat(acc["out"], F.array(F.struct(
                s.line.alias("line"), s.code.alias("code"), s["at"].alias("at"),
                F.coalesce(F.get(st, F.size(st) - 1)["at"], F.lit(-1)).alias("owner"),
                F.coalesce(F.get(st, F.size(st) - 1)["is_class"], F.lit(False)).alias("in_class"),
            )))).otherwise(acc["out"]).alias("out")).cast(
                f"struct<stack:array<{frame}>,out:array<{header}>>"))

    return F.aggregate(openers, start, step, lambda acc: acc["out"])


_DEF = "^def\\s+(\\w+)\\s*(?:\\[[^\\]]*\\])?\\(((?:[^()]++|\\((?:[^()]++|\\([^()]*\\))*+\\))*+)\\)"
_CLASS = "^class\\s+(\\w+)\\s*(?:\\[[^\\]]*\\])?(?:\\(((?:[^()]++|\\([^()]*\\))*+)\\))?"


def positional_params(signature: Column) -> Column:
    """Names between the parentheses up to the first star, after a lone slash."""
    nested = "\\[[^\\[\\]]*\\]|\\([^()]*\\)|\\{[^{}]*\\}|\"[^\"]*\"|'[^']*'"
    flat = F.regexp_replace(F.regexp_replace(signature, nested, ""), nested, "")
    head = F.regexp_replace(F.regexp_replace(flat, "(^|,)\\s*\\*.*$", ""), "^.*,\\s*/\\s*(,|$)", "")
    return _present(F.transform(F.split(head, ","), lambda p: F.regexp_extract(p, "^\\s*(\\w+)", 1)))


def _aliasless(names: Column) -> Column:
    return _present(F.transform(
        F.split(names, ","), lambda n: F.trim(F.regexp_replace(n, "\\s+as\\s+\\w+", ""))))


def native_python_elements(content: Column) -> Column:
    """Python elements from line rules alone, in the JVM."""
    def imports(sts: Column) -> Column:
        frm = "^from\\s+\\.*\\s*([\\w.]*)\\s+import\\s*\\(?([^)#;]*)"
        return F.flatten(F.transform(
            F.filter(sts, lambda s: s.code.rlike("^import\\s") | s.code.rlike(frm)),
            lambda s: F.when(
                s.code.rlike("^import\\s"),
                F.transform(_aliasless(F.regexp_extract(s.code, "^import\\s+([^#;]*)", 1)),
                            lambda n: _element("import", n, s.line)))
            .otherwise(F.transform(
                _aliasless(F.regexp_extract(s.code, frm, 2)),
                lambda n: _element("import", F.concat(
                    F.lit("from "), F.regexp_extract(s.code, frm, 1), F.lit(" import "), n),
                    s.line)))))

    def variables(sts: Column) -> Column:
        targets = "^((?:\\w+\\s*=\\s*)+)(?!=)"
        return F.flatten(F.transform(
            F.filter(sts, lambda s: (s.indent == 0) & s.code.rlike(targets)),
            lambda s: F.transform(
                _present(F.transform(F.split(F.regexp_extract(s.code, targets, 1), "="), lambda t: F.trim(t))),
                lambda n: _element("variable", n, s.line))))

    def classes(hs: Column) -> Column:
        return F.transform(
            F.filter(hs, lambda h: F.startswith(h.code, F.lit("class"))),
            lambda c: _element(
                "class", F.regexp_extract(c.code, _CLASS, 1), c.line)
            .withField("bases", F.filter(
                F.transform(F.split(F.regexp_extract(c.code, _CLASS, 2), ","), lambda t: F.trim(t)),
                lambda b: b.rlike("^[^\\W\\d]\\w*$")))
            .withField("methods", F.transform(
                F.filter(hs, lambda m: (m.owner == c["at"]) & F.startswith(m.code, F.lit("def"))),
                lambda m: F.regexp_extract(m.code, _DEF, 1))))

    def functions(hs: Column) -> Column:
        return F.transform(
            F.filter(hs, lambda h: F.startswith(h.code, F.lit("def")) & ~h.in_class),
            lambda d: _element("function", F.regexp_extract(d.code, _DEF, 1), d.line)
            .withField("params", positional_params(F.regexp_extract(d.code, _DEF, 2))))

    return X.let(python_statements(content), lambda sts: X.let(
        enclosing_headers(sts), lambda hs: _in_line_order(F.concat(
            imports(sts), classes(hs), functions(hs), variables(sts)))))


def native_wide_functions(content: Column) -> Column:
    """Functions and methods with too many positional parameters, from line rules."""
    return X.let(python_statements(content), lambda sts: F.filter(
        F.transform(enclosing_headers(sts), lambda h: F.struct(
            h.line.alias("line"), F.regexp_extract(h.code, _DEF, 1).alias("name"),
            F.size(positional_params(F.regexp_extract(h.code, _DEF, 2))).alias("args"))),
        lambda w: (w["args"] > C.MAX_ARGUMENTS) & (w["name"] != "")))


# --- assembly -------------------------------------------------------------------

def with_elements(files: DataFrame, python_mode: str = "exact",
                  extra_languages: dict[str, str] | None = None, elements: bool = True) -> DataFrame:
    """Add ``language``, ``parse_ok``, ``elements`` and ``wide_functions`` to the files.

    ``python_mode`` "exact" sends the texts that can hold a Python definition to the
    parser; a Python file it rejects falls back to the generic rules. "native" stays
    in the JVM. Without `elements` only `language` and `wide_functions` are sure to be
    there, and only texts that can hold such a function are parsed.
    """
    extra = tuple(sorted((extra_languages or {}).items()))
    out = files
    for step in _element_columns(python_mode, extra, elements):
        out = out.withColumns(step)
    return out.drop("facts", "native_ok", "rules")


#: After the first ``def`` there are as many commas as the parameters of a wide function have.
_MAYBE_WIDE = rf"(?s)\A(?>.*?def)(?:[^,]*+,){{{C.MAX_ARGUMENTS}}}"


def _no_functions() -> Column:
    return F.array().cast("array<struct<line:int,name:string,args:int>>")


@per_context
def _element_columns(python_mode: str, extra: tuple, elements: bool = True) -> list[dict[str, Column]]:
    content, rules = F.col("content"), F.col("rules")
    steps = [{"language": language_of(F.col("path"), dict(extra))},
             {"rules": rule_set(F.col("language"))}]
    if python_mode == "exact":
        parse = content.rlike(_MAYBE_WIDE)
        if not elements:
            return [*steps, {"facts": python_facts(F.when(parse, content))},
                    {"wide_functions": F.coalesce("facts.wide", _no_functions())}]
        steps.append({"facts": python_facts(F.when((rules == "python") | parse, content))})
        python = F.when(F.col("facts.ok"), F.col("facts.elements")).otherwise(
            generic_elements(content))
        wide, parsed = F.col("facts.wide"), F.when(rules == "python", F.col("facts.ok"))
    else:
        steps.append({"native_ok": F.when(rules == "python", plausible_python(content))})
        parsed = F.col("native_ok")
        python = F.when(parsed, native_python_elements(content)).otherwise(generic_elements(content))
        wide = F.when(parsed, native_wide_functions(content))
    steps.append({
        "parse_ok": parsed,
        "wide_functions": F.coalesce(wide, _no_functions()),
        "elements": F.when(rules == "python", python)
        .when(rules == "javascript", javascript_elements(content))
        .when(rules == "java", java_elements(content))
        .otherwise(generic_elements(content)).cast(_ELEMENTS)})
    return steps


def names_of(elements: Column, kind: str) -> Column:
    """Names of one kind in the order they were found."""
    picked = F.filter(elements, lambda e: e.type == kind)
    return F.transform(
        F.sort_array(F.transform(picked, lambda e: F.struct(
            e.ord.alias("ord"), e["name"].alias("name")))),
        lambda e: e["name"])


def element_rows(analysed: DataFrame) -> DataFrame:
    """One row per element, ``ord`` giving the order inside the file."""
    return analysed.select(
        "project", "path", "language", F.posexplode(X.each("elements")).alias("ord", "e")).select(
        "project", "path", "language", "ord", "e.line", "e.type", "e.name", "e.params",
        "e.bases", "e.methods", "e.extends", "e.implements")


def import_rows(analysed: DataFrame) -> DataFrame:
    """One row per import text in the order found."""
    return analysed.select("project", "path", F.posexplode(
        names_of(F.col("elements"), "import")).alias("ord", "name"))
