"""Templated questions about the code, answered in batches.

questions(qid, project, text) are answered per distinct (project, subject) and joined
back, so a question asked many times is worked out once. Answers and references are
separate tables: references may be many and are never gathered into one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.operators import metrics as M
from codequarry.operators.copies import matcher_ratio, shingle_overlap
from codequarry.operators.rollup import top_k
from codequarry.operators.search import content_hits, substring_pairs, word_hits
from codequarry.operators.spread import hot_join, shuffled
from codequarry.plans.stage import stage

_SUBJECT_GROUP = {"what": 2, "how": 2, "where": 1, "why": 2, "list": 1, "explain": 1, "compare": 1}
_ANCHORED = ("what", "how", "where")


def _quoted(subject: str | Column) -> Column:
    s = F.col(subject) if isinstance(subject, str) else subject
    return F.concat(F.lit("'"), s, F.lit("'"))


def route(questions: DataFrame) -> DataFrame:
    """Add ``intent``, ``subject``, ``action`` and ``subject2`` by the first pattern that fits.

    Where a pattern allows a tail verb the subject stops before it.
    """
    q = F.trim(F.lower("text"))
    intent, subject, action = F.lit("generic"), F.lit(None), F.lit(None)
    for name, pattern in reversed(C.QUESTION_PATTERNS):
        fits = q.rlike(X.jvm_regex(pattern))
        group = _SUBJECT_GROUP[name]
        if name in _ANCHORED:
            pattern = pattern.replace("[^?]+)", "[^?]+?)") + r"\s*(?:\?|$)"
        value = F.trim(F.regexp_extract(q, X.jvm_regex(pattern), group))
        intent = F.when(fits, name).otherwise(intent)
        subject = F.when(fits, value).otherwise(subject)
        if name == "where":
            action = F.when(fits, F.trim(F.regexp_extract(q, X.jvm_regex(pattern), 2)))
        elif name in ("what", "how"):
            action = F.when(fits, F.lit(None)).otherwise(action)
    compare = dict(C.QUESTION_PATTERNS)["compare"]
    second = F.when(intent == "compare", F.trim(F.regexp_extract(q, X.jvm_regex(compare), 2)))
    # Routed as one generated row: conditions on it are tested after it, not spelled out
    # again below it.
    return questions.select("qid", "project", "text", F.inline(F.array(F.struct(
        intent.alias("intent"), subject.alias("subject"), action.alias("action"),
        second.alias("subject2")))))


def subjects_of(routed: DataFrame, *intents: str) -> DataFrame:
    return routed.where(F.col("intent").isin(*intents)).select("project", "subject").distinct()


# --- element lookup -----------------------------------------------------------------

def named_things(analysed: DataFrame) -> DataFrame:
    """Files and elements under one shape; ``ord`` -1 puts a file before its elements."""
    element = F.transform("elements", lambda e, i: F.struct(
        i.alias("ord"), e.type.alias("type"), e["name"].alias("name"), e.line.alias("line"),
        F.concat(F.initcap(e.type), F.lit(": "), e["name"]).alias("context"),
        e.params.alias("params"), e.bases.alias("bases"), e.methods.alias("methods")))
    none = F.lit(None).cast("array<string>")
    file = F.array(F.struct(
        F.lit(-1).alias("ord"), F.lit("file").alias("type"), F.col("path").alias("name"),
        F.lit(1).alias("line"), F.concat(F.lit("File: "), "path").alias("context"),
        none.alias("params"), none.alias("bases"), none.alias("methods")))
    return analysed.select("project", "path", F.inline(F.concat(file, element))).withColumn(
        "lname", F.lower("name"))


def find_elements(subjects: DataFrame, analysed: DataFrame) -> DataFrame:
    """Everything whose name contains the subject; ``partial`` is 0 for the exact name."""
    things = named_things(analysed)
    names = things.select("project", F.col("lname").alias("hid")).distinct()
    pairs = substring_pairs(names, subjects.select("project", F.col("subject").alias("needle")))
    pairs = pairs.select("project", F.col("hid").alias("lname"), F.col("needle").alias("subject"))
    return things.join(shuffled(pairs), ["project", "lname"]).withColumn(
        "partial", F.when(F.col("lname") == F.col("subject"), 0).otherwise(1)).drop("lname")


def best_elements(hits: DataFrame) -> DataFrame:
    """The first hit of each subject: exact names first, then file and element order."""
    return hits.groupBy("project", "subject").agg(F.min(F.struct(
        "partial", "path", "ord", "type", "name", "line", "context", "params", "bases",
        "methods")).alias("b")).select("project", "subject", "b.*")


def _hits_of(asked: DataFrame, analysed: DataFrame, hits: DataFrame | None) -> DataFrame:
    """The hits of the subjects asked for, looked up unless they are at hand."""
    return find_elements(asked.select("project", "subject").distinct(), analysed) if hits is None else hits


# --- where --------------------------------------------------------------------------

def _located(routed: DataFrame, found: DataFrame) -> DataFrame:
    """Answers from (project, subject, path, line) rows: the place, or how many places."""
    per = found.groupBy("project", "subject").agg(
        F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("one"))
    joined = routed.join(shuffled(per), ["project", "subject"], "left")
    answer = (F.when(F.col("n").isNull(), F.concat(
        F.lit("I couldn't find "), _quoted("subject"), F.lit(" in the codebase.")))
        .when(F.col("n") == 1, F.concat(
            _quoted("subject"), F.lit(" is located in "), F.col("one.path"),
            F.lit(" at line "), F.col("one.line").cast("string"), F.lit(".")))
        .otherwise(F.concat(_quoted("subject"), F.lit(" is found in "),
                            F.col("n").cast("string"), F.lit(" locations:"))))
    return joined.select("qid", answer.alias("answer"), F.coalesce("n", F.lit(0)).alias("n_refs"))


def _is_usage() -> Column:
    return (F.col("intent") == "where") & F.coalesce("action", F.lit("")).isin("used", "called")


def where_defined(routed: DataFrame, analysed: DataFrame, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers of ``where is X`` / ``where is X defined``, and references (project, subject, file,
    line, context), each once however many questions ask for the subject."""
    asked = routed.where((F.col("intent") == "where") & ~_is_usage())
    hits = _hits_of(asked, analysed, hits)
    refs = hits.select("project", "subject", F.col("path").alias("file"), "line", "context")
    return _located(asked, hits), refs


def where_used(routed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers and references of ``where is X used``: lines with X as a whole word, each once
    per subject."""
    asked = routed.where(_is_usage())
    hits = word_hits(files, asked.select("project", F.col("subject").alias("needle")))
    hits = hits.withColumnRenamed("needle", "subject")
    refs = hits.select(
        "project", "subject", F.col("path").alias("file"), "line",
        F.concat(F.lit("Usage of "), "subject").alias("context"))
    return _located(asked, hits), refs


# --- descriptions -------------------------------------------------------------------

def describe_files(analysed: DataFrame) -> DataFrame:
    """Language, non-zero counts and summary of each file."""
    e = F.col("elements")

    def part(kind: str, word: str) -> Column:
        n = M.count_of(e, kind)
        return F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(word)))

    details = F.concat_ws(", ", part("class", "classes"), part("function", "functions"),
                          part("import", "imports"))
    answer = F.concat(
        F.lit("File "), _quoted("path"), F.lit(" ("), "language", F.lit(")"),
        F.when(details != "", F.concat(F.lit(" contains "), details)).otherwise(""),
        F.lit(". Summary: "), "summary")
    return analysed.select("project", "path", answer.alias("answer"))


def _list_or_none(names: Column) -> Column:
    joined = F.array_join(names, ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", "none").otherwise(joined)


def _describe_element() -> Column:
    place = F.concat(F.initcap("type"), F.lit(" "), _quoted("name"), F.lit(" is defined in "),
                     F.col("path"), F.lit(" at line "), F.col("line").cast("string"))
    return (F.when(F.col("type") == "function", F.concat(
        place, F.lit(" with parameters: "), _list_or_none(F.col("params")), F.lit(".")))
        .otherwise(F.concat(
            place, F.lit(" with bases: "), _list_or_none(F.col("bases")),
            F.lit("; methods: "), _list_or_none(F.col("methods")), F.lit("."))))


def _described(best: DataFrame) -> DataFrame:
    return best.where("type in ('function', 'class', 'file')")


def what_is(routed: DataFrame, analysed: DataFrame, files: DataFrame, best: DataFrame | None = None,
            mentions: DataFrame | None = None) -> DataFrame:
    """Describe the best hit if it is a file, function or class, else the concept."""
    asked = routed.where("intent = 'what'").select("qid", "project", "subject")
    subjects = asked.select("project", "subject").distinct()
    if best is None:
        best = best_elements(find_elements(subjects, analysed))
    best = _described(best).join(shuffled(subjects), ["project", "subject"], "left_semi")
    described = best.join(
        shuffled(describe_files(analysed).withColumnRenamed("answer", "file_answer")), ["project", "path"],
        "left").select(
            "project", "subject",
            F.when(F.col("type") == "file", F.col("file_answer"))
            .otherwise(_describe_element()).alias("answer"))
    rest = stage(subjects.join(shuffled(best.select("project", "subject")), ["project", "subject"],
                               "left_anti"))
    answers = described.unionByName(describe_concepts(rest, files, hits=mentions)[0].drop("n_refs"))
    return asked.join(shuffled(answers), ["project", "subject"]).select("qid", "answer")


def indent_of(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(\\s*)", 1))


def block_lines(lines: Column, at: Column) -> Column:
    """The lines after 1-based line ``at`` that are indented deeper than it, blanks included."""
    def cut(rest: Column) -> Column:
        level = indent_of(F.get(lines, at - 1))
        stop = F.array_position(F.transform(
            rest, lambda l: (F.trim(l) != "") & (indent_of(l) <= level)), True)
        return F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)

    return X.let(F.slice(lines, at + 1, F.size(lines)), cut)


def _with_code(best: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the code of each function hit: its header line and its body."""
    held = best.join(shuffled(files.select("project", "path", "content")), ["project", "path"])
    held = held.withColumn("lines", X.lines(F.col("content"))).drop("content")
    at = F.greatest("line", F.lit(1))
    body = F.when(F.col("type") == "file", F.col("lines")).otherwise(
        block_lines(F.col("lines"), at))
    return held.withColumn("body", body).withColumn(
        "code", F.array_join(F.concat(F.array(F.get("lines", at - 1)), "body"), "\n")).drop("lines")


def _unexplained(verb_head: str, tail: str) -> Column:
    return F.concat(F.lit(f"I don't have enough information to explain {verb_head} "),
                    _quoted("subject"), F.lit(tail))


def how_works(routed: DataFrame, analysed: DataFrame, files: DataFrame,
              best: DataFrame | None = None) -> DataFrame:
    """Body statistics of the best hit: lines, branches, loops, returns."""
    asked = routed.where("intent = 'how'").select("qid", "project", "subject")
    subjects = asked.select("project", "subject").distinct()
    if best is None:
        best = best_elements(find_elements(subjects, analysed))
    best = _with_code(_described(best).join(shuffled(subjects), ["project", "subject"], "left_semi"), files)
    count = lambda words: F.regexp_count(
        F.array_join("body", "\n"), F.lit(f"(?<![\\p{{L}}\\p{{N}}_])(?:{words})(?![\\p{{L}}\\p{{N}}_])"))
    answer = F.concat(
        F.initcap("type"), F.lit(" "), _quoted("name"), F.lit(" has "),
        F.size("body").cast("string"), F.lit(" lines, "),
        count("if|elif|else|switch|case").cast("string"), F.lit(" branches, "),
        count("for|while").cast("string"), F.lit(" loops and "),
        count("return").cast("string"), F.lit(" returns."))
    stats = best.select("project", "subject", answer.alias("stats"))
    return asked.join(shuffled(stats), ["project", "subject"], "left").select("qid", F.coalesce(
        "stats", _unexplained("how", " works in this codebase.")).alias("answer"))


def comment_above(lines: Column, at: Column) -> Column:
    """The run of comment lines that ends right above 1-based line ``at``."""
    mark = "^\\s*(?:#|//|/\\*|\\*)"

    def run(above: Column) -> Column:
        stop = F.array_position(F.transform(above, lambda l: ~l.rlike(mark)), True)
        picked = F.when(stop > 0, F.slice(above, F.lit(1), (stop - 1).cast("int"))).otherwise(above)
        return F.array_join(F.reverse(F.transform(picked, lambda l: F.trim(
            F.regexp_replace(l, "^\\s*(?:#+|//+|/\\*+|\\*+/?)\\s*|\\s*\\*/\\s*$", "")))), " ")

    return X.let(F.reverse(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))), run)


def why_is(routed: DataFrame, analysed: DataFrame, files: DataFrame,
           best: DataFrame | None = None) -> DataFrame:
    """The comment block right above the best hit."""
    asked = routed.where("intent = 'why'").select("qid", "project", "subject")
    subjects = asked.select("project", "subject").distinct()
    if best is None:
        best = best_elements(find_elements(subjects, analysed))
    said = best.join(shuffled(subjects), ["project", "subject"], "left_semi").join(
        shuffled(files.select("project", "path", "content")), ["project", "path"]).select(
        "project", "subject",
        comment_above(X.lines(F.col("content")), F.col("line")).alias("said")).where("said <> ''")
    return asked.join(shuffled(said), ["project", "subject"], "left").select("qid", F.when(
        F.col("said").isNotNull(),
        F.concat(F.lit("The code documentation suggests: "), F.col("said"))).otherwise(
            _unexplained("why", " is implemented this way.")).alias("answer"))


# --- list all -------------------------------------------------------------------------

def listable(analysed: DataFrame) -> DataFrame:
    """(project, kind, path, ord, line, context) of everything that can be listed."""
    def of(kind: str) -> Column:
        return F.filter(F.transform("elements", lambda e, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ord"), e.line.alias("line"),
            e["name"].alias("context"), e.type.alias("type"))), lambda e: e.type == kind)

    file = F.array(F.struct(F.lit("file").alias("kind"), F.lit(0).alias("ord"),
                            F.lit(0).alias("line"), F.col("path").alias("context"),
                            F.lit("file").alias("type")))
    imports = F.transform(
        F.sort_array(F.filter(F.transform("elements", lambda e: F.struct(
            e.ord.alias("ord"), e["name"].alias("name"), e.type.alias("type"))),
            lambda e: e.type == "import")),
        lambda e, i: F.struct(F.lit("import").alias("kind"), i.alias("ord"), F.lit(0).alias("line"),
                              e["name"].alias("context"), e.type.alias("type")))
    return analysed.select("project", "path", F.inline(
        F.concat(of("function"), of("class"), file, imports))).drop("type")


def list_kind(subject: Column) -> Column:
    has = lambda *words: F.lit(False) if not words else subject.rlike("|".join(words))
    return (F.when(has("function", "method"), "function").when(has("class"), "class")
            .when(has("file"), "file").when(has("import"), "import"))


def list_all(routed: DataFrame, analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Total and first ten of all functions, classes, files or imports of a project."""
    asked = routed.where("intent = 'list'").withColumn("kind", list_kind(F.col("subject")))
    rows = listable(analysed)
    totals = rows.groupBy("project", "kind").agg(F.count("*").alias("n"))
    first = top_k(rows, ["project", "kind"], [F.asc("path"), F.asc("ord")], 10)
    answers = asked.join(totals, ["project", "kind"], "left").select(
        "qid", F.when(F.col("n").isNull(), F.concat(
            F.lit("No "), "subject", F.lit(" found in the codebase."))).otherwise(F.concat(
                F.lit("Found "), F.col("n").cast("string"), F.lit(" "), "subject", F.lit(":"))
            ).alias("answer"), F.coalesce("n", F.lit(0)).alias("n_refs"))
    refs = asked.join(first, ["project", "kind"]).select(
        "qid", F.col("rnk").alias("ref_no"), F.col("path").alias("file"), "line", "context")
    return answers, refs


# --- one line -------------------------------------------------------------------------

_LINE_KINDS = [
    ("^\\s*def\\s+\\w+\\s*\\(", "This defines a function."),
    ("^\\s*class\\s+\\w+", "This defines a class."),
    ("^\\s*if\\s+", "This is a conditional statement."),
    ("^\\s*for\\s+", "This is a loop statement."),
    ("^\\s*return\\s+", "This returns a value from a function."),
    ("^\\s*import\\s+|^\\s*from\\s+\\w+\\s+import", "This imports external modules or functions."),
]


def explain_lines(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(qid, project, file_name, line): what the line of the first such file does."""
    paths = files.select("project", F.col("path").alias("hid"))
    first = substring_pairs(paths, requests.select(
        "project", F.col("file_name").alias("needle"))).groupBy("project", "needle").agg(
            F.min("hid").alias("path")).withColumnRenamed("needle", "file_name")
    held = requests.join(shuffled(first), ["project", "file_name"], "left").join(
        shuffled(files.select("project", "path", "content")), ["project", "path"], "left")
    held = held.withColumn("lines", X.lines(F.col("content")))
    number = F.col("line").cast("string")
    in_range = (F.col("line") >= 1) & (F.col("line") <= F.size("lines"))
    text = F.when(in_range, F.get("lines", F.col("line") - 1))
    kind = F.lit("")
    for pattern, sentence in reversed(_LINE_KINDS):
        kind = F.when(text.rlike(X.jvm_regex(pattern)), sentence).otherwise(kind)
    answer = (F.when(F.col("path").isNull(), F.concat(
        F.lit("I couldn't find a file matching "), _quoted("file_name"), F.lit(".")))
        .when(~in_range, F.concat(F.lit("Line "), number, F.lit(" is out of range for file "),
                                  _quoted("path"), F.lit(".")))
        .otherwise(F.concat(F.lit("Line "), number, F.lit(" contains: "),
                            F.regexp_replace(text, "^\\s+|\\s+$", ""), F.lit(". "), kind)))
    return held.select("qid", answer.alias("answer"))


# --- concepts and topics ----------------------------------------------------------------

def file_mentions(files: DataFrame, subjects: DataFrame, before: int, after: int,
                  clues: dict[str, Callable[[Column, Column], Column]],
                  hits: DataFrame | None = None) -> DataFrame:
    """(project, subject, path, line, context, clues): a row per file that holds the subject.

    line and context are of its first mention, null where no single line holds the subject; a clue
    is true if it holds for the surroundings of any mention in the file. `hits` are those of
    `content_hits` where they are at hand.
    """
    needles = subjects.select("project", F.col("subject").alias("needle")).distinct()
    hits = content_hits(files, needles) if hits is None else hits.join(
        shuffled(needles), ["project", "needle"], "left_semi")
    rows = hits.withColumnRenamed("needle", "subject").join(
        shuffled(files.select("project", "path", "content")), ["project", "path"])
    subject = F.col("subject")

    def around(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda l, i: F.when(
            F.contains(F.lower(l), subject), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(
            (i + 1).alias("line"), M.context_window(lines, i, before, after).alias("context")))

    def any_of(mentions: Column, clue: str) -> Column:
        return F.exists(mentions, lambda m: clues[clue](m.context, subject)).alias(clue)

    def judge(mentions: Column) -> Column:
        return F.struct(
            F.get(mentions, 0).line.alias("line"), F.get(mentions, 0).context.alias("context"),
            *[any_of(mentions, c) for c in clues])

    found = X.let(F.split("content", "\n", -1), lambda ls: X.let(around(ls), judge))
    return rows.select("project", "subject", "path", F.inline(F.array(found)))


#: What the surroundings of a mention say about a concept.
_CONCEPT_CLUES = {
    "cls": lambda ctx, s: F.contains(ctx, F.lit("class")),
    "init": lambda ctx, s: F.contains(ctx, F.lit("def __init__")),
    "fun": lambda ctx, s: F.contains(ctx, F.concat(F.lit("def "), s)),
    "imp": lambda ctx, s: F.contains(ctx, F.lit("import")) & F.contains(ctx, s),
    "var": lambda ctx, s: F.contains(ctx, F.lit("=")) & F.contains(F.substring_index(ctx, "=", 1), s),
}
_TOPIC_CLUES = {
    "cls": lambda ctx, s: F.contains(F.lower(ctx), F.lit("class")),
    "fun": lambda ctx, s: F.lower(ctx).rlike("function|def"),
}


def _judged(mentions: DataFrame, clues: dict) -> DataFrame:
    return mentions.where("line is not null").groupBy("project", "subject").agg(
        F.count("*").alias("n"), *[F.bool_or(c).alias(c) for c in clues])


def describe_concepts(subjects: DataFrame, files: DataFrame, shown: int = 3,
                      hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a subject seems to be, judged from all its mentions in all files.

    References are the first mentions of the first `shown` files.
    """
    mentions = stage(file_mentions(files, subjects, 3, 3, _CONCEPT_CLUES, hits))
    clue = _judged(mentions, _CONCEPT_CLUES)
    guess = (F.when(F.col("cls"), F.concat(F.lit("a class or object that "), F.when(
        F.col("init"), "initializes with some parameters and ").otherwise("")))
        .when(F.col("fun"), "a function that ").when(F.col("imp"), "a module or library that ")
        .when(F.col("var"), "a variable that stores ").otherwise("a concept related to "))
    answers = subjects.join(shuffled(clue), ["project", "subject"], "left").select(
        "project", "subject", F.when(F.col("n").isNull(), F.concat(
            F.lit("I couldn't find any information about "), _quoted("subject"),
            F.lit(" in the code."))).otherwise(F.concat(
                F.lit("Based on the code, "), _quoted("subject"), F.lit(" appears to be "), guess,
                F.lit("is used in the project for functionality related to "), "subject", F.lit("."))
            ).alias("answer"), F.least(F.coalesce("n", F.lit(0)), F.lit(shown)).alias("n_refs"))
    refs = top_k(mentions.where("line is not null").drop(*_CONCEPT_CLUES),
                 ["project", "subject"], [F.asc("path")], shown, "ref_no")
    return answers, refs


def explain_topics(subjects: DataFrame, files: DataFrame, shown: int = 3,
                   hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A topic judged from all its mentions in all files.

    References are the first mentions of the first `shown` files that hold it.
    """
    mentions = stage(file_mentions(files, subjects, 5, 5, _TOPIC_CLUES, hits))
    clue = _judged(mentions, _TOPIC_CLUES)
    refs = top_k(mentions.drop(*_TOPIC_CLUES), ["project", "subject"], [F.asc("path")], shown,
                 "ref_no").where("line is not null")
    counts = refs.groupBy("project", "subject").agg(F.count("*").alias("n_refs"))
    files_held = mentions.select("project", "subject").distinct().withColumn("held", F.lit(True))
    s = F.col("subject")
    tail = (F.when(F.col("n").isNull(), "")
            .when(F.col("cls"), F.concat(F.lit("a class that handles "), s, F.lit(" functionality.")))
            .when(F.col("fun"), F.concat(F.lit("a function or method related to "), s, F.lit(".")))
            .otherwise(F.concat(F.lit("code related to "), s, F.lit("."))))
    key = ["project", "subject"]
    answers = subjects.join(shuffled(files_held), key, "left").join(shuffled(clue), key, "left").join(
        shuffled(counts), key, "left").select(
        *key, F.when(F.col("held").isNull(), F.concat(
            F.lit("I couldn't find any code related to "), _quoted("subject"),
            F.lit(" in the project."))).otherwise(F.concat(
                F.lit("Here's an explanation of "), _quoted("subject"),
                F.lit(":\n\nBased on the code, this appears to be "), tail)).alias("answer"),
        F.coalesce("n_refs", F.lit(0)).alias("n_refs"))
    return answers, refs


# --- compare ----------------------------------------------------------------------------

def definitions(files: DataFrame, kind: str) -> DataFrame:
    """files(project, path, content, elements) -> (project, path, line, name, subject, code, params,
    methods) of every element of a kind; subject is the lower-cased name, code its header and body."""
    def cut(lines: Column) -> Column:
        def one(e: Column) -> Column:
            at = F.greatest(e.line, F.lit(1))
            return F.struct(
                e.line.alias("line"), e["name"].alias("name"), F.lower(e["name"]).alias("subject"),
                F.array_join(F.concat(F.array(F.get(lines, at - 1)), block_lines(lines, at)), "\n").alias("code"),
                e.params.alias("params"), e.methods.alias("methods"))

        return F.transform(F.filter("elements", lambda e: e.type == kind), one)

    return files.select("project", "path", F.inline(X.each(X.let(X.lines(F.col("content")), cut))))


def against_first(found: DataFrame) -> DataFrame:
    """Every definition beside the first one of its full name, by project, path and line.

    So all definitions of a name are compared, however many there are, by one pair each.
    """
    found = stage(found)
    place = F.struct("project", "path", "line", "name", "code", "params", "methods")
    first = found.groupBy("subject").agg(F.min(place).alias("f"))
    columns = ["project", "path", "line", "name", "code", "params", "methods"]
    pairs = hot_join(found, first, ["subject"]).select(
        "subject", *[F.col(c).alias(f"{c}1") for c in columns], *[F.col(f"f.{c}").alias(f"{c}2") for c in columns])
    return pairs.where((F.col("project1") != F.col("project2")) | (F.col("path1") != F.col("path2")) | (
        F.col("line1") != F.col("line2")))


def compare_function_pairs(pairs: DataFrame, exact: bool = False) -> DataFrame:
    """pairs with name1/2, code1/2, params1/2 -> the sentences comparing two functions."""
    ratio = (matcher_ratio if exact else shingle_overlap)(F.col("code1"), F.col("code2"))
    pairs = pairs.withColumn("ratio", ratio)
    percent = X.py_round(F.col("ratio") * 100, 1).cast("string")
    names = lambda n: _list_or_none(F.col(f"params{n}"))
    takes = lambda n: F.concat(_quoted(f"name{n}"), F.lit(" takes parameters: "), names(n), F.lit("."))
    same = F.coalesce("params1", F.array().cast("array<string>")) == F.coalesce(
        "params2", F.array().cast("array<string>"))
    both = lambda word, text: F.when(
        F.contains("code1", F.lit(word)) & F.contains("code2", F.lit(word)), text)
    answer = F.concat_ws(
        " ",
        F.concat(F.lit("Functions "), _quoted("name1"), F.lit(" and "), _quoted("name2"),
                 F.lit(" are "), percent, F.lit("% similar.")),
        F.when(same, F.concat(F.lit("Both functions take the same parameters: "), names(1),
                              F.lit("."))).otherwise(F.concat(takes(1), F.lit(" "), takes(2))),
        F.when(F.col("ratio") > 0.7, "These functions appear to be related or different versions "
                                     "of the same functionality."),
        both("return", "Both functions return values."),
        both("if", "Both functions contain conditional logic."),
        both("for", "Both functions contain loops."),
        both("try", "Both functions include error handling."))
    return pairs.withColumn("answer", answer)


def _overlap(left: Column, right: Column) -> Column:
    from codequarry.operators.links import set_overlap
    empty = F.array().cast("array<string>")
    return set_overlap(F.array_distinct(F.coalesce(left, empty)),
                       F.array_distinct(F.coalesce(right, empty)))


def compare_class_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with name1/2, methods1/2 -> shared and one-sided methods."""
    pairs = pairs.withColumn("o", _overlap(F.col("methods1"), F.col("methods2")))
    some = lambda names, head: F.when(F.size(names) > 0, F.concat(
        head, F.array_join(names, ", "), F.lit(".")))
    only = lambda n: F.concat(F.lit("Methods only in "), _quoted(f"name{n}"), F.lit(": "))
    return pairs.withColumn("answer", F.concat_ws(
        " ",
        F.concat(F.lit("Classes "), _quoted("name1"), F.lit(" and "), _quoted("name2"),
                 F.lit(" share "), F.col("o.percent").cast("string"), F.lit("% of their methods.")),
        some(F.col("o.common"), F.lit("Common methods: ")),
        some(F.col("o.only_left"), only(1)), some(F.col("o.only_right"), only(2)))).drop("o")


def compare_file_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with path1/2, elements1/2 -> shared element names and counts by type."""
    names = lambda n: F.transform(F.col(f"elements{n}"), lambda e: e["name"])
    pairs = pairs.withColumn("o", _overlap(names(1), names(2)))

    def counts(kind: str) -> Column:
        a, b = (M.count_of(F.col(f"elements{n}"), kind) for n in (1, 2))
        return F.when((a > 0) | (b > 0), F.concat(
            _quoted("path1"), F.lit(" has "), a.cast("string"), F.lit(f" {kind}s, "),
            _quoted("path2"), F.lit(" has "), b.cast("string"), F.lit(".")))

    common = F.col("o.common")
    return pairs.withColumn("answer", F.concat_ws(
        " ",
        F.concat(F.lit("Files "), _quoted("path1"), F.lit(" and "), _quoted("path2"),
                 F.lit(" share "), F.col("o.percent").cast("string"),
                 F.lit("% of their code elements.")),
        *[counts(k) for k in ("class", "function", "import", "variable")],
        F.when(F.size(common) > 0, F.concat(
            F.lit("Common elements include: "), F.array_join(F.slice(common, 1, 5), ", "),
            F.when(F.size(common) > 5, F.concat(
                F.lit(" and "), (F.size(common) - 5).cast("string"), F.lit(" others")))
            .otherwise("."))))).drop("o")


def compare(routed: DataFrame, analysed: DataFrame, files: DataFrame,
            exact: bool = False, best: DataFrame | None = None) -> DataFrame:
    """(qid, answer) of ``compare X with Y``, by the type of the two best hits."""
    asked = routed.where("intent = 'compare'").select("qid", "project", "subject", "subject2")
    subjects = asked.select("project", "subject").unionByName(
        asked.select("project", F.col("subject2").alias("subject"))).distinct()
    if best is None:
        best = best_elements(find_elements(subjects, analysed))
    best = _with_code(best.join(shuffled(subjects), ["project", "subject"], "left_semi"), files).join(
        shuffled(analysed.select("project", "path", "elements")), ["project", "path"])
    side = lambda n, subject: best.select(
        "project", F.col("subject").alias(subject),
        *[F.col(c).alias(f"{c}{n}") for c in
          ("type", "name", "path", "code", "params", "methods", "elements")])
    pairs = asked.join(shuffled(side(1, "subject")), ["project", "subject"], "left").join(
        shuffled(side(2, "subject2")), ["project", "subject2"], "left")
    pairs = compare_function_pairs(pairs, exact).withColumnRenamed("answer", "as_functions")
    pairs = compare_class_pairs(pairs).withColumnRenamed("answer", "as_classes")
    pairs = compare_file_pairs(pairs).withColumnRenamed("answer", "as_files")
    one, two = F.col("type1"), F.col("type2")
    answer = (F.when(one.isNull() | two.isNull(), F.concat(
        F.lit("I couldn't find enough information to compare "), _quoted("subject"),
        F.lit(" and "), _quoted("subject2"), F.lit(".")))
        .when(one != two, F.concat(
            F.lit("Cannot compare "), "subject", F.lit(" ("), one, F.lit(") with "), "subject2",
            F.lit(" ("), two, F.lit(") as they are different types.")))
        .when(one == "function", F.col("as_functions"))
        .when(one == "class", F.col("as_classes")).when(one == "file", F.col("as_files"))
        .otherwise(F.concat(F.lit("Both "), _quoted("subject"), F.lit(" and "),
                            _quoted("subject2"), F.lit(" are "), one,
                            F.lit("s, but I cannot provide a detailed comparison."))))
    return pairs.select("qid", answer.alias("answer"))


# --- everything -------------------------------------------------------------------------

def answer_all(questions: DataFrame, analysed: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, intent, answer) for every question, whatever its kind.

    All subjects are looked up among the elements at once, and those that are concepts or topics
    in the contents at once.
    """
    routed = stage(route(questions))

    def spread(intent: str, answers: DataFrame) -> DataFrame:
        return routed.where(F.col("intent") == intent).join(
            shuffled(answers), ["project", "subject"]).select("qid", "answer")

    compared = routed.where("intent = 'compare'")
    named = routed.where((F.col("intent").isin("what", "how", "why", "compare")) | (
        (F.col("intent") == "where") & ~_is_usage()))
    subjects = named.select("project", "subject").unionByName(
        compared.select("project", F.col("subject2").alias("subject"))).distinct()
    hits = stage(find_elements(subjects, analysed))
    best = stage(best_elements(hits))
    concepts = routed.where("intent = 'what'").select("project", "subject").join(
        shuffled(_described(best).select("project", "subject")), ["project", "subject"], "left_anti")
    topics = subjects_of(routed, "explain")
    mentions = stage(content_hits(files, concepts.unionByName(topics.select("project", "subject")).select(
        "project", F.col("subject").alias("needle"))))

    parts = [
        what_is(routed, analysed, files, best, mentions), how_works(routed, analysed, files, best),
        where_defined(routed, analysed, hits)[0].select("qid", "answer"),
        where_used(routed, files)[0].select("qid", "answer"), why_is(routed, analysed, files, best),
        list_all(routed, analysed)[0].select("qid", "answer"),
        spread("explain", explain_topics(topics, files, hits=mentions)[0]),
        compare(routed, analysed, files, best=best),
        routed.where("intent = 'generic'").select("qid", F.lit(
            "I couldn't analyze this query. Please try asking about something specific in the code."
        ).alias("answer")),
    ]
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    return answers.join(shuffled(routed.select("qid", "intent")), "qid").select("qid", "intent", "answer")
