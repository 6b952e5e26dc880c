"""Size, comment, complexity and vocabulary figures of each file, all row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X

_W = r"\p{L}\p{N}_"


def size_bytes(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def comment_count(content: Column) -> Column:
    """Lines whose first non-blank text opens a comment in some language."""
    return F.regexp_count(content, F.lit(X.jvm_regex(C.COMMENT, multiline=True)))


def comment_ratio(comments: Column, lines: Column) -> Column:
    return F.when(lines > 0, X.py_round(comments / lines, 2)).otherwise(F.lit(0.0))


def cyclomatic(content: Column) -> Column:
    """Whole decision words anywhere in the text, comments and strings included."""
    words = "|".join(C.DECISION_WORDS)
    return F.regexp_count(content, F.lit(f"(?<![{_W}])(?:{words})(?![{_W}])"))


def max_nested_depth(content: Column) -> Column:
    """Deepest indent, in units of four characters, over lines that are not comments."""
    skip = "|".join(s.replace("*", "\\*") for s in C.COMMENT_STARTS)
    indents = F.regexp_extract_all(
        X.line_text(content),
        F.lit(rf"(?Udm)^([\s\x1f&&[^\n]]*+)(?!{skip})[^\s\x1c-\x1f]"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(
        indents, lambda s: F.floor(F.length(s) / C.INDENT_WIDTH))), F.lit(0)).cast("int")


def complexity_rating(cyclomatic_: Column) -> Column:
    return (F.when(cyclomatic_ < 5, "low").when(cyclomatic_ < 10, "medium").otherwise("high"))


def complexity(content: Column) -> Column:
    return X.let(cyclomatic(content), lambda c: F.struct(
        c.cast("int").alias("cyclomatic"),
        max_nested_depth(content).alias("max_nested_depth"),
        complexity_rating(c).alias("rating")))


def identifier_words(content: Column) -> Column:
    """Lower-cased words of all identifiers, split at underscores and case changes."""
    # the edges, told from the inside: a word character is beside each of them
    start, name, end = C.IDENTIFIER.partition("[a-zA-Z_][a-zA-Z0-9_]*")
    whole = start.replace(r"\b", r"(?<!\w)") + name + "+" + end.replace(r"\b", r"(?!\w)")
    ids = F.array_join(X.matches(content, X.jvm_regex(whole), 0), "_")
    pieces = F.regexp_extract_all(ids, F.lit(C.WORD_PIECE.replace("[A-Z]|$", "[A-Z_]|$")), F.lit(0))
    return F.filter(F.split(F.lower(F.array_join(pieces, " ")), " ", -1), lambda w: w != "")


def word_ranks(content: Column, stopwords: list[str] | None = None) -> Column:
    """array<struct<word, cnt>>: the words by frequency, ties by first use."""
    stop = C.STOPWORDS if stopwords is None else stopwords
    kept = X.word_counts(F.filter(identifier_words(content), lambda w: (F.length(w) > 2) & ~w.isin(stop)))
    ranked = F.sort_array(F.transform(kept, lambda e: F.struct(
        (-e.cnt).alias("neg"), e.pos.alias("pos"), e.word.alias("word"))))
    return F.transform(ranked, lambda e: F.struct(
        e.word.alias("word"), (-e.neg).cast("long").alias("cnt")))


def concepts(ranks: Column, k: int = C.TOP_CONCEPTS) -> Column:
    """The k most frequent words."""
    return F.slice(ranks, 1, k)


def has_short_variable(content: Column) -> Column:
    return content.rlike(X.jvm_regex(C.SHORT_VARIABLE.replace(r"\b", r"(?<!\w)", 1)))


def count_of(elements: Column, kind: str) -> Column:
    return F.size(F.filter(elements, lambda e: e.type == kind))


def summary_text(language: Column, elements: Column, lines: Column, ratio: Column) -> Column:
    """One sentence: language, counts by type, lines, documentation."""
    kinds = [("import", "imports"), ("class", "classes"), ("function", "functions"),
             ("method", "methods"), ("component", "components")]

    def part(kind: str, word: str) -> Column:
        return X.let(count_of(elements, kind), lambda n: F.when(
            n > 0, F.concat_ws(" ", n.cast("string"), F.lit(word))))

    counts = F.concat_ws(", ", *[part(*k) for k in kinds])
    percent = F.concat(F.floor(ratio * 100).cast("string"), F.lit("% comments)"))
    return F.concat_ws(
        " ",
        F.when(language != "Unknown", F.concat(language, F.lit(" file"))),
        F.when(F.size(elements) == 0, "with no significant code elements")
        .when(counts != "", F.concat(F.lit("containing "), counts)),
        F.when(lines > 0, F.concat(F.lit("with "), lines.cast("string"), F.lit(" lines"))),
        F.when(ratio > 0.2, F.concat(F.lit("well-documented ("), percent))
        .when(ratio > 0, F.concat(F.lit("with some documentation ("), percent)))


def context_window(lines: Column, at: Column, before: int, after: int) -> Column:
    """Lines ``[at - before, at + after)`` of a 0-based position, joined by line feeds."""
    first = F.greatest(at - before, F.lit(0))
    last = F.least(at + after, F.size(lines))
    return F.array_join(F.slice(lines, first + 1, last - first), "\n")
