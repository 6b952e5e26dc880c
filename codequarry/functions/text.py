"""Row-local text functions built from JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_OUTSIDE = {"w": f"[{_WORD}]", "s": f"[{_SPACE}]", "d": r"\p{Nd}", "b": _EDGE}
_INSIDE = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}


def jvm_regex(pattern: str, multiline: bool = False, dotall: bool = False) -> str:
    """Spell a Python (str, Unicode) pattern so that java.util.regex agrees with it.

    Word, space and digit classes become Unicode classes, only ``\\n`` ends a line,
    and a literal brace is escaped.
    """
    out, in_class, i = [], False, 0
    pattern = pattern.removeprefix("(?u)")
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "{" and not in_class and not pattern[i + 1:i + 2].isdigit():
            ch = r"\{"
        out.append(ch)
        i += 1
    flags = "Ud" + ("m" if multiline else "") + ("s" if dotall else "")
    return f"(?{flags})" + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def each(items: Column | str) -> Column:
    """A computed array as the input of a generator.

    Over a bare column Spark infers a size filter and pushes it below the projection
    that computes the array, working the array out twice; over this it does not.
    """
    return F.coalesce(items, F.array())


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def line_text(content: Column) -> Column:
    """Content with every separator that ends a line in ``str.splitlines`` as ``\\n``."""
    return F.regexp_replace(content, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")


def line_count(content: Column) -> Column:
    return let(line_text(content), lambda t: (
        F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        + F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)))


def lines(content: Column) -> Column:
    """The lines of ``str.splitlines``."""
    return let(F.split(line_text(content), "\n", -1), lambda s: F.slice(
        s, 1, F.size(s) - F.when(F.element_at(s, -1) == "", 1).otherwise(0)))


def first_line_of(line_text_: Column, needle: Column) -> Column:
    """1-based number of the first line holding ``needle``; 0 if no line does."""
    before = F.call_function("substring_index", line_text_, needle, F.lit(1))
    return F.when(
        F.contains(line_text_, needle) & ~needle.rlike("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"),
        F.size(F.split(before, "\n", -1))).otherwise(0)


def match_lines(content: Column, pattern: str) -> Column:
    """Line number of every non-overlapping match, in order.

    A mark is put before each match and marks are counted per line, so the cost
    stays linear in the text however many matches there are.
    """
    marked = F.split(F.regexp_replace(F.replace(content, F.lit("\x01"), F.lit("")),
                                      pattern, "\x01$0"), "\n", -1)
    hits = F.filter(
        F.transform(marked, lambda l, i: F.struct(
            (i + 1).alias("line"),
            (F.length(l) - F.length(F.replace(l, F.lit("\x01"), F.lit("")))).alias("n"))),
        lambda h: h.n > 0)
    return F.when(
        content.rlike(pattern),
        F.flatten(F.transform(hits, lambda h: F.array_repeat(h.line, h.n)))
    ).otherwise(F.array().cast("array<int>"))


def word_counts(words: Column) -> Column:
    """array<struct<word, cnt, pos>> of the distinct words; ``pos`` is the first position.

    Sorting and measuring runs keeps the count inside the row.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda e, i: F.when(
                (i == 0) | (e.word != F.element_at(s, F.greatest(i, F.lit(1))).word), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda st: F.transform(st, lambda at, k: F.struct(
            F.get(s, at).word.alias("word"),
            (F.coalesce(F.get(st, k + 1), F.size(s)) - at).alias("cnt"),
            F.get(s, at).pos.alias("pos"))))

    tagged = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    return let(F.sort_array(tagged), runs)


def py_round(value: Column, digits: int) -> Column:
    """``round(x, digits)`` of a non-negative double exactly as CPython rounds it.

    The half-way test needs the exact product x * 10^digits, so x is split in two
    parts whose products are exact.
    """
    scale = float(10 ** digits)
    v = value.cast("double")
    high = v * 134217729.0 - (v * 134217729.0 - v)
    down = F.floor(v * scale).cast("double")
    rest = (high * scale - (down + 0.5)) + (v - high) * scale
    up = (rest > 0) | ((rest == 0) & (down % 2 == 1))
    return F.when(up, (down + 1.0) / scale).otherwise(down / scale)


def py_round_sql(value: str, digits: int) -> str:
    """The same rounding as SQL text."""
    s = float(10 ** digits)
    high = f"(({value}) * 134217729.0e0 - (({value}) * 134217729.0e0 - ({value})))"
    down = f"floor(({value}) * {s}e0)"
    rest = f"(({high} * {s}e0 - ({down} + 0.5e0)) + (({value}) - {high}) * {s}e0)"
    return (f"CASE WHEN {rest} > 0 OR ({rest} = 0 AND {down} % 2 = 1) "
            f"THEN ({down} + 1) / {s}e0 ELSE {down} / {s}e0 END")


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*\\z", 1), "(?<=[^/])/+\\z", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)\\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, '' if none; leading dots do not count."""
    return F.regexp_extract(F.lower(path), "[^/.][^/]*(\\.[^/.]*)\\z", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    cut = F.regexp_extract(name, "^(\\.*[^.].*?)(?:\\.[^.]*)?\\z", 1)
    return F.when(cut == "", name).otherwise(cut)
