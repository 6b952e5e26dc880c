"""Finding many texts inside many texts with equi-joins.

A text that holds a needle holds all its grams, so candidates come from a hash join on
the gram of the needle that the fewest texts hold, and are then checked, however many or
few the needles are. Grams that many texts hold, or that many needles are left with, are
split over tasks. A blank needle is in no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators.spread import KEY_ROWS, shuffled, sized, split_join
from codequarry.plans.stage import stage

_GRAMS = (6, 3, 1)
_CHUNK = 1000
WORD_RUN = r"[\p{L}\p{N}_]++"


def _pieces(text: Column, size: int) -> Column:
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))


def _needle_grams(needle: Column) -> Column:
    """All grams of a needle, of the longest size it has."""
    size = F.length(needle)
    one, three, six = (_pieces(needle, k) for k in sorted(_GRAMS))
    return F.array_distinct(F.when(size >= _GRAMS[0], six).when(size >= _GRAMS[1], three).otherwise(one))


def _grams(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_pieces(text, k) for k in _GRAMS]))


def substring_pairs(haystack: DataFrame, needles: DataFrame, split: int = KEY_ROWS) -> DataFrame:
    """haystack(project, hid, text) x needles(project, needle) -> (project, hid, needle)
    for every text that contains the needle. Without ``text``, ``hid`` is the text."""
    named = "text" not in haystack.columns
    haystack = haystack.withColumn("text", F.col("hid")) if named else haystack
    needles = needles.select("project", "needle").where("needle <> ''").distinct()
    asked = stage(needles.select("project", "needle", F.explode(_needle_grams(F.col("needle"))).alias("gram")))
    chunks = haystack.select("project", "hid", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(_CHUNK)),
        lambda s: F.substr(F.col("text"), s, F.lit(_CHUNK + _GRAMS[0] - 1)))).alias("chunk"))
    held = stage(chunks.select("project", "hid", F.explode(_grams(F.col("chunk"))).alias("gram")).join(
        sized(asked.select("project", "gram").distinct()), ["project", "gram"], "left_semi"))
    spread = held.groupBy("project", "gram").agg(F.count("*").alias("df"))
    rarest = stage(asked.join(shuffled(spread), ["project", "gram"], "left").groupBy("project", "needle").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where(
            "g.df > 0").select("project", "needle", "g.gram"))
    candidates = split_join(held, rarest, ["project", "gram"], split).select(
        "project", "hid", "needle").distinct()
    if named:
        return candidates.where(F.contains("hid", F.col("needle")))
    return candidates.join(shuffled(haystack), ["project", "hid"]).where(
        F.contains("text", F.col("needle"))).select("project", "hid", "needle")


def content_hits(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(project, path, needle) where the lower-cased content holds the needle.

    Needles are matched against the distinct blank-free tokens of a project, which
    grow far slower than the text.
    """
    needles = needles.select("project", "needle").where(F.trim("needle") != "").distinct()
    text = F.lower("content")
    piece = F.element_at(F.array_sort(
        F.split(F.trim("needle"), "\\s+"),
        lambda a, b: F.length(a) - F.length(b)), -1)
    pieces = needles.withColumn("piece", piece)
    tokens = files.select("project", "path", F.explode(
        F.array_distinct(F.split(text, "\\s+"))).alias("token")).where("token <> ''")
    tokens = tokens.withColumn("hid", F.md5("token"))
    vocabulary = tokens.groupBy("project", "hid").agg(F.any_value("token").alias("text"))
    matched = substring_pairs(vocabulary, pieces.select(
        "project", F.col("piece").alias("needle")))
    matched = matched.withColumnRenamed("needle", "piece").join(shuffled(pieces), ["project", "piece"])
    hits = tokens.drop("token").join(shuffled(matched), ["project", "hid"]).select(
        "project", "path", "needle").distinct()
    spaced = F.col("needle").rlike("\\s")
    checked = hits.where(spaced).join(shuffled(files), ["project", "path"]).where(
        F.contains(text, F.col("needle"))).select("project", "path", "needle")
    return hits.where(~spaced).unionByName(checked)


def word_hits(files: DataFrame, words: DataFrame, split: int = KEY_ROWS) -> DataFrame:
    """(project, path, needle, line) of every line holding the needle as whole words.

    Lines are looked up by the word of the needle that the fewest lines hold.
    """
    asked = words.select("project", "needle").distinct().select("project", "needle", F.explode(
        F.array_distinct(F.regexp_extract_all("needle", F.lit(WORD_RUN), F.lit(0)))).alias("word"))
    asked = stage(asked)
    lines = files.select("project", "path", F.posexplode(X.lines(F.lower("content"))).alias("at", "text"))
    held = stage(lines.select("project", "path", "at", "text", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(WORD_RUN), F.lit(0)))).alias("word")).join(
            sized(asked.select("project", "word").distinct()), ["project", "word"], "left_semi"))
    spread = held.groupBy("project", "word").agg(F.count("*").alias("df"))
    rarest = stage(asked.join(shuffled(spread), ["project", "word"], "left").groupBy("project", "needle").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("w")).where(
            "w.df > 0").select("project", "needle", "w.word"))
    edge = r"[\p{L}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{edge})\\Q"), F.replace("needle", F.lit("\\E"), F.lit("")),
                       F.lit(f"\\E(?!{edge})"))
    return split_join(held, rarest, ["project", "word"], split).where(
        F.contains("text", F.col("needle")) & F.rlike("text", pattern)).select(
            "project", "path", "needle", (F.col("at") + 1).alias("line"))


def suffix_matches(paths: DataFrame, requests: DataFrame) -> DataFrame:
    """paths(project, path) x requests(project, request) -> (project, request, path) where
    one is a suffix of the other.

    Both end in the same k characters, k being six or the shorter length, and one
    side always knows k by itself.
    """
    def ends(df: DataFrame, col: str) -> DataFrame:
        anchor = F.least(F.length(col), F.lit(_GRAMS[0]))
        return df.withColumn(f"{col}_k", anchor)

    def all_ends(df: DataFrame, col: str) -> DataFrame:
        return df.withColumn("tail", F.explode(F.transform(
            F.sequence(F.lit(1), F.col(f"{col}_k")), lambda k: F.right(F.col(col), k))))

    p = ends(paths.select("project", "path").where("path <> ''"), "path")
    r = ends(requests.select("project", "request").where("request <> ''").distinct(), "request")
    by_path = p.withColumn("tail", F.right("path", F.col("path_k"))).join(
        shuffled(all_ends(r, "request")), ["project", "tail"])
    by_request = all_ends(p, "path").where(F.length("tail") < F.col("path_k")).join(
        shuffled(r.withColumn("tail", F.right("request", F.col("request_k")))), ["project", "tail"])
    both = by_path.select("project", "request", "path").unionByName(
        by_request.select("project", "request", "path"))
    return both.where(F.endswith("path", F.col("request")) | F.endswith("request", F.col("path")))
