"""The per-file analysis every report starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.functions.memo import per_context
from codequarry.operators import findings as N
from codequarry.operators import metrics as M
from codequarry.operators import structure as S


def analyse_files(files: DataFrame, python_mode: str = "exact",
                  extra_languages: dict[str, str] | None = None, elements: bool = True) -> DataFrame:
    """files(project, path, content) -> one analysed row per file.

    Purely per row: no shuffle, and a consumer that reads few columns has the
    other ones pruned away. ``content`` stays available for search. Without `elements`
    they and the summary are left out, and few texts are parsed.
    """
    out = S.with_elements(files.where("content <> ''"), python_mode, extra_languages, elements)
    for step in _metric_columns():
        out = out.withColumns({name: c for name, c in step.items() if elements or name != "summary"})
    return out


@per_context
def _metric_columns() -> list[dict[str, Column]]:
    content = F.col("content")
    return [{
        "ext": F.ltrim(F.regexp_extract("path", "[^/.][^/]*(\\.[^/.]*)\\z", 1), F.lit(".")),
        "size": M.size_bytes(content),
        "line_count": X.line_count(content).cast("int"),
        "comment_count": M.comment_count(content),
        "complexity": M.complexity(content),
        "word_ranks": M.word_ranks(content),
        "code_smells": N.code_smells(content, F.col("wide_functions")),
        "security_issues": N.security_issues(content),
        "short_names": M.has_short_variable(content),
    }, {
        "concepts": M.concepts(F.col("word_ranks")),
        "comment_ratio": M.comment_ratio(F.col("comment_count"), F.col("line_count")),
    }, {
        "quality_score": N.quality_score(F.col("code_smells"), F.col("security_issues"),
                                         F.col("complexity.cyclomatic")),
        "suggestions": N.suggestions(F.col("code_smells"), F.col("security_issues"),
                                     F.col("complexity.rating"), F.col("short_names")),
        "summary": M.summary_text(F.col("language"), F.col("elements"), F.col("line_count"),
                                  F.col("comment_ratio")),
    }]
