"""The whole review of every project in a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import links as L
from codequarry.operators import rollup as R
from codequarry.operators.analysis import analyse_files
from codequarry.plans.stage import stage


#: Columns of the analysis that quality is judged by, and all that a review reads.
QUALITY = ("comment_ratio", "complexity", "quality_score", "code_smells", "security_issues")
REVIEWED = (*QUALITY, "language", "elements", "line_count", "word_ranks")


def review_advice(analysed: DataFrame) -> DataFrame:
    """(project, recommendations): the review's recommendations alone, without its lists and graphs."""
    totals = stage(R.project_totals(analysed))
    ai = stage(R.ai_findings(analysed, totals))
    return R.review_recommendations(totals, ai, R.quality_assessment(analysed, totals, ai),
                                    _component_counts(analysed), _edge_counts(analysed))


def _component_counts(analysed: DataFrame) -> DataFrame:
    return R.component_directories(analysed).groupBy("project").agg(F.count("*").alias("n_components"))


def _edge_counts(analysed: DataFrame) -> DataFrame:
    return L.component_edges(analysed).groupBy("project").agg(F.count("*").alias("n_edges"))


def review_analysed(analysed: DataFrame) -> DataFrame:
    """One row per project: summary, AI summary, architecture, quality, recommendations.

    Every part is reduced to one row per project before it is joined. Edges, similar pairs and
    directory lists can be long, so the row holds the numbers of edges; ``component_edges``,
    ``file_edges``, ``class_edges``, ``similar_files`` and ``directory_files`` give them in full. Figures several parts build on are one row
    (or ten) per project and are written once.
    """
    totals = stage(R.project_totals(analysed))
    summary = R.project_summary(analysed, totals)
    ai = stage(R.ai_summary(analysed, totals))
    quality = R.quality_assessment(analysed, totals, ai)
    parts = stage(R.components(analysed))
    largest = parts.groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("component_rank", "name", "file_count", "files")))
        .alias("components"))
    sizes, edges = _component_counts(analysed), _edge_counts(analysed)
    graphs = [L.file_edges(analysed).groupBy("project").agg(F.count("*").alias("n_file_edges")),
              L.class_edges(analysed).groupBy("project").agg(F.count("*").alias("n_class_edges"))]
    chart = R._ranked_list(L.complexity_chart(analysed), ["project"], F.struct("path", "cyclomatic"),
                           "complexity_chart")
    imports = R._ranked_list(R.common_imports(analysed), ["project"], F.struct("name", "cnt"),
                             "common_imports")
    languages = R.language_histogram(analysed).groupBy("project").agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("language", "files")))).alias("languages"))
    advice = R.review_recommendations(totals, ai, quality, sizes, edges)
    ai = ai.select("project", F.struct(
        "quality_score", "code_smells", "security_issues", "key_concepts",
        "recommendations").alias("ai_summary"))
    quality = quality.select("project", F.struct(*[
        c for c in quality.columns if c != "project"]).alias("code_quality"))
    out = summary.select("project", "text", "file_count", "total_lines", "class_count",
                         "function_count", "total_elements", "main_languages")
    for part in (languages, imports, ai, largest, edges, *graphs, chart, quality, advice):
        out = out.join(part, "project", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_edges", "n_file_edges", "n_class_edges")})


def project_review(files: DataFrame, python_mode: str = "exact") -> DataFrame:
    """files(project, path, content) -> the review of each project.

    The per-file rows are analysed and written once, with the columns that the review reads.
    """
    return review_analysed(stage(analyse_files(files, python_mode).select("project", "path", *REVIEWED)))
