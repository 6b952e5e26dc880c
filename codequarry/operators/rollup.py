"""Project-level rollups of the per-file analysis.

Counts are pre-aggregated before every shuffle, top-k lists come from ranked
windows that Spark cuts to k rows per task before the exchange, and lists are
only collected where their length is fixed (k, or the number of rule types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.operators import metrics as M
from codequarry.operators.structure import import_rows

RECOMMENDATION = "struct<type:string,message:string>"
#: Near-duplicate pairs beyond which refactoring is advised.
DUPLICATES = 5


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank: str = "rnk") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _ranked_list(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Collect a ranked frame of bounded length into one ordered array."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("rnk"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p.v).alias(name))


def language_histogram(analysed: DataFrame) -> DataFrame:
    """Files per language; ``first_path`` is where a language first appears."""
    return analysed.groupBy("project", "language").agg(
        F.count("*").alias("files"), F.min("path").alias("first_path"))


def main_languages(analysed: DataFrame) -> DataFrame:
    """``Lang (n), ...`` of the three most frequent languages."""
    top = top_k(language_histogram(analysed), ["project"],
                [F.desc("files"), F.asc("first_path")], 3)
    label = F.concat(F.col("language"), F.lit(" ("), F.col("files").cast("string"), F.lit(")"))
    return _ranked_list(top, ["project"], label, "langs").select(
        "project", F.array_join("langs", ", ").alias("main_languages"))


def _quality_sums() -> list[Column]:
    return [F.count("*").alias("file_count"), F.sum("quality_score").alias("quality_sum"),
            F.sum(F.round(F.col("comment_ratio") * 100).cast("long")).alias("comment_hundredths"),
            F.sum("complexity.cyclomatic").alias("cyclomatic_sum")]


def quality_totals(analysed: DataFrame) -> DataFrame:
    """The totals that quality is judged by; they need no elements."""
    return analysed.groupBy("project").agg(*_quality_sums())


def project_totals(analysed: DataFrame) -> DataFrame:
    """All additive figures of a project from a single pass."""
    e = F.col("elements")

    def style(cond) -> Column:
        return F.sum(F.size(F.filter(e, lambda x: (x.type == "function") & cond(x["name"]))))

    snake = lambda n: F.contains(n, F.lit("_"))
    pascal = lambda n: ~snake(n) & n.rlike("^\\p{IsUppercase}")
    camel = lambda n: ~snake(n) & n.rlike("^\\p{IsLowercase}") & n.rlike("\\p{IsUppercase}")
    return analysed.groupBy("project").agg(
        *_quality_sums(),
        F.sum("line_count").alias("total_lines"),
        F.sum(F.size(e)).alias("total_elements"),
        F.sum(M.count_of(e, "class")).alias("class_count"),
        F.sum(M.count_of(e, "function")).alias("function_count"),
        style(snake).alias("snake"), style(pascal).alias("pascal"), style(camel).alias("camel"),
        F.bool_or(_looks_tested(F.col("path"), e)).alias("has_tests"))


def _looks_tested(path: Column, elements: Column) -> Column:
    return F.lower(path).rlike("test|spec") | F.exists(elements, lambda x: (
        ((x.type == "import") & F.contains(F.lower(x["name"]), F.lit("test")))
        | ((x.type == "function") & x["name"].rlike("^(test_|should_)"))))


def common_imports(analysed: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent import texts, ties by first appearance."""
    counted = import_rows(analysed).groupBy("project", "name").agg(
        F.count("*").alias("cnt"), F.min(F.struct("path", "ord")).alias("first"))
    return top_k(counted, ["project"], [F.desc("cnt"), F.asc("first")], k).drop("first")


def size_sentence(elements: Column) -> Column:
    return (F.when(elements > 1000, "This appears to be a large, complex project.")
            .when(elements > 500, "This is a medium-sized project with moderate complexity.")
            .when(elements > 100, "This is a small to medium-sized project.")
            .otherwise("This is a small project with relatively simple structure."))


def project_summary(analysed: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Counts, languages and the summary sentences of each project."""
    totals = project_totals(analysed) if totals is None else totals
    joined = totals.join(main_languages(analysed), "project")
    text = F.concat(
        F.lit("Project with "), F.col("file_count").cast("string"), F.lit(" files ("),
        F.col("total_lines").cast("string"), F.lit(" lines of code) primarily written in "),
        F.col("main_languages"), F.lit(". Contains "), F.col("class_count").cast("string"),
        F.lit(" classes and "), F.col("function_count").cast("string"), F.lit(" functions. "),
        size_sentence(F.col("total_elements")))
    return joined.withColumn("text", text)


def basic_summary(projects: DataFrame, analysed: DataFrame) -> DataFrame:
    """The plain summary, also for projects without any analysed file."""
    main = top_k(language_histogram(analysed), ["project"],
                 [F.desc("files"), F.asc("first_path")], 1).select(
                     "project", F.col("language").alias("main_language"))
    out = projects.select("project").distinct().join(
        project_totals(analysed).join(main, "project"), "project", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in
              ("file_count", "total_lines", "class_count", "function_count")}
    text = F.when(F.col("main_language").isNull(), "No files were analyzed for this project.")
    text = text.otherwise(F.concat(
        F.lit("This project contains "), F.col("file_count").cast("string"),
        F.lit(" files primarily written in "), F.col("main_language"), F.lit(". It has "),
        F.col("class_count").cast("string"), F.lit(" classes and "),
        F.col("function_count").cast("string"), F.lit(" functions across "),
        F.col("total_lines").cast("string"), F.lit(" lines of code.")))
    return out.withColumn("text", text).withColumns(counts).select("project", "text", *counts)


def project_concepts(analysed: DataFrame, k: int = C.TOP_CONCEPTS) -> DataFrame:
    """Top words of a project from all words of its files."""
    rows = analysed.select("project", "path", F.posexplode(X.each("word_ranks")).alias("pos", "c"))
    counted = rows.groupBy("project", F.col("c.word").alias("word")).agg(
        F.sum("c.cnt").alias("cnt"), F.min(F.struct("path", "pos")).alias("first"))
    return top_k(counted, ["project"], [F.desc("cnt"), F.asc("first")], k).drop("first")


def finding_counts(analysed: DataFrame) -> DataFrame:
    """Findings per kind and type."""
    kinds = F.concat(
        F.transform("code_smells", lambda f: F.struct(F.lit("smell").alias("kind"), f.type.alias("type"))),
        F.transform("security_issues", lambda f: F.struct(F.lit("security").alias("kind"), f.type.alias("type"))))
    return analysed.select("project", F.inline(kinds)).groupBy("project", "kind", "type").agg(
        F.count("*").alias("cnt"))


def _finding_maps(analysed: DataFrame) -> DataFrame:
    """Both count maps per project; their keys are rule types, so they stay small."""
    def of(kind: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("type", "cnt"))))
        return F.map_from_entries(entries)

    return finding_counts(analysed).groupBy("project").agg(
        of("smell").alias("code_smells"), of("security").alias("security_issues"))


def _recommend(conditions: list[tuple[Column, str, str]]) -> Column:
    rows = F.array(*[
        F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message")))
        for cond, kind, message in conditions])
    return F.filter(rows, lambda r: r.isNotNull()).cast(f"array<{RECOMMENDATION}>")


def ai_quality(analysed: DataFrame) -> DataFrame:
    """(project, quality_score): the mean quality of the files of each project."""
    return quality_totals(analysed).select("project", X.py_round(_mean_quality(), 1).alias("quality_score"))


def _mean_quality() -> Column:
    return F.col("quality_sum") / F.col("file_count")


def ai_findings(analysed: DataFrame, totals: DataFrame | None = None,
                duplicates: DataFrame | None = None) -> DataFrame:
    """Mean quality, finding counts and recommendations of each project: the AI summary but for its
    concepts, which only a reader asks for and which take all words of all files.

    ``duplicates(project, pairs)`` may supply the number of near-duplicate pairs as
    the ``duplicate_code`` smell, which no text rule emits.
    """
    totals = quality_totals(analysed) if totals is None else totals
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = totals.join(_finding_maps(analysed), "project", "left")
    copies = F.lit(0)
    if duplicates is not None:
        out, copies = out.join(duplicates, "project", "left"), F.coalesce("pairs", F.lit(0))
    mean = _mean_quality()
    smells = F.coalesce("code_smells", empty)
    security = F.coalesce("security_issues", empty)
    return out.select(
        "project", X.py_round(mean, 1).alias("quality_score"), smells.alias("code_smells"),
        security.alias("security_issues"), _recommend([
            (F.size(security) > 0, "security", C.AI_RECOMMENDATIONS["security"]),
            (copies > DUPLICATES, "refactoring", C.AI_RECOMMENDATIONS["refactoring"]),
            (F.try_element_at(smells, F.lit("complex_condition")) > 3, "complexity",
             C.AI_RECOMMENDATIONS["complexity"]),
            (mean < 70, "quality", C.AI_RECOMMENDATIONS["quality"]),
        ]).alias("recommendations"))


def ai_summary(analysed: DataFrame, totals: DataFrame | None = None,
               duplicates: DataFrame | None = None) -> DataFrame:
    """Mean quality, finding counts, concepts and recommendations of each project; ``duplicates`` as
    for ``ai_findings``."""
    words = _ranked_list(project_concepts(analysed), ["project"], F.struct("word", "cnt"),
                         "key_concepts")
    return ai_findings(analysed, totals, duplicates).join(words, "project", "left").select(
        "project", "quality_score", "code_smells", "security_issues",
        F.coalesce("key_concepts", F.array().cast("array<struct<word:string,cnt:bigint>>"))
        .alias("key_concepts"), "recommendations")


# --- architecture -----------------------------------------------------------------

def directory_of(path: Column) -> Column:
    d = X.dirname(path)
    return F.when(d == "", "/").otherwise(d)


def component_name(directory: Column) -> Column:
    name = F.replace(F.ltrim(directory, F.lit("/")), F.lit("/"), F.lit("."))
    return F.when(name == "", "root").otherwise(name)


def directory_files(files: DataFrame) -> DataFrame:
    """One row per file under its directory: the directory lists in long form."""
    return files.select("project", directory_of(F.col("path")).alias("dir"), "path",
                        X.basename(F.col("path")).alias("file"))


def directory_metrics(files: DataFrame) -> DataFrame:
    """Files per directory; ``dir_ord`` (the first path) orders directories by first sight."""
    return directory_files(files).groupBy("project", "dir").agg(
        F.count("*").alias("file_count"), F.min("path").alias("dir_ord"))


def component_directories(files: DataFrame) -> DataFrame:
    """All directories with two or more files."""
    return directory_metrics(files).where("file_count >= 2")


def components(files: DataFrame) -> DataFrame:
    """The ten largest component directories, and five example files each."""
    large = component_directories(files)
    top = top_k(large, ["project"], [F.desc("file_count"), F.asc("dir_ord")], 10, "component_rank")
    examples = _ranked_list(
        top_k(directory_files(files), ["project", "dir"], [F.asc("path")], 5),
        ["project", "dir"], F.col("file"), "files")
    return top.join(examples, ["project", "dir"]).select(
        "project", "component_rank", component_name(F.col("dir")).alias("name"), "dir",
        "file_count", "files")


# --- quality and recommendations ----------------------------------------------------

def quality_assessment(analysed: DataFrame, totals: DataFrame | None = None,
                       ai: DataFrame | None = None) -> DataFrame:
    """Mean comment ratio and complexity, numbers of finding types, and the ratings."""
    totals = quality_totals(analysed) if totals is None else totals
    ai = ai_findings(analysed, totals) if ai is None else ai
    ratio = F.col("comment_hundredths") / 100.0 / F.col("file_count")
    mean = F.col("cyclomatic_sum") / F.col("file_count")
    quality = F.col("quality_score")
    rate = lambda good, fair: F.when(good, "good").when(fair, "fair").otherwise("poor")
    return totals.join(ai, "project").select(
        "project", X.py_round(ratio, 2).alias("comment_ratio"),
        X.py_round(mean, 2).alias("complexity"), "quality_score",
        F.size("code_smells").alias("code_smells"),
        F.size("security_issues").alias("security_issues"),
        rate(ratio > 0.15, ratio > 0.05).alias("documentation_rating"),
        rate(mean < 5, mean < 10).alias("complexity_rating"),
        rate(quality > 80, quality > 60).alias("overall_rating"))


def inconsistent_naming(totals: DataFrame) -> DataFrame:
    """Whether every naming style in use holds over a fifth of the function names."""
    used = [F.col(c) for c in ("snake", "camel", "pascal")]
    total = used[0] + used[1] + used[2]
    flag = total > 10
    for n in used:
        flag = flag & ((n == 0) | (n > total * 0.2))
    return totals.select("project", "snake", "camel", "pascal", flag.alias("inconsistent"))


def review_recommendations(totals: DataFrame, ai: DataFrame, quality: DataFrame,
                           component_counts: DataFrame, edge_counts: DataFrame) -> DataFrame:
    """AI recommendations followed by the review's own, in order."""
    q = quality.select("project", "documentation_rating", "complexity_rating",
                       F.col("security_issues").alias("security_types"))
    joined = (ai.select("project", "recommendations").join(q, "project")
              .join(totals.select("project", "has_tests"), "project")
              .join(inconsistent_naming(totals), "project")
              .join(component_counts, "project", "left").join(edge_counts, "project", "left"))
    n, edges = F.coalesce("n_components", F.lit(0)), F.coalesce("n_edges", F.lit(0))
    m = C.REVIEW_RECOMMENDATIONS
    own = _recommend([
        (F.col("documentation_rating") == "poor", "documentation", m["documentation"]),
        (F.col("complexity_rating") == "poor", "complexity", m["complexity"]),
        (n > 10, "architecture", m["components"]),
        (edges > n * 2, "architecture", m["coupling"]),
        (F.col("inconsistent"), "naming", m["naming"]),
        (~F.col("has_tests"), "testing", m["testing"]),
        (F.col("security_types") > 0, "security", m["security"]),
    ])
    return joined.select("project", F.concat("recommendations", own).alias("recommendations"))


def element_counts(analysed: DataFrame) -> DataFrame:
    """Elements of each type per file, counted inside the row."""
    kinds = ["import", "class", "function", "variable", "method", "component", "package"]
    return analysed.select("project", "path", *[
        M.count_of(F.col("elements"), k).alias(f"n_{k}") for k in kinds])


# --- defaults for missing parts -------------------------------------------------------

def fill_file_defaults(files: DataFrame, insights: DataFrame) -> DataFrame:
    """Every file with its insights, or the stand-in figures where none were stored."""
    kept = insights.select("project", "path", "quality_score", "cyclomatic", "smells", "issues")
    return files.select("project", "path").join(kept, ["project", "path"], "left").select(
        "project", "path",
        F.coalesce("quality_score", F.lit(C.MISSING_QUALITY)).alias("quality_score"),
        F.coalesce("cyclomatic", F.lit(C.MISSING_CYCLOMATIC)).alias("cyclomatic"),
        F.coalesce("smells", F.lit(1)).alias("smells"),
        F.coalesce("issues", F.lit(0)).alias("issues"))


def fill_project_defaults(projects: DataFrame, summary: DataFrame, ai: DataFrame,
                          quality: DataFrame) -> DataFrame:
    """Every project with its summary, or the stand-in values where parts are missing."""
    q = quality.select("project", "documentation_rating", "complexity_rating", "overall_rating",
                       F.col("security_issues").alias("security_types"))
    joined = (projects.select("project").distinct()
              .join(summary.select("project", "text", "file_count", "total_lines", "class_count",
                                   "function_count"), "project", "left")
              .join(ai.select("project", "quality_score"), "project", "left")
              .join(q, "project", "left"))
    fill = {"text": C.MISSING_SUMMARY_TEXT, "file_count": 0, "total_lines": 0, "class_count": 0,
            "function_count": 0, "quality_score": 0.0, "security_types": 0,
            "documentation_rating": C.MISSING_RATING, "complexity_rating": C.MISSING_RATING,
            "overall_rating": C.MISSING_RATING}
    return joined.select("project", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])
