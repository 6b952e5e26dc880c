"""Rule findings with line numbers, quality score and suggestions, all row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X

FINDING = "struct<type:string,message:string,line:int,severity:string>"
SUGGESTION = "struct<type:string,message:string,line:int,priority:string>"

Rule = tuple[str, str, str]
#: The body of a long method is in braces; without one each ``def`` would be followed to the end.
GUARDS = {"long_method": r"(?s)\{[^}]{500}"}


def scan_rules(content: Column, rules: list[Rule], severity: str, dotall: bool) -> Column:
    """array<finding>: every match of every rule, rules in order, matches in order."""
    def hits(kind: str, pattern: str, message: str) -> Column:
        at = X.match_lines(content, X.jvm_regex(pattern, multiline=True, dotall=dotall))
        if kind in GUARDS:  # a cheap test that every match passes
            at = F.when(content.rlike(GUARDS[kind]), at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda line: F.struct(
            F.lit(kind).alias("type"), F.lit(message).alias("message"),
            line.cast("int").alias("line"), F.lit(severity).alias("severity")))

    return F.concat(*[hits(*rule) for rule in rules]).cast(f"array<{FINDING}>")


def wide_function_smells(wide: Column) -> Column:
    return F.transform(wide, lambda w: F.struct(
        F.lit("too_many_arguments").alias("type"),
        F.concat(F.lit("Function "), w["name"], F.lit(" has "), w["args"].cast("string"),
                 F.lit(" parameters. Consider refactoring.")).alias("message"),
        w.line.alias("line"), F.lit(C.SMELL_SEVERITY).alias("severity"))).cast(f"array<{FINDING}>")


def code_smells(content: Column, wide: Column, rules: list[Rule] | None = None) -> Column:
    return F.concat(scan_rules(content, rules or C.SMELL_RULES, C.SMELL_SEVERITY, dotall=True),
                    wide_function_smells(wide))


def security_issues(content: Column, rules: list[Rule] | None = None) -> Column:
    return scan_rules(content, rules or C.SECURITY_RULES, C.SECURITY_SEVERITY, dotall=False)


def quality_score(smells: Column, security: Column, cyclomatic: Column) -> Column:
    penalty = (F.when(cyclomatic > 15, 20).when(cyclomatic > 10, 10)
               .when(cyclomatic > 5, 5).otherwise(0))
    score = 100 - F.size(smells) * 5 - F.size(security) * 10 - penalty
    return F.greatest(F.lit(0), F.least(score, F.lit(100))).cast("int")


def suggestions(smells: Column, security: Column, rating: Column, short_names: Column) -> Column:
    """array<suggestion>: one per finding, then the general ones."""
    def from_findings(findings: Column, kind: str, priority: str) -> Column:
        return F.transform(findings, lambda f: F.struct(
            F.lit(kind).alias("type"), f.message.alias("message"), f.line.alias("line"),
            F.lit(priority).alias("priority"))).cast(f"array<{SUGGESTION}>")

    def general(cond: Column, kind: str, message: str, priority: str) -> Column:
        row = F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"),
                       F.lit(None).cast("int").alias("line"), F.lit(priority).alias("priority"))
        return F.when(cond, F.array(row)).otherwise(F.array()).cast(f"array<{SUGGESTION}>")

    return F.concat(
        from_findings(smells, "code_smell", "medium"),
        from_findings(security, "security", "high"),
        general(rating == "high", "refactoring", C.REFACTOR_MESSAGE, "medium"),
        general(short_names, "naming", C.NAMING_MESSAGE, "low"))


def finding_rows(analysed: DataFrame) -> DataFrame:
    """One row per finding, ``kind`` telling smells from security issues."""
    def tagged(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda f, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ord"), f.type.alias("type"),
            f.message.alias("message"), f.line.alias("line"), f.severity.alias("severity")))

    return analysed.select("project", "path", F.inline(F.concat(
        tagged("smell", "code_smells"), tagged("security", "security_issues"))))


def security_report(analysed: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """Scanner-shaped report; ``grades(type, severity, confidence)`` may grade rules."""
    rows = analysed.select("project", "path", F.inline(X.each("security_issues")))
    if grades is None:
        severity, confidence = F.col("severity"), F.lit(None).cast("string")
    else:
        rows = rows.drop("severity").join(grades, "type", "left")
        severity, confidence = F.col("severity"), F.col("confidence")
    default = F.lit(C.DEFAULT_CONFIDENCE)
    return rows.select(
        "project", F.col("path").alias("file"), "line", F.col("message").alias("issue_type"),
        F.coalesce(severity, default).alias("severity"),
        F.coalesce(confidence, default).alias("confidence"))


def default_override() -> dict[str, Column]:
    """The fixed insight parts that stand in when no reviewing model is at hand."""
    kind, message, line, severity = C.OVERRIDE_SMELL
    text, priority = C.OVERRIDE_SUGGESTION
    return {
        "quality_score": F.lit(C.OVERRIDE_QUALITY),
        "code_smells": F.array(F.struct(
            F.lit(kind).alias("type"), F.lit(message).alias("message"),
            F.lit(line).alias("line"), F.lit(severity).alias("severity"))
        ).cast(f"array<{FINDING}>"),
        "security_issues": F.array().cast(f"array<{FINDING}>"),
        "suggestions": F.array(F.struct(
            F.lit(None).cast("string").alias("type"), F.lit(text).alias("message"),
            F.lit(None).cast("int").alias("line"), F.lit(priority).alias("priority"))
        ).cast(f"array<{SUGGESTION}>"),
    }


def merge_insights(analysed: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Replace insight parts wholesale where ``overrides(project, path, ...)`` has them.

    Without a table every file takes the fixed default parts.
    """
    if overrides is None:
        return analysed.withColumns(default_override())
    parts = [c for c in default_override() if c in overrides.columns]
    o = overrides.select("project", "path", *[F.col(c).alias(f"o_{c}") for c in parts])
    merged = analysed.join(o, ["project", "path"], "left")
    return merged.withColumns(
        {c: F.coalesce(F.col(f"o_{c}"), F.col(c)) for c in parts}
    ).drop(*[f"o_{c}" for c in parts])
