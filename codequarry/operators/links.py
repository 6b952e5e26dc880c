"""Dependency edges between files, directories and classes.

Matching an import against every file is turned into a hash join: each import
emits the few keys it could resolve to, each file its one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.operators.rollup import (
    component_name, directory_files, directory_of, top_k)
from codequarry.operators.structure import element_rows, import_rows


def import_targets(name: Column, resolve_bare: bool = False) -> Column:
    """Texts an import can stand for: the first match of each target pattern.

    ``resolve_bare`` also takes import names that carry no keyword (plain Python
    imports, JavaScript paths, Java names).
    """
    found = [F.regexp_extract(name, X.jvm_regex(p), 1) for p in C.IMPORT_TARGETS]
    if resolve_bare:
        found.append(F.when(~name.rlike("\\s"), F.regexp_replace(name, "^.*/", "")))
    return F.array_distinct(F.filter(F.array(*found), lambda t: t != ""))


def _last_part(target: Column) -> Column:
    return F.substring_index(target, ".", -1)


def file_edges(analysed: DataFrame, resolve_bare: bool = False) -> DataFrame:
    """Distinct (src, dst) file pairs where an import of src names the stem of dst."""
    keys = import_rows(analysed).select(
        "project", F.col("path").alias("src"),
        F.explode(import_targets(F.col("name"), resolve_bare)).alias("target"))
    keys = keys.select("project", "src", F.explode(
        F.array_distinct(F.array("target", _last_part(F.col("target"))))).alias("stem")).distinct()
    files = analysed.select("project", F.col("path").alias("dst"),
                            X.stem(F.col("path")).alias("stem"))
    return keys.join(files, ["project", "stem"]).select("project", "src", "dst").distinct()


def component_edges(analysed: DataFrame) -> DataFrame:
    """Distinct (source, target) components: each import goes to the first directory,
    other than its own, that holds a file of that stem or lies on the import path.

    Only the two earliest directories per key can ever be that first one, so the
    dictionary keeps two rows per key however common a file name is.
    """
    files = directory_files(analysed.select("project", "path"))
    dirs = files.groupBy("project", "dir").agg(F.min("path").alias("dir_ord"))
    by_stem = files.select("project", "dir", F.lit("s").alias("kind"),
                           X.stem(F.col("path")).alias("key")).distinct().join(
                               dirs, ["project", "dir"])
    by_name = dirs.select(
        "project", "dir", F.lit("d").alias("kind"),
        X.basename(F.rtrim(F.col("dir"), F.lit("/"))).alias("key"), "dir_ord").where("key <> ''")
    dictionary = top_k(by_stem.unionByName(by_name), ["project", "kind", "key"],
                       [F.asc("dir_ord")], 2)
    pair = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    wanted = import_rows(analysed).select(
        "project", directory_of(F.col("path")).alias("source_dir"), "name").distinct()
    wanted = wanted.select("project", "source_dir", "name", F.explode(
        import_targets(F.col("name"))).alias("target"))
    wanted = wanted.select("project", "source_dir", "name", F.inline(F.array_distinct(F.concat(
        F.transform(F.array("target", _last_part(F.col("target"))), pair("s")),
        F.transform(F.split("target", "\\."), pair("d"))))))
    hits = wanted.join(dictionary, ["project", "kind", "key"]).where("dir <> source_dir")
    first = hits.groupBy("project", "source_dir", "name").agg(
        F.min(F.struct("dir_ord", "dir")).alias("first"))
    return first.select(
        "project", component_name(F.col("source_dir")).alias("source"),
        component_name(F.col("first.dir")).alias("target")).distinct()


def class_edges(analysed: DataFrame) -> DataFrame:
    """(child, parent) between known classes; the last file that states bases wins."""
    classes = element_rows(analysed).where("type = 'class'").select(
        "project", "path", "ord", "name", "bases")
    last = classes.where(F.size("bases") > 0).groupBy("project", "name").agg(
        F.max_by("bases", F.struct("path", "ord")).alias("bases"))
    edges = last.select("project", F.col("name").alias("child"),
                        F.explode(F.array_distinct("bases")).alias("parent"))
    known = classes.select("project", F.col("name").alias("parent")).distinct()
    return edges.join(known, ["project", "parent"], "left_semi").select(
        "project", "child", "parent")


def complexity_chart(analysed: DataFrame, k: int = 15) -> DataFrame:
    """The k most complex files of each project."""
    rows = analysed.select("project", "path", X.basename(F.col("path")).alias("file"),
                           F.col("complexity.cyclomatic").alias("cyclomatic"))
    return top_k(rows, ["project"], [F.desc("cyclomatic"), F.asc("path")], k)


def set_overlap(left: Column, right: Column) -> Column:
    """Common, one-sided and total names of two lists, and their Jaccard percentage."""
    return X.let(
        F.struct(F.sort_array(F.array_intersect(left, right)).alias("common"),
                 F.sort_array(F.array_except(left, right)).alias("only_left"),
                 F.sort_array(F.array_except(right, left)).alias("only_right"),
                 F.size(F.array_union(left, right)).alias("total")),
        lambda s: s.withField("percent", F.when(s.total > 0, X.py_round(
            F.size(s.common) / s.total * 100, 1)).otherwise(F.lit(0.0))))
