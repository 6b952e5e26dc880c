"""Storing analysed corpora and reading them back.

A store is a folder of runs. `files/run=r` has the rows analysed in run r, `manifest/run=r` names
every file of the corpus at that time with the digest of its content and the run that holds its
row, `summary/run=r` has a row per project. A run that follows another analyses only files that are
new or changed; a reader of any run follows its manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.analysis import analyse_files
from codequarry.operators.rollup import project_totals
from codequarry.plans.stage import stage

_KEY = ["project", "path"]


def _write_sorted(rows: DataFrame, path: str) -> None:
    """Range-partitioned by project and path: a large project spreads over many files, and the
    statistics of each file let a project be read alone."""
    rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).write.mode("overwrite").parquet(path)


def write_results(analysed: DataFrame, summary: DataFrame, path: str, run: str) -> None:
    """Write one run: per-file rows and project summaries, as Parquet."""
    # worked out once: finding the ranges reads the rows as well
    _write_sorted(stage(analysed), f"{path}/files/run={run}")
    summary.write.mode("overwrite").parquet(f"{path}/summary/run={run}")


def read_results(spark: SparkSession, path: str, run: str,
                 project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per-file rows, project summaries) of a run, or of one project in it."""
    frames = [spark.read.parquet(f"{path}/{part}/run={run}") for part in ("files", "summary")]
    if project is not None:
        frames = [f.where(F.col("project") == project) for f in frames]
    return frames[0], frames[1]


def write_run(files: DataFrame, path: str, run: str, previous: str | None = None,
              analyse: Callable[[DataFrame], DataFrame] = analyse_files) -> None:
    """Add a run of files(project, path, content) to a store, building on the run `previous`.

    Only files that are not in the previous manifest with the same content are analysed. Files that
    are gone are in no later manifest; their rows stay with the runs that had them. Files that
    analysis leaves out, as empty ones, are in no manifest either.
    """
    spark = files.sparkSession
    marked = files.select(*_KEY, "content", F.sha2("content", 256).alias("digest"))
    fresh, kept = marked, None
    if previous is not None:
        known = spark.read.parquet(f"{path}/manifest/run={previous}")
        same = [*_KEY, "digest"]
        fresh = marked.join(known.select(*same), same, "left_anti")
        kept = known.join(marked.select(*same), same, "left_semi")
    rows = stage(analyse(fresh.select(*_KEY, "content")).drop("content").join(
        fresh.select(*_KEY, "digest"), _KEY))
    _write_sorted(rows, f"{path}/files/run={run}")
    manifest = rows.select(*_KEY, "digest", F.lit(run).alias("stored"))
    if kept is not None:
        manifest = manifest.unionByName(kept.select(*manifest.columns))
    _write_sorted(stage(manifest), f"{path}/manifest/run={run}")
    project_totals(read_run(spark, path, run)).write.mode("overwrite").parquet(f"{path}/summary/run={run}")


def read_run(spark: SparkSession, path: str, run: str,
             project: str | None = None) -> DataFrame:
    """The analysed rows of a run of a store, or of one project in it, with the run that `stored` each."""
    manifest = spark.read.parquet(f"{path}/manifest/run={run}")
    stored = [r.stored for r in manifest.select("stored").distinct().collect()]
    base = f"{path}/files"
    held = spark.read.option("basePath", base).parquet(*[f"{base}/run={r}" for r in stored or [run]])
    held = held.withColumn("stored", F.col("run").cast("string")).drop("run")
    if project is not None:
        manifest, held = (f.where(F.col("project") == project) for f in (manifest, held))
    rows = held.join(manifest.select(*_KEY, "stored"), [*_KEY, "stored"])
    return rows


def read_summary(spark: SparkSession, path: str, run: str, project: str | None = None) -> DataFrame:
    """The project summaries of a run."""
    summary = spark.read.parquet(f"{path}/summary/run={run}")
    return summary if project is None else summary.where(F.col("project") == project)


def results_json(analysed: DataFrame, columns: list[str]) -> DataFrame:
    """(project, path, json): one JSON object per file."""
    return analysed.select("project", "path", F.to_json(F.struct(*columns)).alias("json"))


def file_lookup(analysed: DataFrame, requests: DataFrame) -> DataFrame:
    """The analysed rows of the requested (project, path) pairs."""
    return analysed.join(requests.select("project", "path").distinct(), ["project", "path"],
                         "left_semi")
