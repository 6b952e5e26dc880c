"""Which files enter a corpus, and under what name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import catalog as C
from codequarry.functions import text as X
from codequarry.operators.rollup import top_k
from codequarry.operators.search import suffix_matches
from codequarry.operators.spread import shuffled


def is_binary(raw: Column, sample: int | None = None) -> Column:
    """NUL or invalid UTF-8 anywhere, or in the first ``sample`` bytes, where a character that the
    sample cuts counts."""
    head = (raw if sample is None else F.substring(raw, 1, sample)).cast("string")
    return F.contains(head, F.lit("\x00")) | ~F.is_valid_utf8(head)


def drop_binary(df: DataFrame, sample: int | None = None) -> DataFrame:
    return df.where(~is_binary(F.col("bytes"), sample))


def decode_text(raw: Column) -> Column:
    """UTF-8 with U+FFFD for bad bytes and ``\\n`` for every line end."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def code_gate(files: DataFrame, extra_extensions: list[str] | None = None) -> DataFrame:
    """Files with a known source extension; ``extra_extensions`` adds ones such as ``.txt``."""
    return files.where(X.extension(F.col("path")).isin([*C.LANGUAGES, *(extra_extensions or [])]))


def admit_upload(uploads: DataFrame) -> DataFrame:
    """uploads(project, ord, name, size) -> the rows admitted, in arrival order ``ord``.

    Bad extensions and oversize files are passed over; the hundredth admitted file or
    the first overflow of the total ends a project's upload. Only the first hundred
    eligible rows of a project can be admitted, so no more reach the running sum.
    """
    ext = F.when(F.contains("name", F.lit(".")), F.lower(F.substring_index("name", ".", -1)))
    eligible = uploads.where(ext.isin(C.UPLOAD_EXTENSIONS)
                             & (F.col("size") <= C.MAX_UPLOAD_FILE_BYTES))
    first = top_k(eligible, ["project"], [F.asc("ord")], C.MAX_UPLOAD_FILES, "position")
    running = F.expr("sum(size) OVER (PARTITION BY project ORDER BY position "
                     "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return first.withColumn("total", running).where(F.col("total") <= C.MAX_UPLOAD_TOTAL_BYTES)


def repo_catalog(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """urls(url) -> distinct (owner, repo, urls) and the rejected addresses."""
    pattern = X.jvm_regex(C.REPO_URL)
    parsed = urls.select("url", F.regexp_extract("url", pattern, 1).alias("owner"),
                         F.regexp_extract("url", pattern, 2).alias("repo"))
    known = parsed.where("owner <> ''").groupBy("owner", "repo").agg(F.count("*").alias("urls"))
    return known, parsed.where("owner = ''").select("url")


def expired(items: DataFrame, now: Column, column: str = "ts",
            hours: int = C.RETENTION_HOURS) -> DataFrame:
    """Items strictly older than the retention time."""
    return items.where(F.col(column) < now - F.expr(f"INTERVAL {hours} HOURS"))


def content_lookup(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(project, request) -> (project, request, path): the file of that path, else
    the first file of which either path is a suffix of the other."""
    wanted = requests.select("project", "request").distinct()
    paths = files.select("project", "path")
    exact = wanted.join(shuffled(paths.withColumn("request", F.col("path"))), ["project", "request"], "left")
    missed = exact.where("path is null").select("project", "request")
    close = suffix_matches(paths, missed).groupBy("project", "request").agg(
        F.min("path").alias("path"))
    return exact.where("path is not null").select("project", "request", "path").unionByName(close)
