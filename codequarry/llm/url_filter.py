"""Exact URL rules by cascades of Bloom filters, without a join per URL.

Level 0 of a cascade holds the listed keys. Level 1 holds the keys of the corpus that level 0
takes for listed ones, level 2 the listed keys that level 1 takes for those, and so on until no
key is mistaken. The universe is every key any URL of the corpus can be asked for, so answers are
exact for it. One cascade knows the rules, a second tells the blocking ones among them.

The list is a parameter: filters have a size in proportion to it, not to the corpus, and go to
the tasks as broadcast bitmaps. Keys are compared by 64-bit hash.

Null URLs and those without "://" have an empty host and path and meet no rule. A URL without a
rule is allowed. Of a key listed twice, blocking counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import stage
from codequarry.llm.words import U64, mix

#: A cascade is as good as endless only if two keys share their hash.
MAX_LEVELS = 200


class Rule(NamedTuple):
    """Fits the host and its subdomains where the URL's path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ascii_uppercase, ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key some rule of this list's shapes could have for the URL, longest first."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)))
            for labels, n in shapes]
    return F.array_sort(
        F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>"),
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
        .when(a < b, -1).when(a > b, 1).otherwise(0))


class Level(NamedTuple):
    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    def places(self, keys: np.ndarray) -> np.ndarray:
        """(hashes, keys) bit numbers."""
        seeds = mix(U64(self.seed) + np.arange(self.hashes, dtype=U64))[:, None]
        return mix(keys[None, :] ^ seeds) % U64(self.size)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return ((self.bits[at >> U64(6)] >> (at & U64(63))) & U64(1)).all(axis=0)


def member(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that lacks it decides."""
    out = np.full(len(keys), len(levels) % 2 == 1)
    open_ = np.arange(len(keys))
    for i, level in enumerate(levels):
        held = level.holds(keys[open_])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    return out


def _filled(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.places(np.asarray(batch.column(0)).view(U64)))
            word, first = np.unique(at >> U64(6), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])
    return run


def _held(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.holds(np.asarray(batch.column(0)).view(U64))))
    return run


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter for n keys (h) with a false positive rate, filled where the keys are."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    size = max(64, math.ceil(n * hashes / math.log(2)))
    level = Level(np.zeros(size // 64 + 1, dtype=U64), size, hashes, seed)
    for row in (keys.mapInArrow(_filled(level), "word long, bits long")
                .groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator()):
        level.bits[row.word] = np.int64(row.bits).view(U64)
    return level


def cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels that tell the keys (h) of `listed` from those of `others`."""
    levels: list[Level] = []
    inside, outside = stage(listed.select("h").distinct()), others.select("h").distinct()
    outside = stage(outside.join(inside, "h", "left_anti"))
    n, m = inside.count(), outside.count()
    # a first rate that lets in fewer others than there are listed keys keeps all levels small
    rate = min(0.5, max(2.0 ** -40, n * math.sqrt(0.5) / m)) if n and m else 0.5
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed key and another one share their hash")
        levels.append(_level(inside, n, rate, 1000 * len(levels)))
        inside, outside = stage(outside.mapInArrow(_held(levels[-1]), "h long")), inside
        n, rate = inside.count(), 0.5
    return levels


def _judged(known: list[Level], blocked: list[Level]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column("hashes"), batch.column("keys")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            keys = np.asarray(lists.flatten()).view(U64)
            hit = np.flatnonzero(member(known, keys))
            rows, first = np.unique(owner[hit], return_index=True)  # keys come longest first
            at = hit[first]
            rule = np.full(batch.num_rows, None, dtype=object)
            rule[rows] = texts.flatten().take(pa.array(at, pa.int64())).to_pylist()
            stop = np.zeros(batch.num_rows, dtype=bool)
            stop[rows] = member(blocked, keys[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path")), pa.array(rule, pa.string()),
                 pa.array(np.where(stop, "block", "allow"), pa.string())],
                ["id", "host", "path", "rule", "verdict"])
    return run


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits, and what it says."""
    spark = pages.sparkSession
    asked = (pages.select(F.col(id_col).cast("long").alias("id"), url_host(F.col(url_col)).alias("host"),
                          url_path(F.col(url_col)).alias("path"))
             .withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
             .withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))))
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    listed = stage(listed.select(F.xxhash64("key").alias("h"), "verdict"))
    block = listed.where("verdict = 'block'")
    universe = asked.select(F.explode("hashes").alias("h"))
    known, blocked = cascade(listed, universe), cascade(block, listed)
    return asked.mapInArrow(_judged(known, blocked),
                            "id long, host string, path string, rule string, verdict string")
