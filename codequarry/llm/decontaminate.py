"""Benchmark passages in documents, by winnowed fingerprints; DataFrame functions only.

Every run of SPAN words contains SPAN - GRAM + 1 word grams. The smallest gram hash of each run is
kept on both sides, so a shared run has a shared fingerprint for certain. Only in documents where
fingerprints meet are they placed; they are extended to the runs of words they stand for, which are
compared exactly with those of the items.

An item with fewer words, but not none, is one run. Documents are searched for runs of those
lengths only if such items exist. Null texts have no words. A row is judged by its own text, also
if its id is null or repeated. An item without an id gives hits, but no name. Empty tables give no
rows, or no hits. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import sized, stage

#: Words of a window.
SPAN = 10
#: Words of a gram.
GRAM = 5
#: Columns that name a row: digests of its id and of its text.
ROW = ["k_id", "k_text"]
#: Bytes of hits that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: What lies between the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, also while A-Z are not lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, letters as they are."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def loose_hashes(text: Column) -> Column:
    """A hash per word that is equal wherever the words are equal but for A-Z."""
    return F.transform(words_of(text), lambda w: F.xxhash64(F.lower(w)))


def exact_hashes(text: Column) -> Column:
    """A hash per word with A-Z lower-cased and nothing else."""
    return F.transform(words_of(lower_ascii(text)), lambda w: F.xxhash64(w))


def _runs(values: Column, size: int, make) -> Column:
    """make(values from i to i + size - 1) for each start i. Elements are read in place."""
    count = F.size(values) - size
    return F.when(count >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(0))),
        lambda i: make([F.get(values, i + j) for j in range(size)]))).otherwise(
            F.array().cast("array<bigint>"))


def grams(values: Column, size: int) -> Column:
    return _runs(values, size, lambda run: F.xxhash64(*run))


def _folded(texts: DataFrame, keys: list[str], width: int, two) -> DataFrame:
    """(*keys, m): `two` taken over every `width` neighbouring values of m, by doubling; the last
    step may overlap."""
    done = 1
    while done < width:
        step = min(done, width - done)
        texts = texts.select(*keys, F.zip_with("m", F.slice("m", step + 1, F.size("m")), two).alias("m"))
        done += step
    # what lacks neighbours stands at the end
    return texts.select(*keys, F.slice("m", 1, F.greatest(F.size("m") - (width - 1), F.lit(0))).alias("m"))


def gram_minima(texts: DataFrame, keys: list[str], span: int, gram: int) -> DataFrame:
    """(*keys, n_words, m): the smallest gram hash of each run of `span` words."""
    keep = [*keys, "n_words"]
    hashed = texts.select(*keys, loose_hashes(F.col("text")).alias("m")).select(*keys, F.size("m").cast("long").alias("n_words"), "m")
    return _folded(_folded(hashed, keep, gram, lambda a, b: F.xxhash64(a, b)), keep, span - gram + 1, lambda a, b: F.least(a, b))


def winnowed(texts: DataFrame, keys: list[str], span: int, gram: int) -> DataFrame:
    """(*keys, print, at, n): the fingerprints of each text, and the runs of words they stand for,
    which start at `at` and the n - 1 words after it."""
    m, starts = F.col("m"), F.col("starts")
    # no filter on sizes here: it would be pushed down, and work everything out again
    return (gram_minima(texts, keys, span, gram)
            .select(*keys, "m", F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0))),
                lambda i: (i < F.size(m)) & ((i == 0) | (F.get(m, i) != F.get(m, i - 1)))).alias("starts"))
            .select(*keys, F.explode(F.coalesce(F.transform(starts, lambda s, j: F.struct(
                F.get(m, s).alias("print"), s.alias("at"),
                (F.coalesce(F.get(starts, j + 1), F.size(m)) - s).alias("n"))), F.array())).alias("f"))
            .select(*keys, "f.print", "f.at", "f.n"))


def extended(held: DataFrame, sizes: list[int]) -> DataFrame:
    """(*ROW, size, at, key) for the runs of words that the met fingerprints of a text stand for."""
    def key(at: Column, size: Column) -> Column:
        made = [F.when(size == s, F.xxhash64(*[F.get(F.col("e"), at + j) for j in range(s)])) for s in sizes]
        return F.coalesce(*made)

    runs = F.transform(F.col("met"), lambda f: F.transform(
        F.sequence(f["at"], f["at"] + f["n"] - 1),
        lambda i: F.struct(f["size"].alias("size"), i.alias("at"), key(i, f["size"]).alias("key"))))
    return (held.select(*ROW, "met", exact_hashes(F.col("text")).alias("e"))
            .select(*ROW, F.explode(F.coalesce(F.flatten(runs), F.array())).alias("r"))
            .select(*ROW, "r.size", "r.at", "r.key"))


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """(id, size, at, key) for every run of `size` words."""
    return (texts.select("id", exact_hashes(F.col("text")).alias("h"))
            .select("id", F.lit(size).alias("size"),
                    F.posexplode(grams(F.col("h"), size)).alias("at", "key")))


def _sized(found: DataFrame, width: Column) -> DataFrame:
    """A staged table, marked for broadcast if its rows, `width` bytes each, are within the bound."""
    total = found.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(found) if total <= BROADCAST_BYTES else found


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", carry: bool = False) -> DataFrame:
    """(id, n_words, n_hit, items) per document; items: sorted ids, as strings, of those it holds.

    n_hit counts words inside any occurrence of a run of `span` words of an item. With `carry` each
    row also has the document's own row, as a struct `row`.
    """
    row = [F.struct("*").alias("row")] if carry else []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.col(id_col)).alias(ROW[0]), F.xxhash64(F.col(text_col)).alias(ROW[1]), *row)
    tests = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text"))
    lengths = (tests.select(F.least(F.size(words_of(F.col("text"))), F.lit(span)).alias("n"))
               .where("n > 0").distinct())
    short = sorted(r.n for r in lengths.collect() if r.n < span)

    prints = sized(stage(winnowed(tests, ["id"], span, gram).select("print").distinct()))
    scanned = gram_minima(texts, ["id", *ROW], span, gram).select(
        "id", *ROW, "n_words", F.array_distinct("m").alias("prints"))
    scanned = scanned if carry else stage(scanned)  # read again for its counts
    # outer: an inner one is given a filter on sizes, which is pushed below all steps of the folding
    touched = stage(scanned.select(*ROW, F.explode_outer("prints").alias("print")).join(prints, "print", "left_semi")
                    .select(*ROW).distinct())
    near = (winnowed(texts.join(_sized(touched, F.lit(48)), ROW, "left_semi"), ROW, span, gram)
            .join(prints, "print", "left_semi")
            .select(*ROW, F.lit(span).alias("size"), "at", "n"))
    few = tests.withColumn("n", F.size(words_of(F.col("text"))))
    for size in short:
        keys = sized(stage(
            few.where(F.col("n") == size)
            .select(F.explode(grams(loose_hashes(F.col("text")), size)).alias("print")).distinct()))
        near = near.unionByName(
            texts.select(*ROW, loose_hashes(F.col("text")).alias("h"))
            .select(*ROW, F.posexplode(grams(F.col("h"), size)).alias("at", "print"))
            .join(keys, "print", "left_semi")
            .select(*ROW, F.lit(size).alias("size"), "at", F.lit(1).alias("n")))
    near = stage(near.groupBy(*ROW).agg(F.collect_set(F.struct("size", "at", "n")).alias("met")))

    held = texts.join(_sized(near, 48 + 16 * F.size("met")), ROW).select(*ROW, "text", "met")
    sizes = [*short, span]
    whole = [few.where(F.col("n") == s if s < span else F.col("n") >= s).select("id", "text") for s in sizes]
    wanted = stage(reduce(DataFrame.unionByName, [_windows(w, s) for w, s in zip(whole, sizes)])
                   .select("size", "key", F.col("id").alias("item")).distinct())
    keys = sized(stage(wanted.select("size", "key").distinct()))
    hits = stage(extended(held, sizes).join(keys, ["size", "key"], "left_semi"))
    words = (hits.groupBy(*ROW, "at").agg(F.max("size").alias("size")).groupBy(*ROW)
             .agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("s"))
             .select(*ROW, F.aggregate(
                 "s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                 lambda a, x: F.struct(
                     (a.n + F.greatest(F.lit(0), x.end - F.greatest(a.reach, x["at"]))).alias("n"),
                     F.greatest(a.reach, x.end).alias("reach")),
                 lambda a: a.n.cast("long")).alias("n_hit")))
    named = (hits.select(*ROW, "size", "key").distinct().join(wanted, ["size", "key"])
             .groupBy(*ROW).agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = stage(words.join(named, ROW))
    found = _sized(found, F.lit(48) + F.octet_length(F.array_join("items", ",")) + 16 * F.size("items"))
    counted = texts.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long")) if carry else scanned
    return (counted.select("id", "n_words", *ROW, *(["row"] if carry else []))
            .join(found, ROW, "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    *(["row"] if carry else [])))
