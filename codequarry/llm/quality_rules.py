"""Quality rules as a cascade that stops at the first rejection.

Every rule's cost and rejections are measured on a sample first; rules then run in the order of
rejections per second. The order changes what is computed, never the verdict: a text is kept if
no rule rejects it. Null texts are empty and fail the base rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import text_rows
from codequarry.llm.textstats import TextStats

#: Rows, about, that rules are measured on.
SAMPLE_ROWS = 2_000

#: A rule rejects a text if it returns true.
RULES: dict[str, Callable[[TextStats], bool]] = {
    "symbols": lambda s: 10 * s.n_symbols > s.n_words,
    "exclamations": lambda s: 10 * s.n_loud > 3 * s.n_words,
    "capitals": lambda s: s.n_upper > s.n_lower,
    "short_words": lambda s: s.word_chars < 2 * s.n_words,
    "long_words": lambda s: s.word_chars > 20 * s.n_words,
    "stutters": lambda s: 5 * s.n_stutters > s.n_words,
    "repeated_lines": lambda s: 2 * s.n_dup_lines > len(s.lines),
}


def base_failed(stats: TextStats) -> bool:
    return stats.n_words < 20 or 100 * stats.n_repeat_words > 30 * stats.n_words


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spent, rejected = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for text in batch.column(0):
            for name, rule in RULES.items():
                stats = TextStats(text.as_py())
                start = time.perf_counter()
                rejected[name] += rule(stats)
                spent[name] += time.perf_counter() - start
        yield pa.RecordBatch.from_arrays(
            [pa.array(RULES), pa.array(spent.values(), pa.float64()),
             pa.array(rejected.values(), pa.int64())], ["rule", "cost", "rejected"])


def rule_order(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second on a sample of the texts (id, text), best first."""
    rows = texts.count()
    step = max(1, rows // sample_rows)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("text")
    seen = (sample.mapInArrow(_measure, "rule string, cost double, rejected long")
            .groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")))
    worth = {r.rule: r.rejected / max(r.cost, 1e-9) for r in seen.collect()}
    return sorted(RULES, key=lambda name: -worth.get(name, 0.0))


def _judge(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[name] for name in order]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = TextStats(text.as_py())
                failed = base_failed(s)
                kept = not failed and not any(rule(s) for rule in rules)
                rows.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words,
                             failed, kept))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept"])
    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    texts = text_rows(docs, id_col, text_col)
    return texts.mapInArrow(
        _judge(rule_order(texts)),
        "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean")
