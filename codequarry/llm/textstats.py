"""Statistics of one whole text, each worked out when first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from codequarry.llm.words import hash_words, spans, text_bytes, windows


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL = _table("#*$%&|<>")
SPACE = _table(" \t\n\v\f\r")
DIGIT = _table("0123456789")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _table("abcdefghijklmnopqrstuvwxyz")
LOUD = _table("!?")
STOP = _table(".,;:")


class TextStats:
    """Null counts as empty. Words are `[^\\x20\\x09-\\x0D]+`."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = text_bytes(text)

    def share(self, table: np.ndarray) -> int:
        return int(np.count_nonzero(table[self.data]))

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return spans(self.data)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_words(self.data, *self.spans)

    @property
    def n_words(self) -> int:
        return len(self.spans[0])

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that start one, white space apart."""
        return int(np.count_nonzero((self.data & 0xC0) != 0x80)) - self.share(SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return self.share(SYMBOL)

    @cached_property
    def lines(self) -> list[str]:
        """The lines, split at \\n, that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in runs of eight that the text has twice or more."""
        keys = windows(self.hashes, 8)
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        steps = np.zeros(self.n_words + 1, dtype=np.int64)
        again = count[place] > 1
        steps[:len(keys)] += again
        steps[8:8 + len(keys)] -= again
        return int(np.count_nonzero(np.cumsum(steps[:-1]) > 0))

    @cached_property
    def n_upper(self) -> int:
        """Capital letters, those of the Latin-1 range included."""
        first, second = self.data[:-1], self.data[1:]
        return self.share(UPPER) + int(np.count_nonzero(
            (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)))

    @cached_property
    def n_lower(self) -> int:
        first, second = self.data[:-1], self.data[1:]
        return self.share(LOWER) + int(np.count_nonzero((first == 0xC3) & (second >= 0x9F)))

    @cached_property
    def n_loud(self) -> int:
        return self.share(LOUD)

    @cached_property
    def distinct_words(self) -> int:
        return len(np.unique(self.hashes))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return int(np.count_nonzero(self.hashes[1:] == self.hashes[:-1]))
