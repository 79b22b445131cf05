"""Words of Arrow batches of texts, found on their bytes by numpy.

A-Z counts as a-z, and a word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: of digits, the letters a-z and all
characters beyond ASCII. Every byte of such a character in UTF-8 is 0x80 or more, so words need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False

#: Bytes of text worked on at once, so that the arrays stay near the processor; one text is never cut.
SLICE = 1 << 20


class Words(NamedTuple):
    """Lower-cased bytes; where words start and end in them; the row of each word; how many words each row has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    def text(self, word: int) -> str:
        return self.data[self.starts[word] : self.ends[word]].tobytes().decode("utf-8", "replace")


def word_slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words of rows ``first`` to ``last`` (exclusive) of a string column, some rows at a time; null has none."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        yield first, last, words(part, offsets[first : last + 1] - offsets[first])
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``; a word ends with its text."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # a word that reaches a border between two texts ends there, and the next text's word begins
    meet = inside[bounds] & inside[bounds + 1]
    begins[bounds[meet]] = ends[bounds[meet]] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    counts = np.diff(np.searchsorted(starts, bounds))
    return Words(data, starts, ends, np.repeat(np.arange(len(counts)), counts), counts)
