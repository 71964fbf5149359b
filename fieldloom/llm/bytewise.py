"""Whole batches of texts as one byte array: words, hashes and shingles without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from fieldloom.llm.common import mixed

_P = 0x9E3779B97F4A7C15 | 1
#: A random number for each byte value; A-Z count as a-z.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: Space and the five controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: White space and every other ASCII sign that is neither letter nor digit.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to ``n``."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        for k, base in enumerate((_P, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pd.Series | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and the ends; null is empty."""
    texts = [b"" if t is None or t is pd.NA or t != t else t.encode() for t in column]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends


def in_blocks(frame: pd.DataFrame, column: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows in blocks of some ``most`` characters; a longer text is a block of its own."""
    sizes = frame[column].str.len().fillna(0).to_numpy(np.int64)
    block = np.cumsum(sizes) // most
    for _, rows in frame.groupby(block, sort=True):
        yield rows


class Words:
    """The words of a block of texts: hashes, and the text that each lies in."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, apart: np.ndarray = _SPACE) -> None:
        n = len(data)
        space = apart[data]
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~space
        cut = np.zeros(n + 1, bool)
        cut[0] = True
        cut[ends[ends < n]] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.stops = np.flatnonzero(before & (~inside | cut)) if n else np.zeros(0, np.int64)
        power, inverse = _powers_to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLDED[data] * power[:n], out=total[1:])
        self.hashes = mixed((total[self.stops] - total[self.starts]) * inverse[self.starts] + (self.stops - self.starts).astype(np.uint64))
        # Words lie in order, so a text has those between two ends.
        self.counts = np.diff(np.searchsorted(self.starts, ends, side="left"), prepend=0).astype(np.int64)
        self.text = np.repeat(np.arange(len(ends)), self.counts)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and how many each text has.

    A text with fewer words than ``width`` has its whole sequence as one; without words, none.
    """
    h, counts = words.hashes, words.counts
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * _P % (1 << 64)
        rolled[: max(0, n - k)] += np.roll(h, -k)[: max(0, n - k)] * np.uint64(factor)
    first = np.cumsum(counts) - counts
    last_start = np.where(counts >= width, counts - width + 1, 0)
    keep = np.arange(n) - first[words.text] < last_start[words.text]
    values, owner = mixed(rolled[keep]), words.text[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            at = np.minimum(first[short] + k, n - 1)
            extra = np.where(has, extra * np.uint64(_P) + h[at], extra)
        values, owner = np.concatenate([values, mixed(extra)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.bincount(owner, minlength=len(counts)).astype(np.int64)
