"""Arrow text columns as numpy arrays: word and shingle hashes without a Python object per word.

A word is a run of characters other than space and ``\\t\\n\\v\\f\\r``; texts are lower-cased
first. A shingle is five words in a row; a text of one to four words has one shingle, made of
all of them; a text without words has none. NULL counts as an empty text.

Texts are handled in groups of about ``GROUP_BYTES``, a longer text in pieces of that size cut
at white space, so memory follows the size of the word hashes (8 bytes a word), not that of
temporary arrays a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 18
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = np.random.default_rng(20_240_501).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls and the limits of its texts."""
    column = column.cast(pa.large_string())
    _, limits, data = column.buffers()
    offsets = np.frombuffer(limits, np.int64)[column.offset : column.offset + len(column) + 1] if limits else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        def table(base: int) -> np.ndarray:
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        return table(_BASE % 2**64), table(pow(_BASE, -1, 2**64))


def _hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in ``data``; a word ends at each of ``breaks``."""
    space = _SPACE[data]
    after = np.empty(len(data) + 1, dtype=bool)  # whether a word can start here
    after[0] = after[-1] = True
    after[1:-1] = space[:-1]
    after[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(~space & after[:-1])
    before = np.empty(len(data) + 1, dtype=bool)
    before[:-1] = space
    before[-1] = True
    before[breaks[breaks < len(data)]] = True
    ends = np.flatnonzero(~space & before[1:]) + 1
    power, inverse = _powers(1 << max(19, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts ``first`` to ``last``, and how many each text has."""
    low, high = int(offsets[first]), int(offsets[last])
    if high - low <= 2 * GROUP_BYTES or last - first > 1:
        hashes, starts = _hashes(data[low:high], offsets[first : last + 1] - low)
        owner = np.searchsorted(offsets[first : last + 1] - low, starts, "right") - 1
        return hashes, np.bincount(owner, minlength=last - first)
    pieces, at = [], low
    while at < high:
        end = min(at + GROUP_BYTES, high)
        while end < high and not _SPACE[data[end]]:  # go on to the end of the word
            run = np.flatnonzero(_SPACE[data[end : end + GROUP_BYTES]])
            end = min(end + (int(run[0]) if len(run) else GROUP_BYTES), high)
        pieces.append(_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    return hashes, np.array([len(hashes)])


def run_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS,
               short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and how many each text has.

    With ``short``, a text with fewer words has one run of all its words.
    """
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        if k < len(words):
            part = words[k:] * _STEPS[k]
            part[left[: len(words) - k] <= k] = 0
            total[: len(words) - k] += part
    whole = left >= size
    if short:
        few = (counts > 0) & (counts < size)
        at = (ends - counts)[few]
        whole[at] = True
        total[at] += counts[few].astype(np.uint64) * _STEPS[63]
    per_text = np.maximum(counts - size + 1, 0)
    if short:
        per_text = np.where(few, 1, per_text)
    return mixed(total[whole]), per_text


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of texts: the number of its first text, the shingle hashes in text order
    and how many each text has."""
    data, offsets = text_bytes(lowered(column))
    for first, last in groups(offsets):
        hashes, counts = run_hashes(*word_hashes(data, offsets, first, last))
        yield first, hashes, counts


def split(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def lists(values: list[np.ndarray] | np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values in row order and the length of each row's list."""
    flat = np.concatenate(values) if isinstance(values, list) else values
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def minima(hashes: np.ndarray, starts: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values: for each slice that begins at ``starts`` and each hash function, the least value."""
    out = np.empty((len(factors), len(starts)), dtype=np.uint64)
    for k, (mask, factor) in enumerate(zip(masks, factors, strict=True)):
        np.minimum.reduceat((hashes ^ mask) * factor, starts, out=out[k])
    return out.T


def hash_functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of ``count`` hash functions."""
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 2**64, size=count, dtype=np.uint64, endpoint=False)
    factors = rng.integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return masks, factors
