"""Word streams and 64-bit fingerprints shared by the document operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of a text's UTF-8
form.  Null texts count as empty.  Everything here works on a whole Arrow column
at once: a word's hash is a difference of two prefix sums, so its cost is a few
nanoseconds a byte and no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Which byte values separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_EXACT = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]

#: Byte classes for word shapes: letters, capitals and digits each become one value.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[SPACE] = 32

_powers: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, _BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that linear combinations lose their structure."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd_weights(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """The words of a column of texts: ``first[d]:first[d + 1]`` are those of text d."""

    hash: np.ndarray
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray  # bytes of all texts, one after the other
    text_at: np.ndarray  # text d is data[text_at[d]:text_at[d + 1]]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start at it or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def column(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def _block_ends(data: np.ndarray) -> list[int]:
    """Cuts of at most ``_BLOCK`` bytes that never split a word, unless a word is longer."""
    ends, at, n = [], 0, len(data)
    while n - at > _BLOCK:
        spaces = np.flatnonzero(SPACE[data[at : at + _BLOCK]])
        if len(spaces):
            at += int(spaces[-1]) + 1
        else:
            later = at + _BLOCK
            while later < n and not SPACE[data[later]]:
                later += 1
            at = later
        ends.append(at)
    return [*ends, n]


def scan(data: np.ndarray, text_at: np.ndarray, fold: bool = False) -> Words:
    table = _FOLDED if fold else _EXACT
    edges = np.unique(text_at[(text_at > 0) & (text_at < len(data))])
    hashes, starts, ends, at = [], [], [], 0
    with np.errstate(over="ignore"):
        for to in _block_ends(data):
            block = data[at:to]
            if not len(block):
                continue
            word = ~SPACE[block]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            cut = edges[np.searchsorted(edges, at + 1) : np.searchsorted(edges, to)] - at
            first[cut] = word[cut]
            last[cut - 1] = word[cut - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _power_tables(len(block))
            total = np.empty(len(block) + 1, np.uint64)
            total[0] = 0
            np.cumsum(table[block] * up[: len(block)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s]))
            starts.append(s + at)
            ends.append(e + at)
            at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    return Words(join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, text_at), data, text_at)


def words_of(texts: pa.Array | pa.ChunkedArray, fold: bool = False) -> Words:
    """Words and their hashes; ``fold`` lower-cases A-Z first."""
    return scan(*column(texts), fold)


def shapes_of(words: Words) -> np.ndarray:
    """One hash per word of its shape: classes of letters, capitals, digits; runs collapsed."""
    kinds = _CLASS[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return scan(kinds[keep], at[words.text_at]).hash


def windows(hashes: np.ndarray, size: int, seed: int = 17) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; empty if there are fewer.

    Runs are built by doubling, so a window of 35 words costs seven passes, not 35.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = odd_weights(2 * size.bit_length() + 2, seed)
    block, width, done, total, bit = hashes, 1, 0, np.full(n, np.uint64(size)), 0
    with np.errstate(over="ignore"):
        while width <= size:
            if size & width:
                total = mix(total * step[2 * bit]) + block[done : done + n]
                done += width
            if 2 * width <= size:
                block = mix(block[:-width] * step[2 * bit + 1]) + block[width:]
            width, bit = 2 * width, bit + 1
        return mix(total)


def batches(batch_iter, most: int = 1 << 20, column_name: str = "text"):
    """Slices of Arrow batches that hold about ``most`` bytes of text (one row at least)."""
    for batch in batch_iter:
        sizes = np.diff(column(batch.column(column_name))[1])
        at = 0
        while at < batch.num_rows:
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()
