"""Words and word shingles of whole Arrow batches as 64-bit numbers, without a loop over words.

A word's number is a polynomial of its bytes, taken from running sums over the batch and mixed
afterwards; a shingle's number mixes those of its words. Equal words or shingles have equal
numbers, and different ones differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, and where each byte takes several numbers; a longer text is
#: one block of its own.
BLOCK, NUMBERED = 1 << 20, 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, p, np.uint64))])
                 for p in (_P, _INVERSE))


def separators(chars: str) -> np.ndarray:
    """A table over byte values: True for those between words, all of them ASCII."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


#: U+0020 and U+0009 to U+000D.
SPACES = separators(" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def blocks(texts: pa.Array, most: int = BLOCK):
    """Slices of the batch of about ``most`` bytes: first row, bytes, start of each row and the end."""
    if not len(texts):
        return
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, data[offsets[row]:offsets[last]], offsets[row:last + 1].astype(np.int64) - offsets[row]
        row = last


def word_spans(data: np.ndarray, bounds: np.ndarray, between: np.ndarray):
    """Start and end of every word; no word goes on beyond the end of its row."""
    inside = ~between[data]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(inside):
        before[filled] = False
        after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_numbers(data: np.ndarray, bounds: np.ndarray, between: np.ndarray, lower: bool):
    """Number of every word, and for each row the range of its words."""
    data = LOWER[data] if lower else data
    starts, ends = word_spans(data, bounds, between)
    power, inverse = _powers(max(NUMBERED.bit_length() - 1, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    numbers = (sums[ends] - sums[starts]) * inverse[starts]
    numbers = mix(numbers + mix((ends - starts).astype(np.uint64)))
    return numbers, np.searchsorted(starts, bounds)


@cache
def _weights(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 2, dtype=np.uint64) * _P) | np.uint64(1)


def combine(numbers: np.ndarray) -> np.uint64:
    """One number for a short sequence as a whole."""
    w = _weights(64)
    total = np.sum(numbers * w[:len(numbers)], keepdims=True)
    return mix(total + np.array([len(numbers)], np.uint64) * w[-1:])[0]


def shingle_sets(texts: pa.Array, size: int = 5):
    """For each row the sorted distinct numbers of its shingles.

    A text of fewer words than ``size`` has its whole sequence as one; none has an empty set.
    """
    weights = _weights(size)
    for _, data, bounds in blocks(texts, NUMBERED):
        numbers, ranges = word_numbers(data, bounds, SPACES, True)
        total = max(0, len(numbers) - size + 1)
        rolled = np.zeros(total, np.uint64)
        for j in range(size):
            rolled += numbers[j:j + total] * weights[j]
        rolled = mix(rolled)
        for i in range(len(bounds) - 1):
            a, b = ranges[i], ranges[i + 1]
            if b - a >= size:
                found = np.sort(rolled[a:b - size + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield np.array([combine(numbers[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
