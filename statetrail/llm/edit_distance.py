"""Bounded edit distance, bit-parallel within the band that the bound leaves."""

from __future__ import annotations

from operator import itemgetter

import numpy as np

#: Characters of the pairs that are worked through at once, pairs below which they go one by one, and the
#: widest bound of the joint form.
CHARS, FEW, WIDEST = 1 << 22, 8, 31


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions lead from a to b.

    Equal beginnings and ends are taken off; what is left is worked through in the band.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    first = 0
    while first < len(a) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(a) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first:len(a) - last], b[first:len(b) - last]
    return len(b) <= most if not a else _banded(a, b, most)


def _banded(a: str, b: str, most: int) -> bool:
    """Bit r of ``reach[d]`` after j characters of b: a[:i] becomes b[:j] by at most d edits, where
    i = j + r - most. Only |i - j| <= most can matter, so that a column is 2 * most + 1 bits."""
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [((1 << d + 1) - 1 << most) & full for d in range(most + 1)]
    for j, c in enumerate(b):
        match = 0
        for i in range(max(0, j - most), min(len(a), j + most + 1)):
            if a[i] == c:
                match |= 1 << i - j + most
        now = [reach[0] & match]
        for d in range(1, most + 1):
            now.append((reach[d] & match | reach[d - 1] >> 1 | reach[d - 1] | now[d - 1] << 1) & full)
        if not now[most]:
            return False
        reach = now
    return bool(reach[most] >> len(a) - len(b) + most & 1)


def _agree(a: str, b: str) -> int:
    """How many characters a and b have in common at the beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within_each(a: list[str], b: list[str], bounds: list[int]) -> np.ndarray:
    """``within`` for many pairs, the band of all pairs of one bound being moved on together."""
    out, groups = np.zeros(len(a), bool), {}
    for at, (x, y, most) in enumerate(zip(a, b, bounds)):
        if len(x) > len(y):
            x, y = y, x
        if len(y) - len(x) > most:
            continue
        first = _agree(x, y)
        x, y = x[first:], y[first:]
        last = _agree(x[::-1], y[::-1])
        x, y = x[:len(x) - last], y[:len(y) - last]
        if not x:
            out[at] = len(y) <= most
        elif most:
            groups.setdefault(most, []).append((len(y), at, x, y))
    for most, pairs in groups.items():
        pairs.sort(key=itemgetter(0))
        start = 0
        while start < len(pairs):
            end = start + 1
            while end < len(pairs) and (end + 1 - start) * pairs[end][0] <= CHARS:
                end += 1
            _, at, x, y = zip(*pairs[start:end])
            if end - start < FEW or most > WIDEST:
                out[list(at)] = [_banded(p, q, most) for p, q in zip(x, y)]
            else:
                out[list(at)] = _banded_each(x, y, most)
            start = end
    return out


def _columns(texts, before: int, height: int, nothing: int) -> np.ndarray:
    """Row k has character k - before of every text, and ``nothing`` where there is none."""
    out = np.full((height, len(texts)), nothing, np.uint32)
    for at, text in enumerate(texts):
        out[before:before + len(text), at] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _banded_each(a, b, most: int) -> np.ndarray:
    """``_banded`` for pairs that are sorted by the length of b; those out of reach leave early."""
    size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
    width, longest, at = 2 * most + 1, int(size_b[-1]), np.arange(len(a))
    # shifts go beyond the band by a bit for each edit before it is cut off
    kind = np.uint32 if width + most <= 32 else np.uint64
    full, one, eight = kind((1 << width) - 1), kind(1), kind(8)
    rows_a = _columns(a, most, longest + width, 0xFFFFFFFF)
    rows_b = _columns(b, 0, longest, 0xFFFFFFFE)
    reach = np.array([[((1 << d + 1) - 1 << most) & int(full)] for d in range(most + 1)], kind).repeat(len(a), 1)
    out, gone, done = np.zeros(len(a), bool), 0, 0
    for j in range(longest):
        packed = np.packbits(rows_a[j - gone:j - gone + width] == rows_b[j - gone], axis=0, bitorder="little").astype(kind)
        match = packed[-1]
        for byte in packed[-2::-1]:
            match = match << eight | byte
        now = reach & match
        now[1:] |= reach[:-1]
        now[1:] |= reach[:-1] >> one
        for d in range(1, most + 1):
            now[d] |= now[d - 1] << one
        now &= full
        reach = now
        ended = int(np.searchsorted(size_b, j + 1, "right"))
        if ended > done:
            place = (size_a[done:ended] - size_b[done:ended] + most).astype(kind)
            out[at[done:ended]] = (reach[most, done:ended] >> place & one).astype(bool)
            done = ended
        left = reach[most] != 0
        left[:ended] = False
        n = int(np.count_nonzero(left))
        if not n:
            break
        if 4 * n < 3 * len(left):
            at, size_a, size_b, reach = at[left], size_a[left], size_b[left], reach[:, left]
            rows_a, rows_b = rows_a[j + 1 - gone:, left], rows_b[j + 1 - gone:, left]
            gone, done = j + 1, 0
    return out
