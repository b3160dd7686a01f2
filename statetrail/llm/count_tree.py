"""R-trees over count vectors.

A set of tokens is a point: how many of its tokens fall into each of GROUPS groups. |A & B| is
at most the sum over the groups of the smaller count. For all sets in a box it is at most that of
the point and the box's upper corner, so a search leaves out whole boxes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .buckets import fresh, sides

#: Groups of a tree's points, and most groups of a single point; powers of two.
GROUPS, MOST_GROUPS = 256, 1 << 16
#: Points of a leaf, and children of an inner box.
FANOUT = 16
#: Stands for any count from there on.
_OPEN, _TOP = np.iinfo(np.uint8).max, np.iinfo(np.uint16).max


def point(tokens: np.ndarray, groups: int | None = None) -> bytes:
    """Counts by group; about as many groups as tokens, so that a large set's bound is as tight."""
    groups = groups or min(max(GROUPS, 1 << (len(tokens) - 1).bit_length()), MOST_GROUPS)
    counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, _OPEN).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Fewer groups: those that are alike in the lower bits, added up."""
    parts = counts.reshape(-1, groups)
    total = np.minimum(parts.sum(axis=0, dtype=np.int64), _TOP)
    return np.where((parts == _OPEN).any(axis=0), _TOP, total).astype(np.uint16)


def matrix(points) -> np.ndarray:
    """Points with GROUPS groups each."""
    data = np.frombuffer(b"".join(points.to_pylist()), np.uint8).reshape(len(points), GROUPS)
    return np.where(data == _OPEN, _TOP, data.astype(np.uint16))


def minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the smaller counts; open counts make the bound as large as can be."""
    low = np.minimum(x, y)
    return low.sum(axis=-1, dtype=np.int64) + np.where((low == _TOP).any(axis=-1), 1 << 50, 0)


def overlap_bound(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of each pair the bound with the groups of the coarser point."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
        groups = min(len(x), len(y))
        out[i] = minima(_folded(np.frombuffer(x, np.uint8), groups),
                        _folded(np.frombuffer(y, np.uint8), groups))
    return out


class CountTree:
    """Bulk-loaded by sizes and then, size by size, by the coordinates that differ most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = self._tiled(points, sizes)
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            corner, low, high = self.levels[-1]
            cuts = np.arange(0, len(corner), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts)))

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Halved again and again: at the median size while sizes differ, else by a coordinate."""
        done, todo = [], [np.argsort(sizes, kind="stable")]
        while todo:
            rows = todo.pop()
            if len(rows) <= FANOUT:
                done.append(rows)
                continue
            if 4 * sizes[rows].min() >= 3 * sizes[rows].max():
                own = points[rows].astype(np.int64)
                rows = rows[np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")]
            half = -(-len(rows) // 2 // FANOUT) * FANOUT
            todo += [rows[half:], rows[:half]]
        return np.concatenate(done)

    def search(self, probe: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions in the input of all points that may be linked with a set of that size."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[level]
            at = at[(100 * low[at] <= 10_000 * size // percent) & (100 * high[at] >= percent * size)]
            at = at[(100 + percent) * minima(corner[at], probe) >= percent * (size + low[at])]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def box_join(unit: pa.Table, percent: int):
    """Pairs (a, b) of a unit that pass the bounds: side 1 against the members on side 0."""
    members, probes = sides(unit)
    if not len(members) or not len(probes):
        return
    node, ask = members.column("node").to_numpy(), fresh(members)
    tree = CountTree(matrix(members.column("box")), members.column("n").to_numpy())
    sizes, points = probes.column("n").to_numpy(), matrix(probes.column("box"))
    a, b = [], []
    for i, (own, kind) in enumerate(zip(probes.column("node").to_numpy(),
                                        probes.column("component").to_numpy())):
        at = ask(own, kind, tree.search(points[i], int(sizes[i]), percent))
        a.append(np.minimum(node[at], own))
        b.append(np.maximum(node[at], own))
    yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})
