"""Keys of line segments, and those of them that more than one line has.

A line has some 40 keys if it may be edited in eight places, and nearly all of them are its own. So
keys do not go through a shuffle as rows: a task packs sorted blocks of 12 bytes a key, one block
for each range of keys, and the receiver of a range hands out only the keys that two lines have and
one of them holds. What is many times in a task already (a hot key) is handed out by that task,
which sends just two lines for it, so that no receiver gets more than a few lines of a key and task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import freed, parts

#: Characters that are hashed at once (a longer line is hashed alone), keys of a block set, keys of a
#: range, distinct lines that a task remembers in order not to send them again, and lines of an
#: unheld key that a task sends before it hands the others out itself.
CHARS, GATHERED, RANGE_KEYS, KNOWN, UNHELD = 1 << 17, 1 << 18, 1 << 18, 1 << 20, 8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def edits(length: int, most: int | tuple[int, int]) -> int:
    """Edits within which a line of that length is linked with another that is no shorter."""
    return most if isinstance(most, int) else min(length // most[0], most[1])


def least_edited(most: int | tuple[int, int]) -> float:
    """The length from which on a line has an edit."""
    chars, bound = (0, most) if isinstance(most, int) else most
    return chars if bound > 0 else math.inf


def number(data: str) -> int:
    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 16)
def length_class(length: int, most: int | tuple[int, int]) -> tuple[int, int]:
    """(least length of the class, edits); classes are wider than the edits."""
    bound = edits(length, most)
    if isinstance(most, int):
        low = bound + 1
    elif bound < most[1]:
        return bound * most[0], bound
    else:
        low = most[0] * bound
    if length < low:
        return 0, bound
    while length >= (above := max(low * 3 // 2, low + bound + 1)):
        low = above
    return low, bound


def keys_per_line(most: int | tuple[int, int]) -> int:
    """Keys of a line in its own class, at most."""
    bound = most if isinstance(most, int) else most[1]
    return (bound // 2 + 1) ** 2 + ((bound + 1) // 2) ** 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, CHARS + 1), _powers(_INVERSE, CHARS + 1)


class _Substrings:
    """Hashes of any substrings of some lines: a polynomial modulo 2 ** 64 from running sums."""

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, self.down = _tables() if len(codes) <= CHARS else (
            _powers(_BASE, len(codes) + 1), _powers(_INVERSE, len(codes) + 1))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(_BASE)) * up[:len(codes)], out=self.sums[1:])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


@lru_cache(1 << 10)
def _places(low: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the segments of a class and how far each can have moved: the place, whether it is counted
    from the end of the line, a number of the segment, and whether this is where it is entered."""
    size, rows = low // (bound + 1), []
    for i in range(bound + 1):
        behind = i > bound - i
        moved = bound - i if behind else i
        place = i * size - behind * (bound + 1) * size
        rows += [(place + shift, behind, low * (bound + 1) + i + 1, not shift) for shift in range(-moved, moved + 1)]
    place, behind, segment, unmoved = zip(*rows)
    return np.array(place), np.array(behind), _mixed(np.array(segment, np.uint64)), np.array(unmoved)


def segment_keys(lines: list[str], most: int | tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, held): the segments that a line is entered under (held), and the substrings
    under which it is looked for among the lines of its class and of the class below."""
    sizes = np.array([len(x) for x in lines], np.int64)
    begins = np.cumsum(sizes) - sizes
    text, groups = _Substrings(lines), {}
    for at, n in enumerate(sizes.tolist()):
        mine = length_class(n, most)
        groups.setdefault((*mine, True), []).append(at)
        if mine[0]:
            below = length_class(mine[0] - 1, most)
            if n - below[1] < mine[0]:
                groups.setdefault((*below, False), []).append(at)
    found = []
    for (low, bound, mine), members in groups.items():
        if not bound:
            continue
        members = np.array(members)
        n, size = sizes[members][:, None], low // (bound + 1)
        place, behind, salt, unmoved = _places(low, bound)
        at = np.where(behind, n, 0) + place
        inside = (at >= 0) & (at + size <= n)
        if inside.all():
            key = text.at(begins[members][:, None] + at, size) ^ salt
            found.append((np.repeat(members, len(place)), key.ravel(), np.tile(unmoved & mine, len(members))))
            continue
        line, which = np.nonzero(inside)
        found.append((members[line], text.at(begins[members][line] + at[inside], size) ^ salt[which],
                      unmoved[which] & mine))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    line, key, held = (np.concatenate(column) for column in zip(*found))
    return line, _mixed(key), held


def _order(key: np.ndarray) -> np.ndarray:
    """What sorts the keys, equal ones by place. Keys and places are sorted as one number where both fit
    into 64 bits, which takes half the time."""
    width = max(1, (len(key) - 1).bit_length())
    if not len(key) or int(key.max()).bit_length() + width > 64:
        return np.argsort(key, kind="stable")
    both = (key << np.uint64(width)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << width) - 1)).astype(np.int64)


def _runs(key: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array are equal to a neighbour."""
    out, same = np.zeros(len(key), bool), key[1:] == key[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _grouped(key: np.ndarray, node: np.ndarray, held: np.ndarray):
    """Each (key, node) once, sorted, with: number of its key, nodes of each key, whether one holds it."""
    order = np.lexsort((node, key))
    key, node, held = key[order], node[order], held[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= node[1:] != node[:-1]
    group = np.cumsum(new_key) - 1
    useful = np.bincount(group, held, minlength=1) > 0
    group, first = group[new], np.flatnonzero(new)
    return key[first], node[first], group, np.bincount(group, minlength=1), useful


def _local(key: np.ndarray, node: np.ndarray, held: np.ndarray):
    """(sent, handed out): entries (key, node, held) for the receivers, and those of hot keys."""
    order = _order(key)
    key, node, held = key[order], node[order], held[order]
    many = _runs(key)
    if not many.any():
        return (key, node, held), None
    single = ~many
    k, n, group, sizes, useful = _grouped(key[many], node[many], held[many])
    place = np.arange(len(k)) - np.searchsorted(group, group)
    here = (place > 0) & (place < sizes[group] - 1) & (useful[group] | (sizes[group] > UNHELD))
    sent = ~here
    merged = [np.concatenate(both) for both in (
        (key[single], k[sent]), (node[single], n[sent]), (held[single], useful[group][sent]))]
    order = _order(merged[0])
    return tuple(x[order] for x in merged), (k[here], n[here], useful[group][here])


def _packed(key: np.ndarray, node: np.ndarray, held: np.ndarray) -> tuple[bytes, bytes]:
    low = (key & np.uint64((1 << 31) - 1)).astype(np.uint32)
    return (low << np.uint32(1) | held).tobytes(), node.tobytes()


def _unpacked(part, keys: list[bytes], nodes: list[bytes]):
    low = np.frombuffer(b"".join(keys), np.uint32)
    return ((np.uint64(part) << np.uint64(31)) | (low >> np.uint32(1)), np.frombuffer(b"".join(nodes), np.int64),
            (low & np.uint32(1)).astype(bool))


def _batch(key: np.ndarray, node: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"token": pa.array(key.astype(np.int64)), "node": pa.array(node),
                            "held": pa.array(held)})


def shared_keys(docs: DataFrame, wanted, most: int | tuple[int, int], n_lines: int) -> DataFrame:
    """(token, node, held) of the keys that two lines have, for lines that ``wanted(line)`` accepts.

    ``n_lines``, about how many lines there are, decides on the number of ranges. Keys that no line holds
    are left out, but for some hot ones.
    """
    bits = max(6, math.ceil(math.log2(1 + n_lines * keys_per_line(most) / RANGE_KEYS)))
    shift, shortest = np.uint64(64 - bits - 31), least_edited(most)

    def blocks(entries, task: int):
        sent, hot = _local(*(np.concatenate(x) for x in zip(*entries)))
        rows = []
        part = (sent[0] >> np.uint64(31)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                rows.append((int(part[a]), -1, *_packed(*(x[a:b] for x in sent))))
        if hot is not None and len(hot[0]):
            # what a task hands out goes to any receiver, with the upper bits of its keys
            part = (hot[0] >> np.uint64(31)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                goes = (int(part[a]) * 31 + task * 17) % (1 << bits)
                rows.append((goes, int(part[a]), *_packed(*(x[a:b] for x in hot))))
        return pa.record_batch({
            "part": pa.array([r[0] for r in rows], pa.int64()), "own": pa.array([r[1] for r in rows], pa.int64()),
            "keys": pa.array([r[2] for r in rows], pa.binary()), "nodes": pa.array([r[3] for r in rows], pa.binary())})

    def send(batches):
        known, entries, n, done = set(), [], 0, 0

        def hashed(lines, nodes):
            line, key, held = segment_keys(lines, most)
            return key >> shift, np.array(nodes, np.int64)[line], held

        for batch in parts(batches):
            lines, nodes, chars = [], [], 0
            for text in batch.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) < shortest or not wanted(line) or (node := number(line)) in known:
                        continue
                    if lines and chars + len(line) > CHARS:
                        entries.append(hashed(lines, nodes))
                        n += len(entries[-1][0])
                        lines, nodes, chars = [], [], 0
                    if n >= GATHERED:
                        yield blocks(entries, done)
                        entries, n, done = [], 0, done + 1
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(node)
                    lines.append(line)
                    nodes.append(node)
                    chars += len(line)
            if lines:
                entries.append(hashed(lines, nodes))
                n += len(entries[-1][0])
        if n:
            yield blocks(entries, done)

    def met(part, keys, nodes):
        key, node, held = _unpacked(part, keys, nodes)
        order = _order(key)
        at = order[_runs(key[order])]
        if len(at):
            key, node, group, sizes, useful = _grouped(key[at], node[at], held[at])
            keep = ((sizes > 1) & useful)[group]
            yield _batch(key[keep], node[keep], np.ones(int(keep.sum()), bool))

    def receive(batches):
        now, keys, nodes = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "keys", "nodes"))):
                part, own, some_keys, some_nodes = row
                if own >= 0:
                    yield _batch(*_unpacked(own, [some_keys], [some_nodes]))
                    continue
                if part != now:
                    if keys:
                        yield from met(now, keys, nodes)
                    now, keys, nodes = part, [], []
                keys.append(some_keys)
                nodes.append(some_nodes)
        if keys:
            yield from met(now, keys, nodes)

    sent = docs.select("text").mapInArrow(freed(send), "part long, own long, keys binary, nodes binary")
    return (sent.repartition("part").sortWithinPartitions("part")
            .mapInArrow(freed(receive), "token long, node long, held boolean"))
