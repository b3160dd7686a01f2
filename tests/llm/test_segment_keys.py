import mmap
import random
from collections import defaultdict

import numpy as np
import pytest
from statetrail.llm import segment_keys as sk
from statetrail.llm.common import freed

GROWING = (16, 8)


def plain_keys(line, most):
    """(class, segment, substring) of every key, and whether the line holds it."""
    n, found = len(line), set()
    mine = sk.length_class(n, most)
    classes = [mine]
    if mine[0]:
        below = sk.length_class(mine[0] - 1, most)
        if n - below[1] < mine[0]:
            classes.append(below)
    for low, bound in classes:
        size = low // (bound + 1) if bound else 0
        for i in range(bound + 1 if bound else 0):
            front = i <= bound - i
            start = i * size if front else n - (bound + 1 - i) * size
            moved = i if front else bound - i
            for at in range(start - moved, start + moved + 1):
                if at >= 0 and at + size <= n:
                    found.add((low, bound, i, line[at:at + size], at == start and low == mine[0]))
    return found


def some_lines(seed, count=60):
    rnd = random.Random(seed)
    lines = {"".join(rnd.choices("ab \U0001F600", k=rnd.choice([16, 17, 40, 130, 200, 500]))) for _ in range(count)}
    for line in list(lines)[:20]:
        at = rnd.randrange(len(line))
        lines.add(line[:at] + "#" + line[at:])
    return sorted(lines | {"", "x", "a" * 16, "a" * 300, "\ud800" * 20})


@pytest.mark.parametrize("most", [1, 3, GROWING])
def test_keys_are_equal_where_substrings_are(most):
    lines = some_lines(1)
    line, key, held = sk.segment_keys(lines, most)
    found = defaultdict(set)
    for at, k, h in zip(line.tolist(), key.tolist(), held.tolist()):
        found[at].add((k, h))
    for at, text in enumerate(lines):
        wanted = plain_keys(text, most)
        assert len(wanted) == len(found[at])
    by_key, by_text = defaultdict(set), defaultdict(set)
    for at, text in enumerate(lines):
        for k, _ in found[at]:
            by_key[k].add(at)
        for name in plain_keys(text, most):
            by_text[name[:4]].add(at)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_text.values()))


def test_a_line_above_the_slice_has_the_same_keys(monkeypatch):
    lines = some_lines(2)
    whole = sk.segment_keys(lines, GROWING)
    monkeypatch.setattr(sk, "CHARS", 64)
    sk._tables.cache_clear()
    try:
        for at, line in enumerate(lines):
            _, key, _ = sk.segment_keys([line], GROWING)
            assert sorted(key.tolist()) == sorted(whole[1][whole[0] == at].tolist())
    finally:
        sk._tables.cache_clear()


def test_hot_keys_of_a_task_send_few_lines():
    key = np.array([7] * 1000 + [9] * 50 + [3, 4], np.uint64)
    node = np.concatenate([np.arange(1000), np.arange(50), [1, 1]])
    held = np.zeros(len(key), bool)
    held[5] = True
    sent, here = sk._local(key, node, held)
    assert sent[0].tolist() == [3, 4, 7, 7, 9, 9] and sent[2].tolist() == [False, False, True, True, False, False]
    both = {*zip(sent[0].tolist(), sent[1].tolist()), *zip(here[0].tolist(), here[1].tolist())}
    assert both == set(zip(key.tolist(), node.tolist()))


def test_blocks_come_back_whole():
    key = (np.uint64(5) << np.uint64(31)) | np.array([0, 1, (1 << 31) - 1], np.uint64)
    node, held = np.array([-5, 2, 1 << 60]), np.array([True, False, True])
    packed = sk._packed(key, node, held)
    for a, b in zip(sk._unpacked(5, [packed[0]], [packed[1]]), (key, node, held)):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("n_lines", [0, 100_000])
def test_shared_keys_as_plain(spark, n_lines):
    """Equal lines are one, also over tasks; a hot segment is in every second line."""
    rnd = random.Random(3)
    lines = some_lines(3) + ["the same beginning of many lines " + "".join(rnd.choices("cdef", k=40))
                             for _ in range(80)]
    texts = [None, "", *("\n".join(rnd.sample(lines, 6)) for _ in range(60)), "\n".join(lines)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sk.shared_keys(docs, lambda line: True, GROWING, n_lines).collect()
    groups, useful = defaultdict(set), set()
    for line in lines:
        for *name, held in plain_keys(line, GROWING) if sk.edits(len(line), GROWING) else ():
            groups[tuple(name)].add(sk.number(line))
            if held:
                useful.add(tuple(name))
    wanted = [sorted(v) for k, v in groups.items() if len(v) > 1 and k in useful]
    found, kept = defaultdict(set), set()
    for row in rows:
        found[row.token].add(row.node)
        if row.held:
            kept.add(row.token)
    assert sorted(sorted(v) for k, v in found.items() if k in kept) == sorted(wanted)


@pytest.mark.parametrize("bits", [3, 40, 64])
def test_order_is_that_of_a_stable_sort(bits):
    for n in (0, 1, 2, 1000):
        key = np.random.default_rng(n).integers(0, 1 << bits, n, np.uint64, endpoint=False)
        assert sk._order(key).tolist() == np.argsort(key, kind="stable").tolist()


@pytest.mark.parametrize("most", [0, 1, (16, 8), (16, 0)])
def test_least_length_with_an_edit(most):
    assert [n >= sk.least_edited(most) for n in range(50)] == [sk.edits(n, most) > 0 for n in range(50)]


def resident():
    with open("/proc/self/statm") as statm:
        return int(statm.read().split()[1]) * mmap.PAGESIZE


def test_workers_give_memory_back():
    """The last of many blocks stays, so that the C library keeps the others by itself."""
    kept = []

    def run(batches):
        blocks = [b"x" * (1 << 16) for _ in range(1 << 11)]
        kept.append(blocks[-1])
        del blocks
        yield resident()
        yield from batches

    before, batch = freed(run)(iter(["batch"]))
    assert batch == "batch" and resident() < before - (100 << 20)
