import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from statetrail.llm import buckets, components, count_tree
from statetrail.llm.buckets import _distinct
from statetrail.llm.components import connected_components
from statetrail.llm.common import Store
from statetrail.llm.ngram_jaccard import jaccard_components, keep_first_of_component
from statetrail.llm.words import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(texts):
    sets, up = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies(seed, groups=12, each=14):
    """Groups of copies with some words changed, all with a common passage."""
    rnd, texts = random.Random(seed), {}
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=20)
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 90))
        for _ in range(rnd.randint(1, each)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 14))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.4:
                words += passage
            texts[len(texts) + 100] = " ".join(words)
    return texts


@pytest.mark.parametrize("seed, unit", [(1, None), (2, (2, 3))])
def test_components_as_plain(docs_of, monkeypatch, seed, unit):
    if unit:
        monkeypatch.setattr(buckets, "PROBES", unit[0])
        monkeypatch.setattr(buckets, "MEMBERS", unit[1])
    texts = near_copies(seed)
    found = jaccard_components(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain(texts)


def test_threshold_is_met_exactly(docs_of):
    """Of 8 shingles 6 are common: 75 percent."""
    words = [f"x{i}" for i in range(11)]
    texts = {9: " ".join(words), 5: " ".join([*words, "y"]), 3: " ".join([*words[:10], "A"]),
             2: " ".join([*words, "y", "z", "q"])}
    assert {r.doc_id: (r.n_shingles, r.component_id)
            for r in jaccard_components(docs_of(texts)).collect()} == plain(texts)


def test_bound_is_never_below_the_overlap():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rnd.choice(600, rnd.integers(1, 500), False).astype(np.uint64) for _ in range(2))
        both = len(set(a.tolist()) & set(b.tolist()))
        pair = [count_tree.pa.array([count_tree.point(x)], count_tree.pa.binary()) for x in (a, b)]
        assert count_tree.overlap_bound(*pair)[0] >= both


def test_tree_finds_what_a_scan_finds():
    rnd = np.random.default_rng(4)
    sets = [rnd.choice(900, rnd.integers(1, 300), False).astype(np.uint64) for _ in range(300)]
    points = count_tree.matrix(count_tree.pa.array(
        [count_tree.point(s, count_tree.GROUPS) for s in sets], count_tree.pa.binary()))
    sizes = np.array([len(s) for s in sets])
    tree = count_tree.CountTree(points, sizes)
    for i in range(0, 300, 7):
        fits = (100 * np.minimum(sizes, sizes[i]) >= 75 * np.maximum(sizes, sizes[i])) & (
            175 * count_tree.minima(points, points[i]) >= 75 * (sizes + sizes[i]))
        assert set(np.flatnonzero(fits)) <= set(tree.search(points[i], int(sizes[i]), 75).tolist())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, Store(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


@pytest.mark.parametrize("cells", [0, components.BROADCAST_CELLS])
def test_components_as_by_plain_union(spark, monkeypatch, cells):
    """Chains, stars and random links over several tasks."""
    monkeypatch.setattr(components, "BROADCAST_CELLS", cells)
    rnd = np.random.default_rng(3)
    names = rnd.permutation(4_000) - 2_000
    pairs = [(i, i + 1) for i in range(1_500) if i % 300] + [(1_600, i) for i in range(1_600, 2_500)]
    pairs += [(i, int(rnd.integers(2_500, 4_000))) for i in range(2_500, 3_500)]
    pairs = [(int(names[a]), int(names[b])) for a, b in pairs]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a long, b long").repartition(7)
    found = [(r.node, r.component) for r in connected_components(edges, Store(spark, "test")).collect()]
    assert sorted(found) == sorted((x, top(x)) for x in up)


def test_components_in_few_stages(spark):
    """Pairs with pivots, and links between some of these: each shuffle is 211 tasks on check_h."""
    pairs = [(i % 20, i) for i in range(20, 900)] + [(i, i + 7) for i in range(10)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    context = spark.sparkContext
    context.setJobGroup("few stages", "")
    try:
        found = connected_components(edges, Store(spark, "test")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    ids = {s for job in tracker.getJobIdsForGroup("few stages") for s in tracker.getJobInfo(job).stageIds}
    ran = [s for s in map(tracker.getStageInfo, ids) if s is not None and s.numCompletedTasks]
    assert len(found) == 900 and len({r.component for r in found}) == 10
    print("stages", len(ran))
    assert len(ran) <= 25


def test_stars_of_a_task():
    u, v = np.array([5, 9, 5, 7]), np.array([9, 3, -4, 8])
    nodes, tops = components._ties(u, v)
    assert dict(zip(nodes.tolist(), tops.tolist())) == {3: -4, 5: -4, 9: -4, 8: 7}


def test_odd_rows(odd_docs, no_docs):
    found = sorted((repr(r.doc_id), r.n_shingles, r.component_id)
                   for r in jaccard_components(odd_docs).collect())
    assert found == [("1", 0, 1), ("2", 0, 2), ("3", 1, 3), ("4", 2, 4), ("4", 2, 4), ("5", 0, 5),
                     ("6", 1, 6), ("7", 1, 7), ("None", 2, None)]
    assert jaccard_components(no_docs).collect() == []


def test_stage_keeps_one_of_a_group(spark, docs_of):
    words = " ".join(f"x{i}" for i in range(40))
    kept = keep_first_of_component(spark, docs_of(
        {4: words, 2: words + " end", 8: "something else altogether in here", 9: ""}), "")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 8, 9]


@pytest.mark.parametrize("own_id", [7, None])
def test_many_rows_of_one_id(spark, own_id):
    """2,000 rows in 1,000 linked pairs; each row meets its own text only."""
    rows = []
    for i in range(1_000):
        words = [f"w{i}x{k}" for k in range(60)]
        rows += [(own_id, " ".join(words)), (own_id, " ".join([*words[:-1], "other"]))]
    rows.append((3, " ".join(f"w5x{k}" for k in range(60))))
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == 2_001
    lowest = [r.component_id for r in found if r.doc_id != 3]
    assert sorted(lowest, key=str) == sorted([3] * 2 + [own_id] * 1_998, key=str)


def test_pairs_of_many_units_are_handed_out_once():
    pairs = pa.record_batch({"a": pa.array([3, 1, 3, 1], pa.int64()), "b": pa.array([4, 2, 4, 9], pa.int64())})
    assert _distinct(pairs).to_pydict() == {"a": [1, 1, 3], "b": [2, 9, 4]}


def test_shingles_of_many_texts_take_little_memory():
    texts = pa.array([f"{i} " + " ".join(f"w{i * k % 977}" for k in range(400)) for i in range(1_000)])
    alone = [next(shingle_sets(texts.slice(i, 1))).tolist() for i in range(0, 1_000, 37)]
    tracemalloc.start()
    try:
        found = [x.tolist() if i % 37 == 0 else None for i, x in enumerate(shingle_sets(texts))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 1_500_000 and peak < 10e6
    assert found[::37] == alone
