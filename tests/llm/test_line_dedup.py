import random
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from statetrail.llm import buckets
from statetrail.llm import line_dedup as ld
from statetrail.llm.common import Store
from statetrail.llm.edit_distance import within, within_each


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_distance_as_plain():
    rnd = random.Random(1)
    for _ in range(6000):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(0, 9))) for _ in range(2))
        most = rnd.randint(0, 4)
        assert within(a, b, most) == (distance(a, b) <= most)


def test_many_pairs_as_one_by_one():
    rnd = random.Random(2)
    a, b, bounds = [], [], []
    for _ in range(4000):
        x = "".join(rnd.choices("ab\U0001F600", k=rnd.choice([0, 1, 5, 20, 90])))
        y = list(x)
        for _ in range(rnd.randint(0, 10)):
            i, what = rnd.randrange(len(y) + 1), rnd.randint(0, 2)
            y[i:i + (what > 0)] = rnd.choice("ab") if what < 2 else ""
        a.append(x)
        b.append("".join(y))
        bounds.append(rnd.choice([0, 1, 2, 8, 31, 40]))
    found = within_each(a, b, bounds)
    assert 500 < found.sum() < 3900
    assert found.tolist() == [within(x, y, most) for x, y, most in zip(a, b, bounds)]
    assert within_each([], [], []).tolist() == []


@pytest.mark.parametrize("most", [1, 2, 3])
def test_lines_within_the_bound_share_a_key(most):
    rnd = random.Random(most)
    for _ in range(4000):
        a = "".join(rnd.choices("abc", k=rnd.randint(most + 1, 14)))
        b = list(a)
        for _ in range(most):
            i, what = rnd.randrange(len(b) + 1), rnd.randint(0, 2)
            b[i:i + (what > 0)] = rnd.choice("abc") if what < 2 else ""
        b = "".join(b)
        if len(b) > most:
            (own_a, asked_a), (own_b, asked_b) = ld.keys(a, most), ld.keys(b, most)
            assert set(own_a) & {*own_b, *asked_b} or set(own_b) & {*own_a, *asked_a}


def plain(texts, most, least):
    places = defaultdict(list)
    for d, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                places[line].append((d, i))
    lines, up = list(places), {x: x for x in places}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if abs(len(x) - len(y)) <= most and within(x, y, most):
                up[top(x)] = top(y)
    first = {}
    for x in lines:
        first[top(x)] = min(first.get(top(x), min(places[x])), min(places[x]))
    return {d: "\n".join(line for i, line in enumerate(t.split("\n"))
                         if len(line) < least or first[top(line)] == (d, i)) for d, t in texts.items()}


def texts_with_near_lines(seed):
    rnd = random.Random(seed)
    stock = ["".join(rnd.choices("abcd ", k=rnd.randint(5, 60))) for _ in range(25)]
    texts = {}
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            line = list(rnd.choice(stock))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                line[rnd.randrange(len(line))] = rnd.choice(string.ascii_letters)
            lines.append("".join(line))
        texts[d] = "\n".join(lines)
    return texts


@pytest.mark.parametrize("most, unit", [(1, None), (2, (2, 3))])
def test_as_plain(docs_of, monkeypatch, most, unit):
    if unit:
        monkeypatch.setattr(buckets, "PROBES", unit[0])
        monkeypatch.setattr(buckets, "MEMBERS", unit[1])
    texts = texts_with_near_lines(most)
    found = {r.doc_id: r.text for r in ld.line_dedup(docs_of(texts), most, 12).collect()}
    assert found == plain(texts, most, 12)


def test_odd_rows(spark, odd_docs, no_docs):
    found = ld.line_dedup(odd_docs).collect()
    assert len(found) == 9 and found[0].asDict().keys() >= {"node", "places", "n_lines", "n_dropped"}
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found if r.doc_id in (1, 2)} == {
        (1, None, 0, 0), (2, "", 1, 0)}
    assert sorted(r.n_dropped for r in found) == [0] * 9
    assert ld.line_dedup(no_docs).collect() == []


def test_stage_drops_documents_of_which_nothing_is_left(spark, docs_of):
    line = "this line is long enough to be looked at, and it comes more than once"
    texts = {1: line, 2: line, 3: f"{line}\nown words", 4: "", 5: line[:-1] + "x"}
    kept = ld.drop_repeated_lines(spark, docs_of(texts), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: line, 3: "own words", 4: ""}


def test_equal_lines_repeat_at_any_length(spark, tmp_path, docs_of):
    texts = {1: "Yes.\n\nname: x\n--\n", 2: "Yes.\n\nname: y\nYes.\n--", 3: "中\nno", 4: "no\n中"}
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.text, r.n_dropped) for r in ld.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: (texts[1], 0), 2: ("\nname: y\n--", 2), 3: (texts[3], 0), 4: ("", 2)}


GROWING = (8, 5)


def edited(rnd, line, n):
    line = list(line)
    for _ in range(n):
        i, what = rnd.randrange(len(line) + 1), rnd.randint(0, 2)
        line[i:i + (what > 0)] = rnd.choice("abc") if what < 2 else ""
    return "".join(line)


def test_lines_within_a_growing_bound_share_a_key_and_are_alike():
    rnd = random.Random(7)
    for _ in range(6000):
        a = "".join(rnd.choices("abc", k=rnd.randint(8, 90)))
        b = edited(rnd, a, ld.edits(len(a), GROWING))
        bound = ld.edits(min(len(a), len(b)), GROWING)
        if within(a, b, bound):
            (own_a, asked_a), (own_b, asked_b) = ld.keys(a, GROWING), ld.keys(b, GROWING)
            assert not bound or set(own_a) & {*own_b, *asked_b} or set(own_b) & {*own_a, *asked_a}
            counts = [ld._counts(ld.signatures([x])) for x in (a, b)]
            assert ld.alike(np.array([len(a)]), counts[0], np.array([len(b)]), counts[1], GROWING).all()


@pytest.mark.parametrize("unit", [None, (2, 3)])
def test_growing_bound_as_plain(docs_of, monkeypatch, unit):
    if unit:
        monkeypatch.setattr(buckets, "PROBES", unit[0])
        monkeypatch.setattr(buckets, "MEMBERS", unit[1])
    rnd = random.Random(3)
    stock = ["".join(rnd.choices("abcd ", k=rnd.randint(12, 90))) for _ in range(25)]
    texts = {d: "\n".join(edited(rnd, rnd.choice(stock), rnd.choice([0, 1, 2, 3, 4, 5]))
                          for _ in range(rnd.randint(1, 5))) for d in range(80)}
    found = {r.doc_id: r.text for r in ld.line_dedup(docs_of(texts), GROWING, 4).collect()}
    lines = sorted((d, i, x) for d, t in texts.items() for i, x in enumerate(t.split("\n")))
    group, linked = list(range(len(lines))), 0
    for i, (_, _, x) in enumerate(lines):
        for j, (_, _, y) in enumerate(lines[:i]):
            if x == y or within(x, y, ld.edits(min(len(x), len(y)), GROWING)):
                linked += not within(x, y, 1)
                group = [group[j] if g == group[i] else g for g in group]
    left = [at for i, at in enumerate(lines) if group.index(group[i]) == i]
    assert linked and found == {d: "\n".join(x for e, _, x in left if e == d) for d in texts}


def test_query_links_long_lines_with_a_word_replaced(spark, tmp_path, docs_of):
    line = " ".join(f"word{i} stands here" for i in range(15))
    docs_of({1: line, 2: line.replace("word7", "another"), 3: line[::-1]}).write.parquet(
        f"{tmp_path}/documents.parquet")
    found = ld.op10_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_dropped for r in found} == {1: 0, 2: 1, 3: 0}


def test_stage_drops_copies_with_short_and_blank_lines(spark, docs_of):
    text = "Title\n\nthis line is long enough to be looked at\n--\n\nYes.\n"
    texts = {1: text, 2: text, 3: f"{text}½ own", 4: "\n--\n", 5: "\n--\n", 6: "Title\n\n" + "=" * 40}
    kept = ld.drop_repeated_lines(spark, docs_of(texts), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {
        1: text, 3: "\n--\n\n½ own", 4: texts[4], 5: texts[5]}


def test_signatures_are_counts_of_each_line(monkeypatch):
    rnd = random.Random(5)
    lines = ["", "a", *("".join(rnd.choices("abc \U0001F600\ud800", k=rnd.randint(0, 600))) for _ in range(60))]
    whole = ld.signatures(lines)
    monkeypatch.setattr(ld, "CHARS", 500)
    assert ld.signatures(lines) == whole == [ld.signatures([x])[0] for x in lines]
    for line, found in zip(lines, whole):
        plain = [0] * 64
        for c in line:
            plain[ord(c) & 31] += 1
        assert list(found[:32]) == [n % 256 for n in plain[:32]]
        assert sum(found[32:]) % 256 == max(len(line) - 1, 0) % 256


@pytest.mark.parametrize("waiting", [1, 50, 1 << 14])
def test_ties_join_what_is_linked_with_fewer_links_than_components(waiting):
    rnd = random.Random(waiting)
    stock = ["".join(rnd.choices("abcd", k=60)) for _ in range(6)]
    lines = sorted({edited(rnd, rnd.choice(stock), rnd.randint(0, 2)) for _ in range(120)})
    ties, nodes, links = ld.Ties((16, 8)), np.arange(len(lines)), []
    for i in range(len(lines)):
        ties.lines.update(enumerate(lines))
        ties.add(i, i, nodes[nodes != i], nodes[nodes != i])
        if ties.n >= waiting:
            links += ties.links().to_pylist()
    if ties.n:
        links += ties.links().to_pylist()

    def groups(pairs):
        group = list(range(len(lines)))
        for a, b in pairs:
            group = [group[a] if g == group[b] else g for g in group]
        return [group.index(g) for g in group]

    plain = [(i, j) for i in range(len(lines)) for j in range(i)
             if within(lines[i], lines[j], ld.edits(min(len(lines[i]), len(lines[j])), (16, 8)))]
    assert groups([(r["a"], r["b"]) for r in links]) == groups(plain)
    assert len(links) == len(lines) - len(set(groups(plain)))


@pytest.mark.parametrize("chars, pairs", [(1, 1), (2000, 7), (1 << 21, 1 << 18)])
def test_units_are_looked_through_together(monkeypatch, chars, pairs):
    monkeypatch.setattr(ld, "UNIT_CHARS", chars)
    monkeypatch.setattr(ld, "PAIRS", pairs)
    rnd = random.Random(11)
    stock = ["".join(rnd.choices("abcd", k=60)) for _ in range(5)]
    lines = sorted({edited(rnd, rnd.choice(stock), rnd.randint(0, 2)) for _ in range(60)})
    units = [rnd.sample(range(len(lines)), rnd.randint(2, 9)) for _ in range(50)]
    tokens = [[t for t, unit in enumerate(units) if n in unit] for n in range(len(lines))]
    # the first node is the main component; all are members, the others ask
    rows = [{"token": t, "part": 0, "chunk": 0, "side": side, "node": n, "component": n, "main": unit[0],
             "line": lines[n], "tokens": tokens[n]}
            for t, unit in enumerate(units) for side in (0, 1) for n in unit[side:]]
    calls = []
    monkeypatch.setattr(ld, "signatures", lambda x, whole=ld.signatures: calls.append(1) or whole(x))
    ties, listed = ld.Ties((16, 8)), pa.Table.from_pylist(rows)
    for some in ld._several(listed.to_batches(max_chunksize=17)):
        ld._gather(some, ties)
    asked = [(int(p), int(q)) for _, a, b, _, _ in ties.waiting for p, q in zip(a, b)]
    met = {(min(p, q), max(p, q)) for unit in units for p in unit for q in unit if p != q}
    near = {(p, q) for p, q in met if within(lines[p], lines[q], ld.edits(min(len(lines[p]), len(lines[q])), (16, 8)))}
    found = {(min(x), max(x)) for x in asked}
    assert near <= found <= met and len(asked) == len(found)
    assert len(calls) == len(units) if chars == 1 else len(calls) < len(units)


def test_lines_are_read_again_once(spark, docs_of, monkeypatch):
    """Candidates and units share the lines; signatures come with them, not with all lines."""
    rnd, calls = random.Random(5), []
    texts = ["the same beginning of lines that differ " + "".join(rnd.choices("abcd", k=40)) for _ in range(20)]
    monkeypatch.setattr(ld, "_texts", lambda *a, whole=ld._texts: calls.append(1) or whole(*a))
    monkeypatch.setattr(ld, "_tied", lambda *a, whole=ld._tied: calls.append(2) or whole(*a))
    docs = docs_of(texts)
    assert "signature" not in ld.lines_of(docs, GROWING, 1).columns
    ld.line_groups(docs, Store(spark, "lines"), GROWING, 1)
    assert calls == [1, 2]
