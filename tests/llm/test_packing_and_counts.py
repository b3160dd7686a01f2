import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from statetrail.llm import packing, token_counts
from statetrail.llm.vocabulary import default_path, load_tokens


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        t: i for i, t in enumerate(load_tokens(default_path()))})


def plain_best_fit(lengths, row):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else row) - size)
    return Counter(rooms)


def test_best_fit_as_plain():
    rnd = random.Random(1)
    for _ in range(200):
        row = rnd.choice([1, 5, 16, 33, 100])
        lengths = [rnd.randint(1, row) for _ in range(rnd.randint(0, 60))]
        rows = packing.best_fit(lengths, row)
        assert sorted(p for members in rows for p in members) == list(range(len(lengths)))
        assert Counter(row - sum(lengths[p] for p in m) for m in rows) == plain_best_fit(lengths, row)


def test_rows_give_the_documents_back(spark, docs_of, coder):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choices(["alpha", "beta", "é", "\n"], k=rnd.randint(0, 400))) for i in range(60)}
    rows = packing.packed(docs_of(texts), row=64).collect()
    matrix = packing.id_matrix(rows, 64)
    parts = defaultdict(list)
    for r, line in zip(rows, matrix):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not line[r.n_tokens:].any()
        reset = packing.positions(r.cu_seqlens)
        assert [i for i, p in enumerate(reset) if p == 0] == r.cu_seqlens[:-1]
        for doc, offset, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[doc].append((offset, line[a:b].tolist()))
    back = {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()}
    assert back == {d: ids for d, t in texts.items() if (ids := coder.encode_ordinary(t))}
    assert len({(r.block, r.row) for r in rows}) == len(rows)


def test_sections_add_up_and_crossings_go_to_the_larger_part(coder):
    lengths = np.array([len(t) for t in load_tokens(default_path())])
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choices(["word", " ", "\n", "\n\n", "é", ".", "  "], k=rnd.randint(0, 30)))
        ends, counts, crossing = token_counts.section_counts(text, coder, lengths)
        borders = [0, *np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *ends[:-1]], ends)]).tolist()]
        want, cross, at = [0] * len(ends), [0] * len(ends), 0
        for token in coder.encode_ordinary(text):
            a, at = at, at + lengths[token]
            share = [max(0, min(at, hi) - max(a, lo)) for lo, hi in zip(borders, borders[1:])]
            best = share.index(max(share))
            want[best] += 1
            cross[best] += sum(s > 0 for s in share) > 1
        assert (counts.tolist(), crossing.tolist()) == (want, cross)


def test_allocation_rule():
    owner, crossing = token_counts.allocate(np.array([3, 7, 9, 12]), np.array([5, 6, 8, 12]))
    assert owner.tolist() == [0, 0, 2, 3] and crossing.tolist() == [False, True, True, False]


def test_odd_rows(odd_docs, no_docs, coder):
    found = token_counts.token_counts(odd_docs).collect()
    total = Counter()
    for r in found:
        total[r.doc_id] += r.n_tokens
    texts = defaultdict(int)
    for r in odd_docs.collect():
        texts[r.doc_id] += len(coder.encode_ordinary(r.text or ""))
    assert total == texts and (1, 0, 0, 0, 0, 0) in [tuple(r) for r in found]
    rows = packing.packed(odd_docs).collect()
    assert sum(r.n_tokens for r in rows) == sum(texts.values())
    assert token_counts.token_counts(no_docs).collect() == packing.packed(no_docs).collect() == []
