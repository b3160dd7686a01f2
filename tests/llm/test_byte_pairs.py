import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from statetrail.llm import byte_pairs as bp
from statetrail.llm.vocabulary import Pieces, default_path, default_pattern, load_tokens


def coder(tokens):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens)})


def ids(texts, tokens):
    found = bp.id_bytes(texts, Pieces(default_pattern()), bp.MergeReplay(tokens), {})
    return [np.frombuffer(x, "<i4").tolist() for x in found]


@pytest.fixture(scope="module")
def tokens():
    return load_tokens(default_path())


def test_odd_characters_as_tiktoken(tokens):
    rnd = random.Random(1)
    chars = "ab \n\t's1²½Ⅷéß中文字\x1c\x85   😀'll ́ǅ٣_-"
    texts = ["".join(rnd.choices(chars, k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 500, " " * 100, "<|endoftext|>"]
    assert ids(texts, tokens) == [coder(tokens).encode_ordinary(t) for t in texts]


def test_merges_that_make_lower_ranks_possible():
    rnd = random.Random(2)
    made = {"".join(rnd.choices("abc", k=rnd.randint(2, 6))).encode() for _ in range(400)}
    tokens = [bytes([b]) for b in range(256)] + rnd.sample(sorted(made), len(made))
    texts = ["".join(rnd.choices("abc", k=rnd.randint(1, 60))) for _ in range(2000)]
    assert ids(texts, tokens) == [coder(tokens).encode_ordinary(t) for t in texts]


def test_query_on_a_table(spark, tokens):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    own, sha = coder(tokens), lambda x: hashlib.sha256(x).hexdigest()
    for r in bp.op1_byte_pairs(spark, folder).collect():
        want = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want), sha(",".join(map(str, want)).encode()), sha(texts[r.doc_id].encode()))


def test_odd_rows(odd_docs, no_docs, tokens):
    found = sorted(bp.decode(bp.encode(odd_docs)).collect(), key=repr)
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in found if r.doc_id) == sorted(
        (r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id)
    assert [len(r.ids) for r in found if r.doc_id in (1, 2)] == [0, 0]
    assert bp.decode(bp.encode(no_docs)).collect() == []


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bp.decode(rows).collect()] == [b"", b""]


def test_merges_of_a_pair_are_looked_up_once(tokens):
    """What two tokens merge to is looked up in tables of the token behind or before."""
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    replay = bp.MergeReplay(tokens)
    replay.ranks = Counted(replay.ranks)
    pieces = [f"qzx{i}wvk{i}".encode() for i in range(200)]
    first, asked = replay.encode(pieces), Counted.asked
    Counted.asked = 0
    assert replay.encode(pieces) == first
    assert Counted.asked == len(pieces) < asked
    assert replay.n_known == sum(len(x) for side in (replay.behind, replay.ahead) for x in side if x)
    replay.n_known = 1 << 21
    assert replay.encode(pieces) == first and replay.n_known < 1 << 20


def test_workers_of_the_stages_give_memory_back(spark, docs_of, monkeypatch):
    from statetrail.llm import ngram_jaccard

    docs, runs = docs_of({1: "a b c"}), []
    kind, plain = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, *a: runs.append(run) or plain(df, run, *a))
    bp.decode(bp.encode(docs))
    nodes = ngram_jaccard.document_nodes(docs, None, 5, 75)
    ngram_jaccard.node_sets(docs, nodes.select("doc_id", "text_key", "node"), 5)
    assert len(runs) == 4 and all(hasattr(run, "__wrapped__") for run in runs)
