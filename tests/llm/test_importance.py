import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from statetrail.llm.common import Store
from statetrail.llm.importance import buckets_of, importance_sample
from statetrail.llm.queries import QUERIES
from statetrail.llm.radix import radix_places

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most, buckets):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs, items, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    """docs: (doc_id, text); ids are there."""
    read = [(i, *features(t, most, buckets)) for i, t in docs]
    s = Counter(b for _, _, f in read for b in f)
    t = Counter(b for text in items for b in features(text, most, buckets)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, n, f in read:
        total = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, weight + noise, None, n])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(order[:percent * len(order) // 100], 1):
        r[4] = rank
    return sorted(((*r[:5],) for r in rows), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_the_query_equals_a_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_importance_resampling"](spark, sf_dir)) == plain(docs, items)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_runs_of_words_and_odd_texts(spark, docs_of, most):
    texts = ["A b a B c", "", None, "x" * 100 + " é中 " + "y" * 70 + " a", "\x00 a\x7Fb-9 Z", "one", "a b " * 20_000]
    texts += [f"w{i} common w{i % 7} Words again and again" for i in range(60)]
    items = spark.createDataFrame([(1, "common words w3 again"), (2, None), (3, "a b")], "item_id long, text string")
    found = importance_sample(docs_of(texts), items, percent=37, least_words=3, most=most, buckets=97, seed=5)
    assert rows_of(found) == plain(list(enumerate(texts)), ["common words w3 again", None, "a b"], most, 97, 37, 3, 5)


def test_nulls_repeated_rows_clashing_names_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = odd_docs.withColumnsRenamed({"node": "score", "places": "rank"})
    rows = importance_sample(docs, items, percent=100, least_words=1).collect()
    assert len(rows) == docs.count()
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(r.n_features > 0 for r in rows)
    assert sum(r.doc_id is None for r in rows) == 1
    assert importance_sample(no_docs, items).collect() == []


def test_words_are_hashed_as_zlib_does():
    texts = ["", "abc ééé " + "q" * 5_000 + " z", None, "0 " * 10, "word" * 16 + " " + "word" * 16 + "s"]
    found = [[] for _ in texts]
    for size in (1, 2):
        row = 0
        for k, numbers, first, last in buckets_of(pa.array(texts), 2, 1 << 32):
            if k == size:
                for a, b in zip(first, last):
                    found[row] += numbers[a:b].tolist()
                    row += 1
    for text, own in zip(texts, found):
        assert own == features(text, 2, 1 << 32)[1]


@pytest.mark.parametrize("bits, block", [(11, 1 << 20), (3, 50)])
def test_radix_places(spark, bits, block):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(
        rng.integers(-3, 3, 400), rng.choice([-2**63, 2**63 - 1, 0, 1, 5, 5, 5, 10**12], 400)))]
    found = radix_places(spark.createDataFrame(rows, "a long, b long, i long").repartition(7), ["a", "b"],
                         Store(spark, "radix"), bits, block).collect()
    assert [r.place for r in sorted(found, key=lambda r: r.place)] == list(range(400))
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.place)] == sorted((a, b) for a, b, _ in rows)
    assert sorted(r.i for r in found) == list(range(400))


def test_radix_places_of_equal_keys_and_of_nothing(spark):
    rows = spark.range(100).selectExpr("id", "7L AS a")
    assert sorted(r.place for r in radix_places(rows, ["a"], Store(spark, "radix")).collect()) == list(range(100))
    assert radix_places(rows.limit(0), ["a"], Store(spark, "radix")).collect() == []
