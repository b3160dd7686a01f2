import numpy as np
import pytest

from statetrail.llm.language_id import _counts, _points, clustered, language_id
from statetrail.llm.queries import QUERIES

WORDS = {"aa": ["talo", "kala", "vesi", "suomi", "maa"], "bb": ["house", "fish", "water", "land", "stone"]}


def corpus(spark, n=60, extra=()):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 30)), lang) for i, lang in
            enumerate(["aa", "bb"] * (n // 2))]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op13_language_id"](spark, sf_dir).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.05


def test_odd_texts(spark):
    odd = [(100, None, "aa"), (101, "", "aa"), (102, "123 !? \n", "bb"), (None, "talo vesi", "bb"),
           (103, "water and stone", None), (104, "中文字符", None), (105, "x", None),
           (106, "fish water " * 100_000, None), (107, "kala", "aa"), (107, "kala", "aa"), (108, "kala퟿\U0001F600", None)]
    rows = language_id(corpus(spark, extra=odd).withColumn("score", clash())).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert [found[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(found[i][0].score == 0 and found[i][0].rejected for i in (100, 101, 102))
    assert found[None][0].lang_pred == "aa" and found[None][0].held_out is False
    assert found[103][0].lang_pred == found[106][0].lang_pred == "bb"
    assert found[104][0].lang_pred in WORDS and found[104][0].rejected
    assert [r.lang_pred for r in found[107]] == ["aa", "aa"] and found[108][0].lang_pred == "aa"
    assert len(rows) == 60 + len(odd)


def clash():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = corpus(spark)
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 'zz' ELSE lang END lang")
    first, second = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id(d).collect()} for d in (docs, wrong))
    assert first == second


def test_nothing_to_learn_from(spark):
    docs = corpus(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in language_id(docs).collect()} == {("und", 0.0)}
    assert language_id(docs.limit(0)).collect() == []


def test_many_rows_of_one_id_are_learned_once(spark):
    docs = corpus(spark, extra=[(7, "talo kala vesi", "aa")] * 3_000)
    rows = language_id(docs, per_language=20).collect()
    assert len(rows) == 3_060 and {r.lang_pred for r in rows if r.doc_id == 7} <= {"aa", "bb"}


@pytest.mark.parametrize("text", ["", "ab", "Ab c", "déjà vu 12x", "a" * 700_000])
def test_counts_are_those_of_all_grams(text):
    points = _points(text)
    assert _counts(text).sum() == sum(max(0, len(points) - n + 1) for n in (1, 2, 3))
    assert bytes(points[:1]) in (b"", np.uint32(32).tobytes())


def test_clusters_separate_what_is_apart():
    rng = np.random.default_rng(4)
    rows = np.concatenate([np.eye(8)[c] + rng.normal(size=(30, 8)) * 0.05 for c in (0, 3, 5)]).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centroids, radius = clustered(rows, 3)
    assert sorted(np.argmax(centroids, axis=1)) == [0, 3, 5] and min(radius) > 0.8
    assert len(clustered(rows[:2], 3)[0]) == 2
