import zlib

import pytest
from pyspark.sql import functions as F
from statetrail.llm import toxicity as t
from statetrail.llm.toxicity_grammar import KINDS, Reader

FOLDER = "/root/testdata/sf0.01"


def kinds(text):
    counts, _ = Reader({"zork", "blorg*"}).counts(text)
    return {k: n for k, n in zip(KINDS, counts) if n}


@pytest.mark.parametrize("text, expected", [
    ("a nice day", {}), ("what an idiot", {"insult": 1}), ("You are an IDIOT.", {"insult_target": 1}),
    ("he is not an idiot", {"insult_negated": 1}), ("not that it matters but he is an idiot", {"insult_target": 1}),
    ('she said "idiot"', {"insult_reported": 1}), ("he called me idiot, you idiot", {
        "insult_reported": 1, "insult_target": 1}),
    ("kill them", {"threat_target": 1}), ("never kill", {"threat_negated": 1}), ("zork", {"insult": 1}),
    ("blorgish", {"insult": 1}), ("idiot. idiot; idiot", {"insult": 3}), ("", {})])
def test_clauses(text, expected):
    assert kinds(text) == expected


def test_held_out_rows_are_scored_well(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    found = t.op3_toxicity(spark, FOLDER).join(labels, "doc_id").filter("toxic is not null").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)


def test_labels_of_held_out_rows_are_never_read(spark, docs_of):
    rows = [(i, 1 if i % 2 else 0) for i in range(400)]
    texts = {i: "plain words" + (" zzgrr" if toxic else "") for i, toxic in rows}
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    one, two = ({r.doc_id: (r.score, r.predicted) for r in t.toxicity(docs_of(texts), x).collect()}
                for x in (labels, turned))
    assert one == two and all(p == texts[i].endswith("zzgrr") for i, (_, p) in one.items())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 7), (4, 1), (4, 1), (6, 0)], "doc_id long, toxic int")
    found = t.toxicity(odd_docs, labels).collect()
    assert len(found) == 9 and all(0 <= r.score <= 1 for r in found)
    assert t.toxicity(no_docs, labels).collect() == []
    none = t.toxicity(odd_docs, labels.filter("doc_id > 99")).collect()
    assert len(none) == 9 and not any(r.predicted for r in none)


def test_stage_keeps_the_others_as_they_are(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = odd_docs.limit(0).sparkSession.createDataFrame([(50, "you idiot, you moron", 1, "p")], odd_docs.schema)
    kept = t.drop_toxic(spark, odd_docs.unionByName(extra), str(tmp_path))
    assert kept.schema == odd_docs.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, odd_docs.collect()))
