import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from statetrail.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_pairs"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()} and len(found) > 0.5 * docs.count()
    assert all(len(r.ids) == r.n_tokens for r in found) and len({r.doc_id for r in found}) == len(found)


def test_stages_but_the_last_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_workers_get_small_batches(spark):
    def sizes(batches):
        yield from (pa.record_batch({"bytes": pa.array([b.nbytes])}) for b in batches)

    texts = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 100_000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0), FOLDER)
        found = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
        assert sum(found) > 24_000_000 and max(found) < corpus_pipeline.BATCH_BYTES + 1_000_000
    spark.conf.unset(name)


def test_a_task_of_byte_pairs_needs_one_worker(spark, capsys):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = dict(corpus_pipeline.STAGES)["byte_pairs"](spark, docs, FOLDER)
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "a b"), (2, "")]


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
