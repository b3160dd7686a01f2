"""A training corpus from raw documents; every stage is one operator of ``statetrail.llm``."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from statetrail.llm.byte_pairs import encode_and_decode
from statetrail.llm.common import Store, table
from statetrail.llm.decontamination import drop_contaminated
from statetrail.llm.line_dedup import drop_repeated_lines
from statetrail.llm.ngram_jaccard import keep_first_of_component
from statetrail.llm.toxicity import drop_toxic

#: Bytes of rows after which a batch goes to a Python worker; each of its columns may take twice that outside the
#: JVM's heap. The setting is the session's and stays, since the caller evaluates what a stage returns.
BATCH_BYTES = 4 << 20


def in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


#: (name, function): each takes (spark, docs, sf_dir); what it returns is the next one's docs.
STAGES = [(name, in_small_batches(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_first_of_component),
    ("decontamination", drop_contaminated),
    ("byte_pairs", encode_and_decode),
)]

#: Sets of shingles, edit distances and byte pairs are beyond SQL. The tests compare operators with
#: plain versions, but not yet the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Store(spark, "pipeline")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
