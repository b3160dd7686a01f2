"""Toxicity: a weighted grammar of clauses, its words and weights learned from labelled rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, freed, parts, small, table
from .toxicity_grammar import KINDS, TOKEN, Reader

#: Most labelled rows that are learned from; which ones is decided by a hash of the doc_id.
LABELLED = 20_000
#: Most learned words and beginnings.
LEARNED = 5_000
#: A word is learned as an insult if at least so many toxic samples have it, and of the others
#: at most this part as many.
LEAST, OTHERS = 5, 0.2
STEMS = (4, 5, 6)
#: Weights without any labels: bias, kinds, share of words.
_UNTAUGHT = [-2.0, 3, 4, 0.5, 0.5, 2, 4, 0, 0, 0]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _forms(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if w[0].isalpha()}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def learned_words(sample: DataFrame) -> set[str]:
    """Words and beginnings of words that mark toxic samples (text, toxic)."""
    def count(batches):
        with_, without = Counter(), Counter()
        for batch in parts(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (with_ if toxic else without).update(_forms(text or ""))
        forms = [w for w in with_.keys() | without.keys()]
        yield pa.record_batch({"form": pa.array(forms, pa.string()),
                               "t": pa.array([with_[w] for w in forms], pa.int64()),
                               "o": pa.array([without[w] for w in forms], pa.int64())})

    counts = sample.select("text", "toxic").mapInArrow(count, "form string, t long, o long")
    marked = (counts.groupBy("form").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
              .filter((F.col("t") >= LEAST) & (F.col("o") <= OTHERS * F.col("t")))
              .orderBy(F.desc("t"), "o", "form").limit(LEARNED))
    return {r.form for r in marked.collect()}


def _features(counts: list[int], words: int) -> list[float]:
    return [1.0, *np.log1p(counts), 100 * sum(counts) / (words + 20)]


def fitted(rows: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method, held to the fixed weights by a small ridge."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return _UNTAUGHT
    weights = fixed = np.array(_UNTAUGHT, float)
    ridge = np.eye(rows.shape[1]) * 0.1
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (toxic - p) - ridge @ (weights - fixed)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge
        step = np.linalg.solve(curve, gradient)
        weights = weights + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return weights.tolist()


def train(docs: DataFrame, labels: DataFrame, store: Store) -> tuple[set[str], list[float]]:
    """Learned words and weights, from at most LABELLED rows that are not held out."""
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).distinct()
              .orderBy(F.xxhash64("doc_id"), "toxic").limit(LABELLED))
    sample = store.keep(docs.select("doc_id", "text").join(small(store.keep(chosen)), "doc_id"))
    words = learned_words(sample)

    def read(batches):
        reader = Reader(words)
        for batch in parts(batches):
            out = [_features(*reader.counts(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"x": pa.array(out, pa.list_(pa.float64())),
                                   "toxic": batch.column("toxic")})

    rows = sample.select("text", "toxic").mapInArrow(freed(read), "x array<double>, toxic int").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(KINDS) + 2)
    return words, fitted(x, np.array(rows["toxic"].to_pylist(), float))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every row of ``docs``.

    The score depends on the text alone; null counts as empty, which has no toxic clause. Labels
    that are null or neither 0 nor 1 are not learned from; without usable labels fixed weights
    and words are used. Repeated rows and null doc_ids are scored like others; the labels of a
    doc_id that is null are not used. Empty tables give no rows. Other columns are not read.
    """
    words, weights = train(docs, labels, Store(docs.sparkSession, "toxicity"))

    def score(batches):
        reader, w = Reader(words), np.array(weights)
        for batch in parts(batches):
            x = [_features(*reader.counts(t or "")) for t in batch.column("text").to_pylist()]
            x = np.array(x, float).reshape(-1, len(w))
            yield pa.record_batch({"doc_id": batch.column("doc_id"),
                                   "score": 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))})

    scored = docs.select("doc_id", "text").mapInArrow(freed(score), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that are not predicted to be toxic."""
    words, weights = train(docs, table(spark, sf_dir, "labels"), Store(spark, "toxicity"))

    def keep(batches):
        reader, w = Reader(words), np.array(weights)
        for batch in parts(batches):
            x = [_features(*reader.counts(t or "")) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(np.array(x, float).reshape(-1, len(w)) @ w < 0))

    return docs.mapInArrow(freed(keep), docs.schema)
