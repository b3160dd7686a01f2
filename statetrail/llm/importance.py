"""Importance resampling: draw the documents that look most like a target, with Gumbel noise.

Both corpora are counted in a fixed number of buckets of hashed words. The log ratio of a bucket is
its gain; a document's weight is the mean gain of its words. Adding Gumbel noise, taken from a
hash of the id, and drawing the highest scores samples without replacement by weight. Ranks come
from the radix sort of (score, id).
"""

from __future__ import annotations

import zlib
from functools import cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, table
from .radix import radix_places
from .words import LOWER, blocks, separators, word_spans

BUCKETS, MOST_WORDS = 10_000, 1
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
#: Longer words are hashed on their own.
_LONG = 64
#: All ASCII but digits and letters; capitals are lower-cased first.
_BETWEEN = separators("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


@cache
def _crc_table() -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, (table_ >> 1) ^ np.uint32(0xEDB88320), table_ >> 1)
    return table_


def _advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of every word, for all words a byte at a time."""
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, _LONG + 1).astype(np.uint8), kind="stable")[::-1]
    register, first, rest = state[order], starts[order], np.minimum(lengths[order], _LONG + 1)
    n_long = int(np.searchsorted(-rest, -_LONG))
    going, bytes_of = len(rest), _crc_table()
    for j in range(min(_LONG, int(rest[0]) if len(rest) else 0)):
        going = int(np.searchsorted(-rest, -j))
        now = register[n_long:going]
        register[n_long:going] = bytes_of[(now ^ data[first[n_long:going] + j]) & 0xFF] ^ (now >> 8)
    out = np.empty_like(register)
    out[order] = register
    for i in order[:n_long]:
        out[i] = ~np.uint32(zlib.crc32(data[starts[i]:ends[i]], int(~state[i])))
    return out


def buckets_of(texts: pa.Array, most: int = MOST_WORDS, buckets: int = BUCKETS):
    """For each block of rows: the buckets of all features, and each row's bounds among them."""
    space = np.array([ord(" ")], np.uint8)
    for _, data, bounds in blocks(texts):
        data = LOWER[data]
        starts, ends = word_spans(data, bounds, _BETWEEN)
        ranges = np.searchsorted(starts, bounds)
        state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        zero = np.zeros(len(starts), np.int64)
        for size in range(1, most + 1):
            n = max(0, len(starts) - size + 1)
            if size > 1:
                state = _advanced(state[:n], space, zero[:n], zero[:n] + 1)
            state = _advanced(state[:n], data, starts[size - 1:], ends[size - 1:])
            valid = np.zeros(n + 1, np.int64)
            last = np.maximum(ranges[1:] - size + 1, ranges[:-1])  # first start that has too few words
            np.add.at(valid, np.minimum(ranges[:-1], n), 1)
            np.add.at(valid, np.minimum(last, n), -1)
            whole = np.cumsum(valid)[:n] > 0
            numbers = (~state[whole]).astype(np.int64) % buckets
            places = np.concatenate([[0], np.cumsum(whole)])
            yield size, numbers, places[np.minimum(ranges[:-1], n)], places[np.minimum(last, n)]


def bucket_counts(docs: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket, a fixed number of sums."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, numbers, _, _ in buckets_of(batch.column("text"), most, buckets):
                total += np.bincount(numbers, minlength=buckets)
        kept = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(kept, pa.int64()), "n": pa.array(total[kept], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source frequency per bucket, one added to each count."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log(float((b + 1) * (s + n)) / float((a + 1) * (t + n))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS,
                      buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row, all long."""
    of_bucket = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))

    def score(batches):
        for batch in batches:
            counts, sums, words = ([] for _ in range(3))
            for size, numbers, first, last in buckets_of(batch.column("text"), most, buckets):
                running = np.concatenate([[0], np.cumsum(of_bucket[numbers])])
                if size == 1:
                    counts.append(last - first)
                    sums.append(running[last] - running[first])
                    words.append(last - first)
                else:
                    counts[-1] = counts[-1] + last - first
                    sums[-1] = sums[-1] + running[last] - running[first]
            if not counts:
                continue
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(np.concatenate(words), pa.int64()),
                "n_features": pa.array(n, pa.int64()),
                "weight": pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64())})

    scored = docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT,
                      least_words: int = LEAST_WORDS, most: int = MOST_WORDS,
                      buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1 is best; null if not drawn) of every row.

    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn (rounded down): those
    of the highest scores, of equal scores those of smaller ids; null ids come last. Null and empty texts have no
    features and weight 0. Rows that repeat are ranked one by one. An empty target makes frequent
    words cost weight, empty ``docs`` give no rows. Other columns are not read.
    """
    store = Store(docs.sparkSession, "importance")
    scored = store.keep(importance_scores(docs, target, most, buckets, seed))
    long_enough = F.col("n_words") >= least_words
    named = scored.filter(long_enough).select(
        "doc_id", "n_features", "weight", "score", F.bitwise_not("score").alias("falling"),
        F.col("doc_id").isNull().cast("long").alias("unnamed"),
        F.coalesce("doc_id", F.lit(0)).alias("number"))
    placed = radix_places(named, ["falling", "unnamed", "number"], store)
    drawn = percent * placed.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    result = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*result, rank.alias("rank")).unionByName(
        scored.filter(~long_enough).select(*result, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH c AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
    i) ORDER BY i) AS crc FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
d AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (
  SELECT side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM d),
o AS (SELECT side, doc_id, unnest(words) AS word FROM w),
h AS (
  SELECT word, xor(list_reduce(list_transform(range(0, CAST(length(hx) / 2 AS BIGINT)),
      lambda i: CAST(16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1)
        + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1 AS BIGINT)),
    lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
  FROM (SELECT word, hex(word) AS hx FROM (SELECT DISTINCT word FROM o)), c),
n AS (
  SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM o JOIN h USING (word) GROUP BY b),
g AS (
  SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (SELECT sum(s) + 10000 FROM n)
    / (CAST(s + 1 AS DOUBLE) * (SELECT sum(t) + 10000 FROM n)))) AS BIGINT) AS gain FROM n),
f AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM o JOIN h USING (word) JOIN g USING (b) WHERE side = 0 GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT)
      + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id),
k AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM k"""
