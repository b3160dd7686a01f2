"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of up to 13 item words. It occurs in a document exactly if all its shingles
do, in place; so one shingle of a window, the necessary prefix, has to be looked for. Shingles of
documents that no window has are dropped where they are made; the others leave the scan with the words
around them and are counted over all documents. A window is looked up by its rarest one only, and
a window with a shingle that no document has is gone at once. What is found gives the place the
whole window would have; places that don't fit into the document fall out, and the rest is
verified word by word. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Store, columns, free, small, table

WINDOW, SHINGLE = 13, 5
#: A document is contaminated if it has a hit word and this many times the hits reach its words.
TIMES = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of ASCII digits and letters and all other characters; A-Z lower-cased. Null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _numbers(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(numbers: str, size: int) -> Column:
    """The numbers of all runs of ``size`` words, from those of the words; empty if there are fewer."""
    made = F.transform(F.sequence(F.lit(0), F.size(numbers) - size),
                       lambda i: F.xxhash64(*[F.get(numbers, i + j) for j in range(size)]))
    return F.when(F.size(numbers) >= size, made).otherwise(F.array().cast("array<long>"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, wid, words: the distinct windows of every item; items without words have none."""
    read = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    found = read.select("item_id", F.explode(F.transform(
        starts, lambda s: F.slice("words", s, window))).alias("words"))
    return found.select("item_id", F.xxhash64("words").alias("wid"), "words").distinct()


def _tokens(each: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """wid, words, token and its offset for all shingles of the windows (wid, words)."""
    numbered = each.withColumn("numbers", _numbers("words"))
    out = None
    for k in sizes:
        longer = F.size("words") >= k if k == shingle else F.size("words") == k
        of = numbered.filter(longer).select("wid", "words", F.posexplode(_shingles("numbers", k)).alias(
            "offset", "token"))
        out = of if out is None else out.unionByName(of)
    return out


def _found(docs: DataFrame, asked: DataFrame, sizes: list[int], window: int, marks: bool) -> DataFrame:
    """Shingles of the texts that are asked for, with the words a window around them could have.

    doc_id, text_key, n (words of the text), pos, token, near (words) and near_from, the place of
    the first of them. With ``marks`` every row of ``docs`` also gives one with the pos -1. Each text is
    split once, and nothing but what is found leaves the scan: the words are carried along
    by reference until a shingle has met the broadcast ones.
    """
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    read = read.select("*", F.size("words").alias("n"), _numbers("words").alias("numbers"))
    mark = F.array(F.lit(0).cast("long"))
    runs = read.select("doc_id", "text_key", "words", "n", F.concat(
        *[_shingles("numbers", k) for k in sizes], mark).alias("runs"))
    if marks:
        asked = asked.unionByName(asked.sparkSession.range(1).select(F.col("id").alias("token"))).distinct()
    # outer, as Spark would else filter by the size of the array first, and make it twice for that
    met = (runs.select("doc_id", "text_key", "words", "n", F.posexplode_outer("runs").alias("at", "token"))
           .join(F.broadcast(asked), "token", "left_semi"))
    # shingles of the sizes follow each other, the mark is behind them all
    pos, before = None, F.lit(0)
    for k in sizes:
        here = F.greatest(F.col("n") - k + 1, F.lit(0))
        pos = (F.when(F.col("at") < before + here, F.col("at") - before) if pos is None
               else pos.when(F.col("at") < before + here, F.col("at") - before))
        before = before + here
    pos = F.lit(-1) if pos is None else pos.otherwise(-1)
    back = window - min(sizes, default=window)
    found = met.select("doc_id", "text_key", "n", "words", pos.alias("pos"), "token").select(
        "*", F.greatest(F.col("pos") - back, F.lit(0)).alias("near_from"))
    near = F.when(F.col("pos") >= 0, F.slice("words", F.col("near_from") + 1, F.lit(back + window)))
    found = found.select("doc_id", "text_key", "n", "pos", "token", "near_from", near.alias("near"))
    return found if marks else found.filter("pos >= 0")


def matches(docs: DataFrame, items: DataFrame, store: Store, window: int = WINDOW,
            shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, places): doc_id, text_key and n of all rows of ``docs``; and for texts with verified
    occurrences of windows these and places (start, length, wid).

    All shingles of the windows are broadcast, in blocks if they are too many, each with a scan of its
    own.
    """
    windows = store.keep(windows_of(items, window))
    each = windows.select("wid", "words").distinct()
    sizes = [r.k for r in each.select(F.least(F.size("words"), F.lit(shingle)).alias("k"))
             .distinct().sort("k").collect()]  # at most ``shingle`` numbers
    spark = docs.sparkSession
    tokens = store.keep(_tokens(each, sizes, shingle)) if sizes else spark.createDataFrame(
        [], "wid long, words array<string>, offset int, token long")
    asked = store.keep(tokens.select("token").distinct())
    blocks = max(1, -(-asked.count() // max(1, common.BROADCAST_CELLS)))
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod("token", F.lit(blocks)) == block)
        part = _found(docs, own, sizes, window, block == 0)
        found = part if found is None else found.unionByName(part)
    found = store.keep(found)
    rows, met = found.filter("pos = -1").select("doc_id", "text_key", "n"), found.filter("pos >= 0")
    rarity = met.groupBy("token").agg(F.count("*").alias("n_found"))
    rarest = tokens.join(rarity, "token").groupBy("wid", "words").agg(
        F.min(F.struct("n_found", "token", "offset")).alias("top"), F.count("*").alias("n_tokens"))
    # a window with a shingle that no text has is gone
    needed = tokens.groupBy("wid", "words").agg(F.count("*").alias("n_tokens"))
    rarest = store.keep(rarest.join(needed, ["wid", "words", "n_tokens"], "left_semi").select(
        "wid", "words", F.size("words").alias("length"), F.col("top.token").alias("token"),
        F.col("top.offset").alias("offset")))
    start = F.col("pos") - F.col("offset")
    places = (met.join(small(rarest, F.size("words")), "token").withColumn("start", start)
              .filter("start >= 0 AND start + length <= n")
              .filter(F.slice("near", F.col("start") - F.col("near_from") + 1, F.col("length")) == F.col("words")))
    return rows, store.keep(places.groupBy("doc_id", "text_key").agg(
        F.max("n").alias("n"), F.collect_set(F.struct("start", "length", "wid")).alias("places")))


def hits(docs: DataFrame, items: DataFrame, store: Store, window: int = WINDOW,
         shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): doc_id, text_key and n (words) of all rows; and of texts with occurrences also
    n_hit and the sorted item_ids as strings."""
    rows, found = matches(docs, items, store, window, shingle)
    covered = F.aggregate(
        F.array_sort("places"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + F.greatest(F.lit(0), p["start"] + p["length"]
                                 - F.greatest(a["end"], p["start"]))).alias("n"),
            F.greatest(a["end"], p["start"] + p["length"]).alias("end")),
        lambda a: a["n"])
    of_items = windows_of(items, window).select("wid", F.col("item_id").cast("string").alias("item"))
    named = (found.select("doc_id", "text_key", F.explode(F.array_distinct("places.wid")).alias("wid"))
             .join(small(store.keep(of_items.distinct())), "wid")
             .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    both = found.alias("f").join(named.alias("m"), (F.col("f.text_key") == F.col("m.text_key"))
                                 & F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")))
    return rows, store.keep(both.select("f.doc_id", "f.text_key", "f.n", covered.alias("n_hit"), "items"))


def decontamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings) and contaminated, row by row.

    Null texts have no words and no hits. An item that is null or has no words is never found;
    a null item_id counts as hit but is not listed. Items that repeat are one item if their ids
    are equal. Rows that repeat are answered alike; null doc_ids are answered by their texts.
    Empty tables give no rows or no hits. Other columns are not read.
    """
    store = Store(docs.sparkSession, "decontamination")
    rows, found = hits(docs, items, store, window, shingle)
    found = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n_hit", "items")
    n_words, n_hit = F.col("n").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.join(small(found, F.size("items")), (F.col("text_key") == F.col("key"))
                      & F.col("doc_id").eqNullSafe(F.col("id")), "left")
            .select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
                    ((n_hit > 0) & (TIMES * n_hit >= n_words)).alias("contaminated")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that are not contaminated by the benchmark of ``sf_dir``.

    Null and empty texts, and all rows if the benchmark has no words, stay; rows that repeat stay or go
    together, and those with a null doc_id are judged by their texts. All columns are returned.
    """
    store = Store(spark, "contaminated")
    id_, key_ = free("id", docs), free("key", docs)
    _, found = hits(docs, table(spark, sf_dir, "benchmark"), store)
    gone = store.keep(found.filter(TIMES * F.col("n_hit") >= F.col("n")).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key_)))
    same = (F.xxhash64(docs["text"]) == F.col(key_)) & docs["doc_id"].eqNullSafe(F.col(id_))
    return docs.join(small(gone), same, "left_anti").select(*columns(docs))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[s:s + least(len(w), 13) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
s AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d CROSS JOIN (SELECT DISTINCT n FROM v))),
m AS (SELECT doc_id, item_id, i, s.n FROM s JOIN v ON s.win = v.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
      (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
