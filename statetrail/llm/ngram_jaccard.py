"""N-gram Jaccard join: count vectors in R-trees, exact verification, links to components.

Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct word
shingles. Equal sets are one *node*. How all links between different sets are found:

1. Tokens (shingle numbers) are hashed into groups and the groups counted over all documents. A
   token's class is the magnitude of its group's count; the order (class, token) puts tokens
   that very many documents share last.
2. Linked sets share a token among the first n - ceil(percent * n / 100) + 1 of either. These
   meet in *buckets*, one for each token. Buckets are reduced to least and greatest node and a
   sum over the nodes before the shuffle; only those that hold two different nodes go on, and of
   buckets with equal members (the tokens of a passage) one.
3. Each node is a point: the counts of its tokens in groups. The overlap of two sets is at most
   the sum of coordinate minima, of a set and a box at most that of the point and the box's
   upper corner.
4. A bucket's members are compared with one of them, its pivot (a node with many shared
   tokens), so that a large group of near copies is tied together by as many pairs as members.
5. What is left are pairs of different components in one bucket, neither being its pivot. Buckets
   are cut into work units of bounded size (members in chunks against chunks of those outside the
   bucket's largest component); in a unit an R-tree over the members is searched with the
   others' points. Only pairs that pass the bound and the size test leave the unit.
6. All surviving pairs are verified on the full sets; links become connected components.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import meet, search, units
from .common import Store, columns, freed, parts, small, table
from .components import connected_components
from .count_tree import GROUPS, box_join, overlap_bound, point
from .words import shingle_sets

SIZE, PERCENT = 5, 75
#: Groups that tokens are counted in to order them, and how many of them go in one block.
CELLS, BLOCK = 1 << 23, 1 << 16


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def group_counts(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """How many (document, token) pairs fall into each group, over all documents.

    Every task sends its counts in packed blocks, which are added up block by block; the whole is
    CELLS numbers, whatever the size of the corpus.
    """
    def count(batches):
        total = np.zeros(CELLS, "<i4")
        for batch in batches:
            for found in shingle_sets(batch.column(0), size):
                np.add.at(total, _cell(found), 1)
        filled = [(at // BLOCK, total[at:at + BLOCK]) for at in range(0, CELLS, BLOCK)]
        filled = [(block, zlib.compress(x.tobytes(), 1)) for block, x in filled if x.any()]
        yield pa.record_batch({"block": pa.array([b for b, _ in filled], pa.int32()),
                               "counts": pa.array([x for _, x in filled], pa.binary())})

    def add(batches):
        total = {}
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(x), "<i4")
                total[block] = total[block] + part if block in total else part.astype("<i8")
        yield pa.record_batch({
            "block": pa.array(list(total), pa.int32()),
            "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())})

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(freed(count), schema).repartition("block").mapInArrow(
        freed(add), schema)
    out = np.zeros(CELLS, np.int64)
    for block, x in rows.collect():
        out[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(x)), "<i8")
    return out


def token_classes(counts: np.ndarray) -> np.ndarray:
    """0 for the groups that chance explains; above, the magnitude of what is in excess."""
    mean = max(1.0, counts.sum() / len(counts))
    out = np.empty(len(counts), np.uint8)
    for at in range(0, len(counts), BLOCK):  # the driver has room for few arrays of this length
        excess = np.maximum(1.0, (counts[at:at + BLOCK] - mean) / (4 * np.sqrt(mean)))
        out[at:at + BLOCK] = np.minimum(250, 2 * np.log2(excess))
    return out


def _node(tokens: np.ndarray) -> int:
    """A number for the set as a whole."""
    import xxhash
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def document_nodes(docs: DataFrame, classes, size: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node, its point and the tokens that candidates are found by.

    An empty set has a null node. Rows of one doc_id are told apart by their texts' numbers.
    """
    def sets(batches):
        order = classes.value
        for batch in parts(batches):
            n, nodes, points, boxes, firsts = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text"), size):
                n.append(len(tokens))
                nodes.append(_node(tokens) if len(tokens) else None)
                points.append(point(tokens) if len(tokens) else None)
                boxes.append(point(tokens, GROUPS))
                needed = len(tokens) + (-percent * len(tokens)) // 100 + 1 if len(tokens) else 0
                kind = order[_cell(tokens)]
                by = np.argsort(kind, kind="stable") if kind.any() else slice(None)
                firsts.append(tokens[by][:needed].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"),
                "n_shingles": pa.array(n, pa.int64()),
                "node": pa.array(nodes, pa.int64()), "point": pa.array(points, pa.binary()),
                "box": pa.array(boxes, pa.binary()),
                "firsts": pa.ListArray.from_arrays(ends, np.concatenate([*firsts, np.zeros(0, np.int64)]))})

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        freed(sets), "doc_id long, text_key long, n_shingles long, node long, point binary, box binary, "
        "firsts array<long>")


def node_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sorted sets of the wanted nodes (doc_id, text_key, node)."""
    def sets(batches):
        for batch in parts(batches):
            out = [(node, tokens) for node, tokens in
                   zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), size))
                   if len(tokens) and _node(tokens) == node]
            ends = np.cumsum([0, *(len(t) for _, t in out)], dtype=np.int32)
            flat = np.concatenate([*(t for _, t in out), np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch({"node": pa.array([k for k, _ in out], pa.int64()),
                                   "tokens": pa.ListArray.from_arrays(ends, flat)})

    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    same = (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("doc_id"))
    return (texts.join(wanted, same).select("node", "text")
            .mapInArrow(freed(sets), "node long, tokens array<long>").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, size: int, percent: int,
              store: Store) -> DataFrame:
    """The pairs (a, b) that are links: first by the points, then by the full sets."""
    def bounded(batches):
        for batch in batches:
            most = overlap_bound(batch.column("pa"), batch.column("pb"))
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.filter(pa.array((100 + percent) * most >= percent * n)).select(["a", "b"])

    side = points.select("node", "n", "point")
    alike = (pairs.join(side.toDF("a", "na", "pa"), "a").join(side.toDF("b", "nb", "pb"), "b")
             .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    alike = store.keep(alike.select("a", "b", "na", "nb", "pa", "pb")
                       .mapInArrow(freed(bounded), "a long, b long"))
    needed = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = store.keep(points.select("node", "doc_id", "text_key").join(needed, "node"))
    side = store.keep(node_sets(docs, small(wanted), size))
    both = F.size(F.array_intersect("ta", "tb"))
    full = alike.join(side.toDF("a", "ta"), "a").join(side.toDF("b", "tb"), "b")
    return store.keep(full.filter(100 * both >= percent * (F.size("ta") + F.size("tb") - both))
                      .select("a", "b"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Null text counts as empty. Without words the set is empty and linked with nothing. Repeated
    rows are answered one by one, each alike. A null doc_id takes part, but is no component's
    name: where all are null, so is component_id. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    classes = spark.sparkContext.broadcast(token_classes(group_counts(docs, size)))
    nodes = store.keep(document_nodes(docs, classes, size, percent))
    entries = nodes.select(F.explode("firsts").alias("token"), "node")
    shared, pivots, pairs = meet(entries, store)
    every = store.keep(nodes.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    sized = every.select("node", "n")
    pairs = store.keep(
        pairs.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    needed = (pairs.select(F.explode(F.array("a", "b")).alias("node"))
              .unionByName(shared.select("node")).distinct())
    wanted = store.keep(every.select("node", "doc_id").join(needed, "node"))
    points = nodes.withColumnRenamed("n_shingles", "n").select("doc_id", "text_key", "node", "n", "point", "box")
    points = store.keep(points.alias("p").join(
        small(wanted).alias("w"), (F.col("p.node") == F.col("w.node"))
        & F.col("p.doc_id").eqNullSafe(F.col("w.doc_id"))).select("p.*").dropDuplicates(["node"]))
    links = _verified(pairs, points, docs, size, percent, store)
    labels = store.keep(connected_components(links, store))
    rest = units(shared, pivots, labels, points.select("node", "n", "box"))
    more = store.keep(search(rest, lambda unit: box_join(unit, percent)))
    if not more.isEmpty():
        links = links.unionByName(_verified(more, points, docs, size, percent, store))
        labels = store.keep(connected_components(links, store))
    every = every.select("node", F.col("doc_id").alias("least"))
    named = every.join(labels, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = every.join(labels, "node").join(named, "component").select("node", "component_id")
    alone = every.join(labels, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    answer = store.keep(grouped.unionByName(alone))
    return (nodes.select("doc_id", "n_shingles", "node").join(answer, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_first_of_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each group of near copies the document with the least doc_id stays.

    Rows with a null doc_id stay. Repeated rows of the kept doc_id all stay.
    """
    found = jaccard_components(docs)
    dropped = Store(spark, "near-copies").keep(
        found.filter("doc_id != component_id").select("doc_id").distinct())
    return docs.join(small(dropped), "doc_id", "left_anti").select(*columns(docs))
