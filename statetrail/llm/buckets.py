"""Candidates that meet in buckets: pairs enough to tie copies together, units for the rest.

``entries`` (token, node) say which nodes a token brings together. Links are looked for between
nodes of one bucket, and only components are wanted, so pairs that are known to be in one
component need not be compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, freed, small

#: Rows of a work unit, on either side.
PROBES, MEMBERS = 512, 4096
#: Pairs that a task gathers from its units, to hand out each of them once.
GATHERED = 1 << 19


def meet(entries: DataFrame, store: Store, useful: Column | None = None, once: bool = False):
    """(shared, pivots, pairs): the buckets of three or more, their pivots and the first pairs.

    Buckets are summed up before the shuffle, to the least and greatest node and a sum over the
    nodes. Those with one node go, those with two are a pair. Of buckets with equal members one
    stays. In a larger one every member is paired with the pivot, the node that is in most
    buckets; or, with ``once``, every node with one of its pivots only, so that there is not more
    than a pair for a node. ``useful`` is a further aggregate that buckets must pass.
    """
    members = F.try_sum(F.pmod(F.xxhash64("node"), F.lit(1 << 32)))
    found = entries.groupBy("token").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"),
        members.alias("members"), *([] if useful is None else [useful.alias("useful")]))
    found = found.filter("lo < hi" if useful is None else "lo < hi AND useful").drop("useful")
    buckets = store.keep(found)
    large = store.keep(buckets.filter("n > 2").groupBy(
        "lo", "hi", "n", F.coalesce("members", "token")).agg(F.min("token").alias("token")).select("token"))
    shared = store.keep(entries.select("token", "node")
                        .join(small(large), "token", "left_semi").distinct())
    common = shared.groupBy("node").agg(F.count("*").alias("weight"))
    pivots = store.keep(shared.join(common, "node").groupBy("token").agg(
        F.max(F.struct("weight", "node")).alias("top")).select("token", F.col("top.node").alias("pivot"), "top.weight"))
    tied = shared.join(pivots, "token").filter("node != pivot")
    if once:
        tied = tied.groupBy("node").agg(F.max(F.struct("weight", "pivot")).alias("top")).select("node", "top.pivot")
    pairs = (buckets.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
             .unionByName(tied.select(
                 F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))))
    return shared, pivots.drop("weight"), store.keep(pairs.distinct())


def units(shared: DataFrame, pivots: DataFrame | None, labels: DataFrame,
          payload: DataFrame | None = None) -> DataFrame:
    """What is left to compare: members (side 0) and those outside the main component (side 1).

    A bucket whose nodes, but for a pivot that all were paired with, are of one component is done. The others are cut
    into units (token, part, chunk) of bounded size, each a part of the members against a chunk
    of the nodes outside the bucket's largest component. ``payload`` (node, ...) comes along, if there is one.
    """
    rows = shared if pivots is None else shared.join(pivots, "token").filter("node != pivot")
    rows = (rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("token").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"),
        F.count("*").alias("components")).filter("components > 1")
    top = top.select(
        "token", F.col("top.component").alias("main"),
        F.ceil(F.col("members") / MEMBERS).cast("int").alias("parts"),
        F.ceil((F.col("members") - F.col("top.n")) / PROBES).cast("int").alias("chunks"))
    rows = rows.select("token", "node", "component").join(top, "token")
    members = rows.select(
        "token", "node", "component", "main", F.lit(0).alias("side"),
        F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    others = rows.filter("component != main").select(
        "token", "node", "component", "main", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int").alias("chunk"))
    both = members.unionByName(others)
    return both if payload is None else both.join(payload, "node")


def search(rows: DataFrame, compare) -> DataFrame:
    """Distinct pairs (a, b) that ``compare`` gives for the table of each unit.

    Nodes that meet under many tokens are a pair of many units; a task hands such a pair out once for
    every GATHERED pairs.
    """
    def run(batches):
        found, n = [], 0
        for unit in units_of(batches):
            for batch in compare(unit):
                found.append(_distinct(batch))
                n += found[-1].num_rows
            if n > GATHERED:
                found = [_distinct(pa.Table.from_batches(found))]
                if (n := found[0].num_rows) > GATHERED // 2:
                    yield found.pop()
                    n = 0
        if found:
            yield _distinct(pa.Table.from_batches(found))

    keys = ["token", "part", "chunk"]
    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(freed(run), "a long, b long").distinct())


def _distinct(pairs) -> pa.RecordBatch:
    """The pairs (a, b), each once."""
    pairs = np.stack([pairs.column(c).to_numpy() for c in ("a", "b")], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    keep = np.ones(len(pairs), bool)
    keep[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pa.record_batch({"a": pa.array(pairs[keep, 0]), "b": pa.array(pairs[keep, 1])})


def units_of(batches):
    """The rows of one unit after the other; a unit is of bounded size."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now]).combine_chunks()
        key = [now.column(c).to_numpy() for c in ("token", "part", "chunk")]
        start = 0
        for cut in np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1:
            yield now.slice(start, cut - start)
            start = cut
        rest = now.slice(start)
    if rest is not None and len(rest):
        yield rest


def sides(unit: pa.Table):
    side = unit.column("side").to_numpy()
    return unit.filter(pa.array(side == 0)), unit.filter(pa.array(side == 1))


def fresh(members: pa.Table):
    """A test for a probe (node, component): which members it has to be compared with.

    Pairs within one component are known, and two nodes that are both outside the main component
    would meet twice.
    """
    node, component = members.column("node").to_numpy(), members.column("component").to_numpy()
    main = members.column("main").to_numpy()[0] if len(members) else 0

    def ask(own: int, kind: int, at: np.ndarray) -> np.ndarray:
        return at[(component[at] != kind) & ((component[at] == main) | (node[at] > own))]

    return ask
