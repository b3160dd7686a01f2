"""Connected components by stars within tasks and label exchange between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CELLS, Store, freed

#: Edges that a task ties together at once.
TIED = 1 << 19


def _ties(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that is not the least of its component among them, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    top = np.arange(len(nodes))
    while len(a):
        # the greater top goes below the least one that it meets, then all go to their tops
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: in each task those of stars, v being the least node."""
    def run(batches):
        some, n = [], 0
        for batch in batches:
            some.append([batch.column(c).to_numpy() for c in ("u", "v")])
            n += batch.num_rows
            if n >= TIED:
                some = [_ties(*map(np.concatenate, zip(*some)))]
                if (n := len(some[0][0])) > TIED // 2:
                    yield pa.record_batch([*map(pa.array, some.pop())], ["u", "v"])
                    n = 0
        if n:
            yield pa.record_batch([*map(pa.array, _ties(*map(np.concatenate, zip(*some))))], ["u", "v"])

    return edges.filter("u != v").mapInArrow(freed(run), "u long, v long")


def connected_components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node.

    Tasks turn the edges they have into stars. In every round a node's label is the least of its
    neighbours and itself, and both ends of an edge are tied to the label of one; labels that a
    round leaves as they are are the components. The distance over which labels go doubles with
    each round, so rounds grow with the logarithm of the longest path at most. Each round is
    stored. A node with very many edges is summed up before the shuffle, and met by joins only,
    whose large partitions Spark splits. Nulls and loops are left out. No edges give no rows.
    """
    now, seen = store.keep(_stars(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        labels = store.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        mark = labels.agg(F.count("*"), F.sum(F.xxhash64("u", "m").cast("decimal(38,0)"))).first()
        if mark == seen:
            return labels.toDF("node", "component")
        seen = mark
        sent = F.broadcast(labels) if 2 * mark[0] <= BROADCAST_CELLS else labels
        ends = both.join(sent, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = store.keep(_stars(ends.select("e.u", "e.v")))
