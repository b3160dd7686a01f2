"""A distributed LSD radix sort of narrow rows: stable counting passes over the digits of the keys.

Rows lie in blocks. A pass counts the digits of every block; global prefix offsets over (digit,
block) then say where the rows of a block with some digit begin, and each block sends its rows there in
order. After the last digit of the first key a row's place is its rank. Blocks are equal in size
whatever the keys, so equal keys or digits load no task more than others.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store

#: Bits of a digit; the totals of its values, at most 2 to this power, go to the driver.
DIGIT_BITS = 11
#: Most rows of a block, which one task holds.
BLOCK_ROWS = 1 << 20


def _raised(keys: np.ndarray, low: int) -> np.ndarray:
    """How far the keys are above the least one, without overflow."""
    return keys.astype(np.int64).view(np.uint64) - np.array([low], np.int64).view(np.uint64)


def radix_places(rows: DataFrame, keys: list[str], store: Store, bits: int = DIGIT_BITS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``place``, from 0, in ascending order of ``keys``, the most significant first.

    Keys are longs without nulls. Rows with equal keys get consecutive places. ``rows`` should be
    narrow: a task holds a block of them.
    """
    names, spark = rows.columns, rows.sparkSession
    rows = store.keep(rows.withColumn("block", F.spark_partition_id().cast("long"))
                      .withColumn("place", F.lit(0).cast("long")))
    stats = rows.agg(F.count("*"), F.max("block"),
                     *[f(k) for k in keys for f in (F.min, F.max)]).first()
    total, blocks = stats[0], (stats[1] or 0) + 1
    if not total:
        return rows.select(*names, "place")
    size = max(1, min(block_rows, ceil(total / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    passes = [(key, low, shift)
              for key, low, high in reversed(list(zip(keys, stats[2::2], stats[3::2])))
              for shift in range(0, max(1, (high - low).bit_length()) if key == keys[0]
                                 else (high - low).bit_length(), bits)]
    placed = False
    for key, low, shift in passes:
        rows = store.keep(_counting_pass(rows, key, low, shift, bits, blocks, size, placed, store))
        blocks, placed = ceil(total / size), True
    return rows.select(*names, "place")


def _counting_pass(rows, key, low, shift, bits, blocks, size, placed, store) -> DataFrame:
    def digits(batch) -> np.ndarray:
        above = _raised(batch.column(key).to_numpy(), low)
        return ((above >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint16)

    def count(batches):
        for batch in batches:
            cells = batch.column("block").to_numpy() << bits | digits(batch)
            cells, n = np.unique(cells, return_counts=True)
            yield pa.record_batch({"block": cells >> bits, "digit": cells & ((1 << bits) - 1), "n": n})

    counted = store.keep(rows.select("block", key).mapInArrow(count, "block long, digit long, n long")
                         .groupBy("block", "digit").agg(F.sum("n").alias("n")))
    of_digits = sorted(counted.groupBy("digit").agg(F.sum("n")).collect())  # at most 2 ** bits
    firsts = accumulate([n for _, n in of_digits], initial=0)
    firsts = rows.sparkSession.createDataFrame(
        [(d, first) for (d, _), first in zip(of_digits, firsts)], "digit long, first long")
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = (counted.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
               .join(F.broadcast(firsts), "digit")
               .select("block", "digit", (F.col("first") + F.col("earlier")).alias("offset")))

    def scatter(batches):
        block = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if block is None or not len(block):
            return
        block = block.combine_chunks()
        known = block.filter(block.column("digit").is_valid())
        own = block.filter(block.column("digit").is_null())
        if placed:
            at = own.column("place").to_numpy()
            order = np.empty(len(own), np.int64)
            order[at - at.min()] = np.arange(len(own))
            own = own.take(pa.array(order))
        digit = digits(own)
        order = np.argsort(digit, kind="stable")  # a counting sort of 16-bit digits
        n = np.bincount(digit, minlength=1 << bits)
        begin = np.zeros(1 << bits, np.int64)
        begin[known.column("digit").to_numpy()] = known.column("offset").to_numpy()
        goes = np.empty(len(own), np.int64)
        goes[order] = np.arange(len(own)) + np.repeat(begin - (np.cumsum(n) - n), n)
        own = own.drop_columns(["block", "place", "digit", "offset"])
        own = own.append_column("block", pa.array(goes // size)).append_column("place", pa.array(goes))
        yield from own.to_batches()

    schema = rows.select(*[c for c in rows.columns if c not in ("block", "place")], "block", "place").schema
    return (rows.unionByName(offsets, allowMissingColumns=True)
            .repartitionById(blocks, F.col("block").cast("int")).mapInArrow(scatter, schema))
