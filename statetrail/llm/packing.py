"""Token ids packed into rows of fixed length, best fit decreasing.

Every task encodes its documents and packs them block by block, a block being BLOCK_TOKENS tokens, so that
nothing but the block is held. Documents longer than a row are split into pieces, none of which
is lost; pieces are placed from the longest to the shortest, each into the row with the least room
that still takes it. Rows are found by a segment tree over room: its leaves are the numbers of
free places, and the leftmost leaf from the piece's length on that has a row is looked up in as
many steps as the tree is high.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, table
from .vocabulary import default_path, default_pattern, load_tokens

#: Tokens of a row; tokens that a task packs together.
ROW, BLOCK_TOKENS = 2048, 1 << 21

SCHEMA = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.ArrayType(T.LongType()))])


class RoomTree:
    """Rows by free places; ``fit`` gives a row with the least room of at least ``size``."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.counts[at] += 1
            at >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """Takes the row out and returns it with its room."""
        counts, at = self.counts, size + self.leaves
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            counts[at] -= 1
            at >>= 1
        return row, room


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Pieces (by position) of each row; every length is from 1 to ``row``."""
    tree, rows = RoomTree(row), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[piece]
        found = tree.fit(size)
        if found is None:
            rows.append([piece])
            found = len(rows) - 1, row
        else:
            rows[found[0]].append(piece)
        if found[1] > size:
            tree.put(found[1] - size, found[0])
    return rows


def split(length: int, row: int) -> list[tuple[int, int]]:
    """(offset, length) of the pieces of a document, in order and without gaps."""
    return [(at, min(row, length - at)) for at in range(0, length, row)]


def _packed(doc_ids: list, ids: list[np.ndarray], row: int, kind: str, block: int) -> pa.RecordBatch:
    pieces = [(d, at, n) for d, x in enumerate(ids) for at, n in split(len(x), row)]
    rows = best_fit([n for _, _, n in pieces], row)
    data, ends, docs, offsets, used = [], [], [], [], []
    for members in rows:
        line, end = np.zeros(row, kind), [0]
        for piece in members:
            d, at, n = pieces[piece]
            line[end[-1]:end[-1] + n] = ids[d][at:at + n]
            end.append(end[-1] + n)
        data.append(line.tobytes())
        ends.append(end)
        used.append(end[-1])
        docs.append([doc_ids[pieces[p][0]] for p in members])
        offsets.append([pieces[p][1] for p in members])
    return pa.record_batch({
        "block": np.full(len(rows), block, np.int64), "row": np.arange(len(rows), dtype=np.int64),
        "n_tokens": pa.array(used, pa.int32()), "ids": pa.array(data, pa.binary()),
        "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
        "doc_ids": pa.array(docs, pa.list_(pa.int64())),
        "offsets": pa.array(offsets, pa.list_(pa.int64()))})


def packed(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           row: int = ROW) -> DataFrame:
    """A row of SCHEMA for every packed row.

    ``ids`` is a row of the id matrix: ``row`` little-endian numbers of 16 bits (32 for more than
    65,536 tokens), 0 behind the ``n_tokens`` used. ``cu_seqlens`` are the cumulative lengths of
    its segments from 0 on; positions are reset at each (``positions``). A segment is the part
    of document ``doc_ids[i]`` from its token ``offsets[i]`` on. (block, row) names a row; how
    documents are dealt out to blocks follows from the files and is the same for the same files.
    Null and empty texts have no tokens and are in no row. Repeated rows are packed as often as
    they come, null doc_ids stay null; an empty table gives no rows. Other columns are not read.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load_tokens(path or default_path()))
    pattern = pattern or default_pattern()

    def run(batches):
        import tiktoken
        coder = tiktoken.Encoding("bytes", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(tokens.value)})
        kind = "<u2" if len(tokens.value) <= 1 << 16 else "<u4"
        doc_ids, ids, held, block = [], [], 0, 0
        for batch in parts(batches):
            block = batch.column("part")[0].as_py() << 32 | block & 0xFFFFFFFF if len(batch) else block
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = np.array(coder.encode_ordinary(text or ""), kind)
                doc_ids.append(doc_id)
                ids.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield _packed(doc_ids, ids, row, kind, block)
                    doc_ids, ids, held, block = [], [], 0, block + 1
        if held:
            yield _packed(doc_ids, ids, row, kind, block)

    return (docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
            .mapInArrow(run, SCHEMA))


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of every used token of a row, from 0 in each segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def id_matrix(rows: list, row: int = ROW, kind: str = "<u2") -> np.ndarray:
    """The ids of collected rows as a matrix."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), kind).reshape(-1, row)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
