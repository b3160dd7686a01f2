"""Byte-level BPE: corpus-level merge replay, and decoding.

The distinct pieces of a block of documents form a corpus that is encoded as a whole. An inverted
index leads from each token that a merge can make to the positions of its pairs, in whatever
piece. Merges are replayed in the order of ranks: the lowest rank in the index is taken, all its
positions are merged, and only the neighbours they touch enter the index anew. As in the usual
piece-by-piece encoding the lowest rank of a piece goes first, and the leftmost of equals: a
merge that gives rise to a lower rank puts the rest of its piece off until that is done.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, freed, table
from .vocabulary import Pieces, default_path, default_pattern, load_tokens

#: Documents taken at once, distinct pieces encoded together, and pieces that a task remembers.
BLOCK_ROWS, BLOCK_PIECES, REMEMBERED = 500, 10_000, 300_000


class MergeReplay:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full((256, 256), -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        # for each token, what it merges to with the token behind it and before it, as far as known
        self.behind: list[dict[int, int] | None] = [None] * len(tokens)
        self.ahead: list[dict[int, int] | None] = [None] * len(tokens)
        self.n_known = 0

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as 32-bit numbers; none for an empty one."""
        if self.n_known > 1 << 20:
            self.behind, self.ahead = [None] * len(self.tokens), [None] * len(self.tokens)
            self.n_known = 0
        whole = [self.ranks.get(p) for p in pieces]
        open_ = [p for p, rank in zip(pieces, whole) if rank is None and p]
        replayed = iter(self._replay(open_) if open_ else ())
        return [next(replayed) if rank is None and p else
                b"" if rank is None else rank.to_bytes(4, "little")
                for p, rank in zip(pieces, whole)]

    def _replay(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        after = np.arange(1, len(data) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(data) - 1)
        before[ends[:-1]] = -1
        pair = np.full(len(data), -1, np.int32)
        pair[:-1] = self.pairs[data[:-1], data[1:]]
        pair[ends - 1] = -1
        symbols = self.bytes[data].tolist()
        self._merge_all(symbols, after.tolist(), before.tolist(), pair, ends)
        ids = np.array(symbols, "<i4")
        bounds = (4 * np.concatenate([[0], np.cumsum(ids >= 0)])[ends]).tolist()
        joined = ids[ids >= 0].tobytes()
        return [joined[a:b] for a, b in zip([0, *bounds], bounds)]

    def _merge_all(self, symbols, after, before, first, ends) -> None:
        """``first`` has the rank that the pair at each position would merge to, -1 for none."""
        tokens, ranks, many = self.tokens, self.ranks, len(self.tokens)
        push, ends = heapq.heappush, ends.tolist()
        index: list[list[int] | None] = [None] * many
        order = np.argsort(first, kind="stable")[np.count_nonzero(first < 0):]
        heap, starts = np.unique(first[order], return_index=True)
        heap, pair, order, starts = heap.tolist(), first.tolist(), order.tolist(), starts.tolist()
        for rank, start, end in zip(heap, starts, [*starts[1:], len(order)]):
            index[rank] = order[start:end]
        while heap:
            rank = heapq.heappop(heap)
            places, index[rank] = index[rank], None
            places.sort()
            put_off, token = -1, tokens[rank]
            if self.behind[rank] is None:
                self.behind[rank], self.ahead[rank] = {}, {}
            to_behind, to_ahead = self.behind[rank], self.ahead[rank]
            n_known = len(to_behind) + len(to_ahead)
            for at in places:
                if pair[at] != rank:
                    continue
                if at < put_off:
                    if index[rank] is None:
                        index[rank] = []
                        push(heap, rank)
                    index[rank].append(at)
                    continue
                right, made, lower = after[at], -1, False
                symbols[at], symbols[right], pair[right] = rank, -1, -1
                beyond = after[at] = after[right]
                if beyond >= 0:
                    before[beyond] = at
                    other = symbols[beyond]
                    if other in to_behind:
                        made = to_behind[other]
                    else:
                        made = to_behind[other] = ranks.get(token + tokens[other], -1)
                    if made >= 0:
                        lower = made < rank
                        if index[made] is None:
                            index[made] = [at]
                            push(heap, made)
                        else:
                            index[made].append(at)
                pair[at] = made
                ahead = before[at]
                if ahead >= 0:
                    other = symbols[ahead]
                    if other in to_ahead:
                        made = to_ahead[other]
                    else:
                        made = to_ahead[other] = ranks.get(tokens[other] + token, -1)
                    pair[ahead] = made
                    if made >= 0:
                        lower = lower or made < rank
                        if index[made] is None:
                            index[made] = [ahead]
                            push(heap, made)
                        else:
                            index[made].append(ahead)
                if lower:
                    put_off = ends[bisect_right(ends, at)]
            self.n_known += len(to_behind) + len(to_ahead) - n_known


def id_bytes(texts: list[str], cutter: Pieces, replay: MergeReplay, memory: dict) -> list[bytes]:
    """The ids of every text as 32-bit numbers; ``memory`` keeps those of pieces between calls."""
    cut = [cutter.cut(text) for text in texts]
    new = list(set(chain.from_iterable(cut)).difference(memory))
    for start in range(0, len(new), BLOCK_PIECES):
        part = new[start:start + BLOCK_PIECES]
        memory.update(zip(part, replay.encode([p.encode() for p in part])))
    return [b"".join(map(memory.__getitem__, pieces)) for pieces in cut]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids, the tokens of the whole text.

    Null and empty texts have no tokens; special tokens are ordinary text. Repeated rows and null
    doc_ids are answered row by row. Other columns are not read; an empty table gives no rows.
    The vocabulary is read once, on the driver, from ``path`` and sent to the tasks.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load_tokens(path or default_path()))
    pattern = pattern or default_pattern()

    def run(batches):
        cutter, replay, memory = Pieces(pattern), MergeReplay(tokens.value), {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if len(memory) > REMEMBERED:
                    memory.clear()
                ids = id_bytes([t or "" for t in part.column("text").to_pylist()],
                               cutter, replay, memory)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.record_batch({"doc_id": part.column("doc_id"),
                                       "ids": pa.ListArray.from_arrays(ends, flat)})

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for as ``decoded``; null ids count as none."""
    tokens = encoded.sparkSession.sparkContext.broadcast(load_tokens(path or default_path()))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        words = pa.array(tokens.value, pa.binary())
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                ids = part.column("ids").fill_null([])
                taken = words.take(ids.flatten())
                ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
                places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:]
                places = places[ends].astype(np.int32) if len(taken) else np.zeros(len(ends), np.int32)
                joined = pa.BinaryArray.from_buffers(
                    pa.binary(), len(part), [None, pa.py_buffer(places.tobytes()), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*part.columns, joined], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(freed(run), schema)


def op1_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: doc_id, ids and the text decoded from them.

    The ids are stored in between, so that a task needs one Python worker at a time and not two.
    """
    found = decode(Store(spark, "byte-pairs").keep(encode(docs)))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.col("decoded").cast("string").alias("text"))
