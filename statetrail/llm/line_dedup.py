"""Line dedup: lines within a few edits of each other, by a segment-partition edit join.

Of threshold + 1 segments of a line at least one stays unchanged under at most threshold edits, with
at most i edits before it if it is segment i, and at most threshold - i behind it. Segments of
the first half lie at fixed places from the beginning of the line, those of the second half from
its end, with a size that depends on a class of lengths. So each distinct line is entered under
its own segments, and looked up under those of its substrings that could be such a segment of a
line of its class, or of the class below if that is within reach: a segment of the first half
can have moved by i places at most, one of the second half by threshold - i from the end. Lines
that meet are asked for their lengths and counts of characters first, and verified by banded
bit-parallel edit distance.

Of each group of equal or linked lines the first, by doc_id and place, stays.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import meet, units
from .common import Store, columns, free, freed, parts, small, table
from .components import connected_components
from .edit_distance import within_each
from .segment_keys import edits, least_edited, number, segment_keys, shared_keys

#: Edits that lines may differ by, and characters below which ``line_dedup`` leaves a line alone if
#: nothing else is asked for. A line without a word is always left alone below LEAST_CHARS.
MOST_EDITS, LEAST_CHARS = 1, 32
#: What the query and the stage ask for: every line with a word repeats if it is equal to an earlier
#: one, and one edit per so many characters, up to so many, is allowed beside.
ALL_LINES, EDITS = 1, (16, 8)

#: Characters whose signatures are made at once, candidates that a task verifies at once, those of a line that
#: are verified first, and components of which a task remembers what they were tied to.
CHARS, WAITING, FIRST, KNOWN = 1 << 17, 1 << 15, 4, 1 << 20
#: Characters of the lines of units that are looked through together, pairs of theirs that are listed at once (those
#: of a line and its unit at least), and pairs whose counts are compared at once.
UNIT_CHARS, PAIRS, ASKED = 1 << 21, 1 << 18, 1 << 14

_WORD = re.compile(r"\w")


def keys(line: str, most: int | tuple[int, int]) -> tuple[list[int], list[int]]:
    """Own keys, and those under which the line is looked for among others."""
    _, found, held = segment_keys([line], most)
    own = set(found[held].tolist())
    return sorted(own), sorted(set(found.tolist()) - own)


def signatures(lines: list[str]) -> list[bytes]:
    """For each line how often characters come, by the last five bits of their numbers, and pairs of
    neighbours likewise, each count modulo 256."""
    out, start = [], 0
    while start < len(lines):
        end, chars = start + 1, len(lines[start])
        while end < len(lines) and chars + len(lines[end]) <= CHARS:
            chars += len(lines[end])
            end += 1
        some = lines[start:end]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(x) for x in some])
        row = np.repeat(np.arange(len(some)) * 64, np.diff(ends, prepend=0))
        pairs = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519) >> np.uint32(27)
        counts = np.bincount(row + (codes & np.uint32(31)), minlength=64 * len(some))
        pairs = row[:-1] + 32 + pairs
        counts += np.bincount(pairs, minlength=64 * len(some))
        across = np.unique(ends[(ends > 0) & (ends < len(codes))]) - 1
        np.subtract.at(counts, pairs[across], 1)
        data = counts.astype(np.uint8).tobytes()
        out += [data[at:at + 64] for at in range(0, len(data), 64)]
        start = end
    return out


def _counts(marks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint8).reshape(-1, 64)


def _bounds(sizes: np.ndarray, most: int | tuple[int, int]) -> np.ndarray:
    return np.full(len(sizes), most) if isinstance(most, int) else np.minimum(sizes // most[0], most[1])


def _moved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What one has more than the other, the greater of both ways."""
    lost = (a - b).view(np.int8).astype(np.int32)
    return np.maximum(np.maximum(lost, 0).sum(axis=-1), np.maximum(-lost, 0).sum(axis=-1))


def alike(size_a, counts_a, size_b, counts_b, most) -> np.ndarray:
    """Whether lengths and counts allow that lines are within the bound: an edit takes at most one
    character and two pairs of neighbours away and brings at most as many. Differences within the
    bound survive the modulus."""
    bound = _bounds(np.minimum(size_a, size_b), most)
    found = (np.abs(size_a - size_b) <= bound) & (_moved(counts_a[..., :32], counts_b[..., :32]) <= bound)
    at = np.flatnonzero(found)
    other = counts_b[at, 32:] if counts_b.ndim > 1 else counts_b[32:]
    found[at] = _moved(counts_a[at, 32:], other) <= 2 * bound[at]
    return found


def counted(line: str, least: int) -> bool:
    return len(line) >= least and (len(line) >= LEAST_CHARS or _WORD.search(line) is not None)


def lines_of(docs: DataFrame, most: int | tuple[int, int], least: int) -> DataFrame:
    """doc_id, place and node of every line that counts, and whether it is a line's first place in a
    slice of documents and long enough for an edit.
    """
    shortest = least_edited(most)

    def run(batches):
        for batch in parts(batches):
            ids, at, nodes, editable, known = [], [], [], [], {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for place, line in enumerate((text or "").split("\n")):
                    node = known.get(line)
                    if node is not None:
                        editable.append(False)
                    elif counted(line, least):
                        node = known[line] = number(line)
                        editable.append(len(line) >= shortest)
                    else:
                        continue
                    ids.append(doc_id)
                    at.append(place)
                    nodes.append(node)
            yield pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "place": pa.array(at, pa.int32()),
                "node": pa.array(nodes, pa.int64()), "editable": pa.array(editable, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, place int, node long, editable boolean")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, its line, and the line's size and signature, for the wanted (doc_id, places of nodes)."""
    def run(batches):
        for batch in parts(batches):
            nodes, lines = [], []
            places = batch.column("places")
            wanted = zip(*(places.flatten().field(c).to_pylist() for c in ("place", "node")))
            for text, n in zip(batch.column("text").to_pylist(), pc.list_value_length(places).to_pylist()):
                cut = (text or "").split("\n")
                for place, node in islice(wanted, n):
                    if place < len(cut) and number(cut[place]) == node:
                        nodes.append(node)
                        lines.append(cut[place])
            yield pa.record_batch({
                "node": pa.array(nodes, pa.int64()), "line": pa.array(lines, pa.string()),
                "size": pa.array([len(x) for x in lines], pa.int32()),
                "signature": pa.array(signatures(lines), pa.binary())})

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return (texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("text", "places")
            .mapInArrow(freed(run), "node long, line string, size int, signature binary").dropDuplicates(["node"]))


def _near(pairs: DataFrame, marks: DataFrame, most: int | tuple[int, int]) -> DataFrame:
    """The pairs whose lengths and counts allow a link."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = alike(batch.column("m").to_numpy(), _counts(batch.column("x").to_pylist()),
                             batch.column("n").to_numpy(), _counts(batch.column("y").to_pylist()), most)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(marks.toDF("a", "m", "x"), "a").join(marks.toDF("b", "n", "y"), "b")
    return both.select("a", "b", "m", "x", "n", "y").mapInArrow(freed(run), "a long, b long")


def _lines(needed: DataFrame, docs: DataFrame, lines: DataFrame, store: Store) -> DataFrame:
    """node, line, size and signature of the nodes ``needed``; only their documents' texts are read."""
    places = (lines.filter("editable").select("node", "doc_id", "place")
              .join(small(needed), "node", "left_semi").dropDuplicates(["node"]))
    wanted = store.keep(places.groupBy("doc_id").agg(
        F.collect_list(F.struct("place", "node")).alias("places")))
    return store.keep(_texts(docs, small(wanted, 2 * F.size("places"))))


def _links(pairs: DataFrame, texts: DataFrame, store: Store, most: int | tuple[int, int]) -> DataFrame:
    """The pairs that are within the bound."""
    def verify(batches):
        for batch in batches:
            near = _within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    needed = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    found = texts.select("node", "line").join(small(needed), "node", "left_semi")
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    return store.keep(both.select("a", "b", "x", "y").mapInArrow(freed(verify), "a long, b long"))


def _within(x: list[str], y: list[str], most: int | tuple[int, int]) -> np.ndarray:
    return within_each(x, y, [edits(min(len(p), len(q)), most) for p, q in zip(x, y)])


class Ties:
    """Candidates of the units of a task, verified many at a time.

    Components that a link ties together are one from then on, so candidates between them need
    no more be verified, and a task hands out fewer links than it meets components.
    """

    def __init__(self, most: int | tuple[int, int]):
        self.most, self.up = most, {}
        self.lines, self.waiting, self.n, self.probes = {}, [], 0, 0

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, own: int, component: int, nodes: np.ndarray, components: np.ndarray) -> None:
        """``own`` is to be compared with ``nodes``; ``lines`` must know them."""
        self.add_each(np.zeros(len(nodes), np.int64), np.full(len(nodes), own), np.full(len(nodes), component),
                      nodes, components)

    def add_each(self, probe: np.ndarray, own: np.ndarray, component: np.ndarray, nodes: np.ndarray,
                 components: np.ndarray) -> None:
        """``add`` for many: what is compared with several nodes has one number ``probe`` and comes together."""
        numbers = self.probes + np.cumsum(np.append(0, probe[1:] != probe[:-1]))
        self.waiting.append((numbers, own, nodes, component, components))
        self.probes = int(numbers[-1]) + 1
        self.n += len(nodes)

    def links(self) -> pa.RecordBatch:
        """The links (a, b) among what waits that tie components; nothing waits any more."""
        probe, a, b, x, y = (np.concatenate(c) for c in zip(*self.waiting))
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        new = np.ones(len(a), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        left, found, each = np.sort(order[new]), [], FIRST
        while True:
            apart = [self.top(p) != self.top(q) for p, q in zip(x[left].tolist(), y[left].tolist())]
            left = left[np.array(apart, bool)]
            if not len(left):
                break
            now = np.arange(len(left)) - np.searchsorted(probe[left], probe[left]) < each
            at = left[now]
            near = _within(*([self.lines[n] for n in side[at].tolist()] for side in (a, b)), self.most)
            for i in at[near].tolist():
                p, q = self.top(int(x[i])), self.top(int(y[i]))
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    found.append(i)
            left, each = left[~now], each * 4
        self.lines, self.waiting, self.n = {}, [], 0
        if len(self.up) > KNOWN:
            self.up = {}
        return pa.record_batch({"a": pa.array(low[found], pa.int64()), "b": pa.array(high[found], pa.int64())})


def _several(batches):
    """Tables of whole units, which follow one another, with few characters or a single unit each."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now]).combine_chunks()
        starts = _starts(now)
        chars = np.cumsum(pc.fill_null(pc.binary_length(now.column("line")), 0).to_numpy())
        begin, spent = 0, 0
        for start in starts[1:].tolist():
            if chars[start - 1] - spent >= UNIT_CHARS:
                yield now.slice(begin, start - begin)
                begin, spent = start, chars[start - 1]
        last = int(starts[-1]) if len(starts) else 0
        if begin < last:
            yield now.slice(begin, last - begin)
        rest = now.slice(last)
    if rest is not None and len(rest):
        yield rest


def _starts(rows: pa.Table) -> np.ndarray:
    """Where units begin."""
    new = np.ones(len(rows), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in (rows.column(c).to_numpy() for c in ("token", "part", "chunk"))], axis=0)
    return np.flatnonzero(new)


def _meetings(unit: np.ndarray, side: np.ndarray):
    """(probe, member): the rows that meet in a unit, by probe, some PAIRS at a time."""
    members, probes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    low = np.searchsorted(unit[members], unit[probes])
    n = np.searchsorted(unit[members], unit[probes], "right") - low
    ends = np.cumsum(n)
    start = 0
    while start < len(probes):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + PAIRS, "right")))
        some, first = n[start:end], ends[start:end] - n[start:end]
        place = np.arange(some.sum()) - np.repeat(first - first[0], some)
        yield np.repeat(probes[start:end], some), members[np.repeat(low[start:end], some) + place]
        start = end


def _gather(rows: pa.Table, ties: Ties) -> None:
    """The pairs of some units that lengths and counts allow go to ``ties``, those that meet under a
    lesser token too being left to the unit of their least one."""
    node, kind, main, token, side = (
        rows.column(c).to_numpy() for c in ("node", "component", "main", "token", "side"))
    starts = _starts(rows)
    unit = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    _, first, same = np.unique(node, return_index=True, return_inverse=True)
    lines = rows.column("line").take(pa.array(first)).to_pylist()
    sizes, counts = np.array([len(x) for x in lines]), _counts(signatures(lines))
    tokens = rows.column("tokens").combine_chunks()
    ends, tokens = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    lesser = {}
    for probe, member in _meetings(unit, side):
        # pairs within a component are known, and two outside the main one would meet twice
        new = (kind[probe] != kind[member]) & ((kind[member] == main[member]) | (node[member] > node[probe]))
        probe, member = probe[new], member[new]
        x, y = same[probe], same[member]
        near = np.abs(sizes[x] - sizes[y]) <= _bounds(np.minimum(sizes[x], sizes[y]), ties.most)
        probe, member, x, y = probe[near], member[near], x[near], y[near]
        near = np.concatenate([np.zeros(0, bool), *(
            alike(sizes[x[at:at + ASKED]], counts[x[at:at + ASKED]], sizes[y[at:at + ASKED]],
                  counts[y[at:at + ASKED]], ties.most) for at in range(0, len(x), ASKED))])
        probe, member = probe[near], member[near]
        for at in np.unique(np.concatenate([probe, member])).tolist():
            if at not in lesser:
                own = tokens[ends[at]:ends[at + 1]]
                lesser[at] = frozenset(own[own < token[at]].tolist())
        least = np.array([lesser[p].isdisjoint(lesser[m]) for p, m in zip(probe.tolist(), member.tolist())], bool)
        probe, member = probe[least], member[least]
        if len(probe):
            ties.lines.update((int(node[at]), lines[same[at]]) for at in np.unique(np.concatenate([probe, member])))
            ties.add_each(probe, node[probe], kind[probe], node[member], kind[member])


def _tied(rows: DataFrame, most: int | tuple[int, int]) -> DataFrame:
    """Links (a, b) between components, for rows of units with a node's line and all its tokens."""
    def run(batches):
        ties = Ties(most)
        for some in _several(batches):
            _gather(some, ties)
            if ties.n >= WAITING:
                yield ties.links()
        if ties.n:
            yield ties.links()

    keys = ["token", "part", "chunk"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(freed(run), "a long, b long")


def line_groups(docs: DataFrame, store: Store, most: int | tuple[int, int] = MOST_EDITS,
                least: int = LEAST_CHARS):
    """(lines, labels): doc_id, place and node of the lines; node and component of linked nodes."""
    lines = store.keep(lines_of(docs, most, least))
    entries = store.keep(shared_keys(docs, lambda line: counted(line, least), most, lines.filter("editable").count()))
    spent = store.last
    shared, _, pairs = meet(entries, store, F.bool_or("held"), once=True)
    store.remove(spent)
    # nodes of shared buckets are in a pair too, so these are all lines that are read again
    met = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = _lines(met, docs, lines, store)
    near = _near(pairs, texts.select("node", "size", "signature"), most)
    links = _links(store.keep(near), texts, store, most)
    labels = store.keep(connected_components(links, store))
    left = store.keep(units(shared, None, labels))
    if not left.isEmpty():
        # buckets of one component are among these; no pair that is left meets in them
        tokens = shared.groupBy("node").agg(F.collect_list("token").alias("tokens"))
        with_lines = texts.select("node", "line").join(tokens, "node")
        more = store.keep(_tied(left.join(with_lines, "node"), most))
        labels = store.keep(connected_components(links.unionByName(more), store))
    return lines.select("doc_id", "place", "node"), labels


def repeated_lines(docs: DataFrame, store: Store, most: int | tuple[int, int] = MOST_EDITS,
                   least: int = LEAST_CHARS) -> DataFrame:
    """doc_id and the places (from 0) of its lines that are equal or linked to an earlier one."""
    lines, labels = line_groups(docs, store, most, least)
    lines = lines.join(small(labels), "node", "left").select(
        "doc_id", "place", F.coalesce("component", "node").alias("component"))
    groups = store.keep(lines.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"))
    rows = store.keep(lines.join(small(groups), "component", "left_semi"))
    firsts = store.keep(rows.groupBy("component").agg(F.min(F.struct("doc_id", "place")).alias("first")))
    rows = rows.join(small(firsts), "component")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))
    return store.keep(rows.filter(~same).groupBy("doc_id").agg(F.collect_set("place").alias("places")))


def line_dedup(docs: DataFrame, most: int | tuple[int, int] = MOST_EDITS,
               least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines that repeat taken out of ``text``, and n_lines and n_dropped (long).

    A line repeats if an earlier line, by doc_id and place, is in its group: equal lines and lines
    within ``most`` edits, and what these lead to. ``most`` may be a pair (characters, edits): one
    edit for so many characters of the shorter line, up to so many edits; lines too short for one
    repeat only if they are equal. Lines of fewer than ``least`` characters stay, and so do those
    of fewer than LEAST_CHARS without a word (blank ones, say).
    Null text stays null and has no lines; an empty text has one. A null doc_id is before all
    others; rows of equal doc_id are one document as to order, so that equal rows keep the same
    lines. All columns of ``docs`` are returned as they are; columns n_lines and n_dropped of
    its own are replaced. An empty table gives no rows.
    """
    rows, worded = _without_repeats(docs, most, least)
    return rows.drop(worded)


def _without_repeats(docs: DataFrame, most: int | tuple[int, int], least: int) -> tuple[DataFrame, str]:
    """What ``line_dedup`` returns, and a further column, by name: whether the text has a word left."""
    store = Store(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    id_, gone_ = free("id", docs), free("places", docs)
    dropped = repeated_lines(docs, store, most, least).toDF(id_, gone_)
    rows = docs.join(small(dropped, F.size(gone_)), F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(id_)
    names, worded = docs.columns, free("worded", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField(worded, T.BooleanType())])

    def cut(batches):
        for batch in parts(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column(gone_).to_pylist()):
                gone = frozenset(places or ())
                lines = text.split("\n") if text is not None else []
                left = [x for i, x in enumerate(lines) if i not in gone]
                texts.append(None if text is None else text if len(left) == len(lines) else "\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array([bool(_WORD.search(x or "")) for x in texts], pa.bool_())], schema.names)

    return rows.mapInArrow(freed(cut), schema), worded


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), EDITS, ALL_LINES).select("doc_id", "n_lines", "n_dropped", "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: texts without repeated lines; a document that lost lines and has no word left goes."""
    own = docs.drop("n_lines", "n_dropped")
    found, worded = _without_repeats(docs, EDITS, ALL_LINES)
    return found.filter((F.col("n_dropped") == 0) | F.col(worded)).select(*columns(own))
