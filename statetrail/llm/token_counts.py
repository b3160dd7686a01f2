"""Token counts of sections, from one encoding of the whole document.

A document is encoded once, as a whole; cutting it into sections first would change the tokens at
every border. Tokens and sections are both sorted ranges of bytes that follow each other, so they
are joined by binary search: a token belongs to a section as a whole or it crosses borders. A
token that crosses goes to the section that has most of its bytes, the earliest of equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vocabulary import default_path, default_pattern, load_tokens

#: Documents whose rows are handed on together.
BLOCK_ROWS = 1000


def section_ends(text: str) -> list[int]:
    """Ends of the sections in characters: lines with the newline that ends them."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def allocate(token_ends: np.ndarray, section_ends_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, and whether it crosses a border; both inputs are byte ends."""
    starts = np.concatenate([[0], token_ends])[:-1]
    first = np.searchsorted(section_ends_, starts, "right")
    last = np.searchsorted(section_ends_, token_ends, "left")
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        borders = np.concatenate([[starts[i]], section_ends_[first[i]:last[i]], [token_ends[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(borders)))
    return owner, first != last


def section_counts(text: str, coder, lengths: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ends of the sections in characters, and of each section its tokens and crossing tokens."""
    ends = section_ends(text)
    if text.isascii():
        bytes_ = np.array(ends)
    else:
        starts = [0, *ends[:-1]]
        bytes_ = np.cumsum([len(text[a:b].encode()) for a, b in zip(starts, ends)])
    ids = np.array(coder.encode_ordinary(text), np.int64)
    owner, crossing = allocate(np.cumsum(lengths[ids]), bytes_)
    return (ends, np.bincount(owner, minlength=len(ends)),
            np.bincount(owner[crossing], minlength=len(ends)))


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row for every line of every text.

    ``start`` and ``end`` are code points; the newline belongs to the line it ends. The tokens of
    all sections add up to those of the text. Null and empty texts have one empty section without
    tokens. Repeated rows and null doc_ids are answered row by row; an empty table gives no rows.
    Other columns are not read.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load_tokens(path or default_path()))
    pattern = pattern or default_pattern()

    def run(batches):
        import tiktoken
        coder = tiktoken.Encoding("bytes", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(tokens.value)})
        lengths = np.array([len(t) for t in tokens.value])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                found = [section_counts(t or "", coder, lengths) for t in part.column("text").to_pylist()]
                sizes = [len(ends) for ends, _, _ in found]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(np.repeat(np.arange(len(part)), sizes))),
                    "section": np.concatenate([np.arange(n) for n in sizes]),
                    "start": np.concatenate([[0, *ends[:-1]] for ends, _, _ in found]).astype(np.int64),
                    "end": np.concatenate([ends for ends, _, _ in found]).astype(np.int64),
                    "n_tokens": np.concatenate([n for _, n, _ in found]),
                    "n_crossing": np.concatenate([n for _, _, n in found])})

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
