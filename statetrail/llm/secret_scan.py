"""Secrets: fixed patterns, and random strings that a vocabulary needs many tokens for.

A vocabulary learned from ordinary text has long tokens for ordinary words; a random string falls
into short ones. Words that look like keys are therefore encoded, and those with few characters
a token are reported, unless they are known digests or identifiers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table
from .vocabulary import default_path, default_pattern, load_tokens

KINDS = ("assign", "access", "hex", "random")
#: Characters that a candidate has at least, and characters a token below which it is random: with
#: digits, and of letters alone, where ordinary words are nearer.
LEAST_CHARS, RATIO, RATIO_LETTERS = 16, 2.2, 1.75

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

# Lengths of hexadecimal digests, and written forms of identifiers.
_DIGESTS = frozenset((32, 40, 48, 56, 64, 96, 128))
_IDENTIFIERS = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9_-]*Z?|[0-9+/_=-]+|[A-Z]+(?:_[A-Z]+)+|(?:sha256|sha512|md5)-[A-Za-z0-9+/=]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if any(name in text.lower() for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def known(word: str) -> bool:
    """Digests and identifiers, which are random but no secret."""
    if _IDENTIFIERS.fullmatch(word):
        return True
    return len(word) in _DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) is not None


def random_spans(text: str, base, count_tokens) -> list[tuple[int, int, int]]:
    """Candidates with letters, or what the base spans leave of them, that take many tokens."""
    out = []
    for m in _CANDIDATE.finditer(text):
        if not _LETTER.search(m.group()) or known(m.group()):
            continue
        for start, end in _outside(m.start(), m.end(), base):
            word = text[start:end]
            if len(word) < LEAST_CHARS or not _LETTER.search(word) or known(word):
                continue
            if len(word) < (RATIO if _DIGIT.search(word) else RATIO_LETTERS) * count_tokens(word):
                out.append((start, 3, end))
    return out


def _outside(start: int, end: int, base):
    """The parts of a range that no base span covers; base spans come by their start."""
    for a, _, b in base:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end, comma-joined).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Spans of kind
    ``random`` never overlap base spans; base spans of different kinds may overlap. Rows are
    answered one by one, also repeated ones and those with a null doc_id. Other columns are not
    read; an empty table gives no rows.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load_tokens(path or default_path()))
    pattern = default_pattern()

    def run(batches):
        import tiktoken
        coder = tiktoken.Encoding("bytes", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(tokens.value)})
        for batch in parts(batches):
            counts, base, spans = ([], [], []), [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                fixed = base_spans(text)
                extra = random_spans(text, fixed, lambda w: len(coder.encode_ordinary(w)))
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in fixed))
                base.append(spans_text(fixed))
                spans.append(spans_text(fixed + extra))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_assign": pa.array(counts[0], pa.int64()),
                "n_access": pa.array(counts[1], pa.int64()), "n_hex": pa.array(counts[2], pa.int64()),
                "base": pa.array(base, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
