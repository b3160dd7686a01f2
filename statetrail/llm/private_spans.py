"""Personal data: fixed patterns and a semi-Markov conditional random field.

Text is looked at in *regions*: words with digits or an at sign, next to each other. A region is cut
into atoms (runs of letters and digits, single other characters), and the model scores whole
segments of up to LONGEST atoms by features of the segment as one: its shape, its numbers of
digits and groups, check digits, what stands before it. Dynamic programming over segment ends
chooses boundaries and types together. It is trained by the conditional likelihood of regions
whose segments the fixed patterns give, some of them with the part taken off by which the pattern
knows them (the country code of a phone number, say), so that the features carry the decision.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Atoms of the longest segment.
LONGEST = 24
#: Most documents that training regions come from, most regions, rounds and learning rate.
SAMPLE_DOCS, SAMPLE_REGIONS, ROUNDS, RATE = 20_000, 1_500, 4, 0.3

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN, _MARK = re.compile(r"\S+"), re.compile(r"[0-9@]")
_ATOM = re.compile(r"[A-Za-z0-9]+|.", re.S)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _emails(text)]
    if not _DIGIT.search(text):
        return sorted(found)
    if text.count(".") >= 3:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                  if all(_octet(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                  if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _octet(part: str) -> bool:
    """At most 255, whatever zeros it begins with."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    """All matches from left to right. A match holds an at sign, and what stands before the sign
    is a run of name characters; so only the runs before at signs are tried."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words that stand before personal data.
_CUES = {"phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telefon": 3, "teléfono": 3,
         "card": 2, "visa": 2, "karte": 2, "carte": 2, "tarjeta": 2, "ip": 1, "host": 1,
         "address": 1, "email": 0, "mail": 0, "e-mail": 0, "contact": 0, "correo": 0}


def regions(text: str):
    """(start, end) of what the model looks at; nothing outside has a digit or an at sign.

    Words that have one, and such words one or two blanks apart are one region. Every character is
    looked at a bounded number of times, also in a text without blanks.
    """
    mark, region = _MARK.search(text), None
    if mark is None:
        return
    for m in _RUN.finditer(text):
        if mark is None:
            break
        if m.end() <= mark.start():
            continue
        if region is not None and text[region[1]:m.start()] in ("\x20", "\x20\x20"):
            region = region[0], m.end()
        else:
            if region is not None:
                yield region
            region = m.span()
        mark = _MARK.search(text, m.end())
    if region is not None:
        yield region


def atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, start, end)]


def _cue(text: str, start: int) -> int | None:
    words = re.findall(r"[\w-]+", text[max(0, start - 24):start].lower())
    return _CUES.get(words[-1]) if words else None


def features(text: str, start: int, end: int, n_atoms: int, cue: int | None) -> list[str]:
    """Of the segment as a whole; none for a segment that cannot be personal data."""
    part = text[start:end]
    digits = _digits(part)
    mail = "@" in part
    if part[-1] == " " or part[0] == " " or not (mail or len(digits) >= 4):
        return []
    others = {c for c in part if not ("0" <= c <= "9")}
    letters = any(c.isalpha() for c in others)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", part)) if not mail else ""
    out = [f"chars:{''.join(sorted({'a' if c.isalpha() else c for c in others}))[:12]}",
           f"digits:{min(len(digits), 20)}", f"first:{_class(part[0])}", f"last:{_class(part[-1])}",
           f"groups:{min(len(re.findall('[0-9]+', part)), 8)}", f"atoms:{min(n_atoms // 3, 8)}"]
    if mail:
        name, _, host = part.partition("@")
        out += [f"host:{bool(re.fullmatch(r'[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', host))}",
                f"name:{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', name))}"]
    else:
        out.append(f"shape:{shape[:24]}")
        if not letters:
            groups = re.findall("[0-9]+", part)
            out += [f"luhn:{12 <= len(digits) <= 19 and luhn(digits)}",
                    f"octets:{len(groups) == 4 and part.count('.') == 3 and all(map(_octet, groups))}"]
    for name, at in (("before", start - 1), ("after", end)):
        beside = text[at:at + 1] if at >= 0 else ""
        out.append(f"{name}:{_class(beside) if beside else ''}")
    if cue is not None:
        out.append(f"cue:{cue}")
    return out


def _class(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c


class SemiMarkov:
    """Weights by (type, feature). Outside, every atom is a segment of its own that scores 0."""

    def __init__(self, weights: dict | None = None):
        self.weights = defaultdict(float, weights or {})

    def segments(self, text: str, cuts: list[tuple[int, int]]) -> dict[int, list]:
        """By last atom: (first atom, features) of the segments that may be personal data."""
        found, cue = defaultdict(list), _cue(text, cuts[0][0]) if cuts else None
        for first, (start, _) in enumerate(cuts):
            for last in range(first, min(first + LONGEST, len(cuts))):
                made = features(text, start, cuts[last][1], last - first + 1, cue)
                if made:
                    found[last].append((first, made))
        return found

    def score(self, kind: int, made: list[str]) -> float:
        w = self.weights
        return w[kind, "bias"] + sum(w.get((kind, f), 0.0) for f in made)

    def best(self, text: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation, by dynamic programming over the ends.

        Kept are a back pointer for each end and the scores that a segment can begin at; so a region
        can be as long as its text.
        """
        cue = _cue(text, cuts[0][0]) if cuts else None
        top, back = deque([0.0], LONGEST), [None]
        for last in range(len(cuts)):
            value, how, least = top[-1], None, last + 1 - len(top)
            for first in range(least, last + 1):
                made = features(text, cuts[first][0], cuts[last][1], last - first + 1, cue)
                for kind in range(OUTSIDE) if made else ():
                    now = top[first - least] + self.score(kind, made)
                    if now > value:
                        value, how = now, (first, kind)
            top.append(value)
            back.append(how)
        out, at = [], len(cuts)
        while at:
            if back[at] is None:
                at -= 1
                continue
            first, kind = back[at]
            out.append((cuts[first][0], kind, cuts[at - 1][1]))
            at = first
        return out[::-1]

    def learn(self, text: str, cuts: list[tuple[int, int]], gold: dict, rate: float) -> None:
        """One step on the log-likelihood of ``gold``: (first, last) -> type."""
        segments = self.segments(text, cuts)
        scores = {(first, last): [self.score(k, made) for k in range(OUTSIDE)]
                  for last, many in segments.items() for first, made in many}
        n = len(cuts)
        ahead, behind = [0.0] + [0.0] * n, [0.0] * (n + 1)
        for last in range(n):
            ahead[last + 1] = _sum_exp([ahead[last]] + [
                ahead[first] + s for first, _ in segments.get(last, ()) for s in scores[first, last]])
        starting = defaultdict(list)
        for first, last in scores:
            starting[first].append(last)
        for first in range(n - 1, -1, -1):
            behind[first] = _sum_exp([behind[first + 1]] + [
                behind[last + 1] + s for last in starting[first] for s in scores[first, last]])
        for last, many in segments.items():
            for first, made in many:
                for kind in range(OUTSIDE):
                    p = exp(min(0.0, ahead[first] + scores[first, last][kind] + behind[last + 1] - ahead[n]))
                    step = rate * ((gold.get((first, last)) == kind) - p)
                    if abs(step) > 1e-4:
                        self.weights[kind, "bias"] += step
                        for f in made:
                            self.weights[kind, f] += step


def _sum_exp(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


def trained(samples: list[str]) -> SemiMarkov:
    """From regions with what stands before and behind them, in the order given."""
    model = SemiMarkov()
    taught = []
    for i, text in enumerate(samples):
        taught.append(text)
        phones = [s for s in base_spans(text) if s[1] == 3]
        if phones and i % 3 == 0:  # the number without its country code
            start, _, end = phones[0]
            local = re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", text[start:end])
            taught.append((text[:start] + local + text[end:], (start, start + len(local))))
    for step in range(ROUNDS):
        for item in taught:
            text, local = item if isinstance(item, tuple) else (item, None)
            gold_spans = base_spans(text) if local is None else [(local[0], 3, local[1])]
            for start, end in regions(text):
                cuts = atoms(text, start, end)
                first = {a: i for i, (a, _) in enumerate(cuts)}
                last = {b: i for i, (_, b) in enumerate(cuts)}
                gold = {(first[a], last[b]): k for a, k, b in gold_spans if a in first and b in last}
                model.learn(text, cuts, gold, RATE / (1 + step))
    return model


def training_regions(docs: DataFrame) -> list[str]:
    """At most SAMPLE_REGIONS regions, of at most SAMPLE_DOCS documents chosen by a hash of the id."""
    def run(batches):
        for batch in parts(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                for start, end in regions(text):
                    if end - start <= 120:
                        out.append(text[max(0, start - 24):end + 8])
            yield pa.record_batch({"region": pa.array(out, pa.string())})

    some = docs.filter("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    shown = (some.filter(F.col("text").rlike("[0-9@]")).orderBy("h").limit(SAMPLE_DOCS)
             .select("text").mapInArrow(run, "region string").distinct()
             .orderBy(F.xxhash64("region"), "region").limit(SAMPLE_REGIONS))
    return [r.region for r in shown.collect()]


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns, base and spans (kind:start:end, comma-joined).

    Offsets are code points, ends exclusive. Spans that the model adds overlap no base span. Null
    and empty texts have none. Rows are answered one by one, also repeated ones and those with a null doc_id. Other columns
    are not read; an empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(dict(trained(training_regions(docs)).weights))

    def run(batches):
        model = SemiMarkov(weights.value)
        for batch in parts(batches):
            counts, base, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                fixed = base_spans(text)
                extra = added(text, fixed, model)
                for kind, out in enumerate(counts):
                    out.append(sum(k == kind for _, k, _ in fixed))
                base.append(spans_text(fixed))
                spans.append(spans_text(fixed + extra))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)},
                "base": pa.array(base, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def added(text: str, fixed, model: SemiMarkov) -> list[tuple[int, int, int]]:
    """What the model finds beside the base spans."""
    out = []
    for start, end in regions(text):
        if sum("0" <= c <= "9" for c in text[start:end]) < 4 and "@" not in text[start:end]:
            continue
        for a, kind, b in model.best(text, atoms(text, start, end)):
            if not any(s < b and a < e for s, _, e in fixed):
                out.append((a, kind, b))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
