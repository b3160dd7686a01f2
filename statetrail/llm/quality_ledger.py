"""Quality rules as a bitmask ledger.

Each text is measured once and every rule evaluated once; the ledger holds the measurements and
one bit for each rule that failed. Policies are versioned sets of rules: a verdict is the test
of a mask, and what a rule adds to a policy (ablation) is counted from the masks alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements; whole numbers only, so that it is exact."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("short_words", 3, "word_chars < 3 * n_words"),
    Rule("long_words", 4, "word_chars > 12 * n_words"),
    Rule("repeated_lines", 5, "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_letters", 6, "100 * n_letters < 60 * word_chars"),
    Rule("very_long", 7, "n_words > 100000"),
)

#: Versions of what is kept, by the names of their rules. Versions are added, never changed.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "many_symbols", "short_words", "long_words",
               "repeated_lines", "few_letters"),
    "2024-1-strict": tuple(r.name for r in RULES),
}
CURRENT = "2024-1"


def mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def _measured(docs: DataFrame) -> DataFrame:
    """The measurements. Positions of repeated windows are sorted only where some are repeated."""
    words = F.array_remove(F.split("text", BETWEEN_WORDS), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select("doc_id", text_or_empty(docs).alias("text")).select(
        "doc_id", words.alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    read = read.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"), F.col("n_letters").cast("long"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, window).alias("windows"))
    tagged = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    read = read.withColumn("tagged", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), tagged)).drop("windows")
    same = F.filter("tagged", lambda x, j: F.coalesce(
        (j > 0) & (F.get("tagged", F.greatest(j - 1, F.lit(0)))["w"] == x["w"]), F.lit(False))
        | F.coalesce(F.get("tagged", j + 1)["w"] == x["w"], F.lit(False)))
    read = read.withColumn("starts", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("tagged")
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + 3 - F.greatest(a["end"], s)).alias("n"), (s + 3).alias("end")),
        lambda a: a["n"])
    return read.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def failures() -> Column:
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and ``failures``, the bits of the rules that failed.

    Null and empty texts have no words: all measurements are 0 and ``few_words`` fails. Rows are
    answered one by one, also repeated ones and those with a null doc_id. Other columns are not
    read; an empty table gives no rows.
    """
    return _measured(docs).withColumn("failures", failures())


def verdict(policy: str = CURRENT) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only: documents that fail it, and those that no other rule rejects.

    Documents are first counted by failure bits, of which there are few, and the rules are then
    looked up in the bits. ``n_only`` is what the policy would keep in addition without the rule.
    """
    own = mask(policy)
    counted = rows.groupBy(F.col("failures").bitwiseAND(F.lit(own)).alias("bits")).agg(
        F.count("*").alias("n"))
    of_rule = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
               for r in RULES if r.name in POLICIES[policy]]
    each = counted.select("bits", "n", F.inline(F.array(*of_rule)))
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))),
                   F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = ~verdict("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict()).alias("kept"), "n_lines", "failures")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM
      (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST((n_words < 50) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 50 * n_words) AS BIGINT)
    + 4 * CAST((10 * n_symbols > n_words) AS BIGINT) + 8 * CAST((word_chars < 3 * n_words) AS BIGINT)
    + 16 * CAST((word_chars > 12 * n_words) AS BIGINT)
    + 32 * CAST((100 * n_dup_lines > 30 * n_lines) AS BIGINT)
    + 64 * CAST((100 * n_letters < 60 * word_chars) AS BIGINT)
    + 128 * CAST((n_words > 100000) AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  failures & 127 = 0 AS kept, n_lines, failures
FROM f"""
