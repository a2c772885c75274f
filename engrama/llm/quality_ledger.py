"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit r is set where rule r fails. A policy is a versioned
mask over those bits: applying one, or asking what a rule contributes to it,
reads the ledger and never the texts again.

No shuffle: the ledger is one projection over the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.columns import GAPS, count_of, hash_windows, let, plain_words, whole, word_hashes
from engrama.llm.shared import quoted, unused

REPEAT_WIDTH = 8
SYMBOLS = "#*$%&|<>"
MARKS = "!?"


@dataclass(frozen=True)
class Policy:
    """Documents that fail any rule of ``rules`` are rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_BITS[r] for r in self.rules)


def _rules() -> list[tuple[str, Column]]:
    """Name and failure condition, over the measurements. The order fixes the bits; append only."""
    n = F.col("n_words")
    return [
        ("too_few_words", n < 20),
        ("repeated_windows", 100 * F.col("n_repeat_words") > 30 * n),
        ("symbol_heavy", 10 * F.col("n_symbols") > 3 * n),
        ("shouting_marks", 10 * F.col("n_marks") > 3 * n),
        ("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        ("short_words", F.col("word_chars") < 2 * n),
        ("long_words", F.col("word_chars") > 15 * n),
        ("few_letters", 10 * F.col("n_letters") < 4 * F.col("word_chars")),
        ("stuttered_words", 10 * F.col("n_stutters") > 3 * n),
    ]


RULES = ("too_few_words", "repeated_windows", "symbol_heavy", "shouting_marks", "repeated_lines", "short_words", "long_words", "few_letters", "stuttered_words")
RULE_BITS = {name: bit for bit, name in enumerate(RULES)}
BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STRICT = Policy("strict", 1, RULES)
#: What the ledger is read under; a changed policy is a new version.
POLICIES = (BASE, STRICT, Policy("strict", 2, RULES[:-1]))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_letters", "n_stutters")


def repeated_words(singles: Column, width: int = REPEAT_WIDTH) -> Column:
    """From the hash of each word: words inside windows of ``width`` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(placed, lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, j + 1)["h"] == x["h"]).eqNullSafe(True)))
        starts = F.sort_array(F.transform(twins, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last"))
        return F.aggregate(starts, zero, lambda acc, i: F.struct((acc["total"] + F.least(F.lit(width), i - acc["last"])).alias("total"), i.alias("last")))["total"]

    return let(hash_windows(singles, width), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("long")


def stutters(singles: Column) -> Column:
    """From the hash of each word: words equal to the word before them."""
    same = F.zip_with(singles, F.slice(singles, F.lit(2), F.size(singles)), lambda a, b: F.when(a == b, 1))
    return F.size(F.array_compact(same)).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failure_bits``.

    A null or empty text has no words, so it fails ``too_few_words`` and every
    other measurement is 0. Repeated rows are measured each on its own, very
    long texts whole. Columns of ``docs`` that bear the name of a measurement,
    in whatever case, are replaced; all others stay. An empty table gives no rows.
    """
    added = {*MEASURES, "failure_bits"}
    keep = [c for c in docs.columns if c.lower() not in added]
    w, l, m = (unused(keep, name) for name in ("counted", "lined", "rest"))
    body = whole(docs[text])
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(GAPS))) > 0)
    counted = let(word_hashes(plain_words(body)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), stutters(w).alias("n_stutters")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = F.length(body)
    # what is no letter is a fifth of a text, so the counts of characters read only that
    rest = let(F.regexp_replace(body, "\\p{L}+", ""), lambda r: F.struct(
        (chars - F.length(r)).cast("long").alias("n_letters"),
        (chars - count_of(r, GAPS)).cast("long").alias("word_chars"),
        count_of(r, SYMBOLS).alias("n_symbols"),
        count_of(r, MARKS).alias("n_marks"),
    ))
    measured = docs.select(*map(quoted, keep), counted.alias(w), lined.alias(l), rest.alias(m)).select(*map(quoted, keep), f"{w}.*", f"{l}.*", f"{m}.*")
    bits = None
    for bit, (_, fails) in enumerate(_rules()):
        one = F.when(fails, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = one if bits is None else bits.bitwiseOR(one)
    return measured.withColumn("failure_bits", bits)


def passes(policy: Policy, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The rows of a ledger that the policy keeps."""
    return rows.filter(passes(policy))


def ablations(rows: DataFrame, policies: list[Policy] | tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, that fail it alone, and what is kept without it.

    The ledger is first reduced to its distinct bit patterns (at most 2 to the
    number of rules), so the policies cost nothing that grows with the corpus.
    An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    tests = rows.sparkSession.createDataFrame([(p.name, p.version, p.mask, r, 1 << RULE_BITS[r]) for p in policies for r in p.rules], "policy string, version int, mask long, rule string, bit long")
    failed = F.col("failure_bits").bitwiseAND(F.col("mask"))
    per = patterns.join(F.broadcast(tests))  # a fixed list of rules against distinct patterns
    n = F.col("n")
    return per.groupBy("policy", "version", "rule").agg(
        F.sum(n).alias("documents"),
        F.sum(F.when(failed == 0, n).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("failing"),
        F.sum(F.when(failed == F.col("bit"), n).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n).otherwise(0)).alias("kept_without"),
        F.bit_or(F.when(failed != 0, F.col("failure_bits")).otherwise(F.lit(0).cast("long"))).alias("bits_seen"),
    )
