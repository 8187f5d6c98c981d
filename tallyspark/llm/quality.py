"""Quality rules as a bitmask ledger.

Each text is measured once. Every rule is evaluated once on the measurements, and the ledger stores the failures as one
bit per rule. Policies are versioned sets of rules: applying one is a bitwise test, and ablations (what would each rule
alone have rejected, what would be kept without it) aggregate the distinct bit patterns, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = "#*$%&|<>"


class QualityRule(NamedTuple):
    """A text fails the rule when ``fails``, an SQL condition on the measurements, is true."""

    name: str
    fails: str


#: Bit i of the ledger is rule i. New rules go to the end, so that stored ledgers stay readable.
RULES = (
    QualityRule("few_words", "n_words < 10"),
    QualityRule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    QualityRule("short_words", "word_chars < 2 * n_words"),
    QualityRule("long_words", "word_chars > 25 * n_words"),
    QualityRule("symbols", "5 * n_symbols > 2 * n_words"),
    QualityRule("repeated_lines", "n_lines > 4 AND 2 * n_dup_lines > n_lines"),
)


class Policy(NamedTuple):
    """A named, numbered choice of rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[QualityRule, ...] = RULES) -> int:
        known = [r.name for r in rules]
        return sum(1 << known.index(name) for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def repeated_words(words: list[bytes] | list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice; exact, windows are numbered, not hashed."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    windows = ids[:n]
    for k in range(1, width):
        windows = windows * len(numbers) + ids[k:k + n]
        if k + 1 < width:  # renumbered so that the product always fits 64 bits
            windows = np.unique(windows, return_inverse=True)[1].reshape(-1)
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(count[inverse.reshape(-1)] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measurements of one text, in the order of ``MEASURES``; a null text has no words and no lines."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            repeated_words(words))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_measures``.

    Lines without a word count nowhere; equal lines are compared byte by byte. A null or empty text measures 0 throughout.
    Columns of ``docs`` are passed through whatever their names, save ``_measures``.
    """

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEASURES.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure_text(t) for t in texts], columns=columns, dtype="int64")

    return docs.withColumn("_measures", measures(F.col(f"`{text_col}`")))


def ledger_bits(rules: tuple[QualityRule, ...] = RULES, measures: str = "_measures") -> Column:
    """The failure bits of all rules as one long."""
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    fields = [c.split()[0] for c in MEASURES.split(", ")]

    def qualified(condition: str) -> str:
        for field in fields:
            condition = condition.replace(field, f"{measures}.{field}")
        return condition

    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(qualified(rule.fails)), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[QualityRule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_measures`` and ``_failed`` (bits of the rules that failed); rows are neither moved nor dropped."""
    return measure(docs, text_col).withColumn("_failed", ledger_bits(rules))


def passes(policy: Policy, rules: tuple[QualityRule, ...] = RULES, failed: str = "_failed") -> Column:
    """True where no rule of ``policy`` failed."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(written: DataFrame, policy: Policy, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """Per rule of ``policy``: ``n_failed``, ``n_only`` (rejected by this rule alone), ``n_kept_without``.

    ``written`` is a ledger. It is first reduced to one row per bit pattern (at most 2 to the number of rules).
    """
    mask = policy.mask(rules)
    patterns = (written.groupBy(F.col("_failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
                .agg(F.count(F.lit(1)).alias("n")))
    chosen = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    per_rule = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                         for i, name in chosen])
    spread = patterns.select("bits", "n", F.explode(per_rule).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total((F.col("bits") == F.col("bit")) | (F.col("bits") == 0)).alias("n_kept_without"))
