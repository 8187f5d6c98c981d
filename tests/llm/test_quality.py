"""Measurements against plain counting; the ledger, policies and ablations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(covered))


def texts():
    rng = random.Random(3)
    made = [None, "", " \n\t\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "a b c d e x a b c d e", "é ü\u00a0ß", "x\r\nx\r\nx",
            "l\nl\n \nl ", "#*$%&|<>", "word " * 3000, "w" * 100_000]
    for _ in range(80):
        made.append("".join(rng.choices(["a", "b", " ", "\n", "é", "|", "  ", "\t"], k=rng.randint(1, 120))))
    return made


def test_measurements_equal_plain_counting():
    for text in texts():
        assert quality.measure_text(text) == plain(text), repr(text)[:100]


def test_ledger_keeps_rows_and_clashing_columns(docs):
    rows = [(i % 5 or None, t, "n_words") for i, t in enumerate(texts()) if t is None or len(t) < 2000]
    df = docs(rows, "doc_id long, text string, n_words string")
    got = quality.ledger(df)
    assert got.count() == len(rows) and got.filter("n_words <> 'n_words'").count() == 0
    for row in got.collect():
        measured = dict(zip((c.split()[0] for c in quality.MEASURES.split(", ")), plain(row.text)))
        assert row._measures.asDict() == measured
        fails = {"few_words": measured["n_words"] < 10,
                 "repeated_windows": 100 * measured["n_repeat_words"] > 20 * measured["n_words"]}
        assert [bool(row._failed >> i & 1) for i in (0, 1)] == [fails["few_words"], fails["repeated_windows"]]
    assert quality.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    written = spark.createDataFrame([(b,) for b in [0, 0, 1, 1, 1, 2, 3, 4]], "_failed long")
    policy = quality.Policy("p-1", ("few_words", "repeated_windows"))
    assert written.filter(quality.passes(policy)).count() == 3
    got = {r.rule: tuple(r[1:]) for r in quality.ablations(written, policy).collect()}
    assert got == {"few_words": (4, 3, 6), "repeated_windows": (2, 1, 4)}
    assert {r.n_failed for r in quality.ablations(written.limit(0), policy).collect()} <= {0}
    with pytest.raises(ValueError):
        quality.Policy("p-2", ("unheard of",)).mask()


def test_bits_of_all_rules(spark):
    fields = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    rows = [((5, 20, 0, 1, 0, 0),), ((100, 150, 41, 5, 3, 21),), ((100, 2600, 40, 5, 2, 20),), ((0, 0, 0, 0, 0, 0),)]
    df = spark.createDataFrame(rows, f"_measures struct<{fields.replace(' long', ': long')}>")
    assert [r[0] for r in df.select(quality.ledger_bits()).collect()] == [1, 2 | 4 | 16 | 32, 8, 1]
    assert F.col  # the ledger is a column expression, nothing is collected
