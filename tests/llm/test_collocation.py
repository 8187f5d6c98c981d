"""Collocations against plain counts of all runs of words."""

import random
import re
from collections import Counter

import pytest

from tallyspark.llm import collocation
from tests.conftest import plan_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def plain_collocations(rows, min_count=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = {}
    for (lang, run), a in f.items():
        if len(run) == 1 or a < min_count:
            continue
        if any(100 * m >= 50 * a for (o, long), m in f.items()
               if o == lang and len(long) == len(run) + 1 and m >= min_count and run in (long[:-1], long[1:])):
            continue
        cuts = []
        for k in range(1, len(run)):
            left, right = f[lang, run[:k]], f[lang, run[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(run).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "old", "MAN", "sea", "ünd", "日本", "x\x00", "ring", "bell", "a-b"]
    passage = "once upon a Time there\twas  one king of all the lands"
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";"])
                       for _ in range(rng.randint(0, 40)))
        rows.append((i, rng.choice([text, text + passage, passage + "! " + text, text, None]), rng.choice(["en", "en", "fr", None]),
                     "s", 1))
    return rows


@pytest.mark.parametrize("share", [1.5, 0.02])
def test_common_pairs_are_spread_without_a_change(docs, monkeypatch, share):
    monkeypatch.setattr(collocation, "HOT_SHARE", share)
    rows = rows_of(4)
    got = sorted(map(tuple, collocation.collocations(docs(rows), min_count=3).collect()))
    assert got == plain_collocations([r[1:3] for r in rows], 3)


@pytest.mark.parametrize("options", [{}, {"min_count": 3, "block_bytes": 60, "top": 20}])
def test_equals_plain_counts(docs, options):
    rows = rows_of(3)
    got = sorted(map(tuple, collocation.collocations(docs(rows), **options).collect()))
    plain = {k: v for k, v in options.items() if k in ("min_count", "top")}
    assert got == plain_collocations([r[1:3] for r in rows], **plain) and len(got) > 10


def test_texts_are_shuffled_once(docs):
    """The sums of edges and of nodes read the same exchange."""
    rows = [(1, "a b c d", "en", "s", 1)]
    plans = []
    write = collocation.store
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocation, "store", lambda df, *a: df.collect() and None or plans.append(plan_of(df)) or write(df, *a))
        collocation.build(docs(rows))
    assert "ReusedExchange" in plans[0][:plans[0].index("Initial Plan")]


def test_a_passage_is_one_path(docs):
    passage = "once upon a time there was one king of all"
    rows = [(i, f"{passage}. odd{i} word{i}", "en", "s", 1) for i in range(12)] + [(99, "of all things", "en", "s", 1)]
    graph = collocation.build(docs(rows))
    paths = collocation.compact(graph).collect()
    assert [(" ".join(p.words), p.n, p.flow_in, p.flow_out) for p in paths] == [(passage, 12, 12, 13)]


def test_long_piece_and_path(docs):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words), "en", "s", 1) for i in range(10)]
    paths = collocation.compact(collocation.build(docs(rows), block_bytes=500)).collect()
    assert [p.words for p in paths] == [words] and paths[0].n == 10
    repeated = [(i, "la " * 5000, "en", "s", 1) for i in range(2)]
    got = sorted(map(tuple, collocation.collocations(docs(repeated), block_bytes=4000).collect()))
    assert got == plain_collocations([r[1:3] for r in repeated])


def test_empty_nulls_and_other_names(spark, docs):
    assert collocation.collocations(docs([])).collect() == []
    assert collocation.collocations(docs([(1, None, None, None, None), (2, "", "en", "s", 0)])).collect() == []
    named = spark.createDataFrame([("a b. a b", "en", 1, "x")] * 5, "node string, next string, n int, key string")
    got = [tuple(r) for r in collocation.collocations(named, text="node", lang="next").collect()]
    assert got == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([(10**14, 10**14 + 1, 10**14)], "a long, l long, r long")
    got = counts.select(collocation._score(counts.a, counts.l, counts.r)).first()[0]
    assert got == 10**6 * 10**28 // ((10**14 + 1) * 10**14)
