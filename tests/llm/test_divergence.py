"""Divergence of sources against plain loops over whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, min_docs, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: {t: c[t] for t in kept} for (own, s), c in counts.items() if own == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def shares(table):
            below = sum(table.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // below for t, n in table.items()}

        q, p = shares(whole), {s: shares(g) for s, g in groups.items()}
        for s, own in p.items():
            pairs = [(-sum(abs(own[t] - o[t]) for t in kept), r) for r, o in p.items() if r != s]
            terms = [(q[t] - own[t], t) for t in kept if groups[s][t] and own[t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (f[0], f[1].encode()))
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def rows_of(seed, n=200, sources=7, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ünder", "日本", "x", "it's", "A1b", "zeta", "ETA", "rare%d"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words).replace("%d", chr(97 + i % 26)) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, None]), rng.choice(langs),
                     rng.choice([f"s{rng.randint(0, sources)}", "s0", None]), 1))
    return rows


@pytest.mark.parametrize("group_block, term_block", [(16, 4096), (2, 2)])
def test_equals_plain_loops(docs, group_block, term_block):
    rows = rows_of(1)
    found = divergence.audit(docs(rows), min_docs=5, group_block=group_block, term_block=term_block)
    got = sorted(map(tuple, divergence.ranked(found, 4).collect()))
    assert got == plain_audit([r[1:4] for r in rows], 5, 4) and {r[2] for r in got} == {"pair", "term"}


def test_many_sources_stay_within_cells(docs):
    rows = rows_of(2, n=300, sources=40, langs=("en",))
    found = divergence.audit(docs(rows), min_docs=3, group_block=4, term_block=3)
    assert sorted(map(tuple, divergence.ranked(found).collect())) == plain_audit([r[1:4] for r in rows], 3)


def test_without_kept_terms_and_ties(docs):
    rows = [(1, "one two", "en", "a", 1), (2, "three", "en", "b", 1), (3, None, "en", "c", 1), (4, "", "fr", "a", 1),
            (5, "x", None, None, 1)]
    found = divergence.audit(docs(rows))
    assert sorted(map(tuple, divergence.ranked(found).collect())) == [
        ("en", s, "pair", o, 0, i + 1) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(others)]


def test_empty_table_repeats_and_other_names(spark, docs):
    assert divergence.ranked(divergence.audit(docs([]))).collect() == []
    rows = [(1, "a b b", "en", "s", 1)] * 30 + [(2, "a c", "en", "t", 1)] * 2
    assert sorted(map(tuple, divergence.ranked(divergence.audit(docs(rows))).collect())) == plain_audit([r[1:4] for r in rows], 30)
    named = spark.createDataFrame([("w w", "de", "s", 1, "k")] * 30, "term string, n string, block string, p int, key string")
    found = divergence.ranked(divergence.audit(named, text="term", lang="n", source="block"))
    assert found.collect() == []  # one source, whose shares are those of the language


def test_long_text_and_whole_numbers(docs):
    text = "word " * 300_000 + "Ärger"
    rows = [(i, text if i == 0 else "word Ärger none", "en", f"s{i % 3}", 1) for i in range(40)]
    found = divergence.audit(docs(rows))
    assert sorted(map(tuple, divergence.ranked(found).collect())) == plain_audit([r[1:4] for r in rows], 30)
