"""Repeated spans against counts of all strings of the minimum length."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import span_dedup


def plain_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out


def texts_of(seed, n=60):
    rng = random.Random(seed)

    def prose(k):
        return "".join(rng.choice(["ab", "c", "é", "the ", "of ", "日本", "\n", "x"]) for _ in range(k))

    shared = [prose(rng.randint(20, 120)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else prose(rng.randint(1, 60)) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "", None, "z" * 500, "xy" * 130 + prose(50), "ab" * 900, None]
    return texts


@pytest.mark.parametrize("options", [
    {"min_bytes": 40, "gram": 8}, {"min_bytes": 40, "gram": 32, "block_bytes": 1000}, {"min_bytes": 200, "gram": 32},
    {"min_bytes": 33, "gram": 16, "hot_rows": 2}])
def test_equals_counts_of_all_strings(docs, options):
    texts = texts_of(5)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r._row.doc_id: r for r in span_dedup.remove_repeated(docs(rows), **options).collect()}
    want = plain_spans(texts, options["min_bytes"])
    assert {i: [tuple(s) for s in r.spans] for i, r in got.items()} == dict(enumerate(want)) and any(want)
    for i, (text, spans) in enumerate(zip(texts, want)):
        data = (text or "").encode()
        assert got[i].n_bytes == len(data) and got[i].n_removed == sum(e - s for s, e in spans)
        assert bytes(got[i].kept) == b"".join(
            data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)]))


def test_places_of_a_block():
    rng = random.Random(2)
    for length in (2, 5, 9, 20):
        bodies = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randint(length, 60))) for _ in range(12)]
        bodies = list(dict.fromkeys([*bodies, bodies[0] + b"a", b"a" * 50]))
        count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
        for body, got in zip(bodies, span_dedup.repeated_places(bodies, length)):
            assert got.tolist() == [count[body[i:i + length]] > 1 for i in range(len(body) - length + 1)]


def test_prefixes_come_by_increasing_length():
    data = np.frombuffer(b"mississippi$", dtype=np.uint8).astype(np.int64)
    codes = np.where(data == ord("$"), 0, data)
    left = np.arange(len(codes))[::-1].copy()
    order = span_dedup.prefix_order(codes, left, 20)
    suffixes = [bytes(data[i:].astype(np.uint8)) for i in order]
    assert suffixes == sorted(suffixes)
    for length in range(1, 6):
        new = [i == 0 or suffixes[i][:length] != suffixes[i - 1][:length] for i in range(len(suffixes))]
        assert span_dedup.interval_bounds(codes, order, length).tolist() == new


def test_long_texts_cross_the_parts(docs, monkeypatch):
    rng = random.Random(7)
    long = "".join(chr(97 + rng.randint(0, 25)) for _ in range(1_600_000))
    at = (1 << 20) - 100
    rows = [(1, long, "en", "s", 1), (2, "A" + long[at:at + 300] + "B", "en", "s", 1), (3, long[5000:5150], "en", "s", 1)]
    got = {r._row.doc_id: [tuple(s) for s in r.spans] for r in span_dedup.remove_repeated(docs(rows)).collect()}
    assert got == {1: [(at, at + 300)], 2: [(1, 301)], 3: []}


def test_copies_repeats_nulls_and_other_names(spark, docs):
    assert span_dedup.remove_repeated(docs([])).collect() == []
    text = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(100))
    schema = "key string, data string, lo long, copies long, gram string"
    named = spark.createDataFrame([(None, text, 1, 2, "g"), (None, text, 1, 2, "g"), ("a", "- " + text, 3, 4, None),
                                   ("b", text[:199], 5, 6, None), ("c", None, 7, 8, None)], schema)
    got = span_dedup.remove_repeated(named, text="data", id_col="key").collect()
    n = len(text)
    assert sorted((r._row.lo, [tuple(s) for s in r.spans]) for r in got) == [
        (1, [(0, n)]), (1, [(0, n)]), (3, [(2, n + 2)]), (5, []), (7, [])]
    with pytest.raises(ValueError):
        span_dedup.remove_repeated(named, text="data", id_col="key", gram=24)
