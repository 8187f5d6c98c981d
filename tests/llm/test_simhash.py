"""Fingerprints and components against plain loops; long index lists; groups of copies."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def plain_fingerprint(text, shingle=4):
    words = plain_words(text)
    if not words:
        return 0
    pieces = [words[i:i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits):
    """The smallest position reachable from each."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "THE"]
    made = [None, "", " \t\n", "one", "One", "one two three", "a b c d", "a b c d e", "x " * 20_000]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        made.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = "changed"
            made.append("\n".join(base))
    return made + made[10:14]


def test_spark_and_library_hash_alike(spark):
    df = spark.createDataFrame([("a b c d",)], "s string")
    assert df.select(F.xxhash64("s")).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_near_duplicates_equal_plain_loops(docs):
    made = texts()
    prints = [plain_fingerprint(t) for t in made]
    assert [simhash.fingerprint(t) for t in made] == prints
    df = docs([(i, t, "fp", "root", 0) for i, t in enumerate(made)], "doc_id long, text string, fp string, root string, n int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(zip(prints, plain_components(prints, 4))))


@pytest.mark.parametrize("max_bits, list_rows", [(4, 4096), (4, 3), (2, 3)])
def test_links_join_what_is_similar(spark, monkeypatch, max_bits, list_rows):
    """Chains, dense clusters and lone fingerprints, with lists short enough to be posted again."""
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    rng = random.Random(max_bits * 10 + list_rows)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(15):
            prints.add(at)
            for _ in range(rng.choice([1, max_bits, max_bits, max_bits + 1])):
                at ^= 1 << rng.randrange(64)
    prints |= {rng.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.similar_links(df, max_bits)).collect()}
    want = plain_components(prints, max_bits)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(w, set()).add(p)
    for members in groups.values():
        found = {roots.get(p, p) for p in members}
        assert len(found) == 1 and (len(members) == 1 or found == {min(members)})


def test_a_long_path_is_one_component(spark):
    df = spark.range(150).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert simhash.components(df).select("root").distinct().count() == 1


def test_keep_one_of_each_group(docs):
    same = "the same text in all of these rows here"
    rows = [(3, same, "x"), (1, same, "y"), (1, same, "y"), (None, same, "z"), (5, "quite another text with other words", "x"),
            (None, "", "x"), (None, None, "x"), (None, "", "x"), (5, same, "q")]
    kept = simhash.keep_one(docs(rows, "doc_id long, text string, _key string"))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted([(1, same), (5, "quite another text with other words"), (None, "")], key=repr)
    assert kept.columns == ["doc_id", "text", "_key"]


def test_keep_one_without_broadcast(docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice([3, 4, 6])))) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(2000 + i, None) for i in range(5)]
    table = docs(rows, "doc_id long, text string")
    few = sorted(r.doc_id for r in simhash.keep_one(table).collect())
    monkeypatch.setattr("tallyspark.operators.scale.is_small", lambda df, n=0: False)
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == few and 7 < len(few) < 401


def test_empty_table_and_bad_parameter(docs):
    empty = docs([(1, "a")], "doc_id long, text string").limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(empty, max_bits=5)
