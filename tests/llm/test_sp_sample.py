"""Sampled segmentations: exact weights, distinctness, draws without replacement, and the round trip."""

import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import sp_sample
from tallyspark.llm.common import Numbers
from tallyspark.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def trie():
    return sp_sample.Trie(sp_sample.load_vocabulary(TOKENIZER))


@pytest.fixture(scope="module")
def small():
    """A vocabulary of a few pieces over a, b, c; d is unknown."""
    pieces = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc", "é"]
    weights = np.log(np.arange(len(pieces), 0, -1) / sum(range(len(pieces) + 1)))
    texts = [p.replace("▁", " ").encode() for p in pieces] + [bytes([b]) for b in range(256)]
    return sp_sample.Trie(sp_sample.Vocabulary(pieces, np.arange(len(pieces), dtype=np.int32), weights,
                                               np.arange(len(pieces), len(pieces) + 256, dtype=np.int32), texts))


def segmentations(text, vocabulary):
    """All segmentations as tuples of ids, with their probabilities."""
    weight = {p: (int(i), float(w)) for p, i, w in zip(vocabulary.pieces, vocabulary.ids, vocabulary.weights)}

    def of_unit(unit):
        if not unit:
            return [((), 0.0)]
        out = []
        for n in range(1, len(unit) + 1):
            head = None
            if unit[:n] in weight:
                head = ((weight[unit[:n]][0],), weight[unit[:n]][1])
            elif n == 1:
                data = unit[0].replace("▁", " ").encode()
                head = (tuple(int(vocabulary.byte_ids[b]) for b in data), vocabulary.unknown_weight * len(data))
            if head:
                out += [(head[0] + ids, head[1] + w) for ids, w in of_unit(unit[n:])]
        return out

    units = [of_unit("▁" + u) for u in text.split(" ")] if text else []
    found = {}
    for parts in itertools.product(*units):
        found[sum((p[0] for p in parts), ())] = sum(p[1] for p in parts)
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: w - total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["", "a", "abc", "ab abc", "abd é", "d", " ", "  a", "abcabcabc"])
def test_weights_and_exhaustion_are_exact(small, text):
    """Asked for more than there are, every segmentation comes once, with its probability."""
    want = segmentations(text, small.vocabulary)
    drawn = sp_sample.sample_texts([text], ["key"], small, 10_000)[0]
    got = {tuple(ids.tolist()): logp for logp, _, _, ids in drawn}
    assert len(got) == len(drawn) == len(want)
    assert got == pytest.approx(want, abs=1e-9)
    keys = [key for _, key, _, _ in drawn]
    assert keys == sorted(keys, reverse=True) and {s for _, _, s, _ in drawn} == {1.0}


def test_pairs_are_drawn_without_replacement(small, monkeypatch):
    """The frequency of each ordered pair equals p(first) p(second) / (1 - p(first)), with tails opened early and late."""
    text = "abc ab"
    want = {k: math.exp(v) for k, v in segmentations(text, small.vocabulary).items()}
    for near in (1, 8):
        monkeypatch.setattr(sp_sample, "NEAR", near)
        n = 6000
        drawn = sp_sample.sample_texts([text] * n, [str(i) for i in range(n)], small, 2)
        pairs = Counter((tuple(d[0][3].tolist()), tuple(d[1][3].tolist())) for d in drawn)
        assert all(a != b for a, b in pairs)
        for a, b in itertools.permutations(want, 2):
            p = want[a] * want[b] / (1 - want[a])
            assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 5 / n  # the last for the rarest pairs


def test_inclusion_scores_are_unbiased(small):
    """Weighted by probability over inclusion score, the samples' counts estimate the number of segmentations ending in c."""
    text, n = "abc", 4000
    want = segmentations(text, small.vocabulary)
    truth = sum(math.exp(w) for ids, w in want.items() if len(ids) == 2)
    drawn = sp_sample.sample_texts([text] * n, [f"x{i}" for i in range(n)], small, 2)
    estimates = [sum(math.exp(logp) / score for logp, _, score, ids in d if len(ids) == 2) for d in drawn]
    assert abs(np.mean(estimates) - truth) < 5 * np.std(estimates) / math.sqrt(n)


def texts():
    rng = random.Random(8)
    made = [None, "", " ", "   two  spaces ", "▁ is a character here", "\n\t\x00\r", "日本語 and 😀 and é", "x" * 3000,
            "the end " * 800]
    return made + ["".join(rng.choices("abcdeé \n.,ß1", k=rng.randint(1, 200))) for _ in range(40)]


def test_round_trip_and_repeatability(spark, trie):
    rows = [(i, t, "key", 0.5) for i, t in enumerate(texts())] + [(None, "one of them", "x", 0.1), (3, texts()[3], "y", 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, inclusion double").repartition(3)
    got = sp_sample.encode(df, TOKENIZER, k=3)
    decoded = got.withColumn("text", sp_sample.decode(got["ids"], TOKENIZER)).collect()
    by_doc = {}
    for row in decoded:
        by_doc.setdefault((row.doc_id, row.text), set()).add((row.sample, tuple(row.ids), row.key, row.inclusion))
        assert row.round_trip and row.log_prob <= 1e-9 and 0 < row.inclusion <= 1
    assert set(by_doc) == {(r[0], r[1] or "") for r in rows}
    for samples in by_doc.values():
        ids = [s[1] for s in samples]
        assert len(set(ids)) == len(ids) and sorted(s[0] for s in samples) == list(range(1, len(samples) + 1))
    assert len(by_doc[0, ""]) == 1 and len(by_doc[8, texts()[8]]) == 3
    alone = sp_sample.sample_texts([texts()[3]], ["=3"], trie, 3)[0]
    assert {tuple(ids.tolist()) for _, _, _, ids in alone} == {s[1] for s in by_doc[3, texts()[3]]}
    assert sp_sample.encode(df.limit(0), TOKENIZER).count() == 0


def test_ids_are_those_of_the_model(trie):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    for text in texts():
        for _, _, _, ids in sp_sample.sample_texts([text], ["k"], trie, 2)[0]:
            assert model.decode(ids.tolist()) == (text or "").replace("▁", "▁")


def test_kept_lattices_change_nothing(trie):
    """Units met before, forgotten ones and new ones have the arcs they have by themselves."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    met = sp_sample.Units(trie, max_arcs=1500)
    forgotten = 0
    for _ in range(12):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) or None for _ in range(5)]
        before = len(met.numbers)
        lattice, types = met.of(texts)
        forgotten += len(met.numbers) < before
        for text, own in zip(texts, types):
            units = text.split(" ") if text else []
            assert [list(met.numbers)[u] for u in own] == units
            for unit, u in zip(units, own.tolist()):
                alone = sp_sample.Lattice([unit], trie)
                a, z = int(lattice.start[u]), int(lattice.end[u])
                arcs = slice(int(lattice.first[a]), int(lattice.first[z]))
                assert z - a == alone.end[0] and (lattice.to[arcs] - a).tolist() == alone.to.tolist()
                assert np.diff(lattice.first[a:z + 1]).tolist() == np.diff(alone.first).tolist()
                for column in ("logp", "others", "ids"):
                    assert np.allclose(getattr(lattice, column)[arcs], getattr(alone, column))
                assert {k - arcs.start: v.tolist() for k, v in lattice.bytes_of.items() if arcs.start <= k < arcs.stop} == {
                    k: v.tolist() for k, v in alone.bytes_of.items()}
    assert forgotten


class CountedNumbers(Numbers):
    asked = 0

    def __getitem__(self, key):
        CountedNumbers.asked += 1
        return super().__getitem__(key)


def test_distinct_units_are_looked_up_once(small, monkeypatch):
    """However often a unit stands in a list of texts, it is looked up once."""
    monkeypatch.setattr(sp_sample, "Numbers", CountedNumbers)
    met = sp_sample.Units(small)
    texts = ["ab abc ab", None, "", "ab  abc ", " ", "é \ud800 ab"] * 50
    cut = [t.split(" ") if t else [] for t in texts]
    for _ in range(2):
        CountedNumbers.asked = 0
        _, types = met.of(texts)
        names = list(met.numbers)
        assert [[names[u] for u in own] for own in types] == cut
        assert CountedNumbers.asked == len(names) == len(set(itertools.chain(*cut)))


def test_units_of_pieces_are_found_through_all_parents(small):
    """Drawn deep, a segmentation still knows the unit of each of its pieces."""
    text = "abc ab  dé abcabc"
    lattice, types = sp_sample.Units(small).of([text])
    places = sp_sample._Places(types, [5])
    search = sp_sample.Search(lattice, random.Random(5))
    opened = (None, None)
    with np.errstate(divide="ignore"):
        for turn in range(60):
            sp_sample._draw_round([(0, *opened)], places, [search], lattice, turn)
            opened = search.open()
    own = types[0].tolist()
    for leaf in search.leaves:
        unit, at, want = 0, int(lattice.start[own[0]]), []
        for arc in leaf.arcs.tolist():
            want.append(unit)
            assert lattice.first[at] <= arc < lattice.first[at + 1]
            at = int(lattice.to[arc])
            if at == lattice.end[own[unit]] and unit + 1 < len(own):
                unit += 1
                at = int(lattice.start[own[unit]])
        assert [leaf.unit(i) for i in range(len(leaf.arcs))] == want
    assert max(leaf.drawn for leaf in search.leaves) > 3


def test_memory_of_a_task_is_bounded(spark, monkeypatch):
    """Many different units and a batch of long texts: neither all their lattices nor all texts are held at once."""
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(4, 14))) for _ in range(300_000)]
    texts = [" ".join(words[at:at + 1000]) for at in range(0, len(words), 1000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(len(texts))], "text": texts})
    given = []
    df = spark.createDataFrame([], "doc_id long, text string")
    as_is = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *rest: given.append(f) or as_is(self, f, *rest))
    sp_sample.encode(df, TOKENIZER)
    del words, texts
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in given[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows == 300 * 2 + 2
    assert peak < 150
