"""Subword buckets against a plain loop, accuracy on held-out documents, and rejection."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyspark.llm import lang_id
from tallyspark.llm.common import crc_remainder

_SYLLABLES = {"xa": ["ba", "ko", "mi", "tu"], "yb": ["ster", "gren", "olk", "und"], "zc": ["ção", "nhe", "lh", "õe"]}


def plain_buckets(text):
    factors = [int(f) for f in lang_id._FACTORS]
    chars = [0] + [ord(c.lower()) if c.isalpha() else 0 for c in text] + [0, 0]
    out = []
    for before, middle, after in zip(chars, chars[1:], chars[2:]):
        hashes = [before * factors[1] + middle * factors[0] + 2] if before or middle else []
        if middle:
            hashes += [middle * factors[0], before * factors[1] + middle * factors[0] + after * factors[2] + 3]
        for h in hashes:
            h &= 0xFFFFFFFF
            out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 18)
    return np.bincount(np.array(out, dtype=int), minlength=lang_id.BUCKETS)


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 19])
def test_buckets_equal_a_plain_loop(monkeypatch, piece):
    monkeypatch.setattr(lang_id, "PIECE", piece)
    rng = random.Random(piece)
    for text in ["", "a", "Éa b.", " x ", "12", "日本 a"] + ["".join(rng.choices("abÉ .1", k=60)) for _ in range(10)]:
        got = sum((np.bincount(b, minlength=lang_id.BUCKETS) for b in lang_id.bucket_stream(text)), 0)
        assert (got == plain_buckets(text)).all()


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(_SYLLABLES))
        words = ["".join(rng.choices(_SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


@pytest.fixture(scope="module")
def predicted(spark):
    rows = documents(400, 1) + [(1000, None, "xa"), (1001, "", "yb"), (1002, "123 !?", "zc"), (1003, "ba ko mi", None),
                                (None, "ster gren", "xa"), (1004, "ba tu " * 30_000, "xa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = crc_remainder(F.col("doc_id"), 5)
    model = lang_id.train(df.filter(held != 0))
    got = df.select("doc_id", "lang", (held == 0).alias("held"), lang_id.predict_column(F.col("text"), model).alias("p"))
    return df, model, got.select("doc_id", "lang", "held", "p.*").collect()


def test_held_out_accuracy(predicted):
    held = [r for r in predicted[2] if r.held and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in predicted[2])


def test_texts_without_letters_are_undetermined(predicted):
    by_id = {r.doc_id: r for r in predicted[2]}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False)
    assert by_id[1003].lang_pred == "xa" and by_id[None].lang_pred == "yb" and by_id[1004].lang_pred == "xa"


def test_predictions_equal_the_two_layers(predicted):
    """The table of the model is the embeddings times the output layer: averaged buckets give the score."""
    model = predicted[1]
    counts = plain_buckets("Ba ko stergren")
    scores = counts @ model.table / counts.sum() + model.bias
    share = lang_id.softmax(scores[None] / model.temperature)[0]
    name, score, accepted = model.predict("Ba ko stergren")
    assert (name, accepted) == (model.languages[share.argmax()], share.max() >= model.threshold)
    assert score == pytest.approx(share.max())


def test_training_repeats_and_rejection_is_calibrated(predicted):
    df, model, _ = predicted
    again = lang_id.train(df.repartition(5).filter(crc_remainder(F.col("doc_id"), 5) != 0))
    assert (again.table == model.table).all()
    assert lang_id._threshold(np.array([0.9, 0.8, 0.7]), np.array([True, True, False])) == 0.8
    assert lang_id._threshold(np.array([0.9]), np.array([False])) > 1


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "ba", None), (2, None, "xa")], "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert model.languages == [] and model.predict("ba") == ("und", 0.0, False)
    assert lang_id.train(df.limit(0)).languages == []
    one = lang_id.train(spark.createDataFrame([(1, "ba", "xa")], df.schema))
    assert one.predict("ko")[:2] == ("xa", 1.0)


def test_repeated_rows_take_one_place(spark):
    """A row repeated more often than a label has places, with the smallest hash, leaves the other documents theirs."""
    rows = documents(60, 7)
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = labelled.filter("lang = 'xa'").orderBy(F.xxhash64("doc_id")).first()
    copied = labelled.unionByName(spark.createDataFrame([tuple(least)] * 40, labelled.schema))
    want, got = lang_id.train(labelled, per_label=30), lang_id.train(copied, per_label=30)
    assert got.languages == want.languages == sorted(_SYLLABLES)
    assert np.array_equal(got.table, want.table) and np.array_equal(got.bias, want.bias)
