"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of one to three letters of a lower-cased word, its edges marked. Each is hashed to one of ``BUCKETS``
embeddings; a text is the average of its embeddings, and a linear softmax over it gives the languages. Both layers are
trained by stochastic gradient descent in numpy, on a sample of at most ``PER_LABEL`` documents a language (the only bound;
their whole texts are read, by the executors, and reach the driver as counts per bucket). A held-back fifth of the sample
sets the softmax temperature and the score below which a prediction is rejected.

For predictions the two layers are one table, bucket to language scores: a text's score is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1 << 14
DIMENSIONS = 16
PER_LABEL = 500
PARTS = 64
STEPS = 800
BATCH = 32
RATE = 8.0  # over the longest row of a batch, so that no input makes training diverge
SEED = 7
MAX_ERROR = 0.02
UNDETERMINED = "und"
PIECE = 1 << 19
_FACTORS = tuple(np.uint32(f) for f in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@cache
def letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is none."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def bucket_stream(text: str) -> Iterator[np.ndarray]:
    """The buckets of all subwords of ``text``, piece by piece.

    The letters stand at positions 1 to n, with an edge (0) at 0 and n + 1. A subword belongs to its middle position: the
    letter itself, the pair that ends there, and the three around it.
    """
    n = len(text)
    for low in range(1, n + 2, PIECE):
        high = min(low + PIECE, n + 2)  # middle positions of this piece: low to high - 1
        codes = np.zeros(high - low + 2, dtype=np.uint32)  # positions low - 1 to high
        part = text[max(0, low - 2):high].encode("utf-32-le", "surrogatepass")
        found = letters()[np.frombuffer(part, dtype=np.uint32)]
        start = int(low == 1)
        codes[start:start + len(found)] = found
        yield _buckets(codes[:-2], codes[1:-1], codes[2:])


def _buckets(before: np.ndarray, middle: np.ndarray, after: np.ndarray) -> np.ndarray:
    inside = middle != 0
    one = middle[inside] * _FACTORS[0]
    pair = before * _FACTORS[1] + middle * _FACTORS[0]
    three = pair[inside] + after[inside] * _FACTORS[2] + np.uint32(3)
    two = pair[inside | (before != 0)] + np.uint32(2)
    hashed = np.concatenate((one, two, three))
    return (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)


class Model(NamedTuple):
    """``table`` maps buckets to language scores; ``threshold`` is the least score that isn't rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str | None) -> np.ndarray | None:
        """Averaged scores; None for a text without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for buckets in bucket_stream(text or ""):
            total += np.bincount(buckets, minlength=BUCKETS) @ self.table
            n += len(buckets)
        return None if n == 0 else total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the score is high enough to be accepted."""
        scores = self.logits(text) if self.languages else None
        if scores is None:
            return UNDETERMINED, 0.0, False
        share = softmax(scores[None] / self.temperature)[0]
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(share[best] >= self.threshold)


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


class Bag(NamedTuple):
    """The buckets of a text that are used at all, and how often."""

    buckets: np.ndarray
    counts: np.ndarray

    def average(self) -> np.ndarray:
        return (self.counts / max(1.0, float(self.counts.sum()))).astype(np.float32)


def fit(bags: list[Bag], labels: np.ndarray, languages: list[str]) -> Model:
    """``labels`` are the numbers of the languages. Only the rows of a batch are ever laid out in full, over its own buckets."""
    held = np.arange(len(labels)) % 5 == 4
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    scale = np.float32(np.sqrt(BUCKETS))  # averages over many buckets are small
    taught, target = np.flatnonzero(~held), np.eye(len(languages), dtype=np.float32)[labels[~held]]
    order = np.concatenate([rng.permutation(len(taught)) for _ in range(-(-STEPS * BATCH // len(taught)))])
    for step in range(STEPS):
        some = order[step * BATCH:(step + 1) * BATCH]
        chosen = [bags[i] for i in taught[some].tolist()]
        used, place = np.unique(np.concatenate([bag.buckets for bag in chosen]), return_inverse=True)
        rows = np.zeros((len(some), len(used)), dtype=np.float32)
        rows[np.repeat(np.arange(len(some)), [len(bag.buckets) for bag in chosen]), place] = np.concatenate(
            [bag.average() for bag in chosen]) * scale
        rate = np.float32(RATE * (1 - step / STEPS) / max(1.0, np.square(rows).sum(axis=1).max()))
        hidden = rows @ embedding[used]
        error = (softmax(hidden @ output + bias) - target[some]) / len(some)
        back = error @ output.T
        output -= rate * hidden.T @ error
        bias -= rate * error.sum(axis=0)
        embedding[used] -= rate * rows.T @ back
    table = (embedding.astype(np.float64) @ output) * float(scale)
    checks = np.flatnonzero(held) if held.any() else np.arange(len(labels))
    checked = np.stack([bags[i].average() @ table[bags[i].buckets] for i in checks.tolist()]) + bias
    truth = labels[checks]
    temperature = min((2.0 ** (e / 4) for e in range(-16, 17)), key=lambda t: _loss(checked / t, truth))
    share = softmax(checked / temperature)
    return Model(languages, table, bias.astype(np.float64), temperature,
                 _threshold(share.max(axis=1), share.argmax(axis=1) == truth))


def _loss(scores: np.ndarray, truth: np.ndarray) -> float:
    """Cross entropy with the truth at (n + 1) / (n + 2) and the rest spread, so that no temperature makes it vanish."""
    share = softmax(scores)
    logs = np.log(share + 1e-300)
    right = logs[np.arange(len(truth)), truth]
    wrong = (logs.sum(axis=1) - right) / max(1, share.shape[1] - 1)
    doubt = 1 / (len(truth) + 2)
    return float(-((1 - doubt) * right + doubt * wrong).mean())


def _threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on at most ``MAX_ERROR`` of the accepted are wrong; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= MAX_ERROR)
    return float(score[order[fine[-1]]]) if len(fine) else 2.0


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
          per_label: int = PER_LABEL) -> Model:
    """Fit on at most ``per_label`` documents a label, those with the smallest hashes of their ids.

    Rows with a null label, or without a letter, teach nothing; rows equal in label, id and text teach once. Without any
    label the model predicts nothing. Training repeats exactly on the same rows; ties among equal ids go by text hash.
    """
    text, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`").cast("string")
    rows = (labelled.select(label.alias("label"), F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.xxhash64(text).alias("t"),
                            text.alias("text"))
            .filter(F.col("label").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))))
    # Texts stay where they are until the choice is made: only hashes are ranked, first within parts of a label.
    # Repeated rows must not take places, so they fall away before the ranks; of many copies one row per task travels.
    first = Window.partitionBy("label", F.pmod("h", F.lit(PARTS))).orderBy("h", "t")
    chosen = rows.select("label", "h", "t").distinct()
    for by in (first, Window.partitionBy("label").orderBy("h", "t")):
        chosen = chosen.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_label).drop("n")
    key = ["label", "h", "t"]
    sampled = rows.join(F.broadcast(chosen), key).dropDuplicates(key)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                total = np.zeros(BUCKETS, dtype=np.int64)
                for buckets in bucket_stream(text):
                    total += np.bincount(buckets, minlength=BUCKETS)
                used = np.flatnonzero(total)
                found.append((used.astype(np.uint16).tobytes(), total[used].astype(np.float32).tobytes()))
            yield pd.DataFrame({"label": batch["label"], "h": batch["h"], "t": batch["t"],
                                "buckets": [f[0] for f in found], "counts": [f[1] for f in found]})

    sample = sampled.select("label", "h", "t", "text").mapInPandas(
        counted, "label string, h long, t long, buckets binary, counts binary").toPandas()
    sample = sample.sort_values(["h", "t", "label"], kind="stable", ignore_index=True)
    languages = sorted(set(sample["label"]))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 2.0)
    bags = [Bag(np.frombuffer(b, dtype=np.uint16), np.frombuffer(n, dtype=np.float32))
            for b, n in zip(sample["buckets"], sample["counts"])]
    return fit(bags, sample["label"].map(languages.index).to_numpy(), languages)


def predict_column(text: Column, model: Model) -> Column:
    """A struct ``lang_pred``, ``score`` (0 to 1), ``accepted`` for each text.

    A null text, or one without letters, is ``und`` with score 0 and not accepted. Below the model's threshold the likeliest
    language is still named, but not accepted. The model (buckets times languages) travels with the tasks.
    """

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return predicted(text)
