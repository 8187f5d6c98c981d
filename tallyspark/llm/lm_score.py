"""Language-model scores from a weighted backoff automaton that is never held in one place.

The model interpolates n-grams with absolute discounting over an add-one unigram. As an automaton its states are the
contexts seen in training; a state has an arc, weighted with the log probability, for every word seen after it, and a
failure arc, weighted with the log of what discounting left over, to the state of the next shorter context. A text is read
once from left to right: the state goes along, an arc that exists adds its weight, else failure arcs add theirs until one
does; the last resort, the root, has an arc for every word.

The automaton grows with the corpus, so it is neither broadcast nor collected. Texts are packed into blocks of about
``PACK_BYTES``. For each order a block asks for the counts of its own n-grams only: they go, with their contexts, to buckets
by the context's hash, are totalled there, and the totals return in the order of the question, one small number each. Each
block then weighs its part of the automaton and reads its texts, all positions at a time. N-grams are known by 64-bit
fingerprints. There are as many buckets as blocks, and a bucket holds about as many n-grams as a block, so both fit a task
at any size; questions number blocks times buckets, which larger blocks on larger executors keep down.

A context that makes up a thousandth of all tokens or more is hot: its n-grams are dealt by their own hash instead, and the
partial counts of its successors are added up. There are at most a thousand such contexts whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Numbers, mix64, store, words_of

ORDER = 2
PACK_BYTES = 6 << 20
HOT_SHARE = 1000
_BEGIN = np.uint64(xxhash.xxh64_intdigest(b"begin", 1))
_END = np.uint64(xxhash.xxh64_intdigest(b"end", 1))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, after one byte that tells how many."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    values = np.zeros((len(raw), 8), dtype=np.uint8)
    values[:, :data[0]] = raw
    return values.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


class Block(NamedTuple):
    """The tokens of a pack's texts, each text behind a begin mark and followed by an end.

    ``grams[n - 1]`` has the fingerprint of the n tokens up to a position; it is meant where ``place`` (0 for the begin mark)
    is n - 1 or more. ``trains`` tells the positions of texts that train.
    """

    grams: list[np.ndarray]
    place: np.ndarray
    trains: np.ndarray
    starts: np.ndarray

    def known(self, n: int) -> np.ndarray:
        """Positions with an n-gram; the begin mark alone is none."""
        return self.place >= max(1, n - 1)


def read_block(texts: bytes, trains: np.ndarray, order: int) -> Block:
    numbers = Numbers()
    pieces, lengths = [], []
    for line in zstandard.decompress(texts).split(b"\n")[:-1]:
        words = line.split()
        pieces.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        lengths.append(len(words) + 2)
    each = np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)
    length = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(length) - length
    hashes = np.empty(int(length.sum()), dtype=np.uint64)
    for start, piece in zip(starts.tolist(), pieces):
        hashes[start] = _BEGIN
        hashes[start + 1:start + 1 + len(piece)] = each[piece]
        hashes[start + 1 + len(piece)] = _END
    place = np.arange(len(hashes)) - np.repeat(starts, length)
    grams = [hashes]
    for _ in range(order - 1):
        longer = np.zeros(len(hashes), dtype=np.uint64)
        longer[1:] = mix64(grams[-1][:-1] * _ODD + hashes[1:])
        grams.append(longer)
    return Block(grams, place, np.repeat(np.asarray(trains, dtype=bool), length), starts)


class Question(NamedTuple):
    """The distinct n-grams of a block in the order bucket, context, n-gram."""

    grams: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray
    edges: np.ndarray
    inverse: np.ndarray


def question(block: Block, n: int, hot: np.ndarray, buckets: int) -> Question:
    """``edges`` are the bounds of the buckets; ``inverse`` gives for each position with an n-gram its row here.

    An n-gram goes where its context does, one of a hot context where its own fingerprint does. Words are their own context.
    """
    at = np.flatnonzero(block.known(n))
    grams, first, inverse = np.unique(block.grams[n - 1][at], return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    counts = np.bincount(inverse, weights=block.trains[at], minlength=len(grams)).astype(np.uint64)
    contexts = grams if n == 1 else block.grams[n - 2][at[first] - 1]
    route = np.where(np.isin(contexts, hot), grams, contexts)
    bucket = (mix64(route) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(contexts, kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16) if buckets < 1 << 16 else bucket[order], kind="stable")]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    return Question(grams[order], contexts[order], counts[order], edges, rank[inverse])


def _runs(contexts: np.ndarray) -> np.ndarray:
    """Where each context begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(contexts) else np.empty(0, np.int64)


def pack_texts(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``docs`` (``id``, ``text``, ``trains``) as blocks: ``pack``, ``ids``, ``trains``, ``tokens`` that train, ``texts``."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, size, ids, trains, lines, tokens = 0, 0, [], [], [], 0

        def block(part: int) -> pd.DataFrame:
            data = zstandard.compress(b"".join(lines), 3)
            return pd.DataFrame({"pack": [(part << 32) + number], "ids": [ids], "trains": [trains], "tokens": [tokens],
                                 "texts": [data]})

        part = 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for doc_id, text, train in zip(batch["id"], batch["text"], batch["trains"]):
                words = words_of(text)
                line = b" ".join(words) + b"\n"
                if lines and size + len(line) > pack_bytes:
                    yield block(part)
                    number, size, ids, trains, lines, tokens = number + 1, 0, [], [], [], 0
                ids.append(doc_id)
                trains.append(bool(train))
                lines.append(line)
                size += len(line)
                tokens += (len(words) + 1) * bool(train)
        if lines:
            yield block(part)

    return docs.withColumn("part", F.spark_partition_id()).mapInPandas(
        packed, "pack long, ids array<string>, trains array<boolean>, tokens long, texts binary")


def _questions(packs: DataFrame, n: int, order: int, hot: np.ndarray, buckets: int) -> DataFrame:
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pack, trains, texts in zip(batch["pack"], batch["trains"], batch["texts"]):
                q = question(read_block(texts, trains, n), n, hot, buckets)
                out = []
                for b in range(buckets):
                    a, z = q.edges[b], q.edges[b + 1]
                    if a == z:
                        continue
                    runs = _runs(q.contexts[a:z])
                    out.append((b, pack, pack_sorted(q.contexts[a:z][runs]), pack_ints(np.diff(runs, append=z - a)),
                                pack_ints(q.grams[a:z]) if n > 1 else b"\x01", pack_ints(q.counts[a:z])))
                yield pd.DataFrame(out, columns=["bucket", "pack", "contexts", "lengths", "grams", "counts"])

    return packs.select("pack", "trains", "texts").mapInPandas(
        asked, "bucket int, pack long, contexts binary, lengths binary, grams binary, counts binary")


def _totals(n: int, hot: np.ndarray, hot_from: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Answers one bucket's questions and reports what the whole model needs to know of it."""

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        heads = [unpack_sorted(x) for x in asked["contexts"]]
        lengths = [unpack_ints(x).astype(np.int64) for x in asked["lengths"]]
        contexts = np.concatenate([np.repeat(h, k) for h, k in zip(heads, lengths)])
        grams = np.concatenate([unpack_ints(x) for x in asked["grams"]]) if n > 1 else contexts
        counts = np.concatenate([unpack_ints(x) for x in asked["counts"]]).astype(np.int64)
        types, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        totals = np.zeros(len(types), dtype=np.int64)
        np.add.at(totals, inverse, counts)
        trained = totals > 0
        followed, successors = np.unique(contexts[first[trained]], return_counts=True)
        rows: list[tuple] = []
        at = 0
        for pack, bucket, head, k in zip(asked["pack"], asked["bucket"], heads, lengths):
            size = int(k.sum())
            found = np.searchsorted(followed, head)
            found = np.minimum(found, max(0, len(followed) - 1))
            n_successors = np.where(followed[found] == head, successors[found], 0) if len(followed) else np.zeros(len(head))
            rows.append(("answer", pack, bucket, pack_ints(totals[inverse[at:at + size]]), pack_ints(n_successors), 0, 0))
            at += size
        for name, value in (("types", trained.sum()), ("once", (totals == 1).sum()), ("twice", (totals == 2).sum())):
            rows.append((name, 0, 0, None, None, 0, int(value)))
        signed = types.view(np.int64)
        rows += [("hot", 0, 0, None, None, int(signed[i]), int(totals[i])) for i in np.flatnonzero(totals >= hot_from)]
        # Of a hot context only the successors in this bucket.
        for i in np.flatnonzero(np.isin(followed, hot)):
            rows.append(("successors", 0, 0, None, None, int(followed.view(np.int64)[i]), int(successors[i])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    return answer


_ANSWER = "kind string, pack long, bucket int, counts binary, successors binary, fp long, value long"


class Level(NamedTuple):
    """What the whole corpus says of one order: its discount, and the successors of its hot contexts."""

    discount: float
    hot: np.ndarray
    hot_successors: np.ndarray


def discount(once: int, twice: int) -> float:
    """The usual estimate from the n-grams seen once and twice; a half if none was seen once, so that none is certain."""
    return once / (once + 2 * twice) if once else 0.5


def score(docs: DataFrame, trains: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
          pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` (a long), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from the rows where ``trains`` is true (null: false). Words have A-Z lower-cased; every text has an end,
    which is a token, so a null or empty text has one. ``base_score`` is the add-one unigram's log10 probability, ``score``
    the automaton's of the given ``order``; with nothing to learn from both are 0. Ids may be null or repeated; every row is
    scored, and trains, by itself. An empty table gives no rows. Other columns aren't read.
    """
    packs = store(pack_texts(docs.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.coalesce(trains, F.lit(False)).alias("trains")), pack_bytes), "lm-packs")
    size = packs.agg(F.count(F.lit(1)).alias("packs"), F.sum("tokens").alias("tokens")).first()
    tokens, buckets = size["tokens"] or 0, max(8, size["packs"])
    hot_from = max(2, -(-tokens // HOT_SHARE))
    hot = np.empty(0, dtype=np.uint64)
    levels, vocabulary, answers = [], 0, None
    for n in range(1, order + 1):
        found = store(_questions(packs, n, order, hot, buckets).groupBy("bucket")
                      .applyInPandas(_totals(n, hot, hot_from), _ANSWER), "lm-answers")
        sums = {r["kind"]: r["value"] for r in found.filter(F.col("kind").isin("types", "once", "twice"))
                .groupBy("kind").agg(F.sum("value").alias("value")).collect()}
        successors = {r["fp"]: r["value"] for r in found.filter(F.col("kind") == "successors")
                      .groupBy("fp").agg(F.sum("value").alias("value")).collect()}  # of hot contexts: at most HOT_SHARE
        levels.append(Level(discount(sums.get("once", 0), sums.get("twice", 0)), hot,
                            np.array([successors.get(int(h), 0) for h in hot.view(np.int64)], dtype=np.int64)))
        vocabulary = sums.get("types", 0) if n == 1 else vocabulary
        frequent = sorted(r["fp"] for r in found.filter(F.col("kind") == "hot").select("fp").collect())
        if n == 1:  # the begin mark is as frequent as the end
            frequent += [int(_BEGIN.view(np.int64))] if int(_END.view(np.int64)) in frequent else []
        hot = np.sort(np.array(frequent, dtype=np.int64).view(np.uint64))
        part = found.filter(F.col("kind") == "answer").select(F.lit(n).alias("n"), "pack", "bucket", "counts", "successors")
        answers = part if answers is None else answers.unionByName(part)
    scored = (packs.groupBy("pack").cogroup(answers.groupBy("pack"))
              .applyInPandas(_scorer(order, buckets, levels, tokens, vocabulary), _SCORED))
    return scored.select(F.col("id").cast("long").alias(id_col), *[c.split()[0] for c in _SCORED.split(", ")[1:]])


_SCORED = "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(order: int, buckets: int, levels: list[Level], tokens: int, vocabulary: int):
    """Weighs a block's arcs and failure arcs and reads its texts."""

    def scored(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, trains, texts = packs["ids"].iloc[0], packs["trains"].iloc[0], packs["texts"].iloc[0]
        block = read_block(texts, trains, order)
        length = len(block.place)
        count, logp = np.zeros(length, dtype=np.int64), np.zeros(length)
        base = logp
        for n in range(1, order + 1):
            level = levels[n - 1]
            q = question(block, n, level.hot, buckets)
            own = answers[answers["n"] == n].sort_values("bucket")
            at = np.flatnonzero(block.known(n))
            if not len(at):  # no text is long enough
                count = np.zeros(length, dtype=np.int64)
                continue
            total = np.concatenate([unpack_ints(x) for x in own["counts"]]).astype(np.int64)[q.inverse]
            if n == 1:
                words = np.zeros(length, dtype=np.int64)
                words[at] = total
                base = np.zeros(length)
                base[at] = np.log10((total + 1) / (tokens + vocabulary + 1))
                logp, count = base.copy(), words.copy()
                count[block.place == 0] = _end_count(block, words)
                continue
            heads = np.concatenate([_runs(q.contexts[a:z]) + a for a, z in zip(q.edges[:-1], q.edges[1:]) if z > a])
            after = np.concatenate([unpack_ints(x) for x in own["successors"]]).astype(np.int64)
            successors = np.repeat(after, np.diff(heads, append=len(q.grams)))
            is_hot = np.isin(q.contexts, level.hot)
            successors[is_hot] = level.hot_successors[np.searchsorted(level.hot, q.contexts[is_hot])]
            state = count[at - 1]  # how often training was in the state of this context
            known = state > 0
            divisor = np.maximum(state, 1)
            failure = np.where(known, np.log10(np.maximum(level.discount * successors[q.inverse], 1e-300) / divisor), 0.0)
            backed_off = failure + logp[at]
            arc = np.log10(np.maximum(total - level.discount, 0) / divisor + 10.0 ** backed_off)
            logp[at] = np.where(total > 0, arc, backed_off)
            count = np.zeros(length, dtype=np.int64)
            count[at] = total
        return pd.DataFrame({
            "id": list(ids),
            "n_tokens": np.add.reduceat((block.place > 0).astype(np.int64), block.starts),
            "n_known": np.add.reduceat(((block.place > 0) & (words > 0)).astype(np.int64), block.starts),
            "train_tokens": np.full(len(ids), tokens, dtype=np.int64),
            "base_score": np.add.reduceat(base, block.starts), "score": np.add.reduceat(logp, block.starts)})

    return scored


def _end_count(block: Block, words: np.ndarray) -> int:
    """Texts that train: as many begin marks as ends. Every text of a block has an end, so its total is at hand."""
    return int(words[block.starts[1] - 1 if len(block.starts) > 1 else -1])
