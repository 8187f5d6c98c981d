"""Targets against iterative sharing, the queue against one global sort, and the mix's rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """sizes: source -> words. Shares all words by weight, freezing what exceeds its cap, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, frozen = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in frozen]
        left = total - sum(frozen.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return {**frozen, **share}
        frozen.update({s: cap * sizes[s] for s in over})


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def text_of(n):
    return " \n".join(["w"] * n) or None


def plain_copies(rows, targets):
    """rows: (id, size, source). One global sort of all copies by virtual finish time."""
    rank = {s: i for i, s in enumerate(sorted(targets, key=lambda s: (s is None, (s or "").encode())))}
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in targets}
    copies = []
    for s, target in targets.items():
        own = sorted((md5(f"{mixing.SEED}:{i}:{md5(text_of(n) or '')}"), n, i) for i, n, x in rows if x == s)
        for epoch in range(3):
            sent = epoch * sizes[s]
            for number, (h, n, i) in enumerate(own):
                sent += n
                if target > 0 and epoch * sizes[s] < target:
                    copies.append((sent / target, rank[s], h, epoch, number, n, i))
    taken, until = {}, 0
    for *_, n, i in sorted(copies):
        until += n
        if until > sum(sizes.values()):
            break
        taken[i] = taken.get(i, 0) + 1
    return taken


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 1, 3, 10, 40]), rng.choice(["a", "a", "a", "a", "b", "c", None, "é", "Z", ""])) for i in range(150)]
    return rows + [(1000, 400, "tiny"), (1001, 0, "void")]


@pytest.mark.parametrize("seed, cell_rows", [(1, 500), (2, 10)])
def test_equals_one_global_sort(docs, monkeypatch, seed, cell_rows):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    rows = rows_of(seed)
    df = docs([(i, text_of(n), s, 1) for i, n, s in rows], "doc_id long, text string, source string, size int")
    got = {r.doc_id: r for r in mixing.queue(df).collect()}
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in {s for _, _, s in rows}}
    targets = plain_targets(sizes)
    copies = plain_copies(rows, {s: got[next(i for i, _, x in rows if x == s)].target for s in sizes})
    assert len(got) == len(rows)
    for i, n, s in rows:
        assert (got[i].size, got[i].source_size) == (n, sizes[s]) and got[i].target == pytest.approx(targets[s])
        assert got[i].copies == copies.get(i, 0) and got[i].copies <= 3
    for s in sizes:
        taken = sum(got[i].size * got[i].copies for i, _, x in rows if x == s)
        assert abs(taken - targets[s]) <= 400


def test_mix_repeats_rows_in_order(docs):
    rows = [(i % 40, "w " * (1 + i % 7), ["a", "b", None][i % 3], "x") for i in range(120)] + [(None, None, None, "y")] * 3
    df = docs(rows, "doc_id long, text string, source string, _row string")
    queued = mixing.queue(df).collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in queued)
    want = {}
    for r in queued:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    have = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert have == {k: v for k, v in want.items() if v}


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    """No cell may grow with the number of rows that share an id."""
    sizes = {}
    window_by = mixing.Window.partitionBy

    def noted(*columns):
        sizes.setdefault("cells", columns)
        return window_by(*columns)

    monkeypatch.setattr(mixing.Window, "partitionBy", staticmethod(noted))
    rows = spark.range(10_000).selectExpr("cast(null as long) doc_id", "concat('w ', id) text", "'s' source")
    queued = mixing.queue(rows)
    assert sizes["cells"] == ("_rank", "_cell") and queued.count() == 10_000
    order = F.md5(F.concat_ws(":", F.lit(mixing.SEED), F.lit(""), F.md5("text")))
    counts = [r["count"] for r in rows.groupBy(mixing._cell(order, 10_000 // mixing.CELL_ROWS)).count().collect()]
    assert len(counts) == 10_000 // mixing.CELL_ROWS and max(counts) < 2 * mixing.CELL_ROWS


def test_nothing_to_mix(docs):
    schema = "doc_id long, text string, source string"
    assert mixing.queue(docs([(1, "a", "s")], schema).limit(0)).count() == 0
    got = mixing.queue(docs([(1, None, "s"), (2, "", None)], schema)).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix(docs([(1, None, "s")], schema)).count() == 0
