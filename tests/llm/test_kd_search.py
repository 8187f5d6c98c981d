"""Exact search against sorting all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import kd_search


def plain(rows, k, scale=256):
    import math

    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = set(), set()
    for q, a in whole:
        if q % 5 or (q, tuple(a)) in seen:
            continue
        seen.add((q, tuple(a)))
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
        out |= {(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scored)}
    return out


def rows_of(n, dims, rng):
    centre = [rng.uniform(-1, 1) for _ in range(dims)]
    made = []
    for i in range(n):
        made.append((i, centre if i % 3 == 0 else [rng.gauss(0, 0.4) for _ in range(dims)]))
    return made


@pytest.mark.parametrize("shard_rows, block_rows", [(4096, 2048), (16, 4)])
def test_equals_sorting_all_products(spark, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(kd_search, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(kd_search, "LEAF_ROWS", 4)
    rows = rows_of(110, 6, random.Random(4)) + [
        (None, [0.1] * 6), (200, None), (205, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (210, [float("nan")] * 6),
        (215, [float("inf")] * 6), (220, [1.0, 2.0]), (221, [0.5, 0.5]), (225, []), (230, [9.0] * 3), (10, rows_of(11, 6, random.Random(4))[10][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = [tuple(r) for r in kd_search.top_k(df, 5, F.col("vec_id") % 5 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 5)


def test_products_beyond_doubles_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, -1.0]) * 2.0 ** rng.randint(0, 24) + rng.randint(0, 3) for _ in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in kd_search.top_k(df, 3, F.col("vec_id") % 5 == 0).collect()} == plain(rows, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert kd_search.top_k(df.limit(0), 3, F.col("vec_id") % 5 == 0).count() == 0
    assert kd_search.top_k(df, 3, F.lit(None).cast("boolean")).count() == 0


def test_tree_boxes_hold_their_rows():
    rng = np.random.default_rng(1)
    ids, vectors = rng.permutation(500), rng.integers(-50, 50, (500, 4)).astype(float)
    tree = kd_search.build_tree(ids, vectors, 8)
    for node, children in enumerate(tree.children):
        rows = tree.vectors[tree.start[node]:tree.end[node]]
        assert (rows.min(axis=0) == tree.low[node]).all() and (rows.max(axis=0) == tree.high[node]).all()
        assert children or len(rows) <= 8
    assert (vectors[np.argsort(ids)] == tree.vectors[np.argsort(tree.ids)]).all()
