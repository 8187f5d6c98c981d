"""Exact top-k inner products with one KD-tree per shard of vectors.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, queries to blocks of about ``BLOCK_ROWS``. A task
searches one block in one shard: it builds the shard's tree (median splits of the widest dimension, tight bounding boxes)
and walks it best first for each query. A box can hold no product above the sum, over the dimensions, of the larger of query
times lower and query times upper bound; a box whose bound is below the query's kth best score is passed over, and so is
everything below it. Shards are grouped: a task takes the shards of its group one after the other and carries every query's
kth score along, so later shards are pruned by what earlier ones found. The groups' best are merged by rank.

Components are integers, floor(scale * x), and so are scores: ties are exact and go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import store

SCALE = 256
LEAF_ROWS = 64
SHARD_ROWS = 4096
GROUP_SHARDS = 2
BLOCK_ROWS = 2048
_EXACT = float(1 << 53)


class Tree(NamedTuple):
    """Nodes in preorder; a node's rows are ``start`` to ``end`` of ``ids`` and ``vectors``; a leaf has no ``children``."""

    ids: np.ndarray
    vectors: np.ndarray
    start: list[int]
    end: list[int]
    children: list[tuple[int, int] | None]
    low: np.ndarray
    high: np.ndarray


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Rows are split at the median of the box's widest dimension until they fit a leaf or are all equal.

    Within a leaf ids ascend, so that the first of several equal scores has the smallest id.
    """
    order = np.argsort(ids, kind="stable")
    start, end, children, low, high = [], [], [], [], []

    def grow(a: int, b: int) -> int:
        node = len(start)
        rows = vectors[order[a:b]]
        start.append(a)
        end.append(b)
        children.append(None)
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        widths = high[node] - low[node]
        if b - a > leaf_rows and widths.size and widths.max() > 0:
            by_value = np.argsort(rows[:, int(widths.argmax())], kind="stable")
            order[a:b] = order[a:b][by_value]
            middle = (a + b) // 2
            children[node] = (grow(a, middle), grow(middle, b))
        else:
            order[a:b] = np.sort(order[a:b])
        return node

    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    order = np.arange(len(ids))
    grow(0, len(ids))
    return Tree(ids[order], vectors[order], start, end, children, np.stack(low), np.stack(high))


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple]]) -> None:
    """Merge each query's ``k`` best of the tree into ``best`` (heaps of (score, -id), the worst on top).

    Rows with the query's own id are not candidates.
    """
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    for q, own in enumerate(query_ids.tolist()):
        heap, kept = [(-bounds[q, 0], 0)], best[q]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(kept) == k and -bound < kept[0][0]:
                break  # no box that is left can reach the kth score
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if len(kept) < k or bounds[q, child] >= kept[0][0]:
                        heapq.heappush(heap, (-bounds[q, child], child))
                continue
            a, b = tree.start[node], tree.end[node]
            scores = tree.vectors[a:b] @ queries[q]
            ids = tree.ids[a:b]
            if len(kept) == k:
                near = np.flatnonzero(scores >= kept[0][0])
                scores, ids = scores[near], ids[near]
            if len(scores) > k + 1:  # one of them may be the query itself
                first = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k + int((ids == own).sum())]
                scores, ids = scores[first], ids[first]
            for score, i in zip(scores.tolist(), ids.tolist()):
                if i == own:
                    continue
                if len(kept) < k:
                    heapq.heappush(kept, (score, -i))
                elif (score, -i) > kept[0]:
                    heapq.heapreplace(kept, (score, -i))


def _matrix(vectors: pd.Series, exact_floats: bool) -> np.ndarray:
    stacked = np.stack(vectors.to_list()) if len(vectors) else np.empty((0, 0))
    if exact_floats:
        return stacked
    return np.array([[int(x) for x in row] for row in stacked], dtype=object).reshape(stacked.shape)


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Components floor(scale * x) as doubles; null if the vector or a component is null or not finite."""

    def floored(x: Column) -> Column:
        product = x.cast("double") * scale
        return F.when(F.abs(product) < _EXACT, F.floor(product).cast("double")).otherwise(product)

    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(embedding, floored))


def top_k(vectors: DataFrame, k: int, is_query: Column, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows for every row where ``is_query``: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Every row is a candidate but those with the query's own id. Equal scores go to the smaller id. Rows with a null id, or a
    vector that is null or has null or non-finite components, take no part; vectors are compared with those of equal length.
    Rows repeated in full are one query and as many candidates. A query with fewer than ``k`` candidates gets them all; an
    empty table gives no rows. Scores are exact integers of any size, clipped to a long on return.
    """
    whole = store(vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vector_col}`"), scale).alias("v"),
                                 F.coalesce(is_query, F.lit(False)).alias("asks"))
                  .filter("id IS NOT NULL AND v IS NOT NULL"), "kd-vectors")
    shape = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asking"),
                      F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("top"),
                      F.max(F.size("v")).alias("dims")).first()
    groups = max(1, -(-shape["n"] // (SHARD_ROWS * GROUP_SHARDS)))
    blocks = max(1, -(-(shape["asking"] or 0) // BLOCK_ROWS))
    # Products and their sums are exact in doubles below 2**53, beyond it in Python's integers.
    exact = (shape["top"] or 0.0) ** 2 * max(1, shape["dims"] or 0) < _EXACT
    dealt = whole.withColumn("dims", F.size("v")).withColumn("hash", F.xxhash64("id"))
    # A cell is a group of shards and a block of queries; cells are the tasks, each reads both sides once.
    shards = dealt.select("dims", F.pmod("hash", F.lit(groups)).cast("int").alias("group"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asking = (dealt.filter("asks").dropDuplicates(["id", "v"])
              .select("dims", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
                      F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int").alias("block"), "id", "v",
                      F.xxhash64("v").alias("asked")))

    def search_cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            wanted, asked = queries["id"].to_numpy(), _matrix(queries["v"], exact)
            best: list[list[tuple]] = [[] for _ in range(len(wanted))]
            ids, stacked = rows["id"].to_numpy(), _matrix(rows["v"], exact)
            for at in range(0, len(ids), SHARD_ROWS):
                search(build_tree(ids[at:at + SHARD_ROWS], stacked[at:at + SHARD_ROWS]), wanted, asked, k, best)
            out = [(q, a, -i, s) for q, a, kept in zip(wanted.tolist(), queries["asked"].tolist(), best) for s, i in kept]
        found = pd.DataFrame(out, columns=["query_id", "asked", "vec_id", "score"])
        found["score"] = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in found["score"]]
        return found.astype({"query_id": "int64", "asked": "int64", "vec_id": "int64", "score": "int64"})

    cell = ["dims", "group", "block"]
    found = (asking.groupBy(*cell).cogroup(shards.groupBy(*cell))
             .applyInPandas(search_cell, "query_id long, asked long, vec_id long, score long"))
    best_first = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
