"""Clusters of similar descriptions.

The most frequent description left absorbs every description left that is similar to it; similarity
counts against that anchor only and is not passed on. All anchors that cannot influence each other are
found at once. A run of characters that very many descriptions hold is no join key by itself, so it
adds no rounds; only a key that more than ``FRONT`` descriptions share, two common runs or more, does:
one round per ``FRONT`` of them that no anchor absorbs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.similarity import may_reach, token_sort
from tallyspark.functions.text import clean_key, date_text
from tallyspark.operators.scale import cut_lineage, forget, lookup_join
from tallyspark.operators.similarity_join import copies, join_keys, salt, score_pairs, shares, with_subsequences
from tallyspark.schema import UNCATEGORIZED, require_columns

# What decides a range travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRONT = 1000
SAMPLE_ROWS = 5
#: Rows (pairs of similar texts, 20 bytes each) of a range of ranks that one task goes through in order.
RANGE_ROWS = 4_000_000
#: Texts that one task goes through in rank order where similar texts share a key, and in how many parts they are stored.
WALK_TEXTS = 400_000
WALK_PARTS = 8
OPEN, ANCHOR, COVERED = 0, 1, 2
_END = -2
_SAMPLE = ["date", "description", "paid_out", "paid_in", "source"]


def uncategorized(ledger: DataFrame) -> DataFrame:
    """Uncategorised rows with a description, which is stripped and lower-cased."""
    df = require_columns(ledger, ["category", "description"], on_missing="empty")
    return (df.filter((F.col("category") == UNCATEGORIZED) & F.col("description").isNotNull())
            .withColumn("description", clean_key(F.col("description"))))


def description_freq(rows: DataFrame) -> DataFrame:
    return rows.groupBy("description").agg(F.count("*").alias("count"))


def cluster_members(freq: DataFrame, threshold: int = 85, front: int = FRONT) -> DataFrame:
    """Rows (description, count, anchor), one per description in ``freq``.

    Descriptions rank by count, then text. In each round every join key (see ``similarity_join``) shows its ``front`` lowest ranked undecided texts. A text that is in the
    front of all its keys has all its possible lower neighbours there, which decides whether it is an
    anchor. The new anchors, at most ``front`` per key, then meet the texts of their keys, and each
    text remembers the lowest anchor found. Thus no key ever emits all pairs of its texts, and the
    result is exactly that of going through the ranks one by one.

    Where texts are similar exactly if they share a join key, no pairs are made at all: see ``_walk_in_ranges``.
    """
    texts = freq.select(F.col("description"), "count").withColumn("key", token_sort(F.col("description")))
    texts = cut_lineage(texts)
    # Texts of equal sorted form have the same neighbours, so one stands for all.
    rank = F.struct((-F.col("count")).alias("neg"), F.col("description").alias("text"))
    nodes = texts.groupBy("key").agg(F.min(rank).alias("rank"))
    state = _walk_in_ranges(nodes, threshold)
    if state is None:
        state = _decide_in_fronts(nodes, threshold, front)
    return (texts.join(state.select("key", F.col("owner.text").alias("anchor")), "key")
            .select("description", "count", "anchor"))


def _walk_in_ranges(nodes: DataFrame, threshold: int) -> DataFrame | None:
    """The ``owner`` (a rank) of each node; None if there are texts that do not meet on subsequences alone.

    Ranges of ranks are decided one after the other. The anchors of the ranges before cover what shares a key with them; the
    rest goes through one task in order, which holds nothing but the keys of the anchors it finds. So every key of a text is
    looked up, and no two texts meet unless one is an anchor.
    """
    nodes = cut_lineage(nodes)
    ranges = -(-nodes.count() // WALK_TEXTS) or 1
    keyed = with_subsequences(nodes.repartitionByRange(ranges * WALK_PARTS, "rank").withColumn(
        "part", F.floor(F.spark_partition_id() / WALK_PARTS).cast("int")), threshold)
    if keyed is None:
        return None
    keyed = cut_lineage(keyed)
    decided, anchors = [], None
    for number in range(ranges):
        decided += _round(_decide_range_of_texts, keyed.filter(F.col("part") == number).drop("part"), anchors, threshold)
        new = decided[-1].filter("is_anchor").select(F.explode("elements").alias("element"), "length", "owner")
        anchors = new if anchors is None else anchors.unionByName(new)
    return reduce(DataFrame.unionByName, [d.select("key", "owner") for d in decided])


def _decide_range_of_texts(texts: DataFrame, anchors: DataFrame | None, threshold: int) -> list[DataFrame]:
    """Texts that lower ``anchors`` cover and the rest, each with their ``owner``."""
    if anchors is None:
        met = texts.withColumn("found", F.lit(None).cast(texts.schema["rank"].dataType))
    else:
        owners = (anchors.groupBy("element", "length").agg(F.min("owner").alias("owner"))
                  .groupBy("element").agg(F.collect_list(F.struct("owner", F.col("length").alias("size"))).alias("_anchors")))
        each = texts.select("key", "length", F.explode("elements").alias("element"))
        room = 200 * (F.length("element") - 1) - threshold * F.col("length")
        near = F.filter("_anchors", lambda a: a["size"] * threshold <= room)
        found = lookup_join(each, owners, "element").groupBy("key").agg(
            F.min(F.array_min(F.transform(near, lambda a: a["owner"]))).alias("found"))
        met = texts.join(found, "key", "left")
    met = cut_lineage(met)
    covered = met.filter("found is not null").select("key", F.col("found").alias("owner"))
    walk = (met.filter("found is null").select("key", "rank.*", "length", "elements").repartition(1)
            .sortWithinPartitions("neg", "text")
            .mapInArrow(_walk(threshold), "key string, neg long, text string, is_anchor boolean, length int, elements array<string>"))
    return [covered, cut_lineage(walk.withColumn("owner", F.struct("neg", "text")).drop("neg", "text"))]


def _walk(threshold: int):
    """Texts in rank order, each with the rank of its anchor; ``elements`` stay those of anchors."""
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: list[tuple] = []
        # For a key the anchors that have it, in order: their lengths and numbers. A longer one after a shorter adds nothing.
        having: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            owner, is_anchor, kept = [], [], []
            for neg, text, length, elements in zip(*(batch.column(c).to_pylist() for c in ("neg", "text", "length", "elements"))):
                lowest = len(ranks)
                for element in elements:
                    for size, number in having.get(element, ()):
                        if number < lowest and threshold * (length + size) <= 200 * (len(element) - 1):
                            lowest = number
                            break
                new = lowest == len(ranks)
                if new:
                    ranks.append((neg, text))
                    for element in elements:
                        shorter = having.setdefault(element, [])
                        if not shorter or length < shorter[-1][0]:
                            shorter.append((length, lowest))
                owner.append(ranks[lowest])
                is_anchor.append(new)
                kept.append(elements if new else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([o[0] for o in owner], pa.int64()), pa.array([o[1] for o in owner], pa.string()),
                 pa.array(is_anchor, pa.bool_()), batch.column("length"), pa.array(kept, pa.list_(pa.string()))],
                names=["key", "neg", "text", "is_anchor", "length", "elements"])

    return walked


def _decide_in_fronts(nodes: DataFrame, threshold: int, front: int) -> DataFrame:
    """The ``owner`` of each node from rounds over what the join keys show."""
    blocks = cut_lineage(join_keys(nodes.select("key"), threshold, front).filter("freq is null or freq > 1")
                         .select("key", "element"))
    lists = blocks.groupBy("element").count().filter("count > 1").select("element")
    blocks = cut_lineage(blocks.join(lists, "element", "left_semi"))
    parts = shares(blocks)
    keys_of = blocks.groupBy("key").agg(F.count("*").alias("keys"))
    state = (nodes.join(keys_of, "key", "left")
             .withColumn("owner", F.when(F.col("keys").isNull(), F.col("rank"))))
    state = cut_lineage(state)
    while True:
        left = state.filter("owner is null").agg(F.count("*").alias("n"), F.min("rank").alias("lowest")).first()
        if left["n"] == 0:
            break
        before, state = state, _round(_decide_front, state, blocks, left["lowest"], threshold, front, parts)
        forget([before])
    return state


def _round(decide: Callable, *tables):
    """One round of decisions; how many it takes is what grows with chains of texts."""
    return decide(*tables)


def _decide_front(state: DataFrame, blocks: DataFrame, lowest, threshold: int, front: int, parts: int) -> DataFrame:
    # An owner below every undecided text is final.
    bound = F.struct(F.lit(lowest["neg"]).cast("long").alias("neg"), F.lit(lowest["text"]).alias("text"))
    open_to_change = F.col("owner").isNull() | (F.col("owner") > bound)
    spent: list[DataFrame] = []
    work = cut_lineage(blocks.join(state.filter(open_to_change), "key"), spent)
    anchors = _new_anchors(work.filter("owner is null"), threshold, front, spent)
    best = _lowest_anchor(work, anchors, threshold, parts)
    chosen = anchors.select("key", F.col("rank").alias("own"))
    updated = (state.join(chosen, "key", "left").join(best, "key", "left")
               .withColumn("owner", F.coalesce("own", F.least("owner", "found"), "found"))
               .select("key", "rank", "keys", "owner"))
    updated = cut_lineage(updated)
    forget(spent)
    return updated


def _new_anchors(undecided: DataFrame, threshold: int, front: int, spent: list[DataFrame]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("element").orderBy("rank"))
    shown = undecided.withColumn("_rn", place).filter(F.col("_rn") <= front).select("element", "key", "rank", "keys")
    ready = (shown.groupBy("key").agg(F.count("*").alias("_n"), F.first("keys").alias("_keys"),
                                      F.first("rank").alias("rank"))
             .filter("_n = _keys").select("key", "rank"))
    ready = cut_lineage(ready, spent)
    higher = shown.join(ready.select("key"), "key", "left_semi")
    lower = shown.select("element", F.col("key").alias("lower_key"), F.col("rank").alias("lower_rank"))
    pairs = (higher.join(lower, "element")
             .filter((F.col("lower_rank") < F.col("rank")) & may_reach(F.col("key"), F.col("lower_key"), threshold))
             .select("key", "rank", "lower_key").distinct())
    scored = score_pairs(pairs, "key", "lower_key", threshold).select("key", "rank", "lower_key")
    return _resolve(ready, cut_lineage(scored, spent), spent)


def _resolve(ready: DataFrame, edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Anchors among the ``ready`` texts, given their similar lower ones.

    A text without any is an anchor, one that is similar to an anchor is not, and texts known not to
    be anchors stand in nobody's way. What follows from what may be a chain as long as the ranks, so the texts are dealt
    into ranges of ranks and each task goes through its own in order. The lowest range still open is always decided as a
    whole, so there are at most as many steps as ranges, each over what the steps before left open.
    """
    placed = cut_lineage(ready.orderBy("rank").select("key", "rank", F.monotonically_increasing_id().alias("place")), spent)
    lower = placed.select(F.col("key").alias("lower_key"), F.col("place").alias("lower"))
    # A lower text that is not ready is never decided here.
    rows = (edges.select("key", "lower_key").join(placed.select("key", "place"), "key").join(lower, "lower_key", "left")
            .select("place", F.coalesce("lower", F.lit(-1).cast("long")).alias("lower"), F.lit(OPEN).alias("lower_status")))
    ends = placed.select("place", F.lit(None).cast("long").alias("lower"), F.lit(OPEN).alias("lower_status"))
    rows = cut_lineage(rows.unionByName(ends), spent)
    n_rows, anchors = rows.count(), None
    while True:
        ranges = -(-n_rows // RANGE_ROWS) or 1
        found = cut_lineage(rows.repartitionByRange(ranges, "place").sortWithinPartitions("place")
                            .mapInArrow(_decide_range, "place long, lower long, status int"), spent)
        new = found.filter(F.col("status") == ANCHOR).select("place")
        anchors = new if anchors is None else anchors.unionByName(new)
        counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
        n_rows = counts.pop(OPEN, 0)
        if not n_rows or not counts:
            break
        decided = found.filter(F.col("status") != OPEN).select(F.col("place").alias("lower"), F.col("status").alias("lower_status"))
        rows = (found.filter(F.col("status") == OPEN).drop("status").join(decided, "lower", "left")
                .select("place", "lower", F.coalesce("lower_status", F.lit(OPEN)).alias("lower_status")))
    return placed.join(anchors, "place", "left_semi").select("key", "rank")


def _decide_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through the texts of one range, sorted by place; what can't be told yet comes back as it was.

    A text has a row per similar lower text and one without. A decided text comes back as one row with its status, an open
    one as its rows whose lower text is open.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    place, lower_status = table["place"].to_numpy(), table["lower_status"].to_numpy()
    lower = table["lower"].fill_null(_END).to_numpy()
    own, starts = np.unique(place, return_index=True)
    local = np.searchsorted(own, lower)
    local[local == len(own)] = 0
    here = own[local] == lower
    status = np.full(len(own), OPEN, dtype=np.int32)
    # Places of lower texts in this range, statuses of those elsewhere.
    for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(place)])):
        inside = here[start:end]
        known = np.where(inside, status[local[start:end]], lower_status[start:end])[lower[start:end] != _END]
        if (known == ANCHOR).any():
            status[i] = COVERED
        elif (known == COVERED).all():
            status[i] = ANCHOR
    of_row = np.repeat(status, np.diff([*starts, len(place)]))
    lower_now = np.where(here, status[local], lower_status)
    is_end = lower == _END
    kept = is_end | ((of_row == OPEN) & (lower_now == OPEN))
    yield pa.RecordBatch.from_arrays([pa.array(place[kept]), pa.array(lower[kept], mask=is_end[kept]), pa.array(of_row[kept])],
                                     names=["place", "lower", "status"])


def _lowest_anchor(work: DataFrame, anchors: DataFrame, threshold: int, parts: int) -> DataFrame:
    """For each text the lowest new anchor it is similar to; hot join keys are spread by a salt."""
    offered = (work.select("element", F.col("key").alias("anchor_key"))
               .join(anchors.select(F.col("key").alias("anchor_key"), F.col("rank").alias("anchor_rank")), "anchor_key")
               .select("*", copies(parts)))
    targets = work.select("*", salt("key", parts))
    better = (F.col("anchor_rank") < F.col("rank")) & (F.col("owner").isNull() | (F.col("anchor_rank") < F.col("owner")))
    pairs = (targets.join(offered, ["element", "salt"])
             .filter(better & may_reach(F.col("key"), F.col("anchor_key"), threshold))
             .select("key", "anchor_key", "anchor_rank").distinct())
    return (score_pairs(pairs, "key", "anchor_key", threshold)
            .groupBy("key").agg(F.min("anchor_rank").alias("found")))


def description_clusters(members: DataFrame) -> DataFrame:
    """One row per cluster: anchor, number of descriptions, number of transactions.

    The descriptions themselves stay rows of ``members``, as a cluster may have any number of them.
    """
    return (members.groupBy("anchor")
            .agg(F.count("*").alias("n_aliases"), F.sum("count").alias("count"))
            .orderBy(F.desc("count"), "anchor"))


def cluster_samples(rows: DataFrame, members: DataFrame, max_rows: int = SAMPLE_ROWS,
                    order: str = "ingest_seq") -> DataFrame:
    """The first ``max_rows`` ledger rows of each cluster, as (anchor, sample_no, columns...).

    Each description first gives up all but its own first rows, so a description with very many rows
    is never shuffled as a whole, and the join sees at most ``max_rows`` rows of it.
    """
    columns = [c for c in _SAMPLE if c in rows.columns]

    def first_rows(df: DataFrame, by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
        return df.withColumn("sample_no", rank).filter(F.col("sample_no") <= max_rows)

    few = first_rows(rows.select(*columns, order), "description").drop("sample_no")
    return (first_rows(few.join(members.select("description", "anchor"), "description"), "anchor")
            .select("anchor", "sample_no", *columns))


def cluster_report(rows: DataFrame, members: DataFrame, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Review table: one row per cluster with its counts and its sample rows, biggest cluster first."""
    samples = cluster_samples(rows, members, max_rows)
    columns = [date_text(F.col("date")).alias("date") if c == "date" else F.col(c)
               for c in samples.columns if c not in ("anchor", "sample_no")]
    grouped = samples.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("sample_no", *columns))).alias("samples"))
    return (description_clusters(members).join(grouped, "anchor", "left")
            .orderBy(F.desc("count"), "anchor"))
