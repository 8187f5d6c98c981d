"""Similarity join of texts on what similar texts must have in common.

Two texts that reach the threshold have a common subsequence of a length that follows from their own. Where leaving out that
many characters gives few results (``MOST_SUBSEQUENCES``), these results are the join keys: texts meet exactly if they are
similar, however much all texts have in common.

Longer texts share many of their runs of three characters. Sorted by rarity, two of the first runs of the one text must then
be among those of the other (prefix filtering). Join keys are the runs found in few texts, each by itself, and the pairs of
those found in many: similar texts share a rare run or two common ones. So no two texts are compared unless they do, a run
that very many texts hold is no key by itself, and every similar pair is found.

Which keys a text has depends on its length and on the lengths it may meet; a small table has a row per length.
"""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.similarity import lcs, lcs_lengths, lcs_table, may_reach, most_edits, ratio, reaches, token_sort
from tallyspark.operators.scale import cut_lineage, is_small, lookup_join

# What compares a cell travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = 3
SHARED = 2
COMMON_FROM = 1000
SALTED_ROWS = 10_000
#: Most results of leaving characters out of a text that serve as its join keys.
MOST_SUBSEQUENCES = 200
#: Texts a side of a cell of pairs, most tasks that cells are dealt to, and how many meetings are never too many.
CELL = 2000
MOST_CELL_TASKS = 2000
FEW_PAIRS = 1_000_000
#: Bytes of a table of pairs that are compared at once, so that it stays in a core's cache.
TABLE_BYTES = 1 << 21
_PLAN = "length int, kinds array<int>, needs array<int>, left_out array<int>"


def _check(threshold: int) -> None:
    if not 1 <= threshold <= 100:
        raise ValueError(f"threshold must be within 1..100, got {threshold}")


def _lost(length: int, n: int, t: int) -> int:
    """Most runs of ``n`` characters a text of ``length`` can lose against a text that reaches ``t``.

    With d unmatched characters here and e there, n*d + (n-1)*e runs are lost at most, that is
    n*la + (n-1)*lb - (2n-1)*LCS where 200*LCS >= t*(la+lb). The partner's length is taken at its
    worst.
    """
    own, other = 200 * n - (2 * n - 1) * t, 200 * (n - 1) - (2 * n - 1) * t
    partner = -(-length * t // (200 - t)) if other < 0 else length * (200 - t) // t
    return (length * own + partner * other) // 200


def _safe_kind(length: int, t: int) -> int:
    """The longest run of which a text of ``length`` shares ``SHARED`` with every text that reaches ``t``; 0 if none."""
    return max((n for n in range(1, RUN + 1) if length - (n - 1) >= _lost(length, n, t) + SHARED), default=0)


def _left_out(length: int, other: int, t: int) -> int | None:
    """How many characters to leave out of a text so that it meets all similar ones of length ``other``; None if that
    gives too many results for either."""
    common = -(-t * (length + other) // 200)
    few = all(common <= n and math.comb(n, min(n - common, n // 2)) <= MOST_SUBSEQUENCES for n in (length, other))
    return length - common if few else None


def length_plan(lengths: list[int], t: int) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each of the sorted ``lengths`` the kinds of runs that are its keys, how many are needed of each kind, and how many
    characters are left out for subsequences.

    Elements of kind n are runs of n characters. Two texts meet on the longer of their safe kinds, unless they meet on
    subsequences. Texts too short for any kind have single characters of a kind of their own, 0, of which they share one.
    """
    safe = [_safe_kind(n, t) for n in lengths]
    plan = []
    for n, own in zip(lengths, safe):
        near = range(bisect.bisect_left(lengths, -(-n * t // (200 - t))), bisect.bisect_right(lengths, n * (200 - t) // t))
        out: set[int] = set()
        kinds: set[int] = set()
        if n > MOST_SUBSEQUENCES and t < 100:
            kinds = {max(own, k) for k in safe[near.start:near.stop]}
        else:
            for i in near:
                few = _left_out(n, lengths[i], t)
                if few is None:
                    kinds.add(max(own, safe[i]))
                else:
                    out.add(few)
        needs = [_lost(n, max(1, k), t) + (SHARED if k else 1) for k in range(RUN + 1)]
        plan.append((n, sorted(kinds), needs, sorted(out)))
    return plan


def elements(planned: DataFrame) -> DataFrame:
    """Rows (key, kind, need, element): runs of a text, of which the ``need`` rarest of each kind make join keys.

    Runs are numbered where they repeat, so that a set stands for a multiset.
    """
    each = planned.select("key", "length", "needs", F.explode("kinds").alias("kind")).withColumn("size", F.greatest("kind", F.lit(1)))
    runs = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1),
                                    lambda i: F.substring(F.col("key"), i, F.col("size"))))
    numbered = F.transform("runs", lambda g, i: F.concat_ws(
        "", F.col("kind"), F.lit(":"), g, F.lit("#"), i + 1 - F.array_position("runs", g)))
    return (each.filter("length >= size").withColumn("runs", runs)
            .select("key", "kind", F.get("needs", F.col("kind")).alias("need"), F.explode(numbered).alias("element")))


def subsequences(most: int) -> Column:
    """What is left of the text ``key`` without any choice of as many characters as ``left_out`` says, for each of its numbers."""
    def one_less(texts: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(texts, lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))

    by_number = [F.array("key")]
    for _ in range(most):
        by_number.append(one_less(by_number[-1]))

    def chosen(out: Column) -> Column:
        case = F.when(out == 0, by_number[0])
        for number, results in enumerate(by_number[1:], 1):
            case = case.when(out == number, results)
        return case

    return F.transform(F.flatten(F.transform("left_out", chosen)), lambda s: F.concat(F.lit("="), s))


def rare_elements(all_elements: DataFrame, frequency: DataFrame, common_from: int = COMMON_FROM) -> DataFrame:
    """Rows (key, element, freq) of the join keys among runs.

    The frequencies are broadcast when measured small, else their commonest elements are kept apart.
    A pair of common elements has no ``freq``.
    """
    per_text = Window.partitionBy("key", "kind").orderBy("freq", "element")
    first = (lookup_join(all_elements, frequency, "element")
             .withColumn("_rn", F.row_number().over(per_text)).filter(F.col("_rn") <= F.col("need")))
    alone = (F.col("freq") <= common_from) | (F.col("kind") == 0)
    common = first.filter(~alone).groupBy("key", "kind").agg(F.array_sort(F.collect_list("element")).alias("_e"))
    pairs = F.flatten(F.transform("_e", lambda x, i: F.transform(
        F.slice("_e", i + 2, F.size("_e")), lambda y: F.concat(x, F.lit("+"), y))))
    return (first.filter(alone).select("key", "element", "freq")
            .unionByName(common.select("key", F.explode(pairs).alias("element"), F.lit(None).cast("long").alias("freq"))))


def element_frequency(all_elements: DataFrame) -> DataFrame:
    return all_elements.groupBy("element").agg(F.count("*").alias("freq"))


def join_keys(keys: DataFrame, threshold: int, common_from: int = COMMON_FROM) -> DataFrame:
    """Rows (key, element, freq) for the distinct, non-null ``key`` of all texts that are to meet: similar texts share one.

    ``freq`` is known of rare runs only. Blank texts have none. The lengths that occur are collected, at most as many as the
    longest text has characters.
    """
    sized, plan, most, by_runs = _length_plan(keys, threshold)
    planned = sized.join(F.broadcast(plan), "length")
    exact = [] if most is None else [planned.select("key", F.explode(subsequences(most)).alias("element"), F.lit(None).cast("long").alias("freq"))]
    if exact and not by_runs:
        return exact[0]
    runs = cut_lineage(elements(planned))
    found = rare_elements(runs, element_frequency(runs), common_from)
    return found.unionByName(exact[0]) if exact else found


def _length_plan(keys: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, int | None, bool]:
    """The texts that aren't blank with their ``length``, the plan of lengths, the most characters it leaves out, if any, and
    whether it has runs."""
    _check(threshold)
    sized = keys.select("key", F.length("key").alias("length")).filter("length > 0")
    lengths = sorted(r[0] for r in sized.select("length").distinct().collect())
    plan = length_plan(lengths, threshold)
    most = max((out[-1] for _, _, _, out in plan if out), default=None)
    return sized, keys.sparkSession.createDataFrame(plan, _PLAN), most, any(kinds for _, kinds, _, _ in plan)


def with_subsequences(texts: DataFrame, threshold: int) -> DataFrame | None:
    """``texts`` with ``length`` and ``elements``, all join keys of the text ``key``; None if some need runs as keys.

    Texts of lengths m and n are then similar exactly if they share an element of 1 + k characters, 200 k >= threshold (m + n).
    """
    _, plan, most, by_runs = _length_plan(texts, threshold)
    if most is None or by_runs:
        return None
    planned = texts.withColumn("length", F.length("key")).join(F.broadcast(plan.select("length", "left_out")), "length", "left")
    none = F.array().cast("array<string>")
    return planned.withColumn("elements", F.coalesce(subsequences(most), none)).drop("left_out")


def shares(keys: DataFrame) -> int:
    """Into how many parts the texts of a join key are dealt: by the longest list, so that none has many rows."""
    longest = keys.groupBy("element").count().agg(F.max("count")).first()[0] or 1
    return -(-longest // SALTED_ROWS)


def salt(key: str, parts: int) -> Column:
    """Share of a join key's texts that a text belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("salt")


def copies(parts: int) -> Column:
    """One row per share, for the side that must meet all of them."""
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Distinct (key_a, key_b) of the token-sorted texts ``key`` of both sides that share a join key and whose length and edit
    distance allow the threshold. A join key found in very many texts of the right is spread by a salt. Where the keys would
    bring pairs together more often than there are pairs, all pairs are compared instead."""
    return _candidates(left, right, threshold, once=False)[0].select("key_a", "key_b")


def compared_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The candidate pairs, those of a text of the right at least by its own threshold ``need``. Where all pairs are compared,
    they come with their ``score`` and only if they reach that threshold."""
    needs = cut_lineage(right.groupBy("key").agg(F.min("need").alias("need")))
    lowest = needs.agg(F.min("need")).first()[0]
    return _candidates(left, needs, 100 if lowest is None else lowest, once=False)[0]


def _candidates(left: DataFrame, right: DataFrame, threshold: int, once: bool) -> tuple[DataFrame, bool]:
    """The candidate pairs, and whether each is there in one order only (key_a <= key_b). That is so if ``once`` asks for it
    and both sides have the same texts, as every pair then comes in both orders. Pairs have a ``score`` if all were compared."""
    needs = right if "need" in right.columns else right.select("key", F.lit(threshold).alias("need")).distinct()
    left, right = left.select("key").distinct(), needs.select("key")
    found = cut_lineage(join_keys(left.unionByName(right).distinct(), threshold).select("key", "element"))
    sides = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2))).groupBy("key").agg(F.sum("side").alias("side"))
    n_left, n_right, n_both = sides.agg(*[F.count_if(F.col("side").isin(*s)) for s in ((1, 3), (2, 3), (3,))]).first()
    once = once and n_left == n_right == n_both
    own_keys = found if once else found.join(left, "key", "left_semi")
    pool_keys = found if once else found.join(right, "key", "left_semi")
    asking = own_keys.groupBy("element").agg(F.count("*").alias("n_left"))
    lists = (asking.withColumn("n_right", F.col("n_left")) if once
             else pool_keys.groupBy("element").agg(F.count("*").alias("n_right")).join(asking, "element", "left"))
    longest, meetings = lists.agg(F.max("n_right"), F.sum(F.col("n_left").cast("double") * F.col("n_right"))).first()
    in_order = F.col("key_a") <= F.col("key_b") if once else F.lit(True)
    if (meetings or 0) > max(n_left * n_right, FEW_PAIRS):
        return _all_pairs(left, needs, n_left, n_right).filter(in_order), once
    parts = -(-(longest or 1) // SALTED_ROWS)
    offered = own_keys.select(F.col("key").alias("key_a"), "element", copies(parts))
    asked = pool_keys.select(F.col("key").alias("key_b"), "element", salt("key", parts))
    return (offered.join(asked, ["element", "salt"]).filter(in_order)
            .filter(may_reach(F.col("key_a"), F.col("key_b"), threshold))
            .select("key_a", "key_b").distinct()), once


def _all_pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """The pairs that reach the threshold ``need`` of their text of the right, with their ``score``, from a comparison of every
    non-blank text of the left with every one of the right, each pair once, in cells of ``CELL`` texts a side. For texts that
    share so many keys that the keys would bring pairs together more often than that."""
    rows, columns = -(-n_left // CELL), -(-n_right // CELL)
    cell = ["_row", "_column"]

    def dealt(texts: DataFrame, need: Column, parts: int, others: int, own: str, other: str) -> DataFrame:
        return texts.filter("key <> ''").select(
            "key", need.cast("int").alias("need"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    # Texts of the left have no ``need`` and come first.
    both = dealt(left, F.lit(None), rows, columns, *cell).unionByName(dealt(right, F.col("need"), columns, rows, *cell[::-1]))
    return (both.repartition(min(rows * columns, MOST_CELL_TASKS), *cell).sortWithinPartitions(*cell, "need")
            .mapInArrow(_score_cells, "key_a string, key_b string, score double"))


def _score_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell come one after the other, maybe in several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        table = batch.to_pandas()
        if not len(table):
            continue
        cells = table[["_row", "_column"]].to_numpy()
        ends = [*(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1), len(table)]
        for start, end in zip([0, *ends[:-1]], ends):
            if held and (held[-1][["_row", "_column"]].iloc[-1].to_numpy() != cells[start]).any():
                yield from _score_cell(pd.concat(held))
                held = []
            held.append(table.iloc[start:end])
    if held:
        yield from _score_cell(pd.concat(held))


def _score_cell(texts: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell. Texts are grouped by length, so that groups that differ too much are not compared."""
    texts = texts.assign(size=texts["key"].str.len()).sort_values("size", kind="stable")
    left, right = texts[texts["need"].isna()], texts[texts["need"].notna()]
    if not len(left) or not len(right):
        return
    lowest = int(right["need"].min())
    doublings = np.ceil(np.log2(np.maximum(1, -(-left["size"].to_numpy() // 64)))).astype(int)
    for number in np.unique(doublings):
        own = left[doublings == number]
        at_once = max(1, TABLE_BYTES // (8 * len(own) * 2 ** int(number)))
        sizes = own["size"].to_numpy()
        for start in range(0, len(right), at_once):
            others = right.iloc[start:start + at_once]
            low, high = int(others["size"].iloc[0]), int(others["size"].iloc[-1])
            near = own[(sizes * (200 - lowest) >= low * lowest) & (high * (200 - lowest) >= sizes * lowest)]
            if not len(near):
                continue
            common = lcs_table(near["key"], others["key"])
            total = near["size"].to_numpy() + others["size"].to_numpy()[:, None]
            b, a = np.nonzero(common * 200 >= total * others["need"].to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(near["key"], pa.string()).take(pa.array(a)), pa.array(others["key"], pa.string()).take(pa.array(b)),
                 pa.array(common[b, a] * 200.0 / total[b, a])], names=["key_a", "key_b", "score"])


def score_pairs(pairs: DataFrame, left: str, right: str, threshold: int, bounded: bool = False) -> DataFrame:
    """Pairs whose token-sorted texts reach the threshold, with their score. ``bounded`` pairs have passed ``may_reach``."""
    a, b = F.col(left), F.col(right)
    scored = (pairs if bounded else pairs.filter(may_reach(a, b, threshold))).withColumn("_lcs", lcs(a, b))
    return (scored.filter(reaches(F.col("_lcs"), a, b, threshold))
            .withColumn("score", ratio(F.col("_lcs"), a, b)).drop("_lcs"))


def _with_texts(pairs: DataFrame, key: str, texts: DataFrame, text: str) -> DataFrame:
    """``pairs`` with a row for each of the ``texts`` whose token-sorted form is ``key``.

    Most texts are their own form. If the texts of all other forms are measured small, they are broadcast and the pairs stay
    where they are.
    """
    others = texts.join(texts.filter(F.col(text) != F.col("key")).select("key").distinct(), "key", "left_semi")
    if not is_small(others):
        return pairs.join(texts.withColumnRenamed("key", key), key)
    named = others.select(F.col("key").alias(key), F.col(text).alias("_text"))
    return pairs.join(F.broadcast(named), key, "left").withColumn(text, F.coalesce("_text", key)).drop("_text")


def similar_pairs(anchors: DataFrame, pool: DataFrame, threshold: int = 85, *,
                  anchor: str = "anchor", text: str = "text") -> DataFrame:
    """Every (anchor, text, score) that reaches the threshold, blank texts excepted.

    Comparison is on the token-sorted form, so texts of equal form are compared once. If both sides have the same texts, a
    pair is compared in one order and given in both, as the score is the same.
    """
    _check(threshold)
    left = anchors.select(anchor).distinct().withColumn("key", token_sort(F.col(anchor)))
    right = pool.select(text).distinct().withColumn("key", token_sort(F.col(text)))
    pairs, once = _candidates(left, right, threshold, once=True)
    scored = pairs if "score" in pairs.columns else score_pairs(pairs, "key_a", "key_b", threshold, bounded=True)
    if once:
        there, back = F.struct("key_a", "key_b"), F.struct(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))
        both = F.when(F.col("key_a") == F.col("key_b"), F.array(there)).otherwise(F.array(there, back))
        scored = scored.select(F.explode(both).alias("_pair"), "score").select("_pair.*", "score")
    return _with_texts(_with_texts(scored, "key_a", left, anchor), "key_b", right, text).select(anchor, text, "score")


def best_pairs(pairs: DataFrame, by: list[str], limit: int, threshold: int, parts: int = 1) -> DataFrame:
    """Of the pairs (key_a, key_b) of each group ``by``, with a score, all that may be among its ``limit`` best.

    A pair's edit distance bounds its score. The pairs of a group come by falling bound and are scored a few at a time; once
    ``limit`` of them score more than the bounds of the rest, the rest is not scored. ``parts`` splits groups of very many
    pairs; each part then keeps its own best. Ties at the last place are all kept. ``n_scored`` is set on one row of a group
    and counts those scored of it, so that its sum tells the work; a group none of whose pairs reaches the threshold has
    that row alone, without a score.
    """
    _check(threshold)
    a, b = F.col("key_a"), F.col("key_b")
    size = F.length(a) + F.length(b)
    bounded = pairs.withColumn("_edits", F.call_function("levenshtein", a, b, most_edits(a, b, threshold))).filter("_edits >= 0")
    bounded = bounded.withColumn("_bound", F.when(size == 0, 100.0).otherwise((size - F.col("_edits")) * 100.0 / size))
    order = [*by, "_part", F.desc("_bound"), "key_b", "key_a"]
    dealt = (bounded.withColumn("_part", F.pmod(F.xxhash64("key_a", "key_b"), F.lit(parts)).cast("int"))
             .repartition(*by, "_part").sortWithinPartitions(*order).drop("_edits"))
    names, keys = pairs.columns, [*by, "_part"]
    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_scored", T.LongType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None  # the group of the batch before that may go on, and its best scores
        for batch in batches:
            table = batch.to_pandas()
            if not len(table):
                continue
            result, carried = _score_batch(table, keys, limit, threshold, carried)
            fields = [batch.schema.field(c) for c in names] + [pa.field("score", pa.float64()), pa.field("n_scored", pa.int64())]
            yield pa.RecordBatch.from_pandas(result, schema=pa.schema(fields), preserve_index=False)

    return dealt.mapInArrow(scored, schema)


def _score_batch(table: pd.DataFrame, keys: list[str], limit: int, threshold: int,
                 carried: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Score what is needed of a batch sorted by group and falling bound; also the last group's key and best scores."""
    own = list(table[keys].itertuples(index=False, name=None))
    starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
    best = [[] for _ in starts[1:]]
    if carried is not None and carried[0] == own[0]:
        best[0] = list(carried[1])
    score = np.full(len(table), np.nan)
    counted = np.zeros(len(table), dtype=np.int64)
    bound = table["_bound"].to_numpy()
    at, width = starts[:-1].copy(), max(4, 2 * limit)
    live = list(range(len(best)))
    while live:
        take = []
        still = []
        for g in live:
            low = best[g][-1] if len(best[g]) == limit else threshold
            end = at[g]
            while end < starts[g + 1] and end < at[g] + width and bound[end] >= low:
                end += 1
            if end > at[g]:
                take.append((g, at[g], end))
                at[g] = end
                still.append(g)
        if not take:
            break
        rows = np.concatenate([np.arange(begin, end) for _, begin, end in take])
        left, right = table["key_a"].iloc[rows].reset_index(drop=True), table["key_b"].iloc[rows].reset_index(drop=True)
        sizes = (left.str.len() + right.str.len()).to_numpy()
        common = lcs_lengths(left, right)
        reached = common * 200 >= sizes * threshold
        score[rows] = np.where(reached, np.where(sizes == 0, 100.0, common * 200.0 / np.maximum(sizes, 1)), np.nan)
        for g, begin, end in take:
            counted[starts[g]] += end - begin
            found = score[begin:end]
            best[g] = sorted([*best[g], *found[~np.isnan(found)].tolist()], reverse=True)[:limit]
        live = still
    low = np.repeat([b[-1] if len(b) == limit else threshold for b in best], np.diff(starts))
    out = table.assign(score=score, n_scored=counted)
    kept = out[(score >= low) | (counted > 0)]
    return kept.assign(score=kept["score"].where(kept["score"].notna() & (kept["score"] >= low[kept.index]), None)), (own[-1], best[-1])
