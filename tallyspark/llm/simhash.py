"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most ``d`` bits share at least ``8 - d`` bytes at
their positions, so the index posts a fingerprint under every choice of ``8 - d`` positions and their bytes: similar ones
meet, and a list holds few others. Within a list the shared bytes of a pair are tallied: a pair below the minimum is
impossible there, and one that shares more than the minimum is taken up in the first of its lists only. What is left is
verified by its bit distance.

Work per list is bounded. Equal fingerprints are one entry. A list of more than ``LIST_ROWS`` entries is posted again under
choices of the half bytes that it leaves open; the new lists leave four bits per differing bit open, so with four bits at
most 2**16 fingerprints can share one. A list hands on a spanning forest of its links, never its pairs, and components come from
alternating star contraction, so nothing here grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import drop_stored, row_key, store, whole_rows, words_of
from tallyspark.operators.scale import lookup_join

SHINGLE = 4
MAX_BITS = 4
LIST_ROWS = 4096
SEED = 42
_SLICE = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    tally = np.zeros(64, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(joined)]
    for at in range(0, n, _SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _SLICE], stops[at:at + _SLICE])],
                          dtype="<u8")
        tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return hashed(text)


def _first_met(fps: np.ndarray, others: np.ndarray, number: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Count filter: True for pairs that share enough bytes and meet in no earlier list than in list ``number``.

    ``positions`` has a row per list: which of the eight positions it is posted under.
    """
    same = (fps ^ others).view(np.uint8).reshape(-1, 8) == 0
    shared = int(positions[0].sum())
    leading = same & (np.cumsum(same, axis=1) <= shared)
    return (same.sum(axis=1) >= shared) & (leading == positions[number]).all(axis=1)


def _spanning_links(fps: np.ndarray, ends: np.ndarray, number: np.ndarray, positions: np.ndarray,
                    max_bits: int) -> np.ndarray:
    """Index pairs that span the links (at most ``max_bits`` apart) within each list.

    ``ends`` holds for each entry where its list ends. All lists are compared at once, each entry with the one ``step``
    places further; pairs already joined are skipped, so at most one link per entry is found.
    """
    label = np.arange(len(fps))
    found = [np.empty((0, 2), dtype=np.int64)]
    at = np.arange(len(fps))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < ends[at]]
        near = at[(np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits) & (label[at] != label[at + step])]
        if not len(near):
            continue
        near = near[_first_met(fps[near], fps[near + step], number[near], positions)]
        joined = []
        for a, b in zip(near.tolist(), (near + step).tolist()):
            low, high = sorted((_root(label, a), _root(label, b)))
            if low != high:
                label[high] = low
                joined.append((a, b))
        if joined:
            found.append(np.array(joined, dtype=np.int64))
            while (label != label[label]).any():
                label = label[label]
    return np.concatenate(found)


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        i = int(label[i])
    return i


def _posts(fp: Column, choices: list[tuple[int, ...]], width: int) -> Column:
    """For every choice of positions (units of ``width`` bits): its number, then the bits at its positions, as one long."""
    unit = (1 << width) - 1
    out = []
    for number, positions in enumerate(choices):
        packed = F.lit(number).cast("long")
        for p in positions:
            packed = F.shiftleft(packed, width).bitwiseOR(F.shiftrightunsigned(fp, p * width).bitwiseAND(F.lit(unit)))
        out.append(packed)
    return F.array(*out)


def _lists(posted: DataFrame, keys: list[str]) -> DataFrame:
    """The postings of lists with two entries or more, with the list's length ``n``; stored."""
    sized = posted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return store(sized.filter("n > 1"), "simhash-lists")


def _links_in_lists(lists: DataFrame, keys: list[str], max_bits: int, choices: list[tuple[int, ...]]) -> DataFrame:
    """Links (``a``, ``b``) from bounded lists. A partition's lists are read one after the other."""
    positions = np.zeros((len(choices), 8), dtype=bool)
    for row, chosen in zip(positions, choices):
        row[list(chosen)] = True
    key_bits = 8 * len(choices[0])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            edges = list_edges(batch)
            rest = batch.iloc[edges[-1]:]  # the last list may go on in the next batch
            yield links(batch.iloc[:edges[-1]], edges)
        if rest is not None:
            yield links(rest, np.array([0, len(rest)]))

    def list_edges(batch: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True
        for key in keys:
            column = batch[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new) if len(batch) else np.array([0])

    def links(part: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        fps = part["fp"].to_numpy()
        ends = np.repeat(edges[1:], np.diff(edges))
        number = part[keys[0]].to_numpy() >> key_bits
        pairs = _spanning_links(fps.view(np.uint64), ends, number, positions, max_bits)
        return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})

    # The partitioning keeps a list together, the sort makes its entries neighbours.
    return (lists.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "fp")
            .mapInPandas(scan, "a long, b long"))


def similar_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links among the distinct longs ``fp`` that join all fingerprints at most ``max_bits`` apart, directly or by others.

    ``max_bits`` may be 1 to 4: a linked pair then shares half of its bytes or more, which keeps the lists short.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits is 1 to 4")
    choices = list(combinations(range(8), 8 - max_bits))
    # Fingerprints are few and their posts many: they are dealt to all cores first.
    fps = fps.repartition(fps.sparkSession.sparkContext.defaultParallelism * 2, "fp")
    lists = _lists(fps.select("fp", F.explode(_posts(F.col("fp"), choices, 8)).alias("k1")), ["k1"])
    links = _links_in_lists(lists.filter(F.col("n") <= LIST_ROWS), ["k1"], max_bits, choices)
    long_lists = lists.filter(F.col("n") > LIST_ROWS).select("k1", "fp")
    if not long_lists.isEmpty():
        # The bytes a list leaves open hold 2 * max_bits half bytes, of which a linked pair shares max_bits.
        opened = F.element_at(F.array(*[_open_bits(F.col("fp"), c) for c in choices]),
                              (F.shiftright("k1", 8 * (8 - max_bits)) + 1).cast("int"))
        halves = list(combinations(range(2 * max_bits), max_bits))
        finer = long_lists.withColumn("_open", opened).select(
            "k1", "fp", F.explode(_posts(F.col("_open"), halves, 4)).alias("k2"))
        links = links.unionByName(_links_in_lists(_lists(finer, ["k1", "k2"]), ["k1", "k2"], max_bits, choices))
    return store(links.distinct(), "simhash-links")


def _open_bits(fp: Column, chosen: tuple[int, ...]) -> Column:
    """The bytes of ``fp`` at the positions that aren't ``chosen``, packed."""
    packed = F.lit(0).cast("long")
    for p in range(8):
        if p not in chosen:
            packed = F.shiftleft(packed, 8).bitwiseOR(F.shiftrightunsigned(fp, p * 8).bitwiseAND(F.lit(255)))
    return packed


def components(links: DataFrame) -> DataFrame:
    """One row per linked vertex: ``fp`` and ``root``, the smallest vertex of its component.

    Alternating star contraction: every vertex links its larger neighbours, then its smaller ones, to the smallest of all.
    The number of rounds grows with the logarithm of a component's size. Each round writes its links and drops the last.
    """
    stars, before = links, None
    while True:
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _link_to_smallest(both, F.col("b") > F.col("a"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _link_to_smallest(down, F.lit(True))
        now = store(small.distinct(), "simhash-stars")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"),
                        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if stars is not links:
            drop_stored(stars)
        stars = now
        if state == before:
            break
        before = state
    roots = stars.select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()


def _link_to_smallest(edges: DataFrame, chosen: Column) -> DataFrame:
    """For each ``a``: link its ``chosen`` neighbours ``b``, and itself, to the smallest of ``a`` and all its neighbours."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = lookup_join(edges, smallest, "a")
    own = joined.select("a", F.col("m").alias("b"))
    return joined.filter(chosen).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b")


def _labelled(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``_key`` (of id and text), ``fp``, ``root``, ``component_id``."""
    row_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    prints = store(docs.select(row_id.alias("_id"), row_key(row_id, text).alias("_key"),
                               fingerprint_column(text, shingle).alias("fp")), "simhash-prints")
    distinct = store(prints.groupBy("fp").agg(F.min("_id").alias("first_id")), "simhash-distinct")
    linked = components(similar_links(distinct, max_bits))
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return lookup_join(prints, rooted.select("fp", "root").join(smallest, "root"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` (a long) and ``component_id``, the smallest id in its component.

    A null, empty or blank text has fingerprint 0 and is linked like any other. A null id is passed over unless a component
    has no other. Repeated rows are rows of the same component. An empty table gives no rows. Other columns aren't read.
    """
    labelled = _labelled(docs, shingle, max_bits, id_col, text_col)
    return labelled.select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, that with the smallest id; its columns may have any names.

    Null ids come last; among rows with equal ids the smallest row key decides, and one of wholly equal rows stays.
    """
    labelled = _labelled(docs, shingle, max_bits, id_col, text_col)
    winners = (labelled.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key")).alias("w"))
               .select("w._key").distinct())
    keyed = whole_rows(docs).withColumn("_key", row_key(F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")))
    return keyed.join(winners, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
