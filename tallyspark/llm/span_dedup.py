"""Removal of passages that occur more than once, byte by byte, by threshold-bounded interval expansion.

A byte goes if a string of ``min_bytes`` that covers it also starts anywhere else. Equal strings of that length hold the same
gram of smallest hash, so the places where such strings start fall into runs that share a smallest gram, and only runs whose
gram comes up again can hold a repeated string. These runs are cut out with the bytes their strings cover and brought together
by gram, many grams to a block of bounded size. Each block is searched by its Burrows-Wheeler transform: intervals of equal
prefixes are extended backwards, breadth first, which gives the lengths of common prefixes in increasing order; the expansion
stops at ``min_bytes``, and what no shorter prefix has told apart is repeated.

Nothing is gathered that grows without bound: texts that occur as a whole more than once are searched once, equal runs of a
block are searched once, and a gram with more than ``HOT_ROWS`` runs is left out of the blocks. The strings of its runs are
counted by a 128-bit digest instead, which spreads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import id_key, mix64, store, whole_rows
from tallyspark.operators.scale import lookup_join

MIN_BYTES = 200
GRAM = 32
#: Most places of one run; a longer one is cut.
RUN_STARTS = 1024
#: Bytes hashed at once, and bytes of a block that is searched at once.
HASHED_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20
#: Runs of one gram that are searched in one block.
HOT_ROWS = 20_000

# Positions are kept in the low bits of a hash while the smallest is sought.
_PLACE = np.uint64((1 << 21) - 1)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "key binary, gram long, lo long, hi long, again boolean"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` bytes (a power of two)."""
    hashes, size, step = _BYTE_CODES[data], 1, _STEP
    while size < gram:
        hashes = hashes[:-size] * step + hashes[size:]
        size, step = size * 2, step * step
    return mix64(hashes)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[:size - width], values[width - size:])


def _runs_of(data: np.ndarray, lengths: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of places where strings of ``min_bytes`` start, within each text of the joined ``data``, that have the same
    smallest gram: first place, place after the last, the gram's hash, and whether the run holds the gram more than once."""
    hashes = _gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    coarse, width = hashes & ~_PLACE, min_bytes - gram + 1
    first = (_sliding_min(coarse | place, width) & _PLACE).astype(np.int64)
    last = len(hashes) - 1 - (_sliding_min(coarse | place[::-1], width) & _PLACE).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[:len(first)]
    inside = ends - np.arange(len(first)) >= min_bytes
    smallest = hashes[first]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (smallest[1:] != smallest[:-1])
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return lo, hi, smallest[lo], first[lo] != last[hi - 1]


def _index(min_bytes: int, gram: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        offsets: list[int] = []
        parts: list[bytes] = []

        def rows() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts])
            lo, hi, smallest, again = _runs_of(np.frombuffer(b"".join(parts), dtype=np.uint8), lengths, min_bytes, gram)
            pieces = -(-(hi - lo) // RUN_STARTS)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi, smallest, again = (np.repeat(a, pieces) for a in (lo, hi, smallest, again))
            lo = lo + number * RUN_STARTS
            hi = np.minimum(hi, lo + RUN_STARTS)
            again = again | np.repeat(pieces > 1, pieces)
            starts = np.cumsum(lengths) - lengths
            text = np.searchsorted(starts, lo, side="right") - 1
            shift = np.array(offsets, dtype=np.int64)[text] - starts[text]
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()).take(pa.array(text)), pa.array(smallest.view(np.int64)), pa.array(lo + shift),
                pa.array(hi + shift), pa.array(again)], ["key", "gram", "lo", "hi", "again"])

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Parts of a long text overlap, so that every string lies in the part its place belongs to.
                for start in range(0, len(text) - min_bytes + 1, HASHED_BYTES):
                    part = text[start:start + HASHED_BYTES + min_bytes - 1]
                    keys.append(key)
                    offsets.append(start)
                    parts.append(part)
                    held += len(part)
                    if held >= HASHED_BYTES // 2:
                        yield rows()
                        held = 0
                        for kept in (keys, offsets, parts):
                            kept.clear()
        if parts:
            yield rows()

    return indexed


def prefix_order(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` sorted by at least their first ``depth`` symbols.

    Symbol 0 ends a text; ``left`` is the number of symbols before the next 0. Suffixes that agree up to a 0 are equal.
    """
    size, n = 7, len(codes)
    padded = np.concatenate([codes, np.zeros(size, dtype=np.int64)])
    packed = np.zeros(n, dtype=np.int64)
    for j in range(size):
        packed = packed << 9 | np.where(left >= j, padded[j:j + n], 0)
    order = np.argsort(packed)
    ordered = packed[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    while size < depth:
        tied = np.concatenate([~starts[1:], [False]]) | ~starts
        at = np.flatnonzero(tied & (left[order] >= size))
        if not len(at):
            break
        places = order[at]
        pairs = rank[places] << 32 | rank[places + size]
        by_pair = np.argsort(pairs)
        places, pairs = places[by_pair], pairs[by_pair]
        order[at] = places
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        starts[at] = new
        rank[places] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        size *= 2
    return order


def interval_bounds(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Marks the rows of ``order`` at which a new prefix of ``length`` symbols begins.

    Intervals of suffixes with an equal prefix are extended by one symbol to the left, all of one length at a time. An
    extension that ends at a row not marked before shows that this row shares just one symbol less than its length with the
    row before it; one that ends at a marked row tells nothing new and is not followed.
    """
    n = len(codes)
    before = codes[order - 1]
    before[order == 0] = 0
    by_symbol = np.argsort(before, kind="stable")
    image = np.empty(n, dtype=np.int64)
    image[by_symbol] = np.arange(n)
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    earlier, later = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    marked = np.zeros(n + 1, dtype=bool)
    stops = np.cumsum(np.bincount(codes))
    stops = np.unique(stops[stops > 0])
    low, high = np.concatenate([[0], stops[:-1]]), stops
    marked[0] = True
    marked[high] = True
    for _ in range(1, length):
        if not len(low):
            break
        sizes = high - low
        rows = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        extends = before[rows] != 0
        opens = extends & (earlier[rows] < np.repeat(low, sizes))
        closes = extends & (later[rows] >= np.repeat(high, sizes))
        low, high = np.sort(image[rows[opens]]), np.sort(image[rows[closes]]) + 1
        new = ~marked[high]
        low, high = low[new], high[new]
        marked[high] = True
    return marked[:n]


def repeated_places(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Per body, whether the ``length`` bytes that start at each of its places also start at another place of any body."""
    sizes = np.array([len(b) for b in bodies])
    joined = np.frombuffer(b"\0".join([b"", *bodies, b""]), dtype=np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    joined[0] = 0
    joined[ends] = 0
    left = np.concatenate([[0], np.repeat(ends, sizes + 1) - np.arange(1, len(joined))])
    order = prefix_order(joined, left, length)
    group = np.cumsum(interval_bounds(joined, order, length)) - 1
    found = np.zeros(len(joined), dtype=bool)
    found[order] = np.bincount(group)[group] > 1
    return [found[e - s:e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist())]


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as maximal ones: those that overlap or touch become one."""
    by_start = np.argsort(lo, kind="stable")
    lo, reach = lo[by_start], np.maximum.accumulate(hi[by_start])
    apart = np.flatnonzero(lo[1:] > reach[:-1])
    return lo[np.concatenate([[0], apart + 1])], reach[np.concatenate([apart, [len(lo) - 1]])]


def _search(length: int, block_bytes: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[tuple[int, bytes], list[tuple[bytes, int]]] = {}
        held, last = 0, None

        def spans() -> Iterator[pa.RecordBatch]:
            bodies_of: dict[int, int] = {}
            for gram, _ in runs:
                bodies_of[gram] = bodies_of.get(gram, 0) + 1
            # A body that stands alone with its gram repeats itself or, with several owners, is repeated throughout.
            told = [(body, owners) for (gram, body), owners in runs.items() if bodies_of[gram] == 1 and len(owners) > 1]
            sought = [(body, owners) for (gram, body), owners in runs.items() if not (bodies_of[gram] == 1 and len(owners) > 1)]
            out: tuple[list[bytes], list[int], list[int]] = ([], [], [])

            def add(owners: list[tuple[bytes, int]], stretches: list[tuple[int, int]]) -> None:
                for key, start in owners:
                    for lo, hi in stretches:
                        for column, value in zip(out, (key, start + lo, start + hi)):
                            column.append(value)

            for body, owners in told:
                add(owners, [(0, len(body))])
            for (body, owners), places in zip(sought, repeated_places([b for b, _ in sought], length) if sought else ()):
                if len(owners) > 1:
                    add(owners, [(0, len(body))])
                elif places.any():
                    at = np.flatnonzero(places)
                    add(owners, list(zip(*(a.tolist() for a in merged(at, at + length)))))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                                                  pa.array(out[2], pa.int64())], ["key", "lo", "hi"])

        for batch in batches:
            for gram, key, lo, body in zip(*(c.to_pylist() for c in batch.columns)):
                if gram != last and held >= block_bytes:  # rows come by gram, so a gram is never parted
                    yield from spans()
                    runs.clear()
                    held = 0
                last = gram
                owners = runs.get((gram, body))
                if owners is None:
                    owners = runs[gram, body] = []
                    held += len(body)
                owners.append((key, lo))
                held += 100
        if runs:
            yield from spans()

    return searched


def _digests(length: int):
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            places: list[int] = []
            found: list[bytes] = []
            for key, lo, body in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(body) - length + 1
                keys += [key] * n
                places += range(lo, lo + n)
                found += [xxhash.xxh3_128_digest(body[i:i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(keys, pa.binary()),
                                              pa.array(places, pa.int64())], ["digest", "key", "lo"])

    return digested


_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
                     T.StructField("kept", T.BinaryType())])


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    out = []
    for data, begins, stops in zip(text, lo, hi):
        if begins is None or not len(begins):
            out.append((len(data), 0, [], [], data))
            continue
        begins, stops = merged(np.asarray(begins), np.asarray(stops))
        edges = [0, *np.column_stack([begins, stops]).ravel().tolist(), len(data)]
        kept = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
        out.append((len(data), len(data) - len(kept), begins.tolist(), stops.tolist(), kept))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])


def remove_repeated(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_bytes: int = MIN_BYTES,
                    gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (_row, n_bytes, n_removed, spans, kept): each row of ``docs`` with its text's repeated bytes taken out.

    ``spans`` are the maximal removed stretches (start, end) of the UTF-8 bytes and ``kept`` is what is left, which may begin
    or end within a character. A null text is empty; texts under ``min_bytes`` stay whole. Every row is a document: repeated
    rows, and rows of null or equal ids, are copies of each other. Ids serve only to search one of several equal texts. An
    empty table gives an empty one. Input columns are in ``_row``, so none can clash.
    """
    if gram & (gram - 1) or not gram <= min_bytes:
        raise ValueError("gram must be a power of two and at most min_bytes")
    data = F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).cast("binary")
    rows = whole_rows(docs).withColumn("data", data).withColumn("key", F.substring(F.unhex(F.sha2("data", 256)), 1, 16))
    owner = id_key(F.col(f"_row.`{id_col}`"))
    long_enough = F.octet_length("data") >= min_bytes
    copies = (rows.filter(long_enough).groupBy("key").agg(F.count("*").alias("copies"), F.min(owner).alias("owner"))
              .filter("copies > 1"))
    rows = lookup_join(rows, copies, "key")
    # One of several equal texts is searched, but of rows equal in id too all, as nothing tells them apart.
    texts = rows.filter(long_enough & (F.col("copies").isNull() | (F.col("owner") == owner))).select("key", "data")
    index = store(texts.mapInArrow(_index(min_bytes, gram), _RUNS), "spans-index")
    counts = index.groupBy("gram").agg(F.count("*").alias("runs")).filter("runs > 1")
    runs = lookup_join(index, counts, "gram").filter("runs > 1 or again")
    body = F.substring("data", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int") + (min_bytes - 1))
    # Equal rows have equal runs, so a text is joined once and each of the runs counts.
    bodies = runs.join(texts.dropDuplicates(["key"]), "key").select(
        "gram", "key", "lo", body.alias("body"), (F.coalesce("runs", F.lit(1)) > hot_rows).alias("hot"))
    usual = (bodies.filter("not hot").select("gram", "key", "lo", "body").repartition("gram").sortWithinPartitions("gram")
             .mapInArrow(_search(min_bytes, block_bytes), "key binary, lo long, hi long"))
    places = bodies.filter("hot").select("key", "lo", "body").mapInArrow(_digests(min_bytes), "digest binary, key binary, lo long")
    places = store(places, "spans-hot")
    often = places.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    hot = lookup_join(places, often, "digest").filter("n > 1").select("key", "lo", (F.col("lo") + min_bytes).alias("hi"))
    stretches = F.collect_list(F.struct("lo", "hi"))
    per_text = usual.unionByName(hot).groupBy("key").agg(stretches.alias("s")).select(
        F.col("key").alias("unique_key"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    # Of texts with copies all goes.
    copied = F.col("copies").isNotNull() & long_enough
    found = lookup_join(rows.withColumn("unique_key", F.when(~copied, F.col("key"))), per_text, "unique_key")
    whole = F.array(F.lit(0).cast("long")), F.array(F.octet_length("data").cast("long"))
    cut = _cut("data", F.when(copied, whole[0]).otherwise(F.col("lo")), F.when(copied, whole[1]).otherwise(F.col("hi")))
    return found.select("_row", cut.alias("_cut")).select(
        "_row", "_cut.n_bytes", "_cut.n_removed", F.arrays_zip(F.col("_cut.starts").alias("start"), F.col("_cut.ends").alias("end"))
        .alias("spans"), "_cut.kept")
