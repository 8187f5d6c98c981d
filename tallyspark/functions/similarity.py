"""Token-sort similarity: 200 * LCS / (length a + length b) of the token-sorted texts."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import WHITESPACE, strip

# The scorer travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"


def token_sort(c: Column) -> Column:
    """White-space separated tokens in sorted order, joined by single spaces."""
    tokens = F.filter(F.split(strip(c), _SPACES), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def _codes(texts: pd.Series, lengths: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Code points, a row per text, filled up with ``pad``; all texts are encoded at once."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    out = np.full((len(texts), width), pad, dtype=np.int32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lcs_lengths(left: pd.Series, right: pd.Series, chunk_cells: int = 1 << 21) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts, a chunk of pairs at a time.

    Bit-parallel: a row of 64-bit words stands for the places of the left text, in which a 0 marks a
    place where the length grows. A character of the right text updates all of them by one addition.
    """
    n = len(left)
    result = np.zeros(n, dtype=np.int32)
    if n == 0:
        return result
    a_sizes, b_sizes = left.str.len().to_numpy(), right.str.len().to_numpy()
    order = np.argsort(a_sizes, kind="stable")
    start = 0
    while start < n:
        widest = int(a_sizes[order[min(n - 1, start + 4095)]])
        take = order[start:start + max(1, min(4096, chunk_cells // (widest + 1)))]
        words = max(1, -(-int(a_sizes[take].max()) // 64))
        # Different padding on the two sides never counts as equal.
        ac = _codes(left.iloc[take], a_sizes[take], words * 64, -1)
        bc = _codes(right.iloc[take], b_sizes[take], int(b_sizes[take].max()), -2)
        rows = np.full((len(take), words), ~np.uint64(0))
        for j in range(bc.shape[1]):
            equal = np.packbits(ac == bc[:, j:j + 1], axis=1, bitorder="little").view("<u8")
            both = rows & equal
            carry = np.zeros(len(take), dtype=np.uint64)
            for w in range(words):
                total = rows[:, w] + both[:, w]
                over = total < both[:, w]
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                rows[:, w] = total | (rows[:, w] & ~equal[:, w])
        result[take] = words * 64 - np.bitwise_count(rows).sum(axis=1)
        start += len(take)
    return result


def lcs_table(left: pd.Series, right: pd.Series) -> np.ndarray:
    """The same for every text of ``right`` (rows) with every one of ``left`` (columns).

    The places of a character in the texts of the left are found once; a character of the right takes them from there.
    """
    a_sizes, b_sizes = left.str.len().to_numpy(), right.str.len().to_numpy()
    words = max(1, -(-int(a_sizes.max()) // 64))
    ac = _codes(left, a_sizes, words * 64, -1)
    bc = _codes(right, b_sizes, int(b_sizes.max()), -2)
    letters = np.intersect1d(ac, bc)
    masks = np.zeros((len(letters) + 1, words, len(left)), dtype=np.uint64)  # the last one is of all other characters
    for mask, letter in zip(masks, letters):
        mask[:] = np.packbits(ac == letter, axis=1, bitorder="little").view("<u8").T
    at = np.searchsorted(letters, bc)
    at[~np.isin(bc, letters)] = len(letters)
    rows = [np.full((len(right), len(left)), ~np.uint64(0)) for _ in range(words)]
    for j in range(bc.shape[1]):
        carry = None
        for w in range(words):
            both = rows[w] & masks[at[:, j], w]
            total = rows[w] + both
            if words > 1:
                over = total < both
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            rows[w] = total | (rows[w] ^ both)
    return words * 64 - sum(np.bitwise_count(r).astype(np.int32) for r in rows)


@F.pandas_udf(T.IntegerType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(left, right))


# Marked so that a filter on the result is not pushed below it, which would compute it twice.
lcs = lcs.asNondeterministic()


def ratio(lcs_length: Column, a: Column, b: Column) -> Column:
    """Score in percent; two blank texts are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(lcs_length * 200.0 / total)


def reaches(lcs_length: Column, a: Column, b: Column, threshold: int) -> Column:
    """``ratio >= threshold`` in whole numbers, so the bound itself is included exactly."""
    return lcs_length * 200 >= (F.length(a) + F.length(b)) * threshold


def most_edits(a: Column, b: Column, threshold: int) -> Column:
    """Most characters that may be unmatched in texts that reach the threshold."""
    return F.floor((F.length(a) + F.length(b)) * (100 - threshold) / 100).cast("int")


def may_reach(a: Column, b: Column, threshold: int) -> Column:
    """Cheap exact filter run before the score: lengths first, then the edit distance.

    The edit distance never exceeds the number of unmatched characters, la + lb - 2 * LCS.
    """
    total = F.length(a) + F.length(b)
    lengths = F.least(F.length(a), F.length(b)) * 200 >= total * threshold
    return lengths & (F.call_function("levenshtein", a, b, most_edits(a, b, threshold)) >= 0)
