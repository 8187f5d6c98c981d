"""Divergence of the sources of a language: pairs of sources over all kept terms, and the terms a source overuses.

Three-dimensional cube partitioning: the sources of a language are cut into blocks of ``GROUP_BLOCK``, its kept terms into
blocks of about ``TERM_BLOCK``. A slice holds the shares of one block of sources for one block of terms and is replicated to
every cell (source block, source block, term block) it takes part in. A cell adds up the differences of its pairs of sources
over its terms; the sums of the cells are then added along the term axis. So no task holds all terms of a pair or all pairs
of a language, whichever language or source most documents belong to.

Slices are sparse. A term that no source of a cell has differs by the shares of absent terms alone, so cells count the terms
they saw, and the rest is added once at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import store
from tallyspark.operators.scale import lookup_join

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
GROUP_BLOCK = 16
TERM_BLOCK = 4096
#: Counted terms a task holds before it passes them on.
HELD_TERMS = 400_000

#: Terms are runs of ASCII letters and anything beyond ASCII; the bytes of the latter are all above 0x7F.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTIALS = "lang string, a int, b int, part long, seen long"


class Audit(NamedTuple):
    """Tables behind an audit, for callers that want more than its ranks."""

    groups: DataFrame  #: lang, source, number (within lang), n (kept terms counted), terms (kept in lang), absent (share)
    shares: DataFrame  #: lang, source, number, term, block, place (within block), p, q
    pairs: DataFrame  #: lang, source, other, value


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs); every (lang, source) also comes up with a null term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        keys, sizes = list(counts), [len(n) for n, _ in counts.values()]
        index = np.repeat(np.arange(len(keys)), np.array(sizes, dtype=np.int64) + 1)
        terms: list[bytes | None] = []
        n: list[int] = []
        docs: list[int] = []
        for occurrences, documents in counts.values():
            terms += [None, *occurrences]
            n += [0, *occurrences.values()]
            docs += [0, *map(documents.__getitem__, occurrences)]
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()).take(pa.array(index)),
            pa.array([k[1] for k in keys], pa.string()).take(pa.array(index)),
            pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        texts, langs, sources = (batch.column(i) for i in range(3))
        for text, lang, source in zip(texts.cast(pa.binary()).to_pylist(), langs.to_pylist(), sources.to_pylist()):
            found = counts.get((lang, source))
            if found is None:
                found = counts[lang, source] = (Counter(), Counter())
            before = len(found[0])
            words = terms_of(text)
            found[0].update(words)
            found[1].update(set(words))
            held += len(found[0]) - before
            if held > HELD_TERMS:
                yield rows()
                counts.clear()
                held = 0
    if counts:
        yield rows()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, term, n occurrences, docs with it); a null term marks that the group occurs."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                         for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    return (read.mapInArrow(_term_counts, _COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), in decimals; null without terms."""
    above = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTHING) * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> Audit:
    """Shares of the kept terms and divergences of all pairs of sources, per language.

    A language keeps the terms found in at least ``min_docs`` of its documents. Null text, lang and source are read as ``''``.
    Every row is a document, repeated rows too. An empty text adds its group without terms; a language that keeps no term
    has pairs of value 0; an empty table gives empty tables. Other columns are not read, whatever their names.
    """
    counted = store(term_counts(docs, text=text, lang=lang, source=source), "divergence-counts")
    known = counted.filter("term is not null").withColumn("key", F.concat_ws("\0", "lang", "term"))
    kept = (known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= min_docs).drop("docs"))
    kept = store(kept, "divergence-terms")
    langs = counted.select("lang").distinct().join(
        kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = store(langs.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total")]).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("int")), "divergence-langs")

    # A term's block by its hash, its place within the block by its order: alike in all slices of the block.
    blocked = (lookup_join(kept, langs, "lang")
               .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    placed = blocked.select(F.concat_ws("\0", "lang", "term").alias("key"), "block", place.alias("place"),
                            share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    found = lookup_join(known.drop("docs"), placed, "key").filter("block is not null").drop("key")
    found = store(found, "divergence-kept")

    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left")
              .join(langs, "lang").select("lang", "source", number.alias("number"), F.coalesce("n", F.lit(0)).alias("n"),
                                          "terms", "blocks"))
    groups = store(groups.withColumn("absent", share(F.lit(0).cast("long"), F.col("n"), F.col("terms"))), "divergence-groups")
    sized = groups.select(F.concat_ws("\0", "lang", "source").alias("key"), "number", F.col("n").alias("total"), "terms")
    shares = lookup_join(found.withColumn("key", F.concat_ws("\0", "lang", "source")), sized, "key").select(
        "lang", "source", "number", "term", "block", "place",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "q")
    shares = store(shares, "divergence-shares")
    return Audit(groups, shares, _pairs(groups, shares, group_block))


def _pairs(groups: DataFrame, shares: DataFrame, group_block: int) -> DataFrame:
    of_block = F.floor(F.col("number") / group_block).cast("int").alias("groups")
    members = groups.groupBy("lang", of_block, "blocks").agg(
        F.array_sort(F.collect_list(F.struct("number", "absent"))).alias("members"))
    last = groups.groupBy("lang").agg(F.floor(F.max("number") / group_block).cast("int").alias("last"))
    slices = shares.groupBy("lang", of_block, "block").agg(F.collect_list(F.struct("number", "place", "p")).alias("entries"))
    all_slices = (members.join(last, "lang")
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .join(slices, ["lang", "groups", "block"], "left"))
    cells = all_slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "lang", F.least("groups", "other").alias("row"), F.greatest("groups", "other").alias("column"), "block", "groups",
        *[F.col(f"{a}.{f}").alias(f"{a}_{f}") for a, fs in (("members", ("number", "absent")), ("entries", ("number", "place", "p")))
          for f in fs])
    partial = cells.groupBy("lang", "row", "column", "block").applyInPandas(_cell, _PARTIALS)
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    ends = [groups.select("lang", F.col("number").alias(c), F.col("source").alias(f"source_{c}"),
                          F.col("absent").alias(f"absent_{c}"), *(["terms"] if c == "a" else [])) for c in ("a", "b")]
    unseen = (F.col("terms") - F.col("seen")) * F.abs(F.col("absent_a") - F.col("absent_b"))
    valued = summed.join(ends[0], ["lang", "a"]).join(ends[1], ["lang", "b"]).select(
        "lang", "source_a", "source_b", F.when(F.col("terms") > 0, F.col("part") + unseen).otherwise(0).alias("value"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("other")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("other")))).alias("pair")
    return valued.select("lang", both, "value").select("lang", "pair.*", "value")


def _cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Differences of the pairs of one cell, over the terms that any of its sources has."""
    slices = [row for _, row in cell.sort_values("groups").iterrows()]
    listed = [[np.zeros(0, np.int64) if s[c] is None else np.asarray(s[c]) for c in ("entries_number", "entries_place", "entries_p")]
              for s in slices]
    seen = np.unique(np.concatenate([place for _, place, _ in listed]))
    shares = []
    for s, (number, place, p) in zip(slices, listed):
        names = np.asarray(s["members_number"])
        absent = np.array([0 if a is None or a != a else a for a in s["members_absent"]], dtype=np.int64)
        table = np.repeat(absent[:, None], len(seen), axis=1)
        table[np.searchsorted(names, number), np.searchsorted(seen, place)] = p
        shares.append((names, table))
    (left, left_table), (right, right_table) = shares[0], shares[-1]
    out = []
    for i, a in enumerate(left):
        others = right > a
        if others.any():
            sums = np.abs(right_table[others] - left_table[i]).sum(axis=1)
            out.append(pd.DataFrame({"a": a, "b": right[others], "part": sums}))
    result = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "part": []})
    return result.assign(lang=cell["lang"].iloc[0], seen=len(seen))[["lang", "a", "b", "part", "seen"]].astype(
        {"a": "int32", "b": "int32", "part": "int64", "seen": "int64"})


def ranked(found: Audit, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all other sources by divergence, and the terms used above the
    language's share, the first ``top_terms`` of them. Equal values rank by item."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    pairs = found.pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = found.shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(terms.select(*columns))
