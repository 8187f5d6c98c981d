"""Phrase collocations of a language from a weighted de Bruijn graph of its words.

Nodes are pairs of words, an edge is a run of three words and leads from its first pair to its last. Only edges are counted;
shorter counts are flows: a pair occurs as often as it is left, along an edge or because its piece ends there, and a word as
often as pairs it begins, or pieces it ends. Edges whose nodes carry the same flow throughout form a unary path. Such paths
are compacted by pointer doubling into one row each (a passage that always runs the same way); within a path every count is
the path's, so only its two ends need the counts of other nodes.

Blocks of text count their edges before these are shuffled, once, by their first node: there the edges and the flows of the
nodes are added up, and only what reaches the minimum is kept, beside the words. Pairs that are very common in a sample of the
texts are spread by what follows them; the sample decides on nothing but that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Numbers, drop_stored, store
from tallyspark.operators.scale import lookup_join

MIN_COUNT = 10
SCALE = 1_000_000
#: A phrase is dropped if a longer one has at least this percentage of its occurrences.
CONTAINED_PERCENT = 50
TOP_PHRASES = 2000
UNKNOWN_LANG = "und"
#: Texts of the sample, the share of its runs from which on a pair is very common, and into how many parts it is spread.
SAMPLE_TEXTS = 5_000
HOT_SHARE = 0.0005
HOT_PARTS = 64
#: Bytes of text counted at once.
BLOCK_BYTES = 6 * 1024 * 1024

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if b in _BREAKS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
# Bytes that UTF-8 never has: the end of a piece, and a place where a long piece is cut for memory only.
_END, _CUT = b"\xff", b"\xfe"
_ELSEWHERE = " "  # no word has a space
_FLOWS = "lang string, node string, next string, n long"


class Graph(NamedTuple):
    """Counts of a corpus, exact from ``min_count`` on."""

    edges: DataFrame  #: lang, node (first two words), next (third), n
    nodes: DataFrame  #: lang, node, n: pairs that reach the minimum
    words: DataFrame  #: lang, word, n: words that reach the minimum
    totals: DataFrame  #: lang, n: all words


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A folded text in parts of about ``size`` bytes, each of whole pieces or marked as cut within one."""
    text = text.translate(_FOLD)
    start = 0
    while len(text) - start > size:
        end = text.rfind(b"\n", start, start + size)
        if end > start:
            yield text[start:end]
            start = end + 1
            continue
        whole = text.rfind(b" ", start, start + size)
        words = text[start:max(start, whole)].split()
        if len(words) < 4:  # no word is cut
            break
        yield b" ".join([*words, _CUT])
        text, start = b" ".join([*words[-2:], text[whole:]]), 0
    yield text[start:]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Per block and language: the words, numbered, and the text as their numbers (0 end of a piece, 1 cut)."""
    parts: dict[str, list[bytes]] = {}
    held = 0

    def numbered() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        while parts:
            lang, texts = parts.popitem()
            yield lang, *_numbered(texts)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist()):
            for part in _pieces(text, size):
                parts.setdefault(lang, []).append(part)
                held += len(part)
                if held >= size:
                    yield from numbered()
                    held = 0
    yield from numbered()


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    numbers = Numbers({_END: 0, _CUT: 1})
    found = b"\n".join(texts).replace(b"\n", b" \xff ").split()
    texts.clear()
    ids = np.fromiter(map(numbers.__getitem__, found), dtype=np.int64, count=len(found))
    return list(numbers), ids


def _flows(size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _blocks(batches, size):
            yield _edges(lang, words, ids)

    return counted


def _edges(lang: str, words: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
    """Rows (lang, node, next, n) of a block: what follows each pair of words, and each word that ends a piece."""
    # Words are numbered in order, so that rows that follow each other begin alike, which compresses better.
    names = pa.array(words[2:], pa.binary())
    order = pc.sort_indices(names)
    rank = np.arange(len(words))
    rank[2:][order.to_numpy()] = np.arange(2, len(words))
    padded = np.concatenate([rank[ids], np.zeros(2, dtype=np.int64)])
    first, second, third = padded[:-2], padded[1:-1], padded[2:]
    # After a cut the same words start again, with what follows them.
    here = (first > 1) & (second != 1) & ~((second > 1) & (third == 1))
    first, second, third = first[here], second[here], third[here]
    pair, n_words = second > 1, len(words)
    ends, ends_n = np.unique(first[~pair], return_counts=True)
    nodes, node_at = np.unique(first[pair] * n_words + second[pair], return_inverse=True)
    edges, edge_n = np.unique(node_at * (n_words + 1) + np.where(third > 1, third, n_words)[pair], return_counts=True)
    named = pa.concat_arrays([pa.array(["", ""], pa.string()), names.take(order).cast(pa.string()), pa.array([_ELSEWHERE], pa.string())])
    pairs = pc.binary_join_element_wise(named.take(pa.array(nodes // n_words)), named.take(pa.array(nodes % n_words)), " ")
    node = pa.concat_arrays([named.take(pa.array(ends)), pairs.take(pa.array(edges // (n_words + 1)))])
    follower = named.take(pa.array(np.concatenate([np.full(len(ends), n_words), edges % (n_words + 1)])))
    counts = pa.array(np.concatenate([ends_n, edge_n]), pa.int64())
    lang_column = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([lang_column, node, follower, counts], ["lang", "node", "next", "n"])


def build(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
          block_bytes: int = BLOCK_BYTES) -> Graph:
    """Edges, node flows and word flows of the whole texts of ``docs``, per language.

    Null texts are empty, a null language is ``und``; every row counts, repeated rows too; a piece of any length is
    counted whole. Other columns are not read, whatever their names. An empty table gives an empty graph.
    """
    read = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    flows = read.mapInArrow(_flows(block_bytes), _FLOWS).join(F.broadcast(_hot_nodes(read, block_bytes)), ["lang", "node"], "left")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("next"), F.lit(HOT_PARTS))).alias("part")
    flows = flows.select("lang", "node", "next", "n", part).repartition("lang", "node", "part")
    # Both sums read one exchange: ``next`` is named in the second, too, so that neither reads less of it than the other.
    counted = flows.groupBy("lang", "node", "part", "next").agg(F.sum("n").alias("n"))
    reached = F.when(F.col("next") != _ELSEWHERE, F.col("n")).otherwise(F.lit(0)) >= min_count
    edges = counted.filter(reached).select(F.lit("edge").alias("kind"), "lang", "node", "next", "n")
    left = flows.groupBy("lang", "node", "part").agg(F.sum(F.col("n") + F.length("next") * 0).alias("n"))
    may_reach = F.contains("node", F.lit(" ")) & ((F.col("n") >= min_count) | F.col("part").isNotNull())
    # A node's flow is kept as its own count if that may reach the minimum, and goes to its first word in any case.
    shares = F.array_compact(F.array(
        F.when(may_reach, F.struct(F.lit("node").alias("kind"), F.col("node").alias("text"))),
        F.struct(F.lit("word").alias("kind"), F.substring_index("node", " ", 1).alias("text"))))
    flowed = (left.select("lang", "n", F.explode(shares).alias("s")).groupBy("s.kind", "lang", "s.text").agg(F.sum("n").alias("n"))
              .filter((F.col("kind") == "word") | (F.col("n") >= min_count))
              .select("kind", "lang", F.col("text").alias("node"), F.lit(None).cast("string").alias("next"), "n"))
    stored = store(edges.unionByName(flowed), "collocation-graph")
    words = stored.filter("kind = 'word'").select("lang", F.col("node").alias("word"), "n")
    return Graph(stored.filter("kind = 'edge'").select("lang", "node", "next", "n"),
                 stored.filter("kind = 'node'").select("lang", "node", "n"),
                 words.filter(F.col("n") >= min_count), words.groupBy("lang").agg(F.sum("n").alias("n")))


def _hot_nodes(read: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (lang, node, hot) of the very common pairs, at most one for each ``HOT_SHARE``."""
    texts = read.count()
    sample = read.sample(min(1.0, SAMPLE_TEXTS / max(1, texts)), seed=1)
    counted = sample.mapInArrow(_flows(block_bytes), _FLOWS).groupBy("lang", "node").agg(F.sum("n").alias("n"))
    least = HOT_SHARE * (counted.agg(F.sum("n").alias("n")).first()["n"] or 0)
    found = (counted.filter((F.col("n") >= least) & (F.col("node") != "")).orderBy(F.desc("n"), "lang", "node")
             .limit(int(1 / HOT_SHARE)).select("lang", "node").collect())
    return read.sparkSession.createDataFrame([(*r, True) for r in found], "lang string, node string, hot boolean")


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("\0", *parts)


def compact(graph: Graph) -> DataFrame:
    """Rows (lang, words, n, flow_in, flow_out): every edge is in one path; a path longer than an edge is unary inside.

    ``flow_in`` and ``flow_out`` are the counts of the first and of the last pair of words. A path never leaves the piece of
    text it lies in, so it is no longer than the longest piece.
    """
    flows = graph.nodes.select(_key("lang", "node").alias("key"), F.col("n").alias("flow"))
    head = F.concat_ws(" ", F.substring_index("node", " ", -1), "next")
    # An edge has ``min_count`` occurrences at least, so no node has edges out of proportion to its words' share of the text.
    edges = graph.edges.withColumn("key", _key("lang", "node")).join(flows, "key").withColumnRenamed("flow", "flow_in")
    edges = edges.withColumn("key", _key("lang", head)).join(flows, "key").withColumnRenamed("flow", "flow_out")
    edges = store(edges.withColumn("id", _key("lang", F.concat_ws(" ", "node", "next"))), "collocation-edges")
    # A node is unary if one edge brings all its flow and one takes it; each then links to the other.
    brings = edges.filter("n = flow_out").select("key", F.col("id").alias("head"))
    takes = edges.filter("n = flow_in").select(_key("lang", "node").alias("key"), "id")
    links = store(takes.join(brings, "key").select("id", "head", F.lit(1).alias("steps"), F.lit(False).alias("done")),
                  "collocation-links")
    while not links.filter("not done").isEmpty():
        ahead = links.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"),
                             F.col("done").alias("_done"))
        jumped = links.filter("not done").join(ahead, "head", "left").select(
            "id", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.coalesce("_done", F.lit(True)).alias("done"))
        spent, links = links, store(links.filter("done").unionByName(jumped), "collocation-links")
        drop_stored(spent)
    placed = edges.join(links.select("id", F.col("head").alias("path"), "steps"), "id", "left").select(
        "lang", F.coalesce("path", "id").alias("path"), F.coalesce("steps", F.lit(0)).alias("steps"), "node", "next", "n",
        "flow_in", "flow_out")
    step = F.struct("steps", "node", "next", "flow_in", "flow_out")
    paths = placed.groupBy("lang", "path").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(step)).alias("edges"))
    paths = paths.select("lang", F.concat(F.split(F.col("edges")[0]["node"], " "), F.col("edges.next")).alias("words"), "n",
                         F.col("edges")[0]["flow_in"].alias("flow_in"), F.element_at("edges", -1)["flow_out"].alias("flow_out"))
    return store(paths, "collocation-paths")


def candidates(graph: Graph, paths: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, first, last, begin, end): phrases of two or three words that no longer one stands for.

    ``begin`` and ``end`` are the counts of the first and the last two words of three.
    """
    size = F.size("words")
    at = F.explode(F.sequence(F.lit(0), size - 3)).alias("at")
    threes = paths.select("*", at).select(
        "lang", F.slice("words", F.col("at") + 1, 3).alias("run"), F.col("n").alias("a"),
        F.when(F.col("at") == 0, F.col("flow_in")).otherwise(F.col("n")).alias("begin"),
        F.when(F.col("at") == size - 3, F.col("flow_out")).otherwise(F.col("n")).alias("end"))
    threes = threes.select("lang", F.array_join("run", " ").alias("phrase"), "a", F.get("run", F.lit(0)).alias("first"),
                           F.get("run", F.lit(2)).alias("last"), "begin", "end")
    # A pair inside a path always goes on the same way. At the ends of paths the fullest edge decides.
    inner = F.explode(F.transform(F.sequence(F.lit(2), size - 2), lambda i: F.array_join(F.slice("words", i, 2), " ")))
    inside = paths.filter(size > 3).select("lang", inner.alias("node"))
    ends = F.explode(F.array(F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", size - 1, 2), " ")))
    fullest = paths.select("lang", ends.alias("node"), "n").groupBy("lang", "node").agg(F.max("n").alias("longer"))
    stands_alone = F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * CONTAINED_PERCENT)
    unknown = F.lit(None).cast("long")
    twos = (graph.nodes.join(inside, ["lang", "node"], "left_anti").join(fullest, ["lang", "node"], "left")
            .filter(stands_alone).select(
                "lang", F.col("node").alias("phrase"), F.col("n").alias("a"), F.substring_index("node", " ", 1).alias("first"),
                F.substring_index("node", " ", -1).alias("last"), unknown.alias("begin"), unknown.alias("end")))
    return threes.unionByName(twos)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals of 38 digits."""
    def whole(c: Column, digits: int = 16) -> Column:
        return c.cast(f"decimal({digits},0)")

    return F.call_function("div", whole(a) * whole(a) * whole(F.lit(SCALE), 7), whole(left) * whole(right))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 top: int | None = TOP_PHRASES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Ties rank by count, then by the phrase's bytes. Nulls, empty texts, repeated rows and empty tables as in ``build``.
    """
    graph = build(docs, text=text, lang=lang, min_count=min_count, block_bytes=block_bytes)
    found = candidates(graph, compact(graph))
    words = graph.words.select(_key("lang", "word").alias("key"), F.col("n").alias("flow"))
    for side in ("first", "last"):
        found = lookup_join(found.withColumn("key", _key("lang", side)), words, "key").withColumnRenamed("flow", f"{side}_n")
    early = F.coalesce("end", "last_n")
    scored = found.withColumns({"early": _score(F.col("a"), F.col("first_n"), early),
                                "late": F.when(F.col("begin").isNotNull(), _score(F.col("a"), F.col("begin"), F.col("last_n")))})
    cut_late = F.col("late").isNotNull() & (F.col("late") < F.col("early"))
    scored = scored.select(
        "lang", "phrase", "a", F.when(cut_late, F.col("begin")).otherwise(F.col("first_n")).alias("l"),
        F.when(cut_late, F.col("last_n")).otherwise(early).alias("r"), F.when(cut_late, F.col("late")).otherwise(F.col("early")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    totals = graph.totals.select("lang", "n")
    return lookup_join(ranked, totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
