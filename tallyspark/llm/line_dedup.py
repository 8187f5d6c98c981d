"""Line deduplication with levelled sorted runs of line hashes.

``LineRuns`` keeps the lines seen so far as sorted runs in the shared folder. A batch becomes one run: its lines are counted
per key, merge-anti-joined with the runs to find the keys not seen before, and written sorted by key. When a level has
``fanout`` runs they are compacted into one run of the next level, so there are only logarithmically many runs.

Lines are identified by the 128-bit MD5 of their key. What is shuffled and joined are these hashes; texts travel once, when
the flags of their lines come back. A key held by a third of all lines is one row per task before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE, drop_stored, lower_ascii, row_key, store, whole_rows
from tallyspark.operators.scale import lookup_join

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 3
BATCHES = 4


class LineRuns:
    """Runs of (``key``, ``n_docs``, ``keeper``): documents of the run that hold the key, and the keeper if the key was new.

    Exactly one run says who keeps a key: the first that held it.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (``key``, ``doc_id``) with one row per document and key; return the batch's own run.

        In it ``is_new`` marks the keys that no run held before. A null key is no line. An empty batch adds an empty run.
        The run returned can be read until the next batch is added: full levels are compacted before.
        """
        self._compact()
        batch = (lines.filter(F.col("key").isNotNull()).groupBy("key")
                 .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")))
        if self.runs():
            seen = reduce(DataFrame.unionByName, self.runs()).filter("is_new").select("key", F.lit(True).alias("_seen"))
            batch = batch.join(seen, "key", "left")
        else:
            batch = batch.withColumn("_seen", F.lit(None).cast("boolean"))
        is_new = F.col("_seen").isNull()
        run = store(batch.select("key", "n_docs", F.when(is_new, F.col("keeper")).alias("keeper"), is_new.alias("is_new"))
                    .sortWithinPartitions("key"), "line-run")
        self._push(run, 0)
        return run

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            spent = self.levels[level]
            if len(spent) >= self.fanout:
                self._push(store(_merge(spent).sortWithinPartitions("key"), "line-run"), level + 1)
                self.levels[level] = []
                for old in spent:
                    drop_stored(old)
            level += 1

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def keys(self) -> DataFrame:
        """One row per key over all runs."""
        return _merge(self.runs())


def _merge(runs: list[DataFrame]) -> DataFrame:
    return (reduce(DataFrame.unionByName, runs).groupBy("key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("is_new").alias("is_new")))


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """MD5 of the line without white space at its ends and with A-Z lower-cased; null below ``min_chars`` code points."""
    key = lower_ascii(F.btrim(line, F.lit(SPACE)))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_row`` (all its columns), ``n_lines``, ``n_dropped``, ``kept`` (the remaining text).

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines in all but the
    document with the largest id. Rows equal in id and text are one document; rows that share the largest id all keep the
    line, and a null id counts as smaller than any other. A null or empty text is one empty line. An empty table gives no
    rows. The columns of ``docs`` may have any names.

    Documents enter the runs in ``batches`` ranges of their ids, the largest first, so the first run that holds a key
    already holds its largest id.
    """
    spark = docs.sparkSession
    rows = whole_rows(docs)
    doc_id, text = F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")
    cuts = docs.agg(F.percentile_approx(F.col(f"`{id_col}`"), [i / batches for i in range(1, batches)], 1000)
                    .alias("cuts")).first()["cuts"] or []
    older = reduce(lambda a, b: a + b, [F.when(doc_id > F.lit(c), 0).otherwise(1) for c in cuts], F.lit(0))
    lines = store(
        rows.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("doc_key"), older.alias("batch"),
                    F.posexplode(F.transform(lines_of(text), lambda x: line_key(x, min_chars))).alias("pos", "key")),
        "lines", partition_by=("batch",))
    runs = LineRuns(spark)
    for batch in range(len(cuts) + 1):
        held = lines.filter((F.col("batch") == batch) & F.col("key").isNotNull()).select("key", "doc_id", "doc_key")
        runs.add(held.distinct())
    repeated = runs.keys().filter(F.col("n_docs") >= min_docs).select("key", F.struct("keeper").alias("owner"))
    flagged = lookup_join(lines.drop("batch"), repeated, "key")
    drop = F.col("owner").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("owner.keeper"))
    # Position and flag in one number; equal rows of docs give equal numbers, which the set holds once.
    flags = (flagged.groupBy("doc_key")
             .agg(F.max(drop).alias("_any"), F.array_sort(F.collect_set(F.col("pos") * 2 + drop.cast("int"))).alias("flags"))
             .filter("_any").drop("_any"))
    joined = rows.withColumn("doc_key", row_key(doc_id, text)).join(flags, "doc_key", "left")
    kept_lines = F.zip_with(lines_of(text), F.col("flags"), lambda line, flag: F.when(flag % 2 == 0, line))
    return joined.select(
        "_row", F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("flags", F.lit(0).cast("long"), lambda n, flag: n + flag % 2), F.lit(0)).cast("long").alias(
            "n_dropped"),
        F.when(F.col("flags").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept_lines, "\n")).alias("kept"))

