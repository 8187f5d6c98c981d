"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a hash of id and text, so that rows without an id are spread too. A copy of a document gets a virtual finish time: the words its
source has sent so far, this copy included, divided by the source's target. Ordered by virtual time all sources advance at
their target rates; the mix is the prefix of that global order that fits the budget. A source whose target exceeds its size
sends its documents again, in the same order, up to ``MAX_EPOCHS`` times.

No source is handled by one task: running sums are taken within (source, hash range) and (time range) cells of bounded size
and shifted by the sums of the cells before. Both kinds of cell hold about ``CELL_ROWS`` rows at any data size, and the table
of their sums that many times fewer rows than there are documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import id_key, row_key, store, whole_rows, word_count
from tallyspark.operators.scale import lookup_join

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
CELL_ROWS = 500
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``_source_key``, ``_rank``, ``source_size``, ``total``, ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words. A target stops at
    ``MAX_EPOCHS`` times the source's size; the excess goes to the others by weight. In order of size per weight the sources
    that stop come first, so the common level is found by prefix sums over the sources (a table of one row per source).
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_rank")
    before, onward = (by_ratio.rowsBetween(Window.unboundedPreceding, -1),
                      by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
              .withColumn("_rank", F.row_number().over(by_name)).withColumn("_weight", weight)
              .withColumn("_cap", F.col("source_size") * MAX_EPOCHS)
              .withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    levelled = (ranked.withColumn("total", F.sum("source_size").over(everything))
                .withColumn("_level", (F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                            / F.sum("_weight").over(onward)))
    level = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(everything)
    return levelled.select(
        id_key(F.col("_source")).alias("_source_key"), "_rank", "source_size", "total",
        F.least(F.col("_cap").cast("double"), level * F.col("_weight")).alias("target"))


def _cell(order: Column, cells: int) -> Column:
    """The first 32 bits of a hash in hex digits, cut into ``cells`` equal ranges."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.lit(cells) / F.lit(1 << 32)).cast("long")


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """One row per document: ``id_col``, ``text_hash``, ``size``, ``source_size``, ``target``, ``copies``, ``finish``.

    ``copies`` is how often the mix takes the document, ``finish`` the virtual time of its first copy. The same input gives
    the same mix. Rows equal in id and text are interchangeable. A null id is a document of its own, hashed as an empty
    string, as is a null text; a null source is a source; a null or empty text has size 0. If all sizes are 0, all
    targets are 0 and nothing is taken. An empty table gives no rows.
    """
    col = lambda name: F.col(f"`{name}`")
    sized = store(docs.select(
        col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(source_col).cast("string").alias("_source"),
        word_count(col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(col(id_col).cast("string"), F.lit("")),
                          F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))))).alias("_order")), "mix-sizes")
    rows = sized.count()
    targets = source_targets(sized, weights)
    known = lookup_join(sized.withColumn("_source_key", id_key(F.col("_source"))), targets, "_source_key")

    cell = ["_rank", "_cell"]
    in_cell = Window.partitionBy(*cell).orderBy("_order", "size", "text_hash")
    celled = known.withColumn("_cell", _cell(F.col("_order"), max(1, rows // CELL_ROWS)))
    offsets = celled.groupBy(*cell).agg(F.sum("size").alias("_cell_size")).select(
        *cell, F.coalesce(F.sum("_cell_size").over(
            Window.partitionBy("_rank").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    queued = (celled.withColumn("_running", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_number", F.row_number().over(in_cell))
              .join(offsets, cell)
              .select("_id", "text_hash", "size", "source_size", "total", "target", "_rank", "_order", "_number",
                      (F.col("_offset") + F.col("_running")).alias("_sent")))
    queued = store(queued, "mix-queue")
    cut = _budget_cut(queued, max(1, rows // CELL_ROWS))
    copies = F.lit(0)
    for epoch in range(MAX_EPOCHS):
        copies = copies + F.when(_sends(epoch) & _within(cut, epoch), 1).otherwise(0)
    return queued.select(F.col("_id").alias(id_col), "text_hash", "size", "source_size", "target",
                         copies.cast("int").alias("copies"), _finish(0).alias("finish"))


def _finish(epoch: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("source_size") * epoch + F.col("_sent")) / F.col("target"))


def _sends(epoch: int) -> Column:
    """A source starts an epoch only if its target is not met by the epochs before."""
    return (F.col("target") > 0) & (F.col("source_size") * epoch < F.col("target"))


def _position(epoch: Column) -> list[Column]:
    """The global order of copies: virtual time first, the rest breaks ties."""
    return [F.col("_finish"), F.col("_rank"), F.col("_order"), epoch, F.col("_number")]


def _budget_cut(queued: DataFrame, ranges: int) -> tuple | None:
    """The last position within the budget; None if nothing exceeds it, an empty tuple if nothing fits.

    Words per unit of virtual time are even by construction, so ranges of equal width split the global order evenly. Their
    sums show the range in which the budget ends; only that range is sorted.
    """
    sent = F.array(*[F.when(_sends(e), F.struct(F.lit(e).alias("_epoch"), _finish(e).alias("_finish")))
                     for e in range(MAX_EPOCHS)])
    copies = (queued.select("*", F.explode(F.array_compact(sent)).alias("_copy"))
              .select("size", "total", "_rank", "_order", "_number", "_copy._epoch", "_copy._finish")
              .withColumn("_range", F.floor(F.col("_finish") * ranges)))
    per_range = copies.groupBy("_range").agg(F.sum("size").alias("_size"), F.first("total").alias("total"))
    running = per_range.withColumn("_until", F.sum("_size").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    last = running.filter(F.col("_until") > F.col("total")).orderBy("_range").first()
    if last is None:
        return None
    # Zero-size copies never exceed the budget, so the position is complete without the ranges after this one.
    ordered = Window.orderBy(*_position(F.col("_epoch"))).rowsBetween(Window.unboundedPreceding, 0)
    fits = (copies.filter(F.col("_range") == last["_range"])
            .withColumn("_until", F.lit(last["_until"] - last["_size"]) + F.sum("size").over(ordered))
            .filter(F.col("_until") <= F.col("total")))
    top = fits.agg(F.max(F.struct(*_position(F.col("_epoch")))).alias("top")).first()["top"]
    return tuple(top) if top is not None else (last["_range"] / ranges,)


def _within(cut: tuple | None, epoch: int) -> Column:
    if cut is None:
        return F.lit(True)
    if len(cut) == 1:
        return _finish(epoch) < F.lit(cut[0])
    return F.struct(_finish(epoch), F.col("_rank"), F.col("_order"), F.lit(epoch), F.col("_number")) <= F.struct(
        F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2]), F.lit(cut[3]), F.lit(cut[4]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, range-sorted by virtual time.

    Columns of ``docs`` are kept whatever their names. Equal cases as in ``queue``; of rows with equal id and text each gets
    a share of the copies they have together.
    """
    taken = (queue(docs, weights, id_col, text_col, source_col)
             .groupBy(F.concat_ws(":", id_key(F.col(f"`{id_col}`")), "text_hash").alias("_key"))
             .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"), F.min("finish").alias("_first"),
                  F.max(F.try_divide("source_size", "target")).alias("_epoch")).filter("_copies > 0"))
    keyed = whole_rows(docs).withColumn("_key", row_key(F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")))
    # Equal rows divide their copies: each gets the quotient, the first ones one more.
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_first"))
    share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(
        F.col("_number") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return (keyed.join(taken, "_key").withColumn("_number", number).withColumn("_share", share.cast("int"))
            .filter("_share > 0")
            .select("_row", "_first", "_epoch", F.explode(F.sequence(F.lit(1), F.col("_share"))).alias("_copy"))
            .withColumn("_time", F.col("_first") + (F.col("_copy") - 1) * F.col("_epoch"))
            .repartitionByRange("_time").sortWithinPartitions("_time").select("_row.*"))
