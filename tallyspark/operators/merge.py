"""Union of batches into one ledger without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import month_label
from tallyspark.schema import DEDUPE_KEYS, empty_to_null, missing_columns


def dedupe_keep_first(df: DataFrame, order: str | list = "ingest_seq", keys=None) -> DataFrame:
    """Keep the earliest row of each key; nulls are equal. Unchanged when a key column is missing.

    The rank filter is applied on both sides of the shuffle, so of a key with very many copies only
    one row per input partition travels.
    """
    keys = list(keys or DEDUPE_KEYS)
    if missing_columns(df, keys):
        return df
    order = [order] if isinstance(order, (str, Column)) else order
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def union_batches(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def merge_ledger(existing: DataFrame, new: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Existing rows win over new ones with the same key; the first of equal new rows wins."""
    old_first = union_batches(existing.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1)))
    return dedupe_keep_first(old_first, ["_new", order]).drop("_new")


def ledger_sorted(ledger: DataFrame) -> DataFrame:
    """Newest first, undated rows last. The further keys break up a date that holds very many rows."""
    ties = [c for c in ("description", "source", "ingest_seq") if c in ledger.columns]
    return ledger.orderBy(F.desc_nulls_last("date"), *ties)


def new_rows(ledger: DataFrame, batch: DataFrame, order: str = "ingest_seq",
             dates: DataFrame | None = None) -> DataFrame:
    """Rows of ``batch`` that ``merge_ledger`` would add; only the months in the batch are read.

    ``dates`` are the batch's rows before they were categorised; with them the months are found
    without matching the rules a second time.

    The list of months is bounded by the calendar, which is what allows its broadcast and with it
    partition pruning of the ledger. Keys of known rows and the rows of the batch meet in the one
    shuffle that finds the first of equal rows; ``dates`` may name months that the batch lacks.
    """
    rows = batch.withColumn("month", month_label(F.col("date")))
    if missing_columns(ledger, DEDUPE_KEYS):
        return dedupe_keep_first(rows, order)
    months = (batch if dates is None else dates).select(month_label(F.col("date")).alias("month")).distinct()
    known = ledger if "month" in ledger.columns else ledger.withColumn("month", month_label(F.col("date")))
    touched = known.join(F.broadcast(months), "month", "left_semi").select(*DEDUPE_KEYS)
    if any(touched.schema[k].dataType != rows.schema[k].dataType for k in DEDUPE_KEYS):
        # Equal values of different types are equal keys, and the rows keep the types they have.
        touched = touched.select(*[F.col(k).alias(f"known_{k}") for k in DEDUPE_KEYS])
        same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in DEDUPE_KEYS]
        return dedupe_keep_first(rows, order).join(touched, on=same, how="left_anti")
    known_first = union_batches(touched.withColumn("_new", F.lit(0)), rows.withColumn("_new", F.lit(1)))
    return dedupe_keep_first(known_first, ["_new", order]).filter("_new = 1").select(*rows.columns)


def to_ledger(categorized: DataFrame) -> DataFrame:
    """Ledger form of categorised rows: blank texts become null, the month label is added."""
    return categorized.withColumns({
        "description": empty_to_null(F.col("description")),
        "subcategory": empty_to_null(F.col("subcategory")),
        "month": month_label(F.col("date")),
    })


def ingest_stats(batch: DataFrame) -> DataFrame:
    """Rows read and kept, duplicates removed and undated rows kept, per source."""
    per_key = batch.groupBy(*DEDUPE_KEYS).agg(F.count("*").alias("copies"))
    return per_key.groupBy("source").agg(
        F.sum("copies").alias("rows_read"),
        F.count("*").alias("rows_kept"),
        (F.sum("copies") - F.count("*")).alias("duplicates_removed"),
        F.count_if(F.col("date").isNull()).alias("undated_rows"),
    )
