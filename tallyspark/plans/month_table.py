"""Month figures kept with the ledger, so that reports need not read its rows.

A batch leaves one row per month, type, category, subcategory and sign of its amounts, with their sums. Such rows are what the
analytics of ``operating``, ``debt`` and ``p2p`` read of a ledger, so these take the table in the ledger's place and give the
same figures. Sums are taken from the rows the ledger holds of a batch: a batch that is run again finds none of its rows new,
but leaves the same sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import month_label, or_blank
from tallyspark.schema import MONEY, require_columns
from tallyspark.sources.store import read_ledger, table_exists

_NEEDED = ["date", "type", "category", "subcategory", "paid_out", "paid_in"]
_KEYS = ["month", "type", "category", "subcategory", "spends", "earns"]
_SUMS = "month string, type string, category string, subcategory string, spends boolean, earns boolean, paid_out decimal(38,2), paid_in decimal(38,2), n_rows long, batch long"


def _summed(df: DataFrame, n_rows) -> DataFrame:
    return df.groupBy(*_KEYS).agg(F.sum("paid_out").cast("decimal(38,2)").alias("paid_out"),
                                  F.sum("paid_in").cast("decimal(38,2)").alias("paid_in"), F.sum(n_rows).alias("n_rows"))


def month_sums(rows: DataFrame) -> DataFrame:
    """Sums of ledger rows. Amounts above zero are kept apart from others, as all conditions on amounts are of that kind."""
    df = require_columns(rows, _NEEDED, on_missing="empty")
    label = or_blank(F.col("month")) if "month" in df.columns else month_label(F.col("date"))
    above = {s: F.coalesce(F.col(c).cast(MONEY) > 0, F.lit(False)) for s, c in (("spends", "paid_out"), ("earns", "paid_in"))}
    return _summed(df.withColumns({"month": label, **above}), F.lit(1).cast("long"))


def write_month_sums(spark: SparkSession, ledger: str, path: str, batch_id: int, dates: DataFrame | None = None) -> None:
    """Replace the sums of one batch by those of the rows that the ledger at ``ledger`` holds of it.

    With ``dates``, the batch's rows, only the months in it are read.
    """
    rows = read_ledger(spark, ledger)
    if dates is not None:
        months = dates.select(month_label(F.col("date")).alias("month")).distinct()
        rows = rows.join(F.broadcast(months), "month", "left_semi")
    month_sums(rows.filter(F.col("ingest_seq.batch_id") == batch_id)).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/batch={int(batch_id)}")


def read_month_sums(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all batches together, in the form of a ledger (``date`` is the first of the month)."""
    if table_exists(spark, path):
        sums = spark.read.schema(_SUMS).parquet(path).drop("batch")
    else:
        sums = spark.createDataFrame([], _SUMS).drop("batch")
    return _summed(sums, F.col("n_rows")).withColumn(
        "date", F.when(F.col("month") != "", F.to_date(F.concat("month", F.lit("-01")), "yyyy-MM-dd"))).drop("spends", "earns")
