"""One run from raw files to the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.rules import categorize
from tallyspark.operators.scale import run_folder
from tallyspark.plans.month_table import write_month_sums
from tallyspark.sources.statements import read_raw_files, stage
from tallyspark.sources.store import append_ledger, read_staged, write_staged


def ingest(spark: SparkSession, raw: str, staged: str, batch_id: int, multi_line: bool = False) -> dict[str, int]:
    """Raw files to staged rows and rejects, in a folder per batch; ``multi_line`` if quoted cells may hold line breaks.

    Returns the counts of ``write_staged``."""
    with run_folder(spark):
        return write_staged(stage(read_raw_files(spark, raw, batch_id, multi_line)), f"{staged.rstrip('/')}/batch={batch_id}")


def categorize_batch(spark: SparkSession, staged: str, ledger: str, batch_id: int,
                     merchants: DataFrame, patterns: DataFrame) -> None:
    """Staged rows of one batch into the ledger. Running it again adds nothing."""
    rows = read_staged(spark, f"{staged.rstrip('/')}/batch={batch_id}")
    with run_folder(spark):
        append_ledger(spark, ledger, categorize(rows, merchants, patterns), dates=rows)


def run(spark: SparkSession, raw: str, staged: str, ledger: str, batch_id: int,
        merchants: DataFrame, patterns: DataFrame, multi_line: bool = False, months: str | None = None) -> dict[str, int]:
    """One batch from raw files to the ledger and, with ``months``, to the table of month sums there; the counts of ``ingest``."""
    counts = ingest(spark, raw, staged, batch_id, multi_line)
    categorize_batch(spark, staged, ledger, batch_id, merchants, patterns)
    if months is not None:
        write_month_sums(spark, ledger, months, batch_id, read_staged(spark, f"{staged.rstrip('/')}/batch={batch_id}"))
    return counts


def categorized_counts(categorized: DataFrame) -> DataFrame:
    """Rows and amounts per type, category and subcategory."""
    return categorized.groupBy("type", "category", "subcategory").agg(
        F.count("*").alias("n"), F.sum("paid_out").alias("paid_out"), F.sum("paid_in").alias("paid_in"))
