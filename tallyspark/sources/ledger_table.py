"""A ledger table whose rows lie in buckets of their dedupe key, so that appending a batch shuffles the batch only.

Each month is a partition and each partition has the same number of buckets, by a digest of the five dedupe columns. Of the
stored rows an append reads the months of the batch, bucket by bucket where they lie, and only the batch travels to them.
The table is external: its files are all there is, and any session that names the same folder has the same ledger.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import or_blank
from tallyspark.operators.merge import dedupe_keep_first, to_ledger
from tallyspark.operators.scale import cut_lineage, forget
from tallyspark.schema import DEDUPE_KEYS, LEDGER
from tallyspark.sources.store import table_exists

#: A bucket of a month should fit a task; more buckets make more files.
BUCKETS = 64
#: Rows that one task of an append sorts and writes, unless a single month has more in a bucket.
TASK_ROWS = 2_000_000
_KEY = "row_key"


def row_key(columns: list[str] = DEDUPE_KEYS) -> Column:
    """128 bits of a digest of the dedupe columns; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                        F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def ledger_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The name under which the ledger in a folder is known in this session; an empty one where there is none yet.

    ``buckets`` must be the number with which the folder was first written.
    """
    name = "ledger_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()
    fields = [f for f in LEDGER.fields if f.name != "month"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({columns}, {_KEY} string, month string) USING parquet
        PARTITIONED BY (month) CLUSTERED BY ({_KEY}) INTO {int(buckets)} BUCKETS LOCATION '{path.rstrip("/")}'""")
    if table_exists(spark, path):
        spark.catalog.recoverPartitions(name)
    return name


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    # A blank partition value is stored as none at all.
    return spark.table(ledger_table(spark, path, buckets)).drop(_KEY).withColumn("month", or_blank(F.col("month"))).select(
        *LEDGER.fieldNames())


def new_rows(spark: SparkSession, path: str, categorized: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that a merge would add, with their key. The months of the batch, as many as the calendar has, are collected."""
    first = _first_rows(categorized)
    return _unknown(spark, path, first, [r[0] for r in first.select("month").distinct().collect()], buckets)


def _first_rows(categorized: DataFrame) -> DataFrame:
    return dedupe_keep_first(to_ledger(categorized)).withColumn(_KEY, row_key())


def _unknown(spark: SparkSession, path: str, first: DataFrame, months: list[str], buckets: int) -> DataFrame:
    here = F.col("month").isin([m for m in months if m]) | (F.col("month").isNull() if "" in months else F.lit(False))
    known = spark.table(ledger_table(spark, path, buckets)).filter(here).select(F.col(_KEY).alias("_known"))
    return first.join(known, F.col(_KEY) == F.col("_known"), "left_anti")


def _month_groups(counts: dict[str, int], most: int) -> list[list[str]]:
    """Months in order, as many together as have at most ``most`` rows; a month with more is a group of its own."""
    groups: list[list[str]] = []
    rows = 0
    for month in sorted(counts):
        if not groups or rows + counts[month] > most:
            groups.append([])
            rows = 0
        groups[-1].append(month)
        rows += counts[month]
    return groups


def append(spark: SparkSession, path: str, categorized: DataFrame, buckets: int = BUCKETS) -> None:
    """Add the rows a merge would add. A task writes one bucket, a file for each month it has rows of.

    Few buckets and a large batch would give a task any number of rows, so months are appended in groups of at most
    ``TASK_ROWS`` rows a bucket. An append that is cut short has added whole groups; when repeated it adds the others.
    """
    spent: list[DataFrame] = []
    first = cut_lineage(_first_rows(categorized).sortWithinPartitions("month"), spent)
    counts = {r["month"]: r["count"] for r in first.groupBy("month").count().collect()}
    for months in _month_groups(counts, TASK_ROWS * buckets):
        added = _unknown(spark, path, first.filter(F.col("month").isin(months)), months, buckets)
        (added.select(*[c for c in LEDGER.fieldNames() if c != "month"], _KEY, F.when(F.col("month") != "", F.col("month")).alias("month"))
         .repartition(buckets, _KEY).sortWithinPartitions("month", _KEY)
         .write.mode("append").insertInto(ledger_table(spark, path, buckets)))
    forget(spent)
