"""Size checks, lineage cuts and joins that tolerate hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1000
_run: ContextVar[str | None] = ContextVar("run", default=None)


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` with one aggregate and compare its size with ``max_bytes``."""
    size = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)) + 16
        else:
            size = size + 16
    measured = df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"]
    return (measured or 0) <= max_bytes


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Within ``run_folder`` it is the folder of that run. A folder of this machine is made up only on a local master, where
    every task runs on it.
    """
    if _run.get() is not None:
        return _run.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tallyspark-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of plans made within lie in one folder, which is deleted at the end: act on the plans before."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, spent: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, so that a lost executor does not replay the plan behind it.

    With ``spent`` the table is noted there, for ``forget`` once nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._cut_path = path
    if spent is not None:
        spent.append(stored)
    return stored


def forget(spent: list[DataFrame]) -> None:
    """Delete tables that ``cut_lineage`` wrote."""
    for stored in spent:
        delete(stored.sparkSession, stored._cut_path)
    spent.clear()


def lookup_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join ``rows`` to ``table`` (one row per non-null ``key``) without a hot-key task.

    A measured small ``table`` is broadcast and ``rows`` stays where it is. Otherwise the
    ``HOT_KEYS`` most frequent keys are broadcast, the rows they serve are spread evenly over the
    shuffle, and only the rest is matched by hash.
    """
    table = cut_lineage(table)  # measured and joined, computed once
    if is_small(table):
        return rows.join(F.broadcast(table), key, "left")
    return _split_hot_keys(rows, table, key)


def _split_hot_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    values = [c for c in table.columns if c != key]
    # Names of its own that no column of either side has.
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in [*rows.columns, *table.columns]))
    at, hot, cold = f"{own}key", f"{own}hot", f"{own}cold"
    hot_values = table.join(F.broadcast(hot_keys(rows, key)), key, "left_semi").select(
        key, F.struct(*values).alias(hot))
    # The same on every attempt of a task; the partition number keeps copies of one row apart.
    spread = F.concat(F.lit("\0"), F.xxhash64(
        F.spark_partition_id(), *[F.col(f"`{c}`") for c in rows.columns]).cast("string"))
    # A key that is a number is matched as its text, else the spread rows would be read as numbers.
    textual = isinstance(table.schema[key].dataType, (T.StringType, T.BinaryType))
    matched = F.col(key) if textual else F.col(key).cast("string")
    keyed = rows.join(F.broadcast(hot_values), key, "left").withColumn(
        at, F.when(F.col(hot).isNull() & F.col(key).isNotNull(), matched).otherwise(spread))
    rest = table.select(matched.alias(at), F.struct(*values).alias(cold))
    joined = keyed.join(rest, at, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(F.col(hot), F.col(cold))[v].alias(v) for v in values])


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The ``HOT_KEYS`` most frequent keys, among them every key with one row in ``HOT_KEYS``."""
    return (rows.filter(F.col(key).isNotNull()).groupBy(key).count()
            .orderBy(F.desc("count"), key).limit(HOT_KEYS).select(key))
