"""A ledger kept by a stream that remembers the keys it has seen.

Staged files arrive; of rows with equal dedupe columns the first one to arrive becomes a ledger row. The keys are the stream's
state, spread by their hash over the state store's partitions, so a batch meets the keys of its own rows and no stored month is
read again. Rows may come as late as they like: no key is ever forgotten, as a ledger has no date after which a row is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.functions.text import or_blank
from tallyspark.operators.merge import to_ledger
from tallyspark.operators.rules import categorize
from tallyspark.operators.scale import run_folder
from tallyspark.schema import DEDUPE_KEYS, INGEST_SEQ, LEDGER, STAGED, empty_to_null
from tallyspark.sources.store import table_exists

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ledger(spark: SparkSession, staged: str, ledger: str, checkpoint: str, merchants: DataFrame, patterns: DataFrame,
                  max_files: int = 10_000) -> DataStreamWriter:
    """A writer, to start with the trigger of choice, from folders of staged files to a ledger in folders per micro-batch.

    A micro-batch that is repeated after a failure replaces its own folder. Of equal rows within one micro-batch any one is
    taken. The state lies in RocksDB on the executors' disks, with copies in the checkpoint, so it may exceed their memory.
    """
    spark.conf.set(_STORE, _ROCKSDB)
    rows = (spark.readStream.schema(T.StructType([*STAGED.fields, T.StructField("ingest_seq", INGEST_SEQ)])).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(staged)
            # Blank texts are null in a ledger, and the key must be the ledger's.
            .withColumn("description", empty_to_null(F.col("description"))))

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with run_folder(session):
            rows = to_ledger(categorize(batch, merchants, patterns)).select(*LEDGER.fieldNames())
            (rows.hint("rebalance", "month").sortWithinPartitions("month")
             .write.mode("overwrite").partitionBy("month").parquet(f"{ledger.rstrip('/')}/batch={batch_id}"))

    return rows.dropDuplicates(DEDUPE_KEYS).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_streamed(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger that ``stream_ledger`` keeps; an empty one when there is none yet."""
    if not table_exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    stored = spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("batch", T.LongType())])).parquet(ledger)
    return stored.drop("batch").withColumn("month", or_blank(F.col("month")))
