"""The same run driven by files as they arrive.

New files are handled in micro-batches by the batch plans. The checkpoint remembers which files are
done and the append ignores rows that are already there, so a repeated micro-batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators.rules import categorize
from tallyspark.operators.scale import run_folder
from tallyspark.sources.statements import stage, statement_lines, statement_records
from tallyspark.sources.store import append_ledger, read_staged, write_staged


def stream_statements(spark: SparkSession, raw: str, staged: str, ledger: str, checkpoint: str,
                      merchants: DataFrame, patterns: DataFrame, max_files: int = 10_000,
                      multi_line: bool = False) -> DataStreamWriter:
    """A writer to start with the trigger of choice; ``multi_line`` if quoted cells may hold line breaks."""
    text = (spark.readStream.format("text").option("pathGlobFilter", "*.[cC][sS][vV]")
            .option("maxFilesPerTrigger", max_files).load(raw).select("value", "_metadata"))

    def add(batch: DataFrame, batch_id: int) -> None:
        folder = f"{staged.rstrip('/')}/batch={batch_id}"
        session = batch.sparkSession
        with run_folder(session):
            lines = statement_records(batch, batch_id) if multi_line else statement_lines(batch, batch_id)
            write_staged(stage(lines), folder)
            append_ledger(session, ledger, categorize(read_staged(session, folder), merchants, patterns))

    return text.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
