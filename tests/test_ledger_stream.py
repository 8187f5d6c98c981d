"""The streamed ledger against the merge of the same batches."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.merge import merge_ledger, to_ledger
from tallyspark.operators.rules import categorize
from tallyspark.schema import INGEST_SEQ, MERCHANTS, PATTERNS, STAGED
from tallyspark.sources import store
from tallyspark.sources.statements import stage, statement_lines
from tallyspark.streaming.ledger_stream import read_streamed, stream_ledger

DAY = datetime.date(2024, 3, 1)


def _row(day, description, out, source, place):
    return (day, description, Decimal(out), Decimal(0), source, "Credit", "", "", (place, "f", 0, 0))


BATCHES = [
    [_row(DAY, "shop a", 1, "Aqua", 1), _row(DAY, "shop a", 1, "Aqua", 2), _row(None, None, 2, "Aqua", 3), _row(None, " ", 2, "Aqua", 4)],
    [_row(DAY, "shop a", 1, "Aqua", 5), _row(DAY, "shop a", 1, None, 6), _row(DAY, "shop a", 3, "Aqua", 7)],
    # late by years, and repeated from both batches before
    [_row(datetime.date(1999, 1, 1), "b", 1, "Aqua", 8), _row(None, None, 2, "Aqua", 9), _row(DAY, "shop a", 3, "Aqua", 10)],
]


def test_a_stream_keeps_what_a_merge_keeps(spark, tmp_path):
    staged, ledger, checkpoint = (str(tmp_path / n) for n in ("staged", "ledger", "checkpoint"))
    schema = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in STAGED.fields) + f",ingest_seq:{INGEST_SEQ.simpleString()}>"
    rules = (spark.createDataFrame([(0, "a", "A", "Shops", "", "operating", ["shop"])], MERCHANTS), spark.createDataFrame([], PATTERNS))
    assert read_streamed(spark, ledger).count() == 0
    merged = None
    for number, rows in enumerate([*BATCHES, BATCHES[0]]):
        batch = spark.createDataFrame(rows, schema)
        batch.write.parquet(f"{staged}/run-{number}")
        query = stream_ledger(spark, staged, ledger, checkpoint, *rules).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        added = to_ledger(categorize(batch, *rules))
        merged = added.transform(lambda df: merge_ledger(df.limit(0), df)) if merged is None else merge_ledger(merged, added)
        columns = ["date", "description", "paid_out", "paid_in", "source", "category", "subcategory", "type", "month"]
        got = read_streamed(spark, ledger).select(*columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, merged.select(*columns).collect()))
    assert len(got) == 5


@pytest.mark.parametrize("line, reason", [("03/04/2024,a,,2", None), ("no date,a,,2", "bad_date"), ("03/04/2024,a,,2,9", "too_wide"),
                                          ('03/04/2024,"a,,2', "open_quote")])
def test_the_writing_job_counts(spark, tmp_path, line, reason):
    (tmp_path / "s.csv").write_text(f"Date,Description,Note,Amount(GBP)\n03/04/2024,x,,1\n{line}\n")
    checked = stage(statement_lines(spark.read.text(str(tmp_path / "s.csv"))))
    counts = store.write_staged(checked, str(tmp_path / "staged"))
    assert counts["rows"] == 2 and counts["valid"] == 2 - (reason is not None)
    assert {r: counts[r] for r in store.REJECT_REASONS if counts[r]} == ({reason: 1} if reason else {})
    assert counts["undated"] == (reason == "bad_date")
    found = spark.read.parquet(str(tmp_path / "staged")).groupBy("status").agg(F.count("*").alias("n")).collect()
    assert {r.status: r.n for r in found} == ({"valid": 1, "rejected": 1} if reason else {"valid": 2})
