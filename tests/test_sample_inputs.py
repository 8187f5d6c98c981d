"""Inputs made of the test tables: the same rows from fewer passes and without sorts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import sample_inputs as inputs
from tests.conftest import plan_of

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date"


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(2024, 1, 5)
    lines = [(1, 1, 1, 1, 5.0, "R", "O", day), (1, 1, 1, 1, 5.0, "R", "O", day), (2, 1, 2, 1, 6.0, "N", "F", day), (3, 1, 1, 1, 7.0, None, None, None),
             (4, 1, None, 1, 8.0, "N", "O", day), (5, 1, 9, 1, 9.0, "A", "O", day), (6, 2, 2, 1, None, "N", None, day)]
    parts = [(1, "blue ring", "Brand#1", "LARGE"), (2, "red widget", "Brand#2", None), (2, "hot bolt", "Brand#3", "SMALL"), (None, "x", "y", "z")]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_large_parts_are_hashed_and_nothing_is_sorted(spark, folder, monkeypatch):
    small = _rows(inputs.txn(spark, folder))
    assert len(small) == 7
    monkeypatch.setattr(inputs, "is_small", lambda df: False)
    txn = inputs.txn(spark, folder)
    assert _rows(txn) == small
    plan = plan_of(inputs.txn(spark, folder))
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_a_batch_and_its_repeats_come_from_one_pass(spark, folder):
    rows = inputs.ledger(spark, folder).drop("month")
    batch = inputs.ledger_new(spark, folder)
    assert _rows(batch) == _rows(rows.unionByName(rows.filter("l_linestatus = 'O'"))) and batch.count() == 9
    plans = [plan_of(f(spark, folder)) for f in (inputs.ledger_new, inputs.ledger)]  # not yet run
    assert plans[0].count("FileScan parquet") == plans[1].count("FileScan parquet")


def test_statement_lines_lie_file_by_file(spark, folder):
    spark.range(1, 4).select(F.col("id").alias("s_suppkey"), F.format_string("S#%d", "id").alias("s_name")).write.parquet(f"{folder}/supplier.parquet")
    spark.read.parquet(f"{folder}/lineitem.parquet").withColumns({"l_discount": F.lit(0.1), "l_suppkey": F.col("l_orderkey") % 3 + 1}).write.parquet(
        f"{folder}/more/lineitem.parquet")
    for name in ("part", "supplier"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/more/{name}.parquet")
    lines = inputs.statement_text(spark, f"{folder}/more")
    assert lines.count() == 7 + 2 * 3
    # The lines are read more than once, so they are not joined each time.
    assert "Join" not in plan_of(lines)
    places = lines.select("file_path", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == 3


def test_dates_of_line_items_need_no_parts(spark, folder):
    dates = inputs.line_dates(spark, folder)
    assert {r.date for r in inputs.txn(spark, folder).collect()} <= {r.date for r in dates.collect()}
    assert "Join" not in plan_of(dates) and "Exchange" not in plan_of(dates)
