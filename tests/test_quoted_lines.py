"""Quoted cells with line breaks from the files to the ledger, and the queries that stage them."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import pipeline
from tallyspark.plans.queries import QUERIES
from tallyspark.schema import MERCHANTS, PATTERNS
from tallyspark.sources import store

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("multi_line, descriptions, rejects", [
    (False, ["plain"], True), (True, ["a\nb, \"c\"", "d\ne\nf", "plain"], False)])
def test_run_keeps_transactions_with_line_breaks(spark, tmp_path, multi_line, descriptions, rejects):
    raw, staged, ledger = (str(tmp_path / n) for n in ("raw", "staged", "ledger"))
    os.mkdir(raw)
    with open(f"{raw}/s.csv", "w") as f:
        f.write('Date,Transaction type,Description,Paid out,Paid in\n03/04/2024,POS,"a\nb, ""c""",1.00,\n'
                '04/04/2024,POS,plain,2.00,\n05/04/2024,POS,"d\ne\nf",3.00,\n')
    rules = spark.createDataFrame([], MERCHANTS), spark.createDataFrame([], PATTERNS)
    options = {"multi_line": True} if multi_line else {}
    pipeline.run(spark, raw, staged, ledger, 1, *rules, **options)
    assert sorted(r.description for r in store.read_ledger(spark, ledger).collect()) == descriptions
    found = store.read_rejects(spark, f"{staged}/batch=1").collect()
    assert len([r for r in found if r.reject_reason == "open_quote"]) >= (2 if rejects else 0)
    assert bool(found) == bool(rejects)


def test_queries_reach_open_quotes_and_long_cells(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    text, lines = (QUERIES[name](spark, SF_DIR) for name in ("stage_quoted_text", "stage_quoted_lines"))
    assert text.count() == lines.count() == n
    assert text.filter("reject_reason = 'open_quote'").count() == text.filter("block_start % 10 = 3").count() > 0
    assert lines.filter(F.contains("description", F.lit("\n"))).count() > 0
    assert lines.agg(F.max(F.length("description"))).first()[0] > 10_000
