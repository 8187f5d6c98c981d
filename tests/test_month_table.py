"""Figures from the sums of batches equal those from the ledger's rows."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import debt, month_table, operating, p2p, pipeline
from tallyspark.plans import sample_inputs as inputs
from tallyspark.schema import CATEGORIZED, MERCHANTS, PATTERNS
from tallyspark.sources import store
from tests.conftest import plan_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A ledger of three batches, the second of which was run twice, and the sums they left."""
    ledger, months = (str(tmp_path_factory.mktemp("months") / n) for n in ("ledger", "months"))
    rows = inputs.categorized(spark, SF_DIR).withColumn("account_type", F.lit("Credit")).select(*CATEGORIZED.fieldNames(), "ingest_seq")
    extra = rows.limit(40).withColumns({"paid_out": F.lit(0).cast("decimal(18,2)"), "paid_in": F.lit(-3).cast("decimal(18,2)"),
                                        "category": F.lit(None).cast("string"), "subcategory": F.lit("Interest x")})
    for batch in (1, 2, 2, 3):
        own = rows.unionByName(extra).filter(F.col("ingest_seq.block_start") % 3 == batch - 1).withColumn(
            "ingest_seq", F.col("ingest_seq").withField("batch_id", F.lit(batch).cast("long")))
        store.append_ledger(spark, ledger, own)
        month_table.write_month_sums(spark, ledger, months, batch, own if batch == 3 else None)
    return store.read_ledger(spark, ledger), month_table.read_month_sums(spark, months)


@pytest.mark.parametrize("figures", [
    operating.operating_kpis, operating.monthly_spend, operating.monthly_income, operating.monthly_trend, operating.category_spend,
    operating.available_months, operating.available_categories, debt.debt_timeline, debt.debt_metrics, p2p.p2p_balances,
    p2p.p2p_summary, lambda df: operating.subcategory_spend(df, "Bills"), lambda df: operating.operating_kpis(df, drop_null_month=True)])
def test_figures_equal_those_of_the_ledger(stored, figures):
    ledger, sums = stored

    def rows(df):
        return sorted((tuple(round(float(v), 6) if hasattr(v, "quantize") or isinstance(v, float) else v for v in r)
                       for r in figures(df).collect()), key=repr)

    assert rows(sums) == rows(ledger)


def test_reports_read_no_ledger_rows(stored):
    ledger, sums = stored
    kpis = operating.operating_kpis(sums)
    assert not set(kpis.inputFiles()) & set(ledger.inputFiles())
    assert sums.agg(F.sum("n_rows")).first()[0] == ledger.count()
    assert "description" not in plan_of(kpis)


def test_run_leaves_sums_and_an_empty_table_none(spark, tmp_path):
    raw, staged, ledger, months = (str(tmp_path / n) for n in ("raw", "staged", "ledger", "months"))
    assert month_table.read_month_sums(spark, months).count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.csv").write_text("Date,Description,Note,Amount(GBP)\n03/04/2024,a,,2\n05/04/2024,b,,3\n03/05/2024,c,,4\n")
    rules = spark.createDataFrame([], MERCHANTS), spark.createDataFrame([], PATTERNS)
    for batch in (1, 2, 1):
        pipeline.run(spark, raw, staged, ledger, batch, *rules, months=months)
    got = operating.monthly_spend(month_table.read_month_sums(spark, months)).collect()
    assert sorted((r.month_str, float(r.total_spend)) for r in got) == [("2024-04", 5.0), ("2024-05", 4.0)]
