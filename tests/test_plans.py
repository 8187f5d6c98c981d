from pyspark.sql import functions as F

from tallyspark.operators import merge
from tallyspark.plans import operating, p2p, sample_inputs
from tallyspark.sources import store
from tests.conftest import plan_of

SF_DIR = "/root/testdata/sf0.001"


def test_analysis_of_a_stored_ledger_reads_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = sample_inputs.categorized(spark, SF_DIR).withColumn("account_type", F.lit("Credit"))
    store.append_ledger(spark, path, batch)
    ledger = store.read_ledger(spark, path)
    assert ledger.count() == merge.dedupe_keep_first(batch).count()

    one = operating.category_spend(ledger, "1998-03")
    scan = next(line for line in plan_of(one).splitlines() if "FileScan" in line)
    assert "1998-03" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(type,operating)" in scan and "GreaterThan(paid_out,0" in scan
    assert "description" not in scan.split("ReadSchema")[1] and "ingest_seq" not in scan.split("ReadSchema")[1]
    direct = operating.category_spend(sample_inputs.ledger(spark, SF_DIR), "1998-03")
    assert one.collect() == direct.collect()

    kpis = operating.operating_kpis(ledger)
    assert plan_of(kpis).count("FileScan") == 1
    assert sorted(kpis.collect()) == sorted(operating.operating_kpis(sample_inputs.ledger(spark, SF_DIR)).collect())
    assert "EqualTo(category,P2P)" in plan_of(p2p.p2p_summary(ledger))


def test_categories_are_filtered_before_the_rows_are(spark):
    """A filter on the type acts on the few rule outcomes; the match runs once per row."""
    plan = plan_of(operating.operating_base(sample_inputs.ledger(spark, SF_DIR)))
    assert plan.lower().count("contains(") == 1
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
