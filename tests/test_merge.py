import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import merge
from tallyspark.schema import LEDGER, missing_columns, require_columns
from tallyspark.sources import store
from tests.conftest import plan_of

COLUMNS = ("date date, description string, paid_out decimal(18,2), paid_in decimal(18,2), source string, "
           "account_type string, category string, subcategory string, type string, rule_match string, "
           "confidence int, ingest_seq struct<batch_id:bigint,file_name:string,block_start:bigint,line_idx:bigint>")
KEY = ["date", "description", "paid_out", "paid_in", "source"]


def _batch(spark, seed, batch_id, n=80):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        date = rnd.choice([None, datetime.date(2024, 1, 1), datetime.date(2024, 2, 3), datetime.date(2024, 2, 4)])
        rows.append((date, rnd.choice(["a", "b", None]), rnd.choice([1, 2]) * 1.0, 0.0, rnd.choice(["Aqua", None]),
                     "Credit", f"cat{batch_id}-{i}", "", "operating", "none", 0, (batch_id, "f.csv", 0, i)))
    schema = COLUMNS.replace("decimal(18,2)", "double")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("paid_out", "paid_in")})


def _keep_first(*batches):
    kept = {}
    for rows in batches:
        for r in sorted(rows, key=lambda r: tuple(r.ingest_seq)):
            kept.setdefault(tuple(r[k] for k in KEY), r.category)
    return kept


def _as_dict(rows):
    out = {tuple(r[k] for k in KEY): r.category for r in rows}
    assert len(out) == len(rows)
    return out


def test_merge_keeps_the_first_row(spark):
    old, new = _batch(spark, 1, 1), _batch(spark, 2, 0)  # a lower batch number does not make new rows older
    merged = merge.merge_ledger(merge.dedupe_keep_first(old), new)
    assert _as_dict(merged.collect()) == _keep_first(old.collect(), new.collect())
    assert "WindowGroupLimit" in plan_of(merged)
    again = merge.merge_ledger(merged, new)
    assert _as_dict(again.collect()) == _as_dict(merged.collect())


def test_dedupe_is_skipped_without_a_key_column(spark):
    df = _batch(spark, 1, 1).drop("source")
    assert merge.dedupe_keep_first(df).count() == df.count()


@pytest.mark.parametrize("seed", [3, 4])
def test_append_equals_merge(spark, tmp_path, seed):
    path = str(tmp_path / "ledger")
    batches = [_batch(spark, seed * 10 + b, b) for b in range(3)]
    for b in batches:
        store.append_ledger(spark, path, b)
    store.append_ledger(spark, path, batches[1])
    ledger = store.read_ledger(spark, path)
    assert _as_dict(ledger.collect()) == _keep_first(*[b.collect() for b in batches])
    assert ledger.columns == LEDGER.fieldNames()
    assert ledger.filter("subcategory = ''").count() == 0
    assert {r.month for r in ledger.select("month").distinct().collect()} == {"", "2024-01", "2024-02"}


def test_append_reads_only_the_months_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    store.append_ledger(spark, path, _batch(spark, 1, 1))
    one = _batch(spark, 2, 2).filter("date = date'2024-01-01'")
    added = merge.new_rows(store.read_ledger(spark, path), merge.to_ledger(one))
    plan = plan_of(added)
    assert "dynamicpruning" in plan.lower()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sorted_newest_first_undated_last(spark):
    dates = [r.date for r in merge.ledger_sorted(_batch(spark, 1, 1)).collect()]
    dated = [d for d in dates if d]
    assert dated == sorted(dated, reverse=True) and None not in dates[:len(dated)]


def test_ingest_stats(spark):
    df = _batch(spark, 1, 1)
    got = {r.source: tuple(r)[1:] for r in merge.ingest_stats(df).collect()}
    rows = df.collect()
    for source, stats in got.items():
        mine = [r for r in rows if r.source == source]
        keys = {tuple(r[k] for k in KEY) for r in mine}
        assert stats == (len(mine), len(keys), len(mine) - len(keys), sum(k[0] is None for k in keys))


def test_load_ledger(spark):
    df = spark.createDataFrame([("2024-04-03 10:00:00", "1.5", "x"), ("bad", None, "2")],
                               "date string, paid_out string, paid_in string")
    rows = [tuple(map(str, r)) for r in store.load_ledger(df).collect()]
    assert rows == [("2024-04-03", "1.50", "0.00", "2024-04"), ("None", "0.00", "2.00", "")]


def test_required_columns(spark):
    df = spark.range(3)
    assert missing_columns(df, ["id", "date"]) == ["date"]
    empty = require_columns(df, ["id", "date", "paid_out"], on_missing="empty")
    assert empty.count() == 0 and set(empty.columns) == {"id", "date", "paid_out"}
    with pytest.raises(ValueError):
        require_columns(df, ["date"])


def test_known_keys_and_new_rows_meet_in_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "ledger")
    store.append_ledger(spark, path, _batch(spark, 5, 1))
    batch = merge.to_ledger(_batch(spark, 6, 2))
    added = merge.new_rows(store.read_ledger(spark, path), batch, dates=spark.createDataFrame([], "date date"))
    assert added.columns == batch.columns
    plan = plan_of(added)
    assert "LeftAnti" not in plan and plan.count("Exchange hashpartitioning(date") == 1
    known = _keep_first(store.read_ledger(spark, path).collect())
    got = _as_dict(merge.new_rows(store.read_ledger(spark, path), batch).collect())
    assert got == {k: v for k, v in _keep_first(batch.collect()).items() if k not in known}
    # A ledger of another type of amount: equal values are the same key, rows keep their types.
    loose = store.read_ledger(spark, path).withColumn("paid_out", F.col("paid_out").cast("double"))
    other = merge.new_rows(loose, batch)
    assert _as_dict(other.collect()) == got and other.schema["paid_out"].dataType == batch.schema["paid_out"].dataType
