"""A bucketed ledger against the plain merge."""

import random
import re

from pyspark.sql import functions as F

from tallyspark.operators import merge
from tallyspark.schema import CATEGORIZED
from tallyspark.sources import ledger_table, store
from tests.conftest import plan_of

BATCH = "date date, description string, paid_out decimal(18,2), paid_in decimal(18,2), source string, account_type string, category string, subcategory string, type string, rule_match string, confidence long, n long"


def _batch(spark, seed, batch, n=150):
    import datetime
    from decimal import Decimal

    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = rnd.choice([None, datetime.date(2024, rnd.randint(1, 4), rnd.randint(1, 3))])
        rows.append((day, rnd.choice(["a", "a:b", "", None, "c"]), rnd.choice([Decimal(1), Decimal(2), None]), Decimal(0),
                     rnd.choice(["x", None, "=1:x"]), "Credit", f"cat{batch}", rnd.choice([None, "", "s"]), "operating", "none", 0, i))
    seq = F.struct(F.lit(batch).cast("long").alias("batch_id"), F.lit("f").alias("file_name"), F.lit(0).cast("long").alias("block_start"),
                   F.col("n").alias("line_idx"))
    return spark.createDataFrame(rows, BATCH).withColumn("ingest_seq", seq).select(*CATEGORIZED.fieldNames(), "ingest_seq")


def _rows(df):
    return sorted(map(str, df.select("date", "description", "paid_out", "paid_in", "source", "category", "subcategory", "month",
                                     "ingest_seq").collect()))


def test_appends_equal_the_merge(spark, tmp_path):
    path, plain = str(tmp_path / "ledger"), str(tmp_path / "plain")
    assert ledger_table.read(spark, path, 4).count() == 0
    for batch, seed in ((1, 1), (2, 2), (2, 2), (3, 1)):
        rows = _batch(spark, seed, batch)
        ledger_table.append(spark, path, rows, 4)
        store.append_ledger(spark, plain, rows)
        assert _rows(ledger_table.read(spark, path, 4)) == _rows(store.read_ledger(spark, plain))
    assert {r.category for r in ledger_table.read(spark, path, 4).collect()} == {"cat1", "cat2"}
    spark.sql(f"DROP TABLE {ledger_table.ledger_table(spark, path, 4)}")  # the files alone are the ledger
    assert _rows(ledger_table.read(spark, path, 4)) == _rows(store.read_ledger(spark, plain))


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_table.append(spark, path, _batch(spark, 1, 1), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ledger_table.new_rows(spark, path, _batch(spark, 2, 2).filter("month(date) = 2"), 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "2024-02" in plan
    # The plan quotes line breaks, too.
    lines = [line for line in plan.split("\n") if re.match("[ :]*[+:]- ", line)]
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*"))

    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
        if "Join" in above[-1]:
            break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), above


def test_keys_are_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("a", None), ("=1:a", "b")], "x string, y string")
    assert rows.select(ledger_table.row_key(["x", "y"]).alias("k")).distinct().count() == 6


def test_merge_of_the_same_rows(spark, tmp_path):
    first, second = _batch(spark, 3, 1), _batch(spark, 4, 2)
    path = str(tmp_path / "ledger")
    for rows in (first, second):
        ledger_table.append(spark, path, rows, 2)
    merged = merge.merge_ledger(merge.to_ledger(first), merge.to_ledger(second))
    assert _rows(ledger_table.read(spark, path, 2)) == _rows(merged)


def test_a_large_batch_is_appended_in_groups_of_months(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_table, "TASK_ROWS", 10)
    path, plain = str(tmp_path / "ledger"), str(tmp_path / "plain")
    groups = []
    unknown = ledger_table._unknown
    monkeypatch.setattr(ledger_table, "_unknown", lambda s, p, first, months, n: groups.append(months) or unknown(s, p, first, months, n))
    for batch in (1, 2):
        rows = _batch(spark, batch, batch)
        ledger_table.append(spark, path, rows, 2)
        store.append_ledger(spark, plain, rows)
    assert len(groups) > 4 and {m for g in groups for m in g} == {"", "2024-01", "2024-02", "2024-03", "2024-04"}
    assert _rows(ledger_table.read(spark, path, 2)) == _rows(store.read_ledger(spark, plain))


def test_month_groups():
    assert ledger_table._month_groups({"b": 3, "": 1, "a": 2, "c": 9, "d": 1}, 4) == [["", "a"], ["b"], ["c"], ["d"]]
    assert ledger_table._month_groups({}, 4) == []
