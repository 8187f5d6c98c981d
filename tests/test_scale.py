import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import scale
from tests.conftest import plan_of


def test_size_is_measured(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"), F.array(F.lit(1)).alias("a"))
    assert scale.is_small(df) and not scale.is_small(df, 100_000)
    assert scale.is_small(df.limit(0), 0)


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_keeps_every_row(spark, monkeypatch, small):
    monkeypatch.setattr(scale, "is_small", lambda df, n=0: small)
    monkeypatch.setattr(scale, "HOT_KEYS", 2)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    table = spark.range(38).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v")).union(
        spark.sql("select 'hot', 99L"))
    got = scale.lookup_join(rows, table, "key")
    assert got.columns == ["key", "id", "v"] or got.columns == ["id", "key", "v"]
    expected = rows.join(table, "key", "left").select("id", "key", "v")
    key = lambda r: (r[0], r[1] or "", r[2] or -1)
    assert sorted((tuple(r) for r in got.select("id", "key", "v").collect()), key=key) == sorted(
        (tuple(r) for r in expected.collect()), key=key)


def test_lookup_join_leaves_columns_of_any_name_alone(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda df, n=0: False)
    monkeypatch.setattr(scale, "HOT_KEYS", 2)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id") % 40).alias("fp"),
        F.concat(F.lit("="), "id").alias("_key"), F.lit("h").alias("_hot"), F.col("id").alias("_cold"))
    table = spark.range(30).select(F.col("id").alias("fp"), (F.col("id") * 2).alias("root"))
    got = scale.lookup_join(rows, table, "fp").select("_cold", "_hot", "_key", "fp", "root").collect()
    key = lambda i: 0 if i % 3 == 0 else i % 40 if i % 7 else None
    assert sorted(got) == [(i, "h", f"={i}", key(i), 2 * key(i) if key(i) is not None and key(i) < 30 else None) for i in range(300)]


def test_hot_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda df, n=0: False)
    monkeypatch.setattr(scale, "HOT_KEYS", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
        table = rows.select("key").distinct().withColumn("v", F.lit(1))
        joined = scale.lookup_join(rows, table, "key")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(
            F.count("*").alias("n"), F.sum("v")).collect()]
        assert len(sizes) == 4 and max(sizes) < 1400
        assert "CartesianProduct" not in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lineage_is_cut_in_the_named_folder(spark):
    spent = []
    df = scale.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2), spent)
    assert "FileScan parquet" in plan_of(df) and "Range" not in plan_of(df) and df.count() == 5
    named = spark.conf.get("spark.checkpoint.dir")
    assert scale.shared_dir(spark) == named and all(f.startswith(f"file://{named}/") for f in df.inputFiles())
    folder = df._cut_path
    assert os.path.isdir(folder)
    scale.forget(spent)
    assert spent == [] and not os.path.exists(folder)


def test_copies_of_one_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda df, n=0: False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 6400, 1, 64).select(F.lit("same").alias("key"))
        table = spark.sql("select 'same' as key, 1 as v")
        joined = scale.lookup_join(rows, table, "key")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(
            F.count("*").alias("n"), F.sum("v").alias("v")).collect()]
        assert sum(sizes) == 6400 and len(sizes) == 4 and max(sizes) < 3200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_leaves_no_tables(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(named))
    with pytest.raises(RuntimeError), scale.run_folder(spark) as folder:
        scale.cut_lineage(spark.range(3))
        assert len(os.listdir(folder)) == 1 and scale.shared_dir(spark) == folder
        with scale.run_folder(spark) as inner:
            assert inner.startswith(folder)
        assert scale.shared_dir(spark) == folder
        raise RuntimeError
    assert set(os.listdir(named)) == before and scale.shared_dir(spark) == named
