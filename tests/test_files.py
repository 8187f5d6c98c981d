import json
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallyspark.plans import pipeline
from tallyspark.schema import MERCHANTS, PATTERNS
from tallyspark.sources import statements, store
from tallyspark.streaming.ingest import stream_statements

FILES = {
    "aqua.csv": "Date,Description,Note,Amount(GBP)\r\n03/04/2024,Caf\xe9 €,x,12.50\r\n\r\nnot a date,a,b,1\r\n"
                "03/04/2024,too,wide,1,2\r\n03/04/2024,narrow\r\n",
    "b.CSV": "﻿Date;Type;Description;Value;Account Name;Account Number\n04/04/2024;CASH;\"a;b \"\"c\"\"\";-3;n;1\n",
    "c.csv": "Statement date:,today\nAccount,main\n\nDate,Transaction type,Description,Paid out,Paid in\n"
             "05 Apr 2024,Visa,NA,\"£1,234.56\",\n",
    "unknown.csv": "Date|Payee|Sum\n05/04/2024|x|1\n",
    "nodate.csv": "Amount(GBP)\tNote\tDescription\n1\tn\td\n",
    "nodescription.csv": "Date,Amount(GBP),Note\n05/04/2024,1,n\n",
    "~$lock.csv": "Date,Description,Note,Amount(GBP)\n03/04/2024,lock,x,1\n",
    "notes.txt": "Date,Description,Note,Amount(GBP)\n03/04/2024,text,x,1\n",
}


def _write(folder, names=None):
    folder.mkdir(exist_ok=True)
    for name, text in FILES.items():
        if names is None or name in names:
            encoding = "utf-8" if text.startswith("﻿") else "cp1252"
            (folder / name).write_bytes(text.encode(encoding))
    (folder / "older").mkdir(exist_ok=True)
    (folder / "older" / "aqua.csv").write_text("Date,Description,Note,Amount(GBP)\n03/04/2024,sub,x,1\n")
    return str(folder)


def _staged(df):
    return sorted((r.source_file, str(r.date), r.description, str(r.paid_out), str(r.paid_in), r.source, r.reject_reason)
                  for r in df.collect())


EXPECTED = [
    ("aqua.csv", "2024-04-03", "Caf\xe9 € x", "12.50", "0.00", "Aqua", None),
    ("aqua.csv", "2024-04-03", "narrow", "0.00", "0.00", "Aqua", None),
    ("aqua.csv", "2024-04-03", "too wide", "1.00", "0.00", "Aqua", "too_wide"),
    ("aqua.csv", "None", "a b", "1.00", "0.00", "Aqua", "bad_date"),
    ("b.CSV", "2024-04-04", "CASH: a;b \"c\"", "0.00", "3.00", "Natwest", None),
    ("c.csv", "2024-04-05", "NA", "1234.56", "0.00", "Nationwide", None),
    ("nodate.csv", "None", "d n", "1.00", "0.00", "Aqua", "bad_date"),
    ("nodescription.csv", "2024-04-05", "n", "1.00", "0.00", "Aqua", "no_description"),
    ("unknown.csv", "2024-04-05", None, "None", "None", None, "unknown_layout"),
]


def test_files_are_staged(spark, tmp_path):
    folder = _write(tmp_path / "raw")
    assert _staged(statements.stage(statements.read_raw_files(spark, folder))) == EXPECTED


def test_a_file_may_be_split_over_tasks(spark, tmp_path):
    rows = "".join(f"03/04/2024,row {i:05d},n,{i}\n" for i in range(3000))
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "big.csv").write_text("preamble,\nDate,Description,Note,Amount(GBP)\n" + rows)
    (folder / "small.csv").write_text("Date,Description,Note,Amount(GBP)\n03/04/2024,s,n,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = statements.read_raw_files(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 5
        staged = statements.stage(lines).filter("source_file = 'big.csv'").orderBy("ingest_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.description for r in staged] == [f"row {i:05d} n" for i in range(3000)]


def test_files_that_are_not_small_share_forms(spark, tmp_path, monkeypatch):
    raw = _write(tmp_path / "raw")
    _write(tmp_path / "raw" / "more")
    staged = [repr(r) for r in statements.stage(statements.read_raw_files(spark, raw)).orderBy("ingest_seq").collect()]
    joined = []
    plain = statements.lookup_join
    monkeypatch.setattr(statements, "is_small", lambda df: False)
    monkeypatch.setattr(statements, "lookup_join", lambda rows, table, key: joined.append(table.columns) or plain(rows, table, key))
    again = statements.stage(statements.read_raw_files(spark, raw)).orderBy("ingest_seq")
    assert [repr(r) for r in again.collect()] == staged and len(staged) > 5
    assert joined[0] == ["file_path", "header_block", "header_idx", "_form_id"]  # a file's row is short


def test_staged_rows_are_not_sorted_by_their_folder(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, plain = spark.conf.get(name), DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(int(spark.conf.get(name))) or plain(self, path))
    checked = spark.range(90).select(F.col("id"), F.lit("x").alias("description"), F.when(F.col("id") % 3 == 0, "bad_date").alias("reject_reason"))
    path = str(tmp_path / "staged")
    assert store.write_staged(checked, path)["valid"] == 60
    assert seen[0] > 2 and spark.conf.get(name) == before  # Spark sorts the rest once as many writers are open
    assert store.read_staged(spark, path).count() == 60


def _rules(spark):
    merchants = spark.createDataFrame([(0, "cafe", "Cafe", "Food", "", "operating", ["caf\xe9"])], MERCHANTS)
    return merchants, spark.createDataFrame([], PATTERNS)


def _ledger(spark, path):
    return sorted((r.source, r.description, r.category, r.subcategory, r.month)
                  for r in store.read_ledger(spark, path).collect())


LEDGER = [
    ("Aqua", "Caf\xe9 € x", "Food", None, "2024-04"), ("Aqua", "narrow", "Uncategorized", None, "2024-04"),
    ("Nationwide", "NA", "Uncategorized", None, "2024-04"), ("Natwest", "CASH: a;b \"c\"", "Uncategorized", None, "2024-04"),
]


def test_reading_a_row_is_compiled(spark, tmp_path, monkeypatch):
    """Cells are split in one place of the plan, and while rows are written no method may be too large to be compiled."""
    _write(tmp_path / "raw")
    checked = statements.stage(statements.read_raw_files(spark, str(tmp_path / "raw")))
    assert checked._jdf.queryExecution().optimizedPlan().toString().count(" split(") == 1
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: seen.append(spark.conf.get(limit)) or plain(*a, **k))
    before = spark.conf.get(limit)
    store.write_staged(checked, str(tmp_path / "staged"))
    assert seen == ["8000"] and spark.conf.get(limit) == before


def test_run_from_files_to_ledger(spark, tmp_path):
    raw, staged, ledger = _write(tmp_path / "raw"), str(tmp_path / "staged"), str(tmp_path / "ledger")
    shared = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    for batch in (1, 2):
        pipeline.run(spark, raw, staged, ledger, batch, *_rules(spark))
        assert _ledger(spark, ledger) == LEDGER
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == shared  # no intermediate tables are left
    rejects = store.read_rejects(spark, f"{staged}/batch=1").collect()
    assert sorted(r.reject_reason for r in rejects) == ["bad_date", "bad_date", "no_description", "too_wide", "unknown_layout"]
    counts = store.reject_counts(statements.stage(statements.read_raw_files(spark, raw)))
    assert {(r.source_file, r.reject_reason): r["count"] for r in counts.collect()}[("aqua.csv", "")] == 2


def test_stream_from_files_to_ledger(spark, tmp_path):
    staged, ledger, checkpoint = (str(tmp_path / n) for n in ("staged", "ledger", "checkpoint"))
    raw = _write(tmp_path / "raw", ["aqua.csv", "unknown.csv"])
    for names in (None, None):
        query = stream_statements(spark, raw, staged, ledger, checkpoint, *_rules(spark)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        _write(tmp_path / "raw", names)
    assert _ledger(spark, ledger) == LEDGER


def test_rules_from_json(spark, tmp_path):
    path = tmp_path / "merchants.json"
    path.write_text(json.dumps([
        {"id": "a", "name": "A", "category": "x", "aliases": [" Tesco ", "", 12, True]},
        "not an object", {"id": 5, "name": "B", "category": "x", "aliases": []},
        {"id": "c", "name": "C", "category": "x"}, {"id": "d", "name": "D", "category": "x", "aliases": "no list"},
        {"id": "e", "name": "E", "category": "x", "subcategory": None, "aliases": []},
        {"id": "f", "name": "F", "category": "x", "subcategory": "s", "type": "transfer", "aliases": ["f"]}]))
    got = [tuple(r) for r in store.read_merchants(spark, str(path)).orderBy("rule_ord").collect()]
    assert got == [(0, "a", "A", "x", "", "operating", ["tesco", "12", "true"]), (4, "d", "D", "x", "", "operating", []),
                   (6, "f", "F", "x", "s", "transfer", ["f"])]
    path = tmp_path / "patterns.json"
    path.write_text('[{"pattern": " Gym ", "category": "x"}, {"pattern": "b", "category": "x", "weight": "1.5"},'
                    ' {"pattern": "c"}, {"pattern": "d", "category": "x", "weight": "much"}, 7]')
    got = [tuple(r) for r in store.read_patterns(spark, str(path)).orderBy("rule_ord").collect()]
    assert got == [(0, "gym", "x", "", "operating", 1.0), (1, "b", "x", "", "operating", 1.5)]
    assert store.left_out(spark, str(path), store.read_patterns) == 3
    path.write_text('{"pattern": "a", "category": "x"}\n\n{"pattern": "b", "category": "y"}\n{"pattern": "c"}\n')
    assert [r.pattern for r in store.read_patterns(spark, str(path)).orderBy("rule_ord").collect()] == ["a", "b"]
    for broken in ("", "no json", '[{"pattern": "a", "category": "x"}', '"text"'):
        path.write_text(broken)
        with pytest.raises(ValueError):
            store.read_patterns(spark, str(path))
    assert store.read_merchants(spark, str(tmp_path / "absent.json")).count() == 0


def test_rule_versions(spark, tmp_path):
    merchants, _ = _rules(spark)
    first = store.write_rules(merchants, str(tmp_path), 1)
    store.write_rules(merchants.withColumn("category", F.lit("y")), str(tmp_path), 2)
    assert spark.read.parquet(first).first().category == "Food"
    store.write_rules(merchants.withColumn("category", F.lit("z")), str(tmp_path), 10)
    assert {r.category for r in store.read_merchants(spark, str(tmp_path)).collect()} == {"z"}


def _cells(spark, line, delimiter=","):
    df = spark.createDataFrame([(line, delimiter)], "line string, d string")
    row = df.select(statements.split_cells(F.col("line"), F.col("d")).alias("c"),
                    statements.open_quote(F.col("line"), F.col("d")).alias("o")).first()
    return row.c, row.o


@pytest.mark.parametrize("line, cells, is_open", [
    ('a,b,', ["a", "b", ""], False),
    ('"a,b",c', ["a,b", "c"], False),
    ('"a ""x"" b",c', ['a "x" b', "c"], False),
    ('a"b,"c"', ['a"b', "c"], False),
    ('"x"y,z', ['"x"y', "z"], False),
    ("", [""], False),
    ('a,"open', ["a", '"open'], True),
    ('"x"y,"open', ['"x"y', '"open'], True),
])
def test_cells_and_open_quotes(spark, line, cells, is_open):
    assert _cells(spark, line) == (cells, is_open)
    piped, expected = line.replace(",", "|"), [c.replace(",", "|") for c in cells]
    assert _cells(spark, piped, "|") == (expected, is_open)


def test_cells_of_any_length(spark):
    long = "x" * 100_000
    assert _cells(spark, f'"{long}",b') == ([long, "b"], False)
    assert _cells(spark, f'"{long}') == ([f'"{long}'], True)
    quotes = '""' * 50_000
    assert _cells(spark, f'"{quotes}",b') == ([quotes[::2], "b"], False)
    assert _cells(spark, f'"{quotes}')[1]
    assert len(_cells(spark, "," * 50_000)[0]) == 50_001


def _lines(spark, texts, blocks):
    """The lines of a file, dealt to blocks of the given sizes."""
    rows, at = [], 0
    for block, n in enumerate(blocks):
        rows += [("f.csv", "f.csv", block * 1000, i, 0, t) for i, t in enumerate(texts[at:at + n])]
        at += n
    return spark.createDataFrame(rows, "file_path string, file_name string, block_start long, line_idx long, "
                                       "batch_id long, line string").repartition(3)


@pytest.mark.parametrize("blocks", [[7], [2, 2, 3], [1] * 7])
def test_line_breaks_in_quoted_cells(spark, blocks):
    texts = ["Date,Transaction type,Description,Paid out,Paid in", '03/04/2024,POS,"multi', 'line, ""two""', 'end",12.50,',
             "04/04/2024,POS,plain,1.00,", '05/04/2024,POS,"a', 'b",2.00,']
    lines = _lines(spark, texts, blocks)
    joined = statements.join_quoted_lines(lines)
    rows = {r.description: (float(r.paid_out), r.reject_reason) for r in statements.stage(joined).collect()}
    assert rows == {'multi\nline, "two"\nend': (12.5, None), "plain": (1.0, None), "a\nb": (2.0, None)}
    apart = [(r.reject_reason, r.paid_out) for r in statements.stage(lines).collect()]
    assert sum(reason is None for reason, _ in apart) == 1  # the plain one; no part of a broken row is valid
    assert {reason for reason, _ in apart if reason} >= {"open_quote"}


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, description string")
    for _ in range(2):
        store.write_categorized(df, str(tmp_path / "batch=1"))
    assert spark.read.parquet(str(tmp_path / "batch=1")).count() == 1
