"""Records of quoted files against an automaton that reads a file character by character."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import sample_inputs
from tallyspark.plans.queries import QUERIES
from tallyspark.schema import MERCHANTS, PATTERNS
from tallyspark.sources import quoted, statements, store
from tallyspark.streaming.ingest import stream_statements

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HEAD = "Date,Transaction type,Description,Paid out,Paid in"


def run_line(line, inside, sep=","):
    """(state at the end of the line, whether it can't go on inside a cell)."""
    state = "in" if inside else "start"
    first = inside
    for c in line:
        if state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            if c == '"':
                state = "in"
            elif c == sep:
                state, first = "start", False
            elif first:
                return run_line(line, False, sep)[0], True
            else:
                state = "text"
        else:
            state = "start" if c == sep else "in" if c == '"' and state == "start" else "text"
    return state == "in", False


def plain_records(lines, max_lines=10**9, max_chars=10**9):
    records, held, inside = [], [], False

    def give(closed):
        if held:
            whole = closed and len(held) <= max_lines and sum(len(t) + 1 for t in held) <= max_chars
            records.extend(["\n".join(held)] if whole or len(held) == 1 else held)
        held.clear()

    for line in lines:
        after, stray = run_line(line, inside)
        if not inside or stray:
            give(not inside)
        held.append(line)
        inside = after
    give(not inside)
    return [r for r in records if r.strip()]


def random_lines(seed, n):
    rng = random.Random(seed)
    cells = ["a", "bc", '"q"', '"a,b"', '"x ""y"" z"', 'in"ch', '""', '"""', '"open', 'shut"', ";", '"a" b', "", '"""",""']
    return [HEAD, *("" if rng.random() < 0.1 else ",".join(rng.choice(cells) for _ in range(rng.randint(1, 4))) for _ in range(n))]


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_codes_of_lines(spark, sep):
    lines = [line.replace(",", sep) for line in random_lines(1, 400)]
    df = spark.createDataFrame([(t,) for t in lines], "line string").select(
        "line", quoted.line_codes(F.col("line"), [sep]).alias("code"))
    for row in df.collect():
        outside, (within, stray) = run_line(row.line, False, sep)[0], run_line(row.line, True, sep)
        assert bool(row.code & 1) == outside, row.line
        stays = row.code >> 1 in (quoted.STAYS, quoted.REOPENS) if row.code >> 1 != quoted.IS_STRAY else outside
        assert (row.code >> 1 == quoted.IS_STRAY, stays) == (stray, within), row.line


def _lines(spark, texts, sizes, name="f.csv"):
    """A file's lines in blocks of the given sizes, as a scan gives them: each block in one partition, in order."""
    rows, at, block = [], 0, 0
    while at < len(texts):
        n = sizes[block % len(sizes)]
        rows += [(name, name, block * 1000, i, 0, t) for i, t in enumerate(texts[at:at + n])]
        at, block = at + n, block + 1
    return spark.createDataFrame(rows, "file_path string, file_name string, block_start long, line_idx long, batch_id long, line string")


@pytest.mark.parametrize("sizes, bounds, in_order", [
    ([10_000], {}, True), ([50, 1, 7], {}, True), ([1], {}, False), ([13], {"max_lines": 2}, True), ([5, 2], {"max_chars": 12}, False)])
def test_records_equal_a_sequential_reading(spark, sizes, bounds, in_order):
    texts, other = random_lines(2, 600), random_lines(3, 40)
    lines = _lines(spark, texts, sizes).coalesce(1).unionByName(_lines(spark, other, [4], "g.csv").coalesce(1))
    files = spark.createDataFrame([("f.csv", ","), ("g.csv", ",")], "file_path string, delimiter string")
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batches, "37")
    try:
        found = quoted.join_records(lines, files, statements.DELIMITERS, in_order=in_order, **bounds)
        got = found.orderBy("file_path", "block_start", "line_idx").collect()
    finally:
        spark.conf.unset(batches)
    for name, own in (("f.csv", texts), ("g.csv", other)):
        assert [r.line for r in got if r.file_path == name and r.line.strip()] == plain_records(own, **bounds)


def test_one_path_for_many_blocks(spark, monkeypatch):
    texts = random_lines(4, 200)
    monkeypatch.setattr(quoted, "is_small", lambda df: False)
    files = spark.createDataFrame([("f.csv", ",")], "file_path string, delimiter string")
    got = quoted.join_records(_lines(spark, texts, [9]), files, statements.DELIMITERS).orderBy("block_start", "line_idx").collect()
    assert [r.line for r in got if r.line.strip()] == plain_records(texts)


def _stage_file(spark, tmp_path, lines):
    folder = tmp_path / "raw"
    folder.mkdir(exist_ok=True)
    (folder / "s.csv").write_text("\n".join(lines) + "\n")
    return statements.stage(statements.read_raw_files(spark, str(folder), multi_line=True))


def test_blank_lines_in_cells_are_kept(spark, tmp_path):
    rows = _stage_file(spark, tmp_path, ["", HEAD, "", '03/04/2024,POS,"a', "", "  ", 'b",1.00,', ""]).collect()
    assert [(r.description, r.reject_reason) for r in rows] == [("a\n\n  \nb", None)]


@pytest.mark.parametrize("stray", ['5" pipe', '"5 pipe', '5 pipe"'])
def test_a_stray_quote_spoils_its_own_line_only(spark, tmp_path, stray):
    good = [f'03/04/2024,POS,"row {i}, ""x""",{i}.00,' for i in range(2001)]
    lines = [HEAD, *good[:1000], f"03/04/2024,POS,{stray},1.00,", *good[1000:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = _stage_file(spark, tmp_path, lines).select("description", "reject_reason").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    valid = {r.description for r in rows if r.reject_reason is None}
    assert len(rows) == 2002 and {f'row {i}, "x"' for i in range(2001)} <= valid
    assert [r.reject_reason for r in rows if r.reject_reason] == (["open_quote"] if stray.startswith('"') else [])


def test_streams_take_line_breaks(spark, tmp_path):
    raw, staged, ledger, checkpoint = (str(tmp_path / n) for n in ("raw", "staged", "ledger", "checkpoint"))
    os.mkdir(raw)
    with open(f"{raw}/a.csv", "w") as f:
        f.write(f'{HEAD}\n03/04/2024,POS,"a\n\nb",1.00,\n04/04/2024,POS,c,2.00,\n')
    rules = spark.createDataFrame([], MERCHANTS), spark.createDataFrame([], PATTERNS)
    query = stream_statements(spark, raw, staged, ledger, checkpoint, *rules, multi_line=True).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None
    assert sorted(r.description for r in store.read_ledger(spark, ledger).collect()) == ["a\n\nb", "c"]


def test_files_hold_all_documents(spark):
    folder = sample_inputs.document_files(spark, SF_DIR)
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert spark.read.text(folder).count() > 2 * n
    rows = QUERIES["stage_quoted_files"](spark, SF_DIR)
    assert rows.count() == n and rows.filter(F.contains("description", F.lit("\n"))).count() > n / 4
    assert {r.reject_reason for r in rows.select("reject_reason").distinct().collect()} == {None, "open_quote"}
