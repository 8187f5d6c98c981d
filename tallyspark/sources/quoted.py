"""Quoted cells that span lines: records put together without gathering a file.

Whether a line starts inside a quoted cell depends on all lines before it, but only through one bit. Each line is a map of
that bit, found from its text alone: whether a quote is left open if it starts a record, and, if it starts inside a cell,
whether the cell goes on, ends, ends with another one left open, or is followed by something no cell can be followed by. The
last shows that the quote before was a stray one: the line starts a record of its own, whatever came before it. So a block of a
file is a map too, and the bit at the start of each block follows from the maps of the blocks before. Blocks are then read
independently; only the records that cross the border of a block meet.

A quote that nothing closes spoils its own line only. The lines after it that were taken for its cell are given back one by
one, as they are if the cell would exceed ``MAX_LINES`` or ``MAX_CHARS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scale import cut_lineage, is_small

MAX_LINES = 100_000
MAX_CHARS = 4 << 20

#: What a line does that starts inside a quoted cell.
STAYS, CLOSES, REOPENS, IS_STRAY = range(4)
_TO_CLOSE = '^[^"]*+(?:""[^"]*+)*+"'
_BLOCK = ["file_path", "block_start"]
_COLUMNS = [*_BLOCK, "file_name", "line_idx", "batch_id", "line"]
_MAPS = "file_path string, block_start long, maps array<int>"
_RECORDS = ("file_path string, block_start long, file_name string, line_idx long, batch_id long, line string, "
            "part string, lines array<struct<idx: long, line: string>>, closed boolean, released boolean")
_PART = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("file_name", pa.string()), ("line_idx", pa.int64()),
                   ("batch_id", pa.int64()), ("line", pa.string()), ("part", pa.string()),
                   ("lines", pa.list_(pa.struct([("idx", pa.int64()), ("line", pa.string())]))), ("closed", pa.bool_()),
                   ("released", pa.bool_())])


def escaped(delimiter: str) -> str:
    return "\\" + delimiter if delimiter == "|" else delimiter


def quoted_cell(delimiter: str) -> str:
    """A separator and a closed quoted cell. Nothing in it is tried twice, so its length has no bound."""
    return f'{escaped(delimiter)}"[^"]*+(?:""[^"]*+)*+"'


def without_quoted(cells: Column, delimiter: str) -> Column:
    """``cells``, each with its separator before it, without the closed quoted ones."""
    return F.regexp_replace(cells, quoted_cell(delimiter), "")


def leaves_open(cells: Column, delimiter: str) -> Column:
    """Whether ``cells``, each with its separator before it, hold a quoted cell that is not closed."""
    return F.contains(without_quoted(cells, delimiter), F.lit(delimiter + '"'))


def _line_code(line: Column, delimiter: str) -> Column:
    """1 if the line leaves a quote open, and twice what it does inside a cell."""
    rest = F.regexp_replace(line, _TO_CLOSE, "")
    inside = (F.when(F.rlike(line, F.lit('^[^"]*+(?:""[^"]*+)*+\\z')), STAYS)
              .when(~F.rlike(line, F.lit(f"{_TO_CLOSE}(?:{escaped(delimiter)}|\\z)")), IS_STRAY)
              .when(leaves_open(rest, delimiter), REOPENS).otherwise(CLOSES))
    return leaves_open(F.concat(F.lit(delimiter), line), delimiter).cast("int") + inside * 2


def line_codes(line: Column, delimiters: list[str]) -> Column:
    """The codes of a line for every separator, three bits each; 0 without a quote."""
    codes = sum((_line_code(line, d) * (1 << 3 * i) for i, d in enumerate(delimiters)), F.lit(0))
    return F.when(F.contains(line, F.lit('"')), codes).otherwise(0).cast("int")


def _states(codes: np.ndarray, entry: int) -> np.ndarray:
    """Whether each line ends inside a quoted cell, if the first one starts as ``entry`` says."""
    outside_to, inside = codes & 1, codes >> 1
    inside_to = np.where(inside == IS_STRAY, outside_to, inside != CLOSES)
    # The last line whose end does not depend on its start settles it, but for the turns after it.
    settled = outside_to == inside_to
    last = np.maximum.accumulate(np.where(settled, np.arange(len(codes)), -1))
    turns = np.cumsum(~settled & (outside_to == 1))
    known = last >= 0
    start = np.where(known, outside_to[last], entry)
    return start ^ (turns - np.where(known, turns[last], 0)) & 1


def _block_maps(delimiters: int):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[list[int]]] = {}
        for batch in batches:
            for begin, end, key in _stretches(batch):
                ends = found.setdefault(key, [[0, 1] for _ in range(delimiters)])
                codes = batch.column("codes").slice(begin, end - begin).to_numpy()
                for i, pair in enumerate(ends):
                    own = codes >> 3 * i & 7
                    after = [int(_states(own, bit)[-1]) for bit in (0, 1)]
                    ends[i] = [after[pair[0]], after[pair[1]]]
            latest = next(reversed(found), None)
            if len(found) > 1000:  # a block may go on in the next batch
                kept = found.pop(latest)
                yield _maps_batch(found)
                found = {latest: kept}
        yield _maps_batch(found)

    return maps


def _maps_batch(found: dict[tuple[str, int], list[list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([f for f, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64()),
        pa.array([[out + 2 * within for out, within in m] for m in found.values()], pa.list_(pa.int32()))], _BLOCK + ["maps"])


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[str, int]]]:
    """Runs of rows of one block."""
    n = batch.num_rows
    if not n:
        return
    files, blocks = batch.column("file_path").dictionary_encode(), batch.column("block_start").to_numpy()
    file = files.indices.to_numpy()
    edges = np.flatnonzero((file[1:] != file[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    names = files.dictionary.to_pylist()
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), n]):
        yield begin, end, (names[file[begin]], int(blocks[begin]))


def block_entries(coded: DataFrame, files: DataFrame, delimiters: list[str]) -> DataFrame:
    """Rows (file_path, block_start, shift, entry): where a block's codes are, and whether it starts inside a quoted cell."""
    maps = coded.select(*_BLOCK, "codes").mapInArrow(_block_maps(len(delimiters)), _MAPS)
    number = F.array_position(F.array(*map(F.lit, delimiters)), F.col("delimiter")).cast("int") - 1
    own = maps.join(files.select("file_path", number.alias("number")), "file_path").select(
        *_BLOCK, (F.col("number") * 3).alias("shift"), F.get("maps", F.col("number")).alias("map"))
    # As for lines: the last block before that ends alike however it starts, and the turns since.
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_path").orderBy("block_start")
    counted = own.withColumn("turns", F.sum((F.col("map") == 1).cast("int")).over(upto))
    settled = F.max(F.when(F.col("map").isin(0, 3), F.struct("block_start", (F.col("map") == 3).cast("int").alias("bit"), "turns")))
    entry = F.coalesce(F.col("last.bit"), F.lit(0)).bitwiseXOR(
        (F.coalesce("before", F.lit(0)) - F.coalesce("last.turns", F.lit(0))).cast("int").bitwiseAND(1))
    return counted.select(*_BLOCK, "shift", settled.over(earlier).alias("last"), F.max("turns").over(earlier).alias("before")).select(
        *_BLOCK, "shift", entry.cast("int").alias("entry"))


class _Block:
    """The records of one block, as its lines come."""

    def __init__(self, key: tuple[str, int], entry: int, max_lines: int, max_chars: int):
        self.key, self.inside, self.bounds = key, entry, (max_lines, max_chars)
        self.held: list[tuple[int, str]] = []
        self.chars = 0
        self.carried = bool(entry)  # the lines held belong to a record of an earlier block
        self.open = bool(entry)
        self.released = False
        self.first: tuple = ()
        self.rows: list[tuple] = []

    def lines(self, columns: list[pa.Array], codes: np.ndarray) -> np.ndarray:
        """Take lines (file_name, line_idx, batch_id, line); the places of those that are records by themselves."""
        after = _states(codes, self.inside)
        before = np.concatenate([[self.inside], after[:-1]])
        self.inside = int(after[-1])
        starts = np.flatnonzero((before == 0) | (codes >> 1 == IS_STRAY))
        edges = np.append(starts, len(codes))
        ended = np.append(before[starts[1:]] == 0, True)  # whether the next record starts outside a cell
        done = np.ones(len(starts), dtype=bool)
        done[-1:] = self.inside == 0

        def hold(begin: int, end: int) -> None:
            for row in zip(*(c.slice(begin, end - begin).to_pylist() for c in columns)):
                self._hold(row)

        hold(0, int(edges[0]))
        if self.open and (len(starts) or self.inside == 0):
            self._finish(not len(starts) or before[starts[0]] == 0)
        alone = done & (np.diff(edges) == 1)
        for k in np.flatnonzero(~alone).tolist():
            self.open = True
            hold(int(edges[k]), int(edges[k + 1]))
            if done[k]:
                self._finish(bool(ended[k]))
        return starts[alone]

    def _hold(self, row: tuple) -> None:
        name, idx, batch, line = row
        if self.released:
            self._single(row)
            return
        self.first = self.first or row
        self.held.append((idx, line))
        self.chars += len(line) + 1
        if len(self.held) > self.bounds[0] or self.chars > self.bounds[1]:
            self.released = True
            for idx, line in self.held:
                self._single((name, idx, batch, line))
            self.held = []

    def _single(self, row: tuple) -> None:
        self.rows.append((*self.key, *row, None, None, None, None))

    def _finish(self, closed: bool) -> None:
        """Close the record held: whole, given back, or as a part for the blocks before."""
        if self.carried:
            self._part("tail", closed)
        elif closed and not self.released:
            self._single((*self.first[:3], "\n".join(line for _, line in self.held)))
        else:
            for idx, line in self.held:
                self._single((self.first[0], idx, self.first[2], line))
        self.held, self.chars, self.open, self.carried, self.released, self.first = [], 0, False, False, False, ()

    def _part(self, part: str, closed: bool) -> None:
        name, idx, batch = self.first[:3] if self.first else ("", 0, 0)
        self.rows.append((*self.key, name, idx, batch, None, part, [{"idx": i, "line": t} for i, t in self.held], closed,
                          self.released))

    def end(self) -> None:
        if self.open:
            self._part("middle" if self.carried else "head", False)
        self.open = False


def _records(max_lines: int, max_chars: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        for batch in batches:
            alone: list[np.ndarray] = []
            rows: list[tuple] = []
            shifts, entries = batch.column("shift").to_numpy(), batch.column("entry").to_numpy()
            for begin, end, key in _stretches(batch):
                if block is None or block.key != key:
                    if block is not None:
                        block.end()
                        rows += block.rows
                    block = _Block(key, int(entries[begin]), max_lines, max_chars)
                codes = batch.column("codes").slice(begin, end - begin).to_numpy() >> int(shifts[begin]) & 7
                if not block.open and not codes.any():
                    alone.append(np.arange(begin, end))
                    continue
                columns = [batch.column(c).slice(begin, end - begin) for c in _COLUMNS[2:]]
                alone.append(block.lines(columns, codes) + begin)
                rows += block.rows
                block.rows = []
            if alone:
                whole = batch.select(_COLUMNS).take(pa.array(np.concatenate(alone)))
                blank = [pa.nulls(whole.num_rows, f.type) for f in _PART][len(_COLUMNS):]
                yield pa.RecordBatch.from_arrays([*whole.columns, *blank], schema=_PART)
            if rows:
                yield _rows_batch(rows)
        if block is not None:
            block.end()
            if block.rows:
                yield _rows_batch(block.rows)

    return records


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)


def _across_blocks(parts: DataFrame, max_lines: int, max_chars: int) -> DataFrame:
    """Records that cross borders of blocks: a head, any number of middles, a tail. Without a closed tail, or beyond the
    bounds, their lines come back one by one."""
    at = F.struct("block_start", (F.col("part") == "head").cast("int").alias("late"))
    numbered = parts.withColumn("at", at).withColumn(
        "record", F.sum((F.col("part") == "head").cast("int")).over(Window.partitionBy("file_path").orderBy("at")))
    of_record = Window.partitionBy("file_path", "record")
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"]) + 1)
    whole = ((F.max(F.col("closed").cast("int")).over(of_record) == 1) & (F.max(F.col("released").cast("int")).over(of_record) == 0)
             & (F.sum(F.size("lines")).over(of_record) <= max_lines) & (F.sum(chars).over(of_record) <= max_chars))
    judged = numbered.withColumn("whole", whole)
    pieces = F.array_sort(F.collect_list(F.struct("at", "lines")))
    joined = judged.filter("whole").groupBy("file_path", "record").agg(
        F.min_by(F.struct("block_start", "file_name", "line_idx", "batch_id"), "at").alias("f"), pieces.alias("pieces")).select(
            "file_path", "f.block_start", "f.file_name", "f.line_idx", "f.batch_id",
            F.array_join(F.flatten("pieces.lines")["line"], "\n").alias("line"))
    given_back = judged.filter("not whole").select(*_BLOCK, "file_name", "batch_id", F.explode("lines").alias("l")).select(
        *_BLOCK, "file_name", F.col("l.idx").alias("line_idx"), "batch_id", F.col("l.line").alias("line"))
    return joined.unionByName(given_back)


def join_records(lines: DataFrame, files: DataFrame, delimiters: list[str], *, in_order: bool = False,
                 max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The records of files as single rows, with line breaks where a quoted cell has them.

    ``files`` gives the separator of each ``file_path``. Blank lines must not have been left out. With ``in_order`` the lines
    come as a scan reads them, a block in one partition and in order, and aren't shuffled; otherwise they are, by block.
    The result is a table in the shared folder.
    """
    if not in_order:
        lines = lines.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "line_idx")
    coded = lines.select(*_COLUMNS, line_codes(F.col("line"), delimiters).alias("codes"))
    entries = cut_lineage(block_entries(coded, files, delimiters))
    if is_small(entries):
        placed = coded.join(F.broadcast(entries), _BLOCK)
    else:
        placed = coded.join(entries, _BLOCK).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "line_idx")
    found = cut_lineage(placed.mapInArrow(_records(max_lines, max_chars), _RECORDS))
    crossing = _across_blocks(found.filter("part is not null"), max_lines, max_chars)
    return found.filter("part is null").select(*_COLUMNS).unionByName(crossing)
