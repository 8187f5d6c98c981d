"""Raw statement files: delimited text in cp1252 with an unknown separator and header position.

Files are read as lines, so one file may be split over many tasks. What differs between files (the
separator, the header line, the layout, the place of each column) is a small table with a row per
file, found from the first lines only. A quoted cell that spans lines is rejected line by line
(``open_quote``), unless ``join_quoted_lines`` has put its lines together (see ``quoted``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import strip
from tallyspark.operators.layouts import CELLS, identify_layout, standardize, with_reject_reason
from tallyspark.operators.scale import cut_lineage, is_small, lookup_join
from tallyspark.sources.quoted import escaped, join_records, quoted_cell, without_quoted

HEADER_SCAN_DEPTH = 20
# Separators in the order in which ties are decided.
DELIMITERS = [",", ";", "\t", "|"]
# Bytes 0x80-0x9F of cp1252 that differ from iso-8859-1, and their characters.
_CP1252_BYTES = ("\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
                 "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f")
_CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# A byte order mark as itself and as its UTF-8 bytes read in cp1252.
_BOM = "^(\\uFEFF|ï»¿)"


def decode_cp1252(raw: Column) -> Column:
    return F.translate(F.decode(raw.cast("binary"), "iso-8859-1"), _CP1252_BYTES, _CP1252_CHARS)


def read_raw_files(spark: SparkSession, folder: str, batch_id: int = 0, multi_line: bool = False) -> DataFrame:
    """Non-blank lines (file_name, block_start, line_idx, batch_id, line) of the CSV files of a folder.

    Subfolders and lock files are left out. ``block_start`` is the offset of the file block a task
    read and ``line_idx`` grows within it, so the two order the lines of a file. ``multi_line`` is for
    folders whose quoted cells may hold line breaks: it gives records in place of lines.
    """
    text = (spark.read.option("pathGlobFilter", "*.[cC][sS][vV]")
            .option("recursiveFileLookup", "false").text(folder))
    return statement_records(text, batch_id) if multi_line else statement_lines(text, batch_id)


def statement_lines(text: DataFrame, batch_id: int = 0) -> DataFrame:
    """The non-blank lines of a text scan, or of one micro-batch of it, not yet shuffled."""
    return _all_lines(text, batch_id).filter(_is_filled())


def statement_records(text: DataFrame, batch_id: int = 0) -> DataFrame:
    """The same with the lines of quoted cells put together."""
    return join_quoted_lines(_all_lines(text, batch_id), in_order=True)


def _all_lines(text: DataFrame, batch_id: int) -> DataFrame:
    return (text.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        # The scan numbers its rows in order; only the order within a block is used.
        F.monotonically_increasing_id().alias("line_idx"), F.lit(batch_id).cast("long").alias("batch_id"),
        decode_cp1252(F.col("value")).alias("line"))
        .filter(~F.col("file_name").startswith("~$")))


def _is_filled() -> Column:
    return strip(F.col("line")) != ""


def detect_delimiter(line: Column) -> Column:
    """The separator that occurs most often in the line, a comma if none does."""
    counted = F.array(*[F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"),
                                 F.lit(-i).alias("order"), F.lit(d).alias("d"))
                        for i, d in enumerate(DELIMITERS)])
    return F.array_max(counted)["d"]


def _per_delimiter(delimiter: Column, make) -> Column:
    return reduce(lambda case, d: case.when(delimiter == d, make(d)), DELIMITERS[1:],
                  F.when(delimiter == DELIMITERS[0], make(DELIMITERS[0])))


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; a cell in double quotes may hold the separator and doubled quotes.

    What does not depend on the separator is there once: a much larger expression becomes a method that is never compiled.
    """
    def found(d: str) -> Column:
        sep = escaped(d)
        return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(
            f"({quoted_cell(d)}[^{sep}]*+|{sep}[^{sep}]*+)"), F.lit(1))

    bare = F.transform(_per_delimiter(delimiter, found), lambda c: c.substr(F.lit(2), F.length(c)))
    unquoted = F.transform(bare, lambda c: F.when(
        c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
        F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    plain = F.split(line, F.when(delimiter == "|", escaped("|")).otherwise(delimiter), -1)
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(plain)


def open_quote(line: Column, delimiter: Column) -> Column:
    """True for a line with a quoted cell that is not closed in it."""
    rest = _per_delimiter(delimiter, lambda d: without_quoted(F.concat(F.lit(d), line), d))
    return F.contains(line, F.lit('"')) & F.contains(rest, F.concat(delimiter, F.lit('"')))


def join_quoted_lines(lines: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Non-blank records in place of lines: lines put together, with line breaks between, where a quoted cell spans them.

    ``lines`` should hold blank lines too, as a cell may. A quote that nothing closes, or that something closes which no cell
    can end with, rejects its own line only. ``in_order`` is for lines as a scan reads them. The separator of a file is that of
    its header line.
    """
    files = find_header(lines.filter(_is_filled())).select("file_path", "delimiter")
    return join_records(lines, files, DELIMITERS, in_order=in_order).filter(_is_filled())


def normalize_headers(cells: Column) -> Column:
    return F.transform(cells, lambda c: strip(F.regexp_replace(F.regexp_replace(c, _BOM, ""), "\\uFEFF", "")))


def find_header(lines: DataFrame, depth: int = HEADER_SCAN_DEPTH) -> DataFrame:
    """One row per file: its header line, separator, layout and the place of each known column.

    Of the first ``depth`` lines the first one that fits a known layout is the header, else the first
    that contains ``date``, else the first one.
    """
    in_file = Window.partitionBy("file_path").orderBy("block_start", "line_idx")
    # The rank filter is applied before the shuffle too: no more than ``depth`` lines per task travel.
    top = lines.withColumn("_n", F.row_number().over(in_file)).filter(F.col("_n") <= depth)
    # A mark before a quoted first cell would hide the quote.
    bare = F.regexp_replace("line", _BOM, "")
    top = (top.withColumn("delimiter", detect_delimiter(bare))
           .withColumn("header", normalize_headers(split_cells(bare, F.col("delimiter"))))
           .withColumn("layout", identify_layout(F.col("header"))))
    rank = F.struct(
        F.when(F.col("layout").isNotNull(), 0).when(F.contains(F.lower("line"), F.lit("date")), 1).otherwise(2), "_n")
    best = top.groupBy("file_path").agg(F.min_by(F.struct(
        "delimiter", "header", "layout", F.col("block_start").alias("header_block"),
        F.col("line_idx").alias("header_idx")), rank).alias("h"))
    places = F.struct(*[F.array_position(F.col("h.header"), F.lit(c)).cast("int").alias(f"p{i}")
                        for i, c in enumerate(CELLS)])
    return best.select("file_path", "h.delimiter", "h.layout", "h.header_block", "h.header_idx",
                       F.size("h.header").alias("width"), places.alias("places"))


def _with_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``lines`` with what ``files`` says of their file.

    Many files share few forms (separator, layout, places). Where the files are not small, their table holds the number of a
    form in its place, so that it may be broadcast for several times as many files.
    """
    if is_small(files):
        return lines.join(F.broadcast(files), "file_path", "left")
    form = F.struct("delimiter", "layout", "width", "places")
    forms = cut_lineage(files.select(form.alias("_form")).distinct().withColumn("_form_id", F.monotonically_increasing_id()))
    numbered = files.join(forms, form == F.col("_form")).select("file_path", "header_block", "header_idx", "_form_id")
    rows = lookup_join(lookup_join(lines, numbered, "file_path"), forms, "_form_id")
    return rows.select("*", "_form.*").drop("_form", "_form_id")


def read_statement_lines(lines: DataFrame, depth: int = HEADER_SCAN_DEPTH) -> DataFrame:
    """Data rows of all files with the cells of the known columns, the layout and ``reject_reason``.

    Rows wider than their header and files of no known layout are marked as rejected. Narrow rows
    lack their last cells. A file may hold any share of the rows, so the file table is broadcast or
    joined with its biggest files kept apart.
    """
    rows = _with_files(lines, cut_lineage(find_header(lines, depth)))
    after = ((F.col("block_start") > F.col("header_block"))
             | ((F.col("block_start") == F.col("header_block")) & (F.col("line_idx") > F.col("header_idx"))))
    rows = rows.filter(after).withColumn("cells", split_cells(F.col("line"), F.col("delimiter")))

    def cell(i: int) -> Column:
        value = F.get("cells", F.col(f"places.p{i}") - 1)
        return F.when(F.col(f"places.p{i}") > 0, F.when(value != "", value))

    absent = {c: F.col(f"places.p{i}") == 0 for i, c in enumerate(CELLS)}
    reason = (F.when(F.col("layout").isNull(), "unknown_layout")
              .when(open_quote(F.col("line"), F.col("delimiter")), "open_quote")
              .when(F.size("cells") > F.col("width"), "too_wide")
              .when(absent["Description"], "no_description")
              .when((F.col("layout") == "Natwest") & absent["Type"], "no_type"))
    return rows.select(
        F.struct("batch_id", "file_name", "block_start", "line_idx").alias("ingest_seq"),
        F.col("file_name").alias("source_file"), "line", "layout", reason.alias("reject_reason"),
        *[cell(i).alias(c) for i, c in enumerate(CELLS)])


def stage(lines: DataFrame, depth: int = HEADER_SCAN_DEPTH) -> DataFrame:
    """Staged rows with ``reject_reason`` (null for a valid row) from statement lines."""
    return with_reject_reason(standardize(read_statement_lines(lines, depth)))
