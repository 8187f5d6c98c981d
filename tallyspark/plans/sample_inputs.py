"""Ledger inputs derived from the TPC-H-like test tables, for the registered queries and the bench."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import rule_id
from tallyspark.operators.merge import to_ledger
from tallyspark.operators.rules import categorize
from tallyspark.operators.scale import cut_lineage, is_small, shared_dir
from tallyspark.schema import MERCHANTS, MONEY, PATTERNS, UNCATEGORIZED

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def merchants(spark: SparkSession) -> DataFrame:
    rows = [
        (0, "widget_co", "Widget Co", "Shopping", "Widgets", "operating", ["widget", "blue widget"]),
        (1, "gear_shop", "Gear Shop", "Transport", None, "operating", ["gear"]),
        (2, "ring_friend", "Ring Friend", "P2P", "Alex", "transfer", ["ring", "cold ring"]),
        (3, "rod_friend", "Rod Friend", "P2P", None, "transfer", ["rod"]),
        (4, "plate_card", "Plate Card", "Debt", "Card Payoff", "financing", ["plate"]),
    ]
    return spark.createDataFrame(rows, MERCHANTS)


def patterns(spark: SparkSession) -> DataFrame:
    rows = [
        (5, "hot", "Bills", "Card Interest", "operating", 4.0),
        (6, "new", "Bills", "Utilities", "operating", 1.5),
        (7, "economy", "Groceries", "Market", "operating", 1.0),
        (8, "x", "Never", "Short", "operating", 9.0),
        (9, "large", "Bills", "Rent", "operating", 0.35),
    ]
    return spark.createDataFrame(rows, PATTERNS)


def lines_with_parts(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Line items with ``columns`` of their part.

    Parts measured small are broadcast. Otherwise both sides are shuffled and the parts of a partition are hashed, so the line
    items, many times as many, need no sort.
    """
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", *columns)
    parts = F.broadcast(parts) if is_small(parts) else parts.hint("shuffle_hash")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def _txn_date() -> Column:
    return F.when(F.col("l_orderkey") % 997 != 0, F.col("l_shipdate").cast("date"))


def line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all line items, those of ``txn`` among them, from a scan alone."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", _txn_date().alias("date"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item."""
    price = F.col("l_extendedprice").cast(MONEY)
    back = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast(MONEY)
    line_idx = (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")) * 100000000 + F.col("l_suppkey")
    return lines_with_parts(spark, sf_dir, ["p_name", "p_type", "p_brand"]).select(
        *ROW, _txn_date().alias("date"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("description"),
        F.when(back, zero).otherwise(price).alias("paid_out"),
        F.when(back, price).otherwise(zero).alias("paid_in"),
        F.when(F.col("l_linestatus") == "O", "Natwest").otherwise("Aqua").alias("source"),
        "p_brand", "l_returnflag", "l_linestatus",
        F.struct(F.lit(0).cast("long").alias("batch_id"), F.lit("lineitem").alias("file_name"),
                 F.col("l_orderkey").alias("block_start"), line_idx.alias("line_idx")).alias("ingest_seq"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per customer, to a supplier named in the description."""
    customers = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("TRANSFER Supplier#"), F.lpad(((F.col("c_custkey") * 7) % 150).cast("string"), 9, "0"))
    return customers.select("c_custkey", F.concat(name, F.lit(" from "), "c_name", F.lit(" "), "c_mktsegment")
                            .alias("description"))


def payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merchant per supplier, known by its name."""
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("rule_ord"), rule_id(F.col("s_name")).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("category"),
        F.lit("").alias("subcategory"), F.lit("transfer").alias("type"), F.array("s_name").alias("aliases"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern per market segment."""
    names = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("pattern")).agg(
        F.min("c_custkey").alias("rule_ord"))
    return names.select("rule_ord", "pattern", F.lit("Segment").alias("category"), F.lit("").alias("subcategory"),
                        F.lit("operating").alias("type"), F.lit(1.0).alias("weight"))


def categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorize(txn(spark, sf_dir), merchants(spark), patterns(spark))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ledger(categorized(spark, sf_dir))


def ledger_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier ledger whose rows were never categorised."""
    return (txn(spark, sf_dir).filter("l_returnflag <> 'N'")
            .withColumns({"category": F.lit(UNCATEGORIZED), "subcategory": F.lit(None).cast("string"),
                          "type": F.lit("operating"), "rule_match": F.lit("none"), "confidence": F.lit(0)}))


def ledger_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that repeats the rows of the earlier ledger and some rows of its own."""
    rows = ledger(spark, sf_dir).drop("month")
    # Both copies of a row come from one pass.
    twice = F.when(F.col("l_linestatus") == "O", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(twice)).drop("_copy")


def many_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the brand as subcategory of shopping rows."""
    return ledger(spark, sf_dir).withColumn(
        "subcategory", F.when(F.col("category") == "Shopping", F.col("p_brand")).otherwise(F.col("subcategory")))


def amount_text(price: Column) -> Column:
    """Amounts as four kinds of statement print them."""
    kind = F.col("l_orderkey") % 4
    plain = price.cast("string")
    return (F.when(kind == 0, F.concat(F.lit("£"), F.format_number(price, 2)))
            .when(kind == 1, F.concat(F.lit("("), plain, F.lit(")")))
            .when(kind == 2, F.concat(plain, F.lit("-")))
            .otherwise(F.concat(plain, F.lit(" CR"))))


def date_text_variants(date: Column) -> Column:
    kind = F.col("l_orderkey") % 4
    return (F.when(kind == 0, F.date_format(date, "dd/MM/yyyy"))
            .when(kind == 1, F.date_format(date, "yyyy-MM-dd"))
            .when(kind == 2, F.date_format(date, "dd MMM yyyy"))
            .otherwise("not a date"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the text cells of all three layouts."""
    price = F.col("l_extendedprice").cast(MONEY)
    back = F.col("l_returnflag") == "R"
    signed = F.when(back, -price).otherwise(price).cast("string")
    pounds = F.concat(F.lit("£"), F.format_number(price, 2))
    cash = F.when(F.col("l_linestatus") == "O", "CASH").otherwise("POS")
    atm = F.when(F.col("l_linestatus") == "O", "ATM Withdrawal").otherwise("Direct debit")
    return lines_with_parts(spark, sf_dir, ["p_name", "p_type"]).select(
        *ROW, "p_type", "l_discount", date_text_variants(F.col("l_shipdate").cast("date")).alias("Date"),
        F.col("p_name").alias("Description"), F.lower("p_type").alias("Note"), signed.alias("Amount(GBP)"),
        cash.alias("Type"), signed.alias("Value"), F.lit("main").alias("Account Name"),
        F.lit("1").alias("Account Number"), atm.alias("Transaction type"),
        F.when(~back, pounds).alias("Paid out"), F.when(back, pounds).alias("Paid in"))


def layout_of_type() -> Column:
    return (F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "Aqua").when(F.col("p_type") == "LARGE", "Natwest")
            .when(F.col("p_type") == "STANDARD", "Nationwide"))


def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines, one file per supplier: a preamble, a header and a line per line item.

    The supplier decides the layout (one in four is unknown) and the separator; amounts hold a
    separator of thousands and are therefore quoted; a line with a discount of 0.1 is too wide.
    The lines are a table that holds the files one by one, as a folder does: they are read several
    times, and of a file that lies in a few tasks few first lines travel. A big file is split.
    """
    rows = raw_rows(spark, sf_dir)
    file = F.col("l_suppkey")
    sep = F.element_at(F.array(*[F.lit(d) for d in (",", ";", "\t")]), (file % 3 + 1).cast("int"))
    layouts = [["Date", "Description", "Note", "Amount(GBP)"],
               ["Date", "Type", "Description", "Value", "Account Name", "Account Number"],
               ["Date", "Transaction type", "Description", "Paid out", "Paid in"],
               ["Date", "Payee", "Sum"]]

    def per_layout(make) -> Column:
        out = F.when(file % 4 == 0, make(layouts[0]))
        for i in (1, 2, 3):
            out = out.when(file % 4 == i, make(layouts[i]))
        return out

    def cells(names: list[str]) -> Column:
        quoted = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{n}`"), F.lit("")), F.lit('"'))
                  if n.startswith("Paid") else F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]
        return F.call_function("concat_ws", sep, *quoted)

    rows = rows.withColumns({"Payee": F.col("Description"), "Sum": F.col("Value")})
    extra = F.when(F.col("l_discount") == 0.1, F.concat(sep, F.lit("extra"))).otherwise("")
    place = (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey"))
    data = rows.select(file.alias("f"), F.col("l_orderkey").alias("block_start"), place.alias("line_idx"),
                       F.concat(per_layout(cells), extra).alias("line"))
    heads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name").select(
        file.alias("f"), F.explode(F.array(
            F.concat(F.lit("Statement update for "), "s_name"),
            per_layout(lambda names: F.call_function("concat_ws", sep, *[F.lit(n) for n in names])))).alias("line"),
        F.lit(-1).cast("long").alias("block_start")).withColumn(
        "line_idx", F.when(F.startswith("line", F.lit("Statement")), 0).otherwise(1).cast("long"))
    name = F.concat(F.lit("supplier_"), F.col("f").cast("string"), F.lit(".csv"))
    return cut_lineage(data.unionByName(heads).hint("rebalance", "f").select(
        name.alias("file_path"), name.alias("file_name"), "block_start", "line_idx",
        F.lit(0).cast("long").alias("batch_id"), "line"))


def document_lines(spark: SparkSession, sf_dir: str, line_breaks: bool) -> DataFrame:
    """Statement lines, 64 files: a header and a row per document with its text as a quoted cell.

    With ``line_breaks`` a row has as many lines as the text; else they are blanks, and of every tenth row the quote is open.
    """
    text = F.coalesce("text", F.lit(""))
    cell = F.replace(text if line_breaks else F.replace(text, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""'))
    closing = F.lit('"') if line_breaks else F.when(F.col("doc_id") % 10 == 3, "").otherwise('"')
    amount = F.concat((F.col("doc_id") % 1000).cast("string"), F.lit(".00"))
    row = F.concat(F.lit('03/04/2024,POS,"'), cell, closing, F.lit(","), amount, F.lit(","))
    data = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 64).alias("f"), F.col("doc_id").cast("long").alias("block_start"),
        F.posexplode(F.split(row, "\n")).alias("line_idx", "line"))
    heads = spark.range(64).select(F.col("id").alias("f"), F.lit(-1).cast("long").alias("block_start"), F.lit(0).alias("line_idx"),
                                   F.lit("Date,Transaction type,Description,Paid out,Paid in").alias("line"))
    name = F.concat(F.lit("documents_"), F.col("f").cast("string"), F.lit(".csv"))
    return data.unionByName(heads).select(
        name.alias("file_path"), name.alias("file_name"), "block_start", F.col("line_idx").cast("long").alias("line_idx"),
        F.lit(0).cast("long").alias("batch_id"), "line")


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of statement files that hold every document as a quoted cell, line breaks and all.

    Of every tenth row the text is on one line and its quote is left open. What cp1252 lacks is written as a question mark.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x0C\\x0E-\\x7F\\xA0-\\xFF]", "?")
    stray = F.col("doc_id") % 10 == 3
    cell = F.replace(F.when(stray, F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text), F.lit('"'), F.lit('""'))
    record = F.concat(F.lit('03/04/2024,POS,"'), cell, F.when(stray, "").otherwise('"'), F.lit(","),
                      F.col("doc_id").cast("string"), F.lit(".00,"))
    lines = table(spark, sf_dir, "documents").select(
        F.explode(F.split(record, "\n")).alias("Date,Transaction type,Description,Paid out,Paid in"))
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    # One column without quotes or a separator of its own: lines as they are, below a header line in every file.
    plain = {"quote": "\0", "escape": "\0", "sep": "\1", "emptyValue": "", "encoding": "iso-8859-1",
             "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.options(**plain).csv(folder, header=True)
    return folder


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merchant per product name; its aliases equal, resemble or differ from descriptions."""
    part = table(spark, sf_dir, "part")
    kind = F.lower("p_type")
    alias = (F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" "), kind))
             .when(F.col("p_size") <= 10, F.concat(kind, F.lit(" "), "p_name"))
             .otherwise(F.concat(kind, F.lit(" "), "p_name", F.lit(" "), F.lower("p_brand"))))
    return part.groupBy("p_name").agg(
        F.min("p_partkey").alias("rule_ord"), F.max(kind).alias("kind"),
        F.array_sort(F.collect_set(alias)).alias("aliases")).select(
        "rule_ord", rule_id(F.col("p_name")).alias("id"), F.concat("p_name", F.lit(" "), "kind").alias("name"),
        F.lit("Goods").alias("category"), F.lit("General").alias("subcategory"), F.lit("operating").alias("type"),
        "aliases")


def supplier_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merchant per supplier, placed behind those of ``directory``."""
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).cast("long").alias("rule_ord"), rule_id(F.col("s_name")).alias("id"),
        F.col("s_name").alias("name"), F.lit("Goods").alias("category"), F.lit("General").alias("subcategory"),
        F.lit("operating").alias("type"), F.array(F.concat(F.lower("s_name"), F.lit(" to"))).alias("aliases"))


def directory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants to upsert: known ids with other attributes and more aliases, and new ids."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type")))
    alias = F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise(
        F.concat(F.lower("p_brand"), F.lit(" "), "p_name"))
    return part.groupBy(name.alias("name")).agg(
        F.min("p_partkey").alias("rule_ord"), F.array_sort(F.collect_set(alias)).alias("aliases")).select(
        "rule_ord", rule_id(F.col("name")).alias("id"), "name", F.lit("Changed").alias("category"),
        F.lit("Changed").alias("subcategory"), F.lit("transfer").alias("type"), "aliases")


def decisions(members: DataFrame) -> DataFrame:
    """A reviewer's answers, made up from the length of the anchor."""
    n = F.length("anchor") % 4
    return members.select("anchor").distinct().select(
        "anchor",
        F.when(n == 0, "attach").when(n == 1, "new").when(n == 2, "pattern").otherwise("skip").alias("action"),
        F.lit(None).cast("string").alias("name"), F.lit(" ").alias("pattern"),
        F.when(F.length("anchor") % 5 != 0, F.concat(F.lit("Cat "), F.substring("anchor", 1, 3))).alias("category"),
        F.lit(None).cast("string").alias("subcategory"), F.lit("t").alias("type"))
