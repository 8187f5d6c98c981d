"""Tables between the stages: staged and categorised rows, rejects, the ledger, the rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.clean import coerce_amount
from tallyspark.functions.text import clean_key, month_label, or_blank, strip
from tallyspark.operators.learning import as_merchants
from tallyspark.operators.merge import new_rows, to_ledger
from tallyspark.schema import LEDGER, missing_columns

#: Why a row is rejected, by statements or by their layouts.
REJECT_REASONS = ["unknown_layout", "open_quote", "too_wide", "no_description", "no_type", "bad_date", "bad_amount"]


def write_staged(checked: DataFrame, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Rows with ``reject_reason`` written once, valid and rejected ones in folders of their own.

    ``path`` is that of one batch, so writing it again replaces an attempt that was cut short. Returns how many rows the
    writing job saw: all (``rows``), ``valid`` and ``undated`` ones and those of each reason.
    """
    reason = F.col("reject_reason")
    counts = {"rows": F.count(F.lit(1)), "valid": F.count_if(reason.isNull())}
    if "date" in checked.columns:
        counts["undated"] = F.count_if(F.col("date").isNull())
    counts |= {r: F.count_if(F.coalesce(reason == r, F.lit(False))) for r in REJECT_REASONS}
    seen = Observation()
    status = F.when(reason.isNull(), "valid").otherwise("rejected")
    rows = checked.observe(seen, *[c.alias(n) for n, c in counts.items()]).withColumn("status", status)
    # A task keeps a file open for each of the two folders, so its rows are not sorted by them; the rest of a task that reaches
    # the number of writers would be. The JVM compiles no method of more than 8000 bytes: reading a row would be one.
    conf, writers, method = checked.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.codegen.hugeMethodLimit"
    before = {name: conf.get(name) for name in (writers, method)}
    conf.set(writers, max(3, int(before[writers])))
    conf.set(method, min(8000, int(before[method])))
    try:
        rows.write.mode(mode).partitionBy("status").parquet(path)
    finally:
        for name, value in before.items():
            conf.set(name, value)
    return seen.get


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Valid staged rows with stripped lower-case column names."""
    df = spark.read.parquet(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if missing_columns(df, ["description"]):
        raise ValueError(f"no description among {df.columns}")
    return df.filter("status = 'valid'").drop("status", "reject_reason", "line")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("status = 'rejected'").select(
        "source_file", "line", "reject_reason", "ingest_seq")


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rows kept and rejected per file and reason."""
    return checked.groupBy("source_file", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")).count()


def write_categorized(categorized: DataFrame, path: str) -> None:
    """``path`` is that of one batch, so writing it again replaces an attempt that was cut short."""
    categorized.write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; an empty one when there is none yet."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    # A blank partition value is stored as none at all.
    return spark.read.schema(LEDGER).parquet(path).withColumn("month", or_blank(F.col("month")))


def append_ledger(spark: SparkSession, path: str, categorized: DataFrame, dates: DataFrame | None = None) -> None:
    """Add the rows a merge would add. Stored rows are neither rewritten nor, outside the months of
    the batch, read. ``dates``: see ``new_rows``.

    The hint sizes the output files and splits a month that holds very many rows.
    """
    added = new_rows(read_ledger(spark, path), to_ledger(categorized), dates=dates)
    (added.select(*LEDGER.fieldNames()).hint("rebalance", "month")
     .sortWithinPartitions("month", F.desc("date"))
     .write.mode("append").partitionBy("month").parquet(path))


def load_ledger(df: DataFrame) -> DataFrame:
    """A ledger of loose types made ready for analysis: dates or null, amounts or 0, month label."""
    fixed = {}
    if "date" in df.columns:
        fixed["date"] = F.col("date").try_cast("timestamp").cast("date")
    for name in ("paid_in", "paid_out"):
        if name in df.columns:
            fixed[name] = coerce_amount(F.col(name))
    df = df.withColumns(fixed)
    return df.withColumn("month", month_label(F.col("date"))) if "date" in df.columns else df


def _newest(spark: SparkSession, path: str) -> str | None:
    """The folder of the highest version that ``write_rules`` wrote under ``path``; None for a plain file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not files.getFileStatus(place).isDirectory():
        return None
    names = [f.getPath().getName() for f in files.listStatus(place)]
    versions = [int(n.removeprefix("version=")) for n in names if re.fullmatch(r"version=\d+", n)]
    return f"{path.rstrip('/')}/version={max(versions)}" if versions else None


def _items(spark: SparkSession, path: str) -> DataFrame | None:
    """(rule_ord, item) of a rule file: one JSON object per line, read in parallel, or one JSON array.

    None if there is no file; an error if the file holds neither, so that a broken file is not taken
    for one without rules.
    """
    if not table_exists(spark, path):
        return None
    lines = spark.read.text(path).filter(strip(F.col("value")) != "").select(
        F.try_parse_json("value").alias("item"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")), F.lit(False))
    counted = lines.agg(F.count("*").alias("n"), F.count_if(is_object).alias("objects")).first()
    if 0 < counted["n"] == counted["objects"]:
        return lines.select(F.monotonically_increasing_id().alias("rule_ord"), "item")
    whole = spark.read.text(path, wholetext=True).select(
        F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("items"))
    if whole.filter("items is not null").isEmpty():
        raise ValueError(f"{path} holds neither a JSON array nor JSON objects line by line")
    return whole.select(F.posexplode("items").alias("rule_ord", "item"))


def left_out(spark: SparkSession, path: str, read) -> int:
    """How many items of a rule file ``read`` (``read_merchants`` or ``read_patterns``) left out as invalid."""
    items = _items(spark, path)
    return 0 if items is None else items.count() - read(spark, path).count()


def _text(name: str, default: str | None = None) -> tuple[Column, Column]:
    """(value, is valid) of a text field; a field of another type makes the item invalid."""
    field = F.try_variant_get("item", f"$.{name}", "variant")
    value = F.try_variant_get("item", f"$.{name}", "string")
    is_text = F.schema_of_variant(field) == "STRING"
    if default is None:
        return value, field.isNotNull() & is_text
    return F.when(field.isNull(), F.lit(default)).otherwise(value), field.isNull() | is_text


def _any_text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("none"))


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """Merchant rules of a JSON file in file order, or of the newest snapshot under a folder.

    Invalid items of a file are left out one by one; ``left_out`` counts them.
    """
    newest = _newest(spark, path)
    if newest is not None:
        table = spark.read.parquet(newest)
        return as_merchants(table) if "alias" in table.columns else table
    items = _items(spark, path)
    if items is None:
        return spark.createDataFrame([], "rule_ord long, id string, name string, category string, "
                                         "subcategory string, type string, aliases array<string>")
    fields = {"id": _text("id"), "name": _text("name"), "category": _text("category"),
              "subcategory": _text("subcategory", ""), "type": _text("type", "operating")}
    aliases = F.try_variant_get("item", "$.aliases", "array<variant>")
    valid = F.try_variant_get("item", "$.aliases", "variant").isNotNull()
    for _, ok in fields.values():
        valid = valid & ok
    cleaned = F.filter(F.transform(aliases, lambda a: clean_key(_any_text(a))), lambda a: a != "")
    return items.filter(F.coalesce(valid, F.lit(False))).select(
        F.col("rule_ord").cast("long").alias("rule_ord"), *[v.alias(n) for n, (v, _) in fields.items()],
        F.coalesce(cleaned, F.array().cast("array<string>")).alias("aliases"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules of a JSON file in file order, or of the newest snapshot under a folder.

    Invalid items of a file are left out one by one; ``left_out`` counts them.
    """
    newest = _newest(spark, path)
    if newest is not None:
        return spark.read.parquet(newest)
    items = _items(spark, path)
    if items is None:
        return spark.createDataFrame([], "rule_ord long, pattern string, category string, "
                                         "subcategory string, type string, weight double")
    category, subcategory, kind = _text("category"), _text("subcategory", ""), _text("type", "operating")
    pattern = F.try_variant_get("item", "$.pattern", "variant")
    given = F.try_variant_get("item", "$.weight", "variant")
    number = F.try_variant_get("item", "$.weight", "string").try_cast("double")
    weight = F.when(given.isNull(), F.lit(1.0)).otherwise(number)
    valid = pattern.isNotNull() & category[1] & subcategory[1] & kind[1] & weight.isNotNull() & ~F.isnan(weight)
    return items.filter(F.coalesce(valid, F.lit(False))).select(
        F.col("rule_ord").cast("long").alias("rule_ord"), clean_key(_any_text(pattern)).alias("pattern"),
        category[0].alias("category"), subcategory[0].alias("subcategory"), kind[0].alias("type"),
        weight.alias("weight"))


def write_rules(rules: DataFrame, path: str, version: int) -> str:
    """A new version folder per change; earlier ones stay as they are and serve as the backup."""
    target = f"{path.rstrip('/')}/version={version}"
    rules.write.mode("errorifexists").parquet(target)
    return target


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


