"""Table shapes and the fixed values that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

INGEST_SEQ = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("line_idx", T.LongType()),
])

STAGED = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("paid_out", MONEY),
    T.StructField("paid_in", MONEY),
    T.StructField("source", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
])

CATEGORIZED = T.StructType(STAGED.fields + [
    T.StructField("type", T.StringType()),
    T.StructField("rule_match", T.StringType()),
    T.StructField("confidence", T.LongType()),
])

LEDGER = T.StructType(CATEGORIZED.fields + [
    T.StructField("ingest_seq", INGEST_SEQ),
    T.StructField("month", T.StringType()),
])

MERCHANTS = T.StructType([
    T.StructField("rule_ord", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
])

PATTERNS = T.StructType([
    T.StructField("rule_ord", T.LongType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

DECISIONS = T.StructType([
    T.StructField("anchor", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("type", T.StringType()),
])

# Defaults and markers a ledger row may carry.
UNCATEGORIZED = "Uncategorized"
P2P_CATEGORY = "P2P"
DEFAULT_TYPE = "operating"
FINANCING_TYPE = "financing"
NO_MATCH = "none"
DEDUPE_KEYS = ["date", "description", "paid_out", "paid_in", "source"]


def missing_columns(df: DataFrame, required) -> list[str]:
    """Names in ``required`` that ``df`` lacks; looks at the schema only."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required, on_missing: str = "error") -> DataFrame:
    """``df`` itself when complete, else an error or a zero-row frame with the missing columns added."""
    missing = missing_columns(df, required)
    if not missing:
        return df
    if on_missing == "empty":
        types = {f.name: f.dataType for f in LEDGER.fields}
        added = {c: F.lit(None).cast(types.get(c, T.StringType())) for c in missing}
        return df.withColumns(added).filter(F.lit(False))
    raise ValueError(f"missing columns {missing}; present: {df.columns}")


def empty_to_null(c: Column) -> Column:
    """A blank text counts as no value once it is in the ledger."""
    from tallyspark.functions.text import strip

    return F.when(strip(c) != "", c)
