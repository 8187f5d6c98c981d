"""Debt repayments against interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import month_label, or_blank
from tallyspark.schema import DEFAULT_TYPE, FINANCING_TYPE, require_columns

_NEEDED = ["date", "type", "subcategory", "paid_out"]


def _is_repayment() -> Column:
    return (F.col("type") == FINANCING_TYPE) & (F.col("paid_out") > 0)


def _is_interest() -> Column:
    return ((F.col("type") == DEFAULT_TYPE)
            & F.coalesce(F.contains(F.lower("subcategory"), F.lit("interest")), F.lit(False)))


def _with_month(ledger: DataFrame, drop_null_month: bool = False) -> DataFrame:
    df = require_columns(ledger, _NEEDED, on_missing="empty")
    label = or_blank(F.col("month")) if "month" in df.columns else month_label(F.col("date"))
    dated = df.withColumn("month_str", label)
    return dated.filter(F.col("month_str") != "") if drop_null_month else dated


def debt_repayments(ledger: DataFrame) -> DataFrame:
    return _with_month(ledger).filter(_is_repayment())


def debt_interest(ledger: DataFrame) -> DataFrame:
    return _with_month(ledger).filter(_is_interest())


def debt_timeline(ledger: DataFrame, *, drop_null_month: bool = False) -> DataFrame:
    """Payment and interest per month; a month with one side only has zero on the other.

    The two conditions exclude each other, so one conditional aggregate replaces the outer join of
    two monthly tables.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    return (_with_month(ledger, drop_null_month).filter(_is_repayment() | _is_interest())
            .groupBy("month_str")
            .agg(F.sum(F.when(_is_repayment(), F.col("paid_out")).otherwise(zero)).alias("payment"),
                 F.sum(F.when(_is_interest(), F.col("paid_out")).otherwise(zero)).alias("cost"))
            .orderBy("month_str"))


def debt_metrics(ledger: DataFrame) -> DataFrame:
    """Totals, share of the payments that reduced the debt, and number of months with activity."""
    totals = debt_timeline(ledger).agg(
        F.coalesce(F.sum("payment"), F.lit(0)).alias("total_repaid"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_interest"),
        F.count("*").alias("active_months"))
    repaid, interest = F.col("total_repaid"), F.col("total_interest")
    share = (repaid - interest).cast("double") / repaid.cast("double") * 100.0
    return totals.select(
        "total_repaid", "total_interest",
        F.when(repaid > 0, F.greatest(share, F.lit(0.0))).otherwise(0.0).alias("principal_ratio"),
        "active_months")
