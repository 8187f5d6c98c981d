"""Balances with the people money is lent to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import strip
from tallyspark.schema import P2P_CATEGORY, require_columns

_NEEDED = ["category", "subcategory", "paid_in", "paid_out"]


def p2p_balances(ledger: DataFrame) -> DataFrame:
    """Lent, repaid and net per friend, who owes most first."""
    df = require_columns(ledger, _NEEDED, on_missing="empty")
    friend = strip(F.coalesce(F.col("subcategory"), F.lit("Unknown")))
    return (df.filter(F.col("category") == P2P_CATEGORY)
            .groupBy(friend.alias("name"))
            .agg(F.sum("paid_out").alias("total_lent"), F.sum("paid_in").alias("total_repaid"))
            .withColumn("net_balance", F.col("total_repaid") - F.col("total_lent"))
            .orderBy("net_balance", "name"))


def p2p_summary(ledger: DataFrame) -> DataFrame:
    return p2p_balances(ledger).agg(
        F.coalesce(F.sum("net_balance"), F.lit(0)).alias("total_outstanding"),
        F.coalesce(F.sum(F.col("total_lent") + F.col("total_repaid")), F.lit(0)).alias("lending_volume"),
        F.count("*").alias("entities"))
