"""Spending, income and coverage per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import month_label, or_blank
from tallyspark.schema import DEFAULT_TYPE, P2P_CATEGORY, require_columns

_NEEDED = ["date", "type", "category", "paid_out", "paid_in"]
_VIEW = ["date", "account", "account_id", "description", "category", "subcategory", "paid_out"]


def _month(df: DataFrame) -> Column:
    # A stored ledger carries the label as its partition column.
    return or_blank(F.col("month")) if "month" in df.columns else month_label(F.col("date"))


def _is_spend() -> Column:
    # Rows without a category count as spending, so the comparison must be null-safe.
    return ((F.col("type") == DEFAULT_TYPE) & ~F.col("category").eqNullSafe(P2P_CATEGORY)
            & (F.col("paid_out") > 0))


def _is_income() -> Column:
    return (F.col("type") == DEFAULT_TYPE) & (F.col("paid_in") > 0)


def operating_base(ledger: DataFrame, month: str | None = None, *,
                   drop_null_month: bool = False) -> DataFrame:
    """Operating spend rows with their month label."""
    df = require_columns(ledger, _NEEDED, on_missing="empty")
    out = df.filter(_is_spend()).withColumn("month_str", _month(df))
    if drop_null_month:
        out = out.filter(F.col("month_str") != "")
    return out if month is None else out.filter(F.col("month_str") == month)


def _dated(df: DataFrame, drop_null_month: bool) -> DataFrame:
    return df.filter(_month(df) != "") if drop_null_month else df


def operating_income(ledger: DataFrame, *, drop_null_month: bool = False) -> DataFrame:
    df = _dated(require_columns(ledger, _NEEDED, on_missing="empty"), drop_null_month)
    return df.filter(_is_income()).withColumn("month_str", _month(df))


def monthly_spend(ledger: DataFrame, *, drop_null_month: bool = False) -> DataFrame:
    base = operating_base(ledger, drop_null_month=drop_null_month)
    return base.groupBy("month_str").agg(F.sum("paid_out").alias("total_spend"))


def monthly_income(ledger: DataFrame, *, drop_null_month: bool = False) -> DataFrame:
    income = operating_income(ledger, drop_null_month=drop_null_month)
    return income.groupBy("month_str").agg(F.sum("paid_in").alias("total_income"))


def _month_category(ledger: DataFrame, drop_null_month: bool) -> DataFrame:
    """Spend and income per month and category: the one scan all month figures are derived from."""
    df = _dated(require_columns(ledger, _NEEDED, on_missing="empty"), drop_null_month)
    spend, income = _is_spend(), _is_income()
    return (df.filter(spend | income)
            .groupBy(_month(df).alias("month_str"), "category")
            .agg(F.sum(F.when(spend, F.col("paid_out"))).alias("spend"),
                 F.sum(F.when(income, F.col("paid_in"))).alias("income")))


def _month_table(ledger: DataFrame, drop_null_month: bool) -> DataFrame:
    """One row per month that has spending, with its income."""
    named = F.col("category").isNotNull() & F.col("spend").isNotNull()
    # Ties go to the first name; an aggregate over a month's categories, not over its rows.
    ranked = F.when(named, F.struct((-F.col("spend")).alias("s"), F.col("category").alias("c")))
    return (_month_category(ledger, drop_null_month).groupBy("month_str")
            .agg(F.sum("spend").alias("total_spend"),
                 F.coalesce(F.sum("income"), F.lit(0)).alias("total_income"),
                 F.min(ranked)["c"].alias("top_category"))
            .filter(F.col("total_spend").isNotNull()))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100.0).otherwise(0.0)


def operating_kpis(ledger: DataFrame, month: str | None = None, *, drop_null_month: bool = False) -> DataFrame:
    """Per month: spend, mean monthly spend over all months, share of income spent, top category,
    and the changes against the previous month that has spending.

    The windows run over the month table, whose size the calendar bounds.
    """
    by_month = Window.orderBy("month_str")
    everything = Window.partitionBy()
    t = _month_table(ledger, drop_null_month).withColumn("income_coverage", _percent(F.col("total_spend"), F.col("total_income")))
    prev_spend, prev_income = F.lag("total_spend").over(by_month), F.lag("total_income").over(by_month)
    t = t.withColumns({
        "avg_monthly_burn": F.sum("total_spend").over(everything).cast("double") / F.count("*").over(everything),
        "prev_month": F.lag("month_str").over(by_month),
        "prev_spend": prev_spend, "prev_income": prev_income,
        "prev_coverage": F.lag("income_coverage").over(by_month),
    })
    t = t.select(
        "month_str", "total_spend", "total_income", "avg_monthly_burn", "income_coverage",
        F.coalesce("top_category", F.lit("N/A")).alias("top_category"), "prev_month",
        F.when(F.col("prev_spend") > 0, F.col("total_spend") - F.col("prev_spend")).alias("spend_delta"),
        F.when(F.col("prev_spend") > 0,
               (F.col("total_spend") - F.col("prev_spend")).cast("double")
               / F.col("prev_spend").cast("double") * 100.0).alias("spend_delta_pct"),
        F.when(F.col("prev_income") > 0,
               F.col("income_coverage") - F.col("prev_coverage")).alias("coverage_delta_pp"),
    )
    return t if month is None else t.filter(F.col("month_str") == month)


def operating_summary(selection: DataFrame, ledger: DataFrame) -> DataFrame:
    """The KPI row of an arbitrary selection of spend rows; zeros and ``N/A`` when it is empty.

    Income counts only for the months found in the selection.
    """
    named = F.struct((-F.col("s")).alias("s"), F.col("category").alias("c"))
    per = selection.groupBy("month_str", "category").agg(F.sum("paid_out").alias("m"))
    by_category = per.groupBy("category").agg(F.sum("m").alias("s"))
    spend = by_category.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total_spend"),
                            F.min(F.when(F.col("category").isNotNull(), named))["c"].alias("top"))
    months = per.select("month_str").distinct()
    income = (monthly_income(ledger).join(months, "month_str", "left_semi")
              .agg(F.coalesce(F.sum("total_income"), F.lit(0)).alias("total_income")))
    burn = monthly_spend(ledger).agg(
        F.coalesce(F.sum("total_spend").cast("double") / F.count("*"), F.lit(0.0)).alias("avg_monthly_burn"))
    # Three rows with a figure or two each, brought into one without a join.
    rows = spend.unionByName(income, allowMissingColumns=True).unionByName(burn, allowMissingColumns=True)
    return (rows.agg(*[F.max(c).alias(c) for c in rows.columns])
            .select("total_spend", "avg_monthly_burn",
                    _percent(F.col("total_spend"), F.col("total_income")).alias("income_coverage"),
                    F.coalesce("top", F.lit("N/A")).alias("top_category")))


def spend_delta(ledger: DataFrame) -> DataFrame:
    return operating_kpis(ledger).select("month_str", "total_spend", "prev_month", "spend_delta", "spend_delta_pct")


def coverage_delta(ledger: DataFrame) -> DataFrame:
    return operating_kpis(ledger).select(
        "month_str", "total_spend", "total_income", "income_coverage", "coverage_delta_pp")


def monthly_trend(ledger: DataFrame, months_back: int = 6, *, drop_null_month: bool = False) -> DataFrame:
    """The newest ``months_back`` months with spending; the undated month ranks as the newest."""
    newest = monthly_spend(ledger, drop_null_month=drop_null_month).orderBy(
        F.desc(F.col("month_str") == ""), F.desc("month_str")).limit(months_back)
    return newest.orderBy(F.col("month_str") == "", "month_str")


def category_spend(ledger: DataFrame, month: str | None = None) -> DataFrame:
    return (operating_base(ledger, month).filter(F.col("category").isNotNull())
            .groupBy("category").agg(F.sum("paid_out").alias("total_spend"))
            .orderBy(F.desc("total_spend"), "category"))


def subcategory_spend(ledger: DataFrame, category: str | None = None, month: str | None = None,
                      max_slices: int = 8) -> DataFrame:
    """Subcategory totals per category. Beyond ``max_slices`` groups the smallest are summed as
    ``Other``, marked so that a subcategory of that name stays apart.

    All categories are handled at once unless one is named. Ranks run over the totals.
    """
    base = operating_base(ledger, month).filter(F.col("category").isNotNull())
    if category is not None:
        base = base.filter(F.col("category") == category)
    sub = F.coalesce(F.col("subcategory"), F.lit("Uncategorised"))
    totals = base.groupBy("category", sub.alias("subcategory")).agg(F.sum("paid_out").alias("total"))
    per_category = Window.partitionBy("category")
    rank = F.row_number().over(per_category.orderBy(F.desc("total"), "subcategory"))
    rest = (F.count("*").over(per_category) > max_slices) & (rank >= max_slices)
    return (totals.withColumn("is_other", rest)
            .groupBy("category", F.when(F.col("is_other"), F.lit("Other")).otherwise(F.col("subcategory"))
                     .alias("subcategory"), "is_other")
            .agg(F.sum("total").alias("total_spend")))


def operating_transactions(operating: DataFrame, category: str | None = None) -> DataFrame:
    """Spend rows newest first, reduced to the columns worth showing."""
    df = operating if category is None else operating.filter(F.col("category") == category)
    columns = [c for c in _VIEW if c in df.columns]
    if "date" in df.columns:
        ties = [c for c in ("description", "paid_out") if c in df.columns]
        df = df.orderBy(F.desc_nulls_last("date"), *ties)
    return df.select(*columns) if columns else df


def available_months(ledger: DataFrame) -> DataFrame:
    return operating_base(ledger).select("month_str").distinct().orderBy(F.desc("month_str"))


def available_categories(ledger: DataFrame) -> DataFrame:
    return (operating_base(ledger).select("category").filter(F.col("category").isNotNull())
            .distinct().orderBy("category"))
