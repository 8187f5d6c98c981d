import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import debt, operating, p2p

D = datetime.date
SCHEMA = "date date, description string, category string, subcategory string, type string, paid_out double, paid_in double"


def _ledger(spark, rows):
    df = spark.createDataFrame([(d, "x", c, s, t, float(o), float(i)) for d, c, s, t, o, i in rows], SCHEMA)
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("paid_out", "paid_in")})


@pytest.fixture(scope="module")
def ledger(spark):
    jan, feb, apr = D(2024, 1, 5), D(2024, 2, 5), D(2024, 4, 5)
    return _ledger(spark, [
        (jan, "Food", "a", "operating", 10, 0), (jan, None, None, "operating", 30, 0), (jan, "Bills", None, "operating", 10, 0),
        (jan, "P2P", "Al", "operating", 99, 0), (jan, "Food", "a", "transfer", 99, 0),
        (feb, "Food", None, "operating", 20, 0), (feb, "P2P", "Al", "operating", 0, 40), (jan, "Pay", None, "operating", 0, 100),
        (apr, "Food", " b ", "operating", 60, 0), (None, "Food", "b", "operating", 5, 0), (D(2024, 3, 1), "Pay", None, "operating", 0, 7),
    ])


def test_kpis(ledger):
    rows = {r.month_str: r for r in operating.operating_kpis(ledger).collect()}
    assert sorted(rows) == ["", "2024-01", "2024-02", "2024-04"]  # a month with income only is not shown
    jan, feb, apr = rows["2024-01"], rows["2024-02"], rows["2024-04"]
    assert jan.total_spend == 50                    # rows without a category count, P2P does not
    assert jan.top_category == "Bills"              # but cannot be the top; the tie goes by name
    assert jan.income_coverage == 50 and feb.income_coverage == 50  # P2P income counts
    assert apr.income_coverage == 0
    assert jan.avg_monthly_burn == 135 / 4          # the undated month counts
    assert (jan.prev_month, feb.prev_month, apr.prev_month) == ("", "2024-01", "2024-02")  # previous present month
    assert feb.spend_delta == -30 and feb.spend_delta_pct == -60
    assert jan.coverage_delta_pp is None            # nothing came in before
    assert feb.coverage_delta_pp == 0 and apr.coverage_delta_pp == -50
    assert rows[""].prev_month is None and rows[""].spend_delta is None
    assert operating.operating_kpis(ledger, "2024-02").count() == 1


def test_only_nameless_categories(spark):
    df = _ledger(spark, [(D(2024, 1, 1), None, None, "operating", 3, 0)])
    assert operating.operating_kpis(df).first().top_category == "N/A"


def test_summary_of_a_selection(ledger):
    base = operating.operating_base(ledger)
    r = operating.operating_summary(base.filter("month_str in ('2024-01','2024-02')"), ledger).first()
    assert (r.total_spend, r.top_category, r.income_coverage) == (70, "Food", 50.0)
    r = operating.operating_summary(base.filter("false"), ledger).first()
    assert (r.total_spend, r.avg_monthly_burn, r.income_coverage, r.top_category) == (0, 135 / 4, 0.0, "N/A")


def test_months_and_categories(ledger):
    assert [r[0] for r in operating.available_months(ledger).collect()] == ["2024-04", "2024-02", "2024-01", ""]
    assert [r[0] for r in operating.available_categories(ledger).collect()] == ["Bills", "Food"]
    assert [tuple(r) for r in operating.monthly_trend(ledger, 2).collect()] == [("2024-04", 60), ("", 5)]
    assert operating.operating_base(ledger, drop_null_month=True).filter("month_str = ''").count() == 0
    assert {r.month_str: r.total_income for r in operating.monthly_income(ledger).collect()} == {
        "2024-01": 100, "2024-02": 40, "2024-03": 7}
    assert [tuple(r) for r in operating.category_spend(ledger).collect()] == [("Food", 95), ("Bills", 10)]


@pytest.mark.parametrize("groups,others", [(8, 0), (9, 1), (12, 1)])
def test_small_subcategories_become_other(spark, groups, others):
    rows = [(D(2024, 1, 1), "C", f"s{i:02d}" if i else "Other", "operating", 100 - i, 0) for i in range(groups)]
    out = operating.subcategory_spend(_ledger(spark, rows), "C").collect()
    assert len(out) == min(groups, 8)
    assert sum(r.is_other for r in out) == others
    assert sum(r.total_spend for r in out) == sum(100 - i for i in range(groups))
    assert [r.is_other for r in out if r.subcategory == "Other" and r.total_spend == 100] == [False]


def test_nameless_subcategory(spark):
    rows = [(D(2024, 1, 1), "C", None, "operating", 4, 0)]
    assert operating.subcategory_spend(_ledger(spark, rows)).first().subcategory == "Uncategorised"


def test_transactions(ledger):
    out = operating.operating_transactions(operating.operating_base(ledger), "Food")
    assert out.columns == ["date", "description", "category", "subcategory", "paid_out"]
    assert [r.date for r in out.collect()] == [D(2024, 4, 5), D(2024, 2, 5), D(2024, 1, 5), None]
    odd = ledger.select(F.col("type").alias("q"))
    assert operating.operating_transactions(odd).columns == ["q"]


def test_missing_columns_give_empty_results(spark):
    df = spark.range(3)
    assert operating.operating_base(df).count() == 0
    assert p2p.p2p_summary(df).first() == (Decimal(0), Decimal(0), 0)
    assert debt.debt_metrics(df).first() == (Decimal(0), Decimal(0), 0.0, 0)


def test_debt(spark):
    m1, m2 = D(2024, 1, 1), D(2024, 2, 1)
    df = _ledger(spark, [
        (m1, "Debt", "Card", "financing", 100, 0), (m2, "Bills", "Card INTEREST", "operating", 25, 0),
        (m2, "Bills", None, "operating", 50, 0), (None, "Debt", None, "financing", 100, 0),
        (m1, "Debt", "interest", "financing", 0, 9), (D(2024, 5, 1), "Any", "interest back", "operating", 0, 3)])
    r = debt.debt_metrics(df).first()
    assert (r.total_repaid, r.total_interest, r.principal_ratio, r.active_months) == (200, 25, 87.5, 4)
    assert [tuple(r) for r in debt.debt_timeline(df).collect()] == [
        ("", 100, 0), ("2024-01", 100, 0), ("2024-02", 0, 25), ("2024-05", 0, 0)]
    only = debt.debt_metrics(df.filter("type = 'operating'")).first()
    assert (only.total_repaid, only.principal_ratio) == (0, 0.0)
    worse = _ledger(spark, [(m1, "Debt", None, "financing", 1, 0), (m1, "B", "interest", "operating", 5, 0)])
    assert debt.debt_metrics(worse).first().principal_ratio == 0.0


def test_p2p(spark):
    day = D(2024, 1, 1)
    df = _ledger(spark, [
        (day, "P2P", " Alex ", "transfer", 10, 0), (day, "P2P", "Alex", "operating", 5, 4), (day, "P2P", None, "transfer", 1, 3),
        (day, "Food", "Alex", "transfer", 50, 0)])
    assert [tuple(r) for r in p2p.p2p_balances(df).collect()] == [("Alex", 15, 4, -11), ("Unknown", 1, 3, 2)]
    assert p2p.p2p_summary(df).first() == (-9, 23, 2)
