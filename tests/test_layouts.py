import pytest
from pyspark.sql import functions as F

from tallyspark.operators import layouts


def _rows(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def _staged(df):
    return [(str(r.date), r.description, str(r.paid_out), str(r.paid_in), r.source, r.account_type, r.currency_warning)
            for r in df.collect()]


def test_aqua(spark):
    df = _rows(spark, ["Date", "Description", "Note", "Amount(GBP)"], [
        ("03/04/2024", " Shop ", "late", "12.50"), ("03/04/2024", None, "n", "-5"), ("03/04/2024", None, None, None),
        ("03/04/2024", "a", "", "--5")])
    assert _staged(layouts.normalize_aqua(df)) == [
        ("2024-04-03", "Shop  late", "12.50", "0.00", "Aqua", "Credit", False),
        ("2024-04-03", "n", "0.00", "5.00", "Aqua", "Credit", False),
        ("2024-04-03", "", "0.00", "0.00", "Aqua", "Credit", False),
        ("2024-04-03", "a", "None", "None", "Aqua", "Credit", True)]


def test_natwest(spark):
    df = _rows(spark, ["Date", "Type", "Description", "Value", "Account Name", "Account Number"], [
        ("3 Apr 2024", " CASH", "\tATM ", "10", "x", "1"), ("3 Apr 2024", "cash", "ATM", "-10.1", "x", "1"),
        ("3 Apr 2024", None, None, "1", "x", "1")])
    assert _staged(layouts.normalize_natwest(df)) == [
        ("2024-04-03", "CASH: ATM", "10.00", "0.00", "Natwest", "Credit", False),
        ("2024-04-03", "ATM", "0.00", "10.10", "Natwest", "Credit", False),
        ("2024-04-03", "", "1.00", "0.00", "Natwest", "Credit", False)]


def test_nationwide(spark):
    df = _rows(spark, ["Date", "Transaction type", "Description", "Paid out", "Paid in"], [
        ("03 Apr 2024", "ATM Withdrawal LINK", "High St", "£1,234.56", None), ("03 Apr 2024", "Visa", "x", None, "(2)"),
        ("03 Apr 2024", "Visa", "x", "1-", "-")])
    assert _staged(layouts.normalize_nationwide(df)) == [
        ("2024-04-03", "ATM Withdrawal LINK: High St", "1234.56", "0.00", "Nationwide", "Debit", False),
        ("2024-04-03", "x", "0.00", "2.00", "Nationwide", "Debit", False),
        ("2024-04-03", "x", "0.00", "0.00", "Nationwide", "Debit", True)]


def test_a_layout_needs_its_columns(spark):
    with pytest.raises(ValueError, match="Note"):
        layouts.normalize_aqua(_rows(spark, ["Date", "Amount(GBP)"], [("a", "1")]))


def test_layout_is_recognised_in_order(spark):
    def layout(*header):
        return spark.range(1).select(layouts.identify_layout(F.array(*[F.lit(h) for h in header]))).first()[0]

    everything = sum(layouts.LAYOUTS.values(), [])
    assert layout(*everything) == "Aqua"
    assert layout(*[c for c in everything if c != "Note"]) == "Natwest"
    assert layout("Paid in", "Paid out", "Transaction type", "more") == "Nationwide"
    assert layout("Date", "Value") is None


def test_rows_are_split_by_reason(spark):
    df = _rows(spark, ["layout", "Date", "Description", "Note", "Amount(GBP)"], [
        ("Aqua", "03/04/2024", "ok", None, "1"), ("Aqua", "31/02/2024", "x", None, "1"),
        ("Aqua", "03/04/2024", "x", None, "1-"), (None, "03/04/2024", "x", None, "1")])
    valid, rejects = layouts.validate_rows(layouts.standardize(df))
    assert [r.description for r in valid.collect()] == ["ok"]
    assert [r.reject_reason for r in rejects.collect()] == ["bad_date", "bad_amount", "unknown_layout"]
