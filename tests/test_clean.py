import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import clean
from tallyspark.functions.text import WHITESPACE, date_text, month_label, rule_id, strip

DATES = {
    "03/04/2024": "2024-04-03", "04/13/2024": "2024-04-13", "3 Apr 2024": "2024-04-03", "03-Apr-24": "2024-04-03",
    "03.04.2024": "2024-04-03", "20240403": "2024-04-03", "2024-04-03": "2024-04-03", "31/02/2024": None,
    "45000": None, "nan": None, "": None, None: None, "not a date": None, "3/4/24": "2024-04-03",
    "3-4-2024": "2024-04-03", "Apr 3, 2024": "2024-04-03", "3 Sept 2024": "2024-09-03", "3 Mayhem 2024": None,
    "3 April 2024": "2024-04-03", "03/04/2024 10:30": "2024-04-03", "2024-04-03T10:00:00Z": "2024-04-03",
    "2024/04/03": "2024-04-03", "2024/13/04": "2024-04-13", " 03/04/2024\t": "2024-04-03",
    "Wed 3 Apr 2024": "2024-04-03", "3rd April 2024": "2024-04-03", "03042024": None, "ab/cd/efgh": None,
    "29/02/2024": "2024-02-29", "29/02/2023": None,
}

# text -> (amount, warning, signed amount)
AMOUNTS = {
    "£1,234.56": ("1234.56", False, "1234.56"), "(12.50)": ("12.50", False, "12.50"),
    "-5.00": ("5.00", False, "-5.00"), "12 CR": ("12.00", False, "12.00"), None: ("0.00", False, "0.00"),
    " ": ("0.00", False, "0.00"), "£": ("0.00", False, None), "--5": ("0.00", True, None),
    "5.00-": ("0.00", True, None), "1.234,56": ("1.23", False, "1.23"), "1.005": ("1.01", False, "1.01"),
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "v string").select("v", clean.parse_date(F.col("v")).alias("d"))
    got = {r.v: r.d and r.d.isoformat() for r in df.collect()}
    assert got == DATES


def test_dates_cut_by_position_equal_those_by_pattern(spark):
    """The month in three letters: by position if there are two digits for the day and four for the year."""
    dates = {"03 Apr 2024": "2024-04-03", "03 APR 2024": "2024-04-03", "31 Feb 2024": None, "29 Feb 2024": "2024-02-29",
             "31 Dec 0099": "0099-12-31", "03 anf 2024": None, "0a Apr 2024": None, "03 Apr 20x4": None, "03 Apr  024": None,
             "03/Apr/2024": "2024-04-03", "03  Ap 2024": None, "3 June 2024": "2024-06-03", "00 Apr 2024": None, "٣ Apr 2024x": None}
    df = spark.createDataFrame([(k,) for k in dates], "v string").select("v", clean.parse_date(F.col("v")).alias("d"))
    assert {r.v: r.d and r.d.isoformat() for r in df.collect()} == dates


def test_typed_dates_pass_through(spark):
    df = spark.range(1).select(F.lit(datetime.date(2024, 4, 3)).alias("a"),
                               F.lit(datetime.datetime(2024, 4, 3, 9)).cast("timestamp").alias("b"))
    assert df.select(clean.parse_date(F.col("a")), clean.parse_date(F.col("b"))).first() == (
        datetime.date(2024, 4, 3), datetime.date(2024, 4, 3))


def test_two_digit_years_stay_near_today(spark):
    now = datetime.date.today().year
    ahead, behind = (now + 49) % 100, (now + 50) % 100
    df = spark.createDataFrame([(f"01/01/{ahead:02d}",), (f"01/01/{behind:02d}",)], "v string")
    got = [r[0].year for r in df.select(clean.parse_date(F.col("v"))).collect()]
    assert got == [2000 + ahead, 1900 + behind]


def test_amounts(spark):
    df = spark.createDataFrame([(k,) for k in AMOUNTS], "v string")
    v = F.col("v")
    rows = df.select(v, clean.clean_currency(v), clean.currency_warning(v), clean.signed_amount(v)).collect()
    got = {r[0]: (str(r[1]), r[2], None if r[3] is None else str(r[3])) for r in rows}
    assert got == AMOUNTS


@pytest.mark.parametrize("value,expected", [("12.345", "12.35"), ("x", "0.00"), (None, "0.00")])
def test_coerce_amount(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert str(df.select(clean.coerce_amount(F.col("v"))).first()[0]) == expected


def test_text(spark):
    df = spark.createDataFrame([("\t a b  ", "Joe's  Cafe!")], "a string, b string")
    assert df.select(strip(F.col("a")), rule_id(F.col("b"))).first() == ("a b", "joe_s_cafe")
    assert all(c.isspace() for c in WHITESPACE)
    assert len(WHITESPACE) == sum(chr(i).isspace() for i in range(0x110000))


def test_labels_of_dates(spark):
    df = spark.createDataFrame([(datetime.date(2024, 4, 3),), (None,)], "d date")
    rows = df.select(month_label(F.col("d")), date_text(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [("2024-04", "2024-04-03"), ("", "")]


def test_amounts_too_large_to_hold_are_not_zero(spark):
    from tallyspark.operators.layouts import normalize_nationwide, with_reject_reason

    df = spark.createDataFrame([("99999999999999999999", "x", None), ("1.2.3", "y", None), ("£9,999", "z", "1" * 17)],
                               "`Paid out` string, Description string, `Paid in` string").selectExpr(
        "'01/02/2024' AS Date", "'POS' AS `Transaction type`", "*")
    got = {r.description: (r.paid_out, r.reject_reason) for r in with_reject_reason(normalize_nationwide(df)).collect()}
    assert got["x"] == (None, "bad_amount") and got["y"] == (0, None) and got["z"][1] == "bad_amount"
    amounts = df.select(clean.clean_currency(F.col("Paid out")).alias("a"), clean.currency_warning(F.col("Paid out")).alias("w"))
    assert [(r.a, r.w) for r in amounts.collect()] == [(None, True), (0, True), (9999, False)]
