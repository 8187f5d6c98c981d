"""Parsing of the date and amount texts found in statements.

No expression here can raise under ANSI mode. Dates of all shapes are first rewritten to
year-month-day order and then cast, as a chain in which each step uses the one before once: the
generated code stays small enough to be compiled, and no row pays for a formatter exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import strip
from tallyspark.schema import MONEY

# English month names and what may follow their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (r"(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
          r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z]))([a-z]{3})[a-z]*")

_TIME = r"[t ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]m)?(?:z|[+-]\d{2}:?\d{2})?$"
# Each shape with its rewriting to year-month-day; a text of another shape is left as it is.
_SHAPES = [
    (_TIME, ""),
    (r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$", "$3-$2-$1"),
    (r"^(\d{4})[/.]?(\d{2}|(?<=[/.])\d)[/.]?(\d{2}|(?<=[/.])\d)$", "$1-$2-$3"),
    (r"^(?:[a-z]{3,9},? +)?(\d{1,2})(?:st|nd|rd|th)?[ \-/.]*" + _MONTH + r"[ \-/.,]*(\d{4}|\d{2})$", "$3-$2-$1"),
    (r"^" + _MONTH + r"[ \-/.]*(\d{1,2})(?:st|nd|rd|th)?[ ,\-/.]+(\d{4}|\d{2})$", "$3-$1-$2"),
]
_YMD = r"^(\d{4}|\d{2})-(\d{1,2}|[a-z]{3})-(\d{1,2})$"


def _in_order(c: Column) -> Column:
    """``year-month-day`` with the month as number or three letters, as the one element of an array;
    an empty array for any other text."""
    text = F.lower(c)
    for shape, order in _SHAPES:
        text = F.regexp_replace(text, shape, order)
    return F.regexp_extract_all(text, F.lit(_YMD), F.lit(0))


def _to_date(parts: Column) -> Column:
    year, month, day = (F.get(parts, F.lit(n)) for n in range(3))
    number = year.cast("int")
    # Two-digit years fall within fifty years of today.
    near = F.when(number + 2000 >= F.year(F.current_date()) + 50, number + 1900).otherwise(number + 2000)
    full = F.when(F.length(year) == 4, year).otherwise(near.cast("string"))
    named = F.floor((F.instr(F.lit(MONTHS), month) + 2) / 3).cast("string")
    in_letters = F.length(month) == 3
    day_first = F.concat_ws("-", full, F.when(in_letters, named).otherwise(month), day).try_cast("date")
    month_first = F.when(~in_letters, F.concat_ws("-", full, day, month).try_cast("date"))
    return F.coalesce(day_first, month_first)


def parse_date(c: Column) -> Column:
    """Day-first date; month-first only where day-first is impossible; null when unparseable.

    The two usual shapes with ten characters, and that with the month in three letters, are cut by position; others that hold
    a digit go by pattern.
    """
    text = strip(c.cast("string"))

    def piece(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    def date(*parts: Column) -> Column:
        return F.concat_ws("-", *parts).try_cast("date")

    ten = F.length(text) == 10
    digits = F.translate(text, "0123456789", "")
    first, second, year = piece(1, 2), piece(4, 2), piece(7, 4)
    usual = F.coalesce(date(year, second, first), date(year, first, second))
    iso = F.coalesce(text.try_cast("date"), date(piece(1, 4), piece(9, 2), piece(6, 2)))
    letters = F.instr(F.lit(MONTHS), F.lower(piece(4, 3)))
    lettered = ((F.length(text) == 11) & (piece(3, 1) == " ") & (piece(7, 1) == " ") & (letters % 3 == 1)
                & (digits == F.concat(F.lit(" "), piece(4, 3), F.lit(" "))))
    parts = F.transform(_in_order(text), lambda t: F.split(t, "-"))
    other = F.get(F.transform(parts, _to_date), F.lit(0))
    return (F.when(ten & (piece(3, 1) == "/") & (digits == "//"), usual)
            .when(ten & (piece(5, 1) == "-") & (digits == "--"), iso)
            .when(lettered, date(piece(8, 4), F.floor((letters + 2) / 3).cast("string"), piece(1, 2)))
            .when(digits != text, other))


def amount_digits(c: Column) -> Column:
    """Digits, dots and dashes of an amount text; null without any, which also spares the parser."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"[^0-9.\-]+", ""), F.lit(""))


def signed_amount(c: Column) -> Column:
    """Signed amount of a text or number; blank gives 0, text without a readable number gives null."""
    blank = c.isNull() | (strip(c.cast("string")) == "")
    return F.when(blank, F.lit(0).cast(MONEY)).otherwise(amount_digits(c).try_cast(MONEY))


def unsigned_amount(digits: Column, amount: Column) -> Column:
    """``amount`` without its sign; 0 where ``digits`` form no number, null where they form one too large to hold."""
    unreadable = F.abs(digits.try_cast("double")).isNull()
    return F.coalesce(F.abs(amount), F.when(unreadable, F.lit(0).cast(MONEY)))


def clean_currency(c: Column) -> Column:
    """Unsigned amount; what cannot be read counts as 0 and the row stays, a number too large to hold is null."""
    digits = amount_digits(c)
    return unsigned_amount(digits, digits.try_cast(MONEY))


def currency_warning(c: Column) -> Column:
    """True where digits, dots or dashes were present but did not form a number."""
    digits = amount_digits(c)
    return digits.isNotNull() & digits.try_cast(MONEY).isNull()


def coerce_amount(c: Column) -> Column:
    """Numeric coercion used when a stored ledger is loaded: bad or missing becomes 0."""
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))
