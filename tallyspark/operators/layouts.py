"""The bank layouts: how they are recognised and how their rows become staged transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.clean import amount_digits, parse_date, unsigned_amount
from tallyspark.functions.text import or_blank, strip
from tallyspark.schema import MONEY, UNCATEGORIZED, missing_columns

# Columns by which a layout is recognised, in the order in which they are tried.
LAYOUTS = {
    "Aqua": ["Amount(GBP)", "Note"],
    "Natwest": ["Value", "Account Name", "Account Number"],
    "Nationwide": ["Transaction type", "Paid out", "Paid in"],
}
ACCOUNT_TYPES = {"Aqua": "Credit", "Natwest": "Credit", "Nationwide": "Debit"}
# Transaction types that are put before the description.
NATWEST_PREFIXED = ["CASH"]
NATIONWIDE_PREFIXED = [
    "Foreign currency transaction fee",
    "ATM Withdrawal LINK",
    "ATM Withdrawal LLOYDS",
    "ATM Withdrawal",
    "ATM Withdrawal NOTEMACHINE LTD",
]
# Every column some layout reads.
CELLS = ["Date", "Description", "Note", "Amount(GBP)", "Type", "Value",
         "Transaction type", "Paid out", "Paid in"]


def identify_layout(header: Column) -> Column:
    """Name of the first layout whose columns all occur in the array ``header``, else null."""
    def fits(names: list[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), header)) == 0

    first, *others = LAYOUTS.items()
    return reduce(lambda case, item: case.when(fits(item[1]), item[0]), others, F.when(fits(first[1]), first[0]))


def _cell(name: str) -> Column:
    return F.col(f"`{name}`")


def _is(*layouts: str) -> Column:
    return F.col("layout").isin(*layouts)


def _label_and_text(df: DataFrame) -> DataFrame:
    """``_label``: the transaction type where it belongs before the description; ``_text``: the rest."""
    kind = strip(F.when(_is("Natwest"), _cell("Type")).when(_is("Nationwide"), _cell("Transaction type")))
    prefixed = (_is("Natwest") & kind.isin(*NATWEST_PREFIXED)) | (_is("Nationwide") & kind.isin(*NATIONWIDE_PREFIXED))
    note = F.when(_is("Aqua"), F.concat(F.lit(" "), or_blank(_cell("Note")))).otherwise("")
    return df.withColumns({
        "_label": F.when(prefixed, F.concat(kind, F.lit(": "))).otherwise(""),
        "_text": strip(F.concat(or_blank(_cell("Description")), note)),
    })


def _numbers(df: DataFrame) -> DataFrame:
    """The amount cells of whichever layout as numbers: ``_out`` (or the signed amount) and ``_in``."""
    first = (F.when(_is("Aqua"), _cell("Amount(GBP)")).when(_is("Natwest"), _cell("Value"))
             .when(_is("Nationwide"), _cell("Paid out")))
    second = F.when(_is("Nationwide"), _cell("Paid in"))
    df = df.withColumns({"_blank": or_blank(strip(first)) == "",
                         "_out_digits": amount_digits(first), "_in_digits": amount_digits(second)})
    df = df.withColumns({"_out": F.col("_out_digits").try_cast(MONEY), "_in": F.col("_in_digits").try_cast(MONEY)})
    return df.withColumn("_warning", (F.col("_out_digits").isNotNull() & F.col("_out").isNull())
                         | (F.col("_in_digits").isNotNull() & F.col("_in").isNull()))


def standardize(raw: DataFrame) -> DataFrame:
    """Rows of all layouts at once, told apart by the column ``layout``.

    Positive signed amounts are spent, negative ones come back; an unreadable signed amount leaves
    both sides null, an unreadable unsigned one counts as 0, one too large to hold is null. Each cell is parsed once, whatever its
    layout. Columns that no layout reads are carried along.
    """
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in missing_columns(raw, CELLS)})
    raw = raw.withColumn("_date", parse_date(_cell("Date")))
    df = _numbers(_label_and_text(raw))
    zero = F.lit(0).cast(MONEY)
    signed = F.when(F.col("_blank"), zero).otherwise(F.col("_out"))
    unsigned = _is("Nationwide")
    known = F.col("layout").isNotNull()
    out = F.when(unsigned, unsigned_amount(F.col("_out_digits"), F.col("_out"))).when(signed.isNotNull(), F.greatest(signed, zero))
    into = F.when(unsigned, unsigned_amount(F.col("_in_digits"), F.col("_in"))).when(signed.isNotNull(), F.greatest(-signed, zero))
    account = F.when(_is(*[n for n, t in ACCOUNT_TYPES.items() if t == "Credit"]), "Credit").when(known, "Debit")
    staged = {
        "date": F.col("_date"), "description": F.when(known, F.concat("_label", "_text")),
        "paid_out": F.when(known, out).cast(MONEY), "paid_in": F.when(known, into).cast(MONEY),
        "source": F.col("layout"), "account_type": account, "category": F.lit(UNCATEGORIZED),
        "subcategory": F.lit(""), "currency_warning": F.when(known, F.col("_warning")),
    }
    read = {*CELLS, *sum(LAYOUTS.values(), []), "layout", *staged}
    return df.select(*[v.alias(n) for n, v in staged.items()],
                     *[_cell(c) for c in raw.columns if c not in read and c != "_date"])


def _normalize(df: DataFrame, layout: str) -> DataFrame:
    lacking = missing_columns(df, LAYOUTS[layout])
    if lacking:
        raise ValueError(f"not a {layout} statement, missing {lacking}")
    return standardize(df.withColumn("layout", F.lit(layout)))


def normalize_aqua(df: DataFrame) -> DataFrame:
    return _normalize(df, "Aqua")


def normalize_natwest(df: DataFrame) -> DataFrame:
    return _normalize(df, "Natwest")


def normalize_nationwide(df: DataFrame) -> DataFrame:
    return _normalize(df, "Nationwide")


def validate_rows(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``)."""
    checked = with_reject_reason(staged)
    return (checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.filter(F.col("reject_reason").isNotNull()))


def with_reject_reason(staged: DataFrame) -> DataFrame:
    reason = (F.when(F.col("source").isNull(), "unknown_layout")
              .when(F.col("date").isNull(), "bad_date")
              .when(F.col("paid_out").isNull() | F.col("paid_in").isNull(), "bad_amount")
              .when(F.col("description").isNull(), "no_description"))
    if "reject_reason" in staged.columns:
        reason = F.coalesce("reject_reason", reason)
    return staged.withColumn("reject_reason", reason)
