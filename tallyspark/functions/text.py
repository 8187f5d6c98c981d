"""Text expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters that stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_key(c: Column) -> Column:
    """Stripped lower-case form under which descriptions are matched."""
    return F.lower(strip(c))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def rule_id(name: Column) -> Column:
    """Identifier derived from a rule name, e.g. ``Joe's Cafe`` -> ``joe_s_cafe``."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_"), F.lit("_"))


def date_text(c: Column) -> Column:
    """ISO text of a date, blank for null."""
    return or_blank(c.cast("date").cast("string"))


def month_label(c: Column) -> Column:
    """``yyyy-MM`` of a date, blank for null (so undated rows form a month of their own)."""
    return or_blank(F.substring(c.cast("date").cast("string"), 1, 7))
