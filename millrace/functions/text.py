"""Text columns: normal forms, phone numbers and ids.  White space and digits are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(c: Column) -> Column:
    """Trimmed, with one space for each run of white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_form(c: Column) -> Column:
    """Lower case without white space and without the four Thai tone marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", ""), "[่-๋]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def standard_phone(c: Column) -> Column:
    """0 and nine digits where the number can be read so, else the text as it was."""
    found = F.regexp_replace(digits(c), r"^66(\d{9})$", "0$1")
    return F.when(found.rlike(r"^0[0-9]{9}$"), found).otherwise(c)


def comparable_phone(c: Column) -> Column:
    """Digits alone, with 0 for the country code; only to compare numbers."""
    return F.regexp_replace(digits(c), "^66", "0")


def repaired_id(c: Column) -> Column:
    """A member id whose letter O stands for a zero."""
    return F.regexp_replace(c, r"^MO([0-9]{3})$", "M0$1")
