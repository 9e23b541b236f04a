"""Column expressions that bring loosely typed values to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what stands for "no value", compared in lower case
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "nan", "none", "null")

_INVISIBLE = r"\p{Cf}"
_OUTER = r"^[\p{Z}\s\p{Cc}]+|[\p{Z}\s\p{Cc}]+$"


def strip(c: Column) -> Column:
    """Drop invisible characters anywhere and every kind of space at the ends."""
    return F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), _OUTER, "")


def present(c: Column) -> Column:
    """The value as it stands, null where it is null, blank or a placeholder."""
    return F.when(~F.lower(strip(c)).isin(*PLACEHOLDERS), c)


def name(c: Column) -> Column:
    """A rank name in one spelling: stripped, first letter capital, the rest small; null where missing."""
    s = strip(present(c))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def whole_number(c: Column) -> Column:
    """An identifier as BIGINT however it was typed ('7', ' 7', '007', '7.0'); null where it is no whole number."""
    digits = F.regexp_extract(strip(c.cast("string")), r"^\+?0*([0-9]{1,18})(?:\.0*)?$", 1)
    return F.when(digits != "", digits).cast("bigint")
