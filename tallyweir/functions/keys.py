"""Identifiers written in several notations, brought to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces that may precede a tag and a unit.
TAG_NAMESPACES = ("us-gaap", "ifrs-full", "dei")
UNIT_NAMESPACES = ("iso4217",)


#: The white space that is trimmed.
_BLANKS = " \t\n\x0b\f\r"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bare(col: Column) -> Column:
    """Without surrounding blanks."""
    return F.btrim(col, F.lit(_BLANKS))


def cik_number(cik: Column | str) -> Column:
    """The number in a filer key without leading zeros ('CIK0000012' -> '12').

    NULL where no digit is written; a key of only zeros is '0'. Kept as text so
    that no length overflows.
    """
    digits = F.regexp_extract(_column(cik), r"(\d+)", 1)
    number = F.ltrim(digits, F.lit("0"))
    return F.when(digits != "", F.when(number == "", F.lit("0")).otherwise(number))


def accession_digits(accession: Column | str) -> Column:
    """The digits of an accession; NULL where there is none."""
    digits = F.regexp_replace(_column(accession), r"[^0-9]", "")
    return F.when(digits != "", digits)


def accession_18(accession: Column | str) -> Column:
    """18 digits of an accession written plain or as 10-2-6; otherwise NULL.

    All zeros is a placeholder, not an accession.
    """
    bare = F.translate(_bare(_column(accession)), "-", "")
    return F.when(bare.rlike(r"^\d{18}$") & (bare != "0" * 18), bare)


def _plain(col: Column, namespaces: tuple[str, ...], marks: str) -> Column:
    return F.regexp_replace(F.lower(_bare(col)), rf"^(?:{'|'.join(namespaces)})[{marks}]", "")


def tag_key(tag: Column | str) -> Column:
    """A concept name without case, blanks and namespace."""
    return _plain(_column(tag), TAG_NAMESPACES, ":_")


def unit_key(unit: Column | str) -> Column:
    """A unit without case, blanks and namespace."""
    return _plain(_column(unit), UNIT_NAMESPACES, ":")


def context_key(context: Column | str) -> Column:
    """A reporting context without case and blanks."""
    return F.lower(_bare(_column(context)))
