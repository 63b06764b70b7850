"""Text and date expressions. Nothing here is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python counts as white space; Spark's own trim takes blanks only.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Stripped text, or null where nothing is left.

    Not written with nullif: its rewrite puts one more projection under an aggregate, which keeps
    the optimizer from dropping outer joins that the aggregate does not need.
    """
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def has_text(c: Column) -> Column:
    """Neither null nor the empty string; false, not null, for null."""
    return c.isNotNull() & (c != "")


def full_name(first: Column, last: Column) -> Column:
    """``first last``, one of them where the other is missing, '' where both are."""
    none = F.lit("")
    return strip(F.concat(F.coalesce(first, none), F.lit(" "), F.coalesce(last, none)))


def resolve_name(organization: Column, first: Column, last: Column) -> Column:
    """The organization, else the person's stripped name parts, else null."""
    person = full_name(strip(first), strip(last))
    return F.coalesce(blank_to_null(organization), F.nullif(person, F.lit("")))


def to_date(c: Column) -> Column:
    """A date, or null where the text is none (also under ANSI mode)."""
    return c.try_cast("date")


def to_int(c: Column) -> Column:
    """A whole number, or null where the text is none; "2.0" is 2, as a float column prints it."""
    return c.try_cast("double").try_cast("int")


def contains_ignoring_case(c: Column, term: str) -> Column:
    """Substring test; ``%`` and ``_`` in the term stand for themselves."""
    return F.lower(c).contains(F.lower(F.lit(term)))


def truncate(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def drop_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")
