"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim all leading and trailing ASCII white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_missing(col: Column) -> Column:
    """Null or blank."""
    return col.isNull() | (strip(col) == "")


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [col.contains(w) for w in words])


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def excerpt(col: Column, size: int) -> Column:
    """One line of at most ``size`` characters, ending in '...' when cut."""
    flat = strip(F.translate(F.coalesce(col, F.lit("")), "\n", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, size - 3), F.lit(WHITESPACE)),
                   F.lit("..."))
    return F.when(F.length(flat) > size, cut).otherwise(flat)


def clean_for_vectors(col: Column) -> Column:
    """NUL becomes a blank, then trim; blank results are to be dropped."""
    return strip(F.translate(F.coalesce(col, F.lit("")), "\x00", " "))


def html_lines(col: Column) -> Column:
    return F.replace(col, F.lit("\n"), F.lit("<br>"))


def metric_label(name: Column) -> Column:
    """reg_with_deadline -> With deadline."""
    words = F.trim(F.translate(F.regexp_replace(name, "(?i)^reg_", ""), "_", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2))))


def number_text(col: Column) -> Column:
    """A double as plain digits with at least one decimal (60000.0, 9999.99)."""
    digits = F.rtrim(F.round(col, 4).cast("decimal(38,4)").cast("string"), F.lit("0"))
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def plain_number(col: Column) -> Column:
    """A whole number without decimals, any other number with those it has (0.75)."""
    value = col.cast("double")
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")) \
        .otherwise(number_text(value))


def title_case(col: Column) -> Column:
    return F.initcap(F.lower(col))


def joined_or_default(items: Column, default: str) -> Column:
    """Comma-joined list without outer blanks and quotes, or ``default`` when empty."""
    joined = F.btrim(strip(F.array_join(items, ", ")), F.lit("'\""))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))
