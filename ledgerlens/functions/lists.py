"""Lenient parsing of list columns that went through a text format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlens.functions.text import strip

STRINGS = "array<string>"


def parse_list(col: Column, *, split_commas: bool = True, strip_quotes: bool = False) -> Column:
    """Parse ``['a', 'b']``, ``["a"]``, ``a, b`` or ``a`` into a list of labels.

    A bracketed value is read as JSON with single quotes tolerated.  When that
    fails (an apostrophe inside an item, say) the text is split on commas, or
    kept whole with ``split_commas=False``.  Items are trimmed and blanks
    dropped; ``strip_quotes`` also removes quotes around an item.  Null gives
    an empty list.
    """
    text = strip(col)
    bracketed = text.startswith("[") & text.endswith("]")
    as_json = F.when(bracketed, F.from_json(F.translate(text, "'", '"'), STRINGS))
    whole = F.array(text)
    as_text = F.when(text.contains(","), F.split(text, ",")).otherwise(whole) \
        if split_commas else whole

    def clean(item: Column) -> Column:
        item = strip(item)
        return F.regexp_replace(item, "^['\"]+|['\"]+$", "") if strip_quotes else item

    items = F.transform(F.coalesce(as_json, as_text, F.array().cast(STRINGS)), clean)
    return F.filter(items, lambda item: item != "")


def compact(flags: list[tuple[Column, Column | str]]) -> Column:
    """List of the values whose flag is true, in order.

    ``array_except`` removes the nulls inside generated code; ``array_compact``
    would leave it for a lambda.
    """
    values = [F.when(flag, F.lit(value) if isinstance(value, str) else value)
              for flag, value in flags]
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))
