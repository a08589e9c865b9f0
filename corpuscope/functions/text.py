"""Line, whitespace and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python str treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The line boundaries of str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def split_lines(content: Column) -> Column:
    """Array of lines with no trailing empty line."""
    parts = F.transform(F.array(F.split(content, LINE_BREAK, -1)), _drop_last_empty)
    return F.get(parts, F.lit(0))


def _drop_last_empty(parts: Column) -> Column:
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized_hash(c: Column) -> Column:
    """md5 of the text with whitespace runs collapsed."""
    return F.md5(collapse_whitespace(c))


def word_tokens(c: Column, min_len: int = 1) -> Column:
    """Unicode words of at least ``min_len`` characters, in text order.

    A greedy run of word characters is a whole word, so no boundary test is needed.
    """
    return F.regexp_extract_all(c, F.lit(rf"(?U)\w{{{min_len},}}"), F.lit(0))


def capitalize(c: Column) -> Column:
    """First letter in title case, the rest lower case; one letter may become two."""
    head = F.upper(F.substr(c, F.lit(1), F.lit(1)))
    return F.concat(
        F.substr(head, F.lit(1), F.lit(1)), F.lower(F.substr(head, F.lit(2))),
        F.lower(F.substr(c, F.lit(2))),
    )


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding computed the same way on every engine."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_text(c: Column) -> Column:
    """A number as whole-number text, rounded half up."""
    return F.floor(c + F.lit(0.5)).cast("bigint").cast("string")


def first_chars(text: Column, length: int | None) -> Column:
    """The whole text, or its first ``length`` characters."""
    return text if length is None else F.substr(text, F.lit(1), F.lit(length))


def first_items(items: Column, count: int | None) -> Column:
    """The whole array, or its first ``count`` items."""
    return items if count is None else F.slice(items, 1, count)
