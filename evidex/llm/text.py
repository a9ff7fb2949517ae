"""Text conventions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def without_white_space(text: Column) -> Column:
    """Delete every white-space character; literal replacements are faster than one pattern."""
    for char in WHITE_SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; the one-pass lower() serves texts without other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
