"""Vector functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def length(v: Column) -> Column:
    """Norm of a vector, 1 for one of length 0."""
    return F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a vector of length 0 counts as length 1."""
    return dot(a, b) / (length(a) * length(b))


def quantise(v: Column) -> Column:
    """Unit vector in steps of 1/127, halves to even; the length is computed once for a vector."""
    stepped = lambda n: F.transform(v, lambda x: F.rint(x.cast("double") / n * 127).cast("int"))
    return F.when(v.isNotNull(), F.get(F.transform(F.array(length(v)), stepped), 0))


def to_base64(q: Column) -> Column:
    """Quantised vector as text: one byte for each value, moved by 128."""
    hexed = F.array_join(F.transform(q, lambda x: F.lpad(F.hex((x + 128).cast("long")), 2, "0")), "")
    return F.base64(F.unhex(hexed))


def from_base64(text: Column) -> Column:
    digits = F.hex(F.unbase64(text))
    places = F.sequence(F.lit(0), F.shiftright(F.char_length(digits), 1) - 1)
    value = lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") - 128
    return F.when(F.char_length(digits) > 0, F.transform(places, value)).otherwise(F.array().cast("array<int>"))
