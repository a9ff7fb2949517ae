"""SimHash of item bodies, a function of the row alone, and Hamming distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import simhash_tokens


#: Token digests that a worker remembers.
REMEMBERED = 200_000

_digests: dict[str, int] = {}


def _digest(token: str) -> int:
    """The low half of a token's MD5."""
    known = _digests.get(token)
    if known is None:
        if len(_digests) > REMEMBERED:
            _digests.clear()
        known = _digests[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
    return known


@F.pandas_udf(LongType())
def _majority(tokens: pd.Series) -> pd.Series:
    out = np.zeros(len(tokens), np.int64)
    for i, row in enumerate(tokens):
        if row is not None and len(row):
            hashes = np.fromiter(map(_digest, row), np.uint64, len(row))
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(row)
            out[i] = np.packbits(ones).view(">i8")[0]
    return pd.Series(out)


def simhash_value(text: Column) -> Column:
    """64-bit SimHash over the low halves of the tokens' MD5: bits that most tokens have; no tokens give 0."""
    return _majority(simhash_tokens(text))


def simhash(items: DataFrame, key: str, text: str, out: str = "simhash") -> DataFrame:
    """(key, out): the SimHash of each row, without a shuffle."""
    return items.select(key, simhash_value(F.col(text)).alias(out))


def simhash_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; an unknown fingerprint is as far away as can be."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))
