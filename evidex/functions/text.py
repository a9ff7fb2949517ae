"""Text functions as column expressions; entities alone need Python."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = r"[\x{4E00}-\x{9FFF}]"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Resolve HTML entities."""
    return text.map(html.unescape, na_action="ignore")


#: A reference to a character that a semicolon ends.
ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


@F.pandas_udf(StringType())
def unescape_ended(text: pd.Series) -> pd.Series:
    """Resolve HTML entities that a semicolon ends; unescape also takes some old ones without, as browsers do."""

    def one(found: re.Match) -> str:
        name = found[0][1:]
        return html.unescape(found[0]) if name[0] == "#" or name in html5 else found[0]

    return text.map(lambda t: ENDED.sub(one, t), na_action="ignore")


@F.pandas_udf(StringType())
def decode_charset(data: pd.Series) -> pd.Series:
    """Bytes to text: UTF-8, else the Chinese code pages, else UTF-8 without what is broken."""

    def one(raw: bytes) -> str:
        for name in ("utf-8", "gbk", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "ignore")

    return data.map(one, na_action="ignore")


def normalize_plain_title(title: Column) -> Column:
    """Normal form of a title without entities: site suffixes, spaces and punctuation go."""
    bare = F.regexp_replace(title, r"(?U)(?:[_|｜\-—–]\s*[^_|｜\-—–]{1,14}\s*)+$", "")
    return F.lower(F.regexp_replace(bare, r"(?U)[\s\W_]+", ""))


def normalize_title(title: Column) -> Column:
    return normalize_plain_title(unescape(title))


def strip_html(text: Column, resolve: Callable[[Column], Column] = unescape) -> Column:
    """Visible text: entities twice over, blocks that hold none, tags, then spaces."""
    plain = resolve(resolve(text))
    plain = F.regexp_replace(plain, r"(?is)<(script|style|noscript|nav|footer|header).*?</\1>", " ")
    plain = F.regexp_replace(plain, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of few literal terms is a part of the text, case as given."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def keyword_gate(title: Column, content: Column, ai_terms: tuple[str, ...], industry_terms: tuple[str, ...]) -> Column:
    """(passes, misses): a term of either list must occur; an empty list opens the gate."""
    if not ai_terms or not industry_terms:
        return F.struct(F.lit(True).alias("passes"), F.lit(None).cast("string").alias("misses"))
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    ai, industry = contains_any(blob, ai_terms), contains_any(blob, industry_terms)
    misses = F.concat_ws("+", F.when(~ai, F.lit("ai")), F.when(~industry, F.lit("industry")))
    return F.struct((ai & industry).alias("passes"), F.when(~(ai & industry), misses).alias("misses"))


def sliding_tokens(text: Column, ascii_least: int = 3, lower_first: bool = False) -> Column:
    """Distinct overlapping pairs of neighbouring CJK characters and lower-case ASCII words."""
    if lower_first:
        text = F.lower(text)
    cjk = F.array_join(F.regexp_extract_all(text, F.lit(CJK), F.lit(0)), "")
    pairs = F.when(
        F.char_length(cjk) > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(cjk) - 1, F.lit(1))), lambda i: F.substr(cjk, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.regexp_extract_all(text, F.lit(f"[a-zA-Z]{{{ascii_least},}}"), F.lit(0)), F.lower)
    return F.array_union(pairs, words)


def simhash_tokens(text: Column) -> Column:
    """Non-overlapping CJK pairs and ASCII words of three letters or more, in order."""
    return F.regexp_extract_all(text, F.lit(f"{CJK}{{2}}|[a-zA-Z]{{3,}}"), F.lit(0))


def parse_time(raw: Column, exact: bool) -> Column:
    """(at, time_source): a moment in UTC by any known format, else a date found in the text."""
    text = F.regexp_replace(F.trim(raw), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    text = F.regexp_replace(F.replace(text, F.lit("GMT"), F.lit("+0000")), r"([+-]\d\d)(\d\d)$", "$1:$2")
    shapes = (
        (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d\d:\d\d$", "d MMM yyyy HH:mm:ss XXX"),
        (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}Z$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX"),
        (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"),
        (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
    )
    known = F.coalesce(*(F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in shapes))
    loose = r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})"
    year, month, day = (F.lpad(F.regexp_extract(F.trim(raw), loose, k), 4 if k == 1 else 2, "0") for k in (1, 2, 3))
    found = F.when(F.trim(raw).rlike(loose), F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")))
    at = F.coalesce(known, found)
    source = F.when(known.isNotNull(), F.lit("exact" if exact else "parsed")).when(found.isNotNull(), F.lit("parsed"))
    return F.struct(at.alias("at"), source.alias("time_source"))


def json_answer(raw: Column) -> Column:
    """VARIANT of a model's answer: bare, inside the first fence, or the widest object or list in it."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.when(raw.rlike(r"(?s)```.*```"), fenced).otherwise(F.trim(raw))
    return F.coalesce(
        F.try_parse_json(bare),
        F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)),
        F.try_parse_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0)),
    )


def present(value: Column) -> Column:
    """Null for the empty string too, which counts as missing."""
    return F.nullif(value, F.lit(""))
