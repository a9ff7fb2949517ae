"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SOCIAL_HOSTS, TRACKING_PARAMETERS, TWO_PART_SUFFIXES

# scheme, authority, path, query, fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def authority(url: Column) -> Column:
    """Lower-cased authority, with user and port."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encoded(text: Column) -> Column:
    # The JVM leaves * alone and escapes ~; query strings want it the other way round.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One spelling for a page: no tracking parameters, blank values, fragment or trailing slashes; sorted query."""
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.struct(
            _form_decoded(F.substring_index(p, "=", 1)).alias("k"),
            _form_decoded(F.substr(p, F.locate("=", p) + 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING_PARAMETERS))
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&"
    )
    scheme = F.lower(_part(url, 1))
    clean_path = F.rtrim(path(url), F.lit("/"))
    return F.when(
        F.contains(url, F.lit("[")) & ~F.contains(url, F.lit("]")), url  # an address that cannot be parsed stays
    ).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(""),
            F.when(clean_path == "", "/").otherwise(clean_path),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )
    )


def item_id(canonical: Column) -> Column:
    return F.concat(F.lit("it_"), F.substring(F.sha1(canonical.cast("binary")), 1, 14))


def host(url: Column) -> Column:
    """Host alone: no user, port or leading www."""
    bare = F.substring_index(F.substring_index(authority(url), "@", -1), ":", 1)
    return F.regexp_replace(bare, r"^www\.", "")


def display_host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def org_key(url: Column) -> Column:
    """Organisation of an unregistered source: registrable domain, or host and account on social sites."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    registrable = (
        F.when(F.size(labels) <= 2, host(url))
        .when(two.isin(*TWO_PART_SUFFIXES), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(two)
    )
    account = F.regexp_extract(path(url), r"^/*([^/]+)", 1)
    key = (
        F.when(host(url) == "", F.left(url, F.lit(40)))
        .when(registrable.isin(*SOCIAL_HOSTS) & (account != ""), F.concat_ws("/", registrable, F.lower(account)))
        .otherwise(registrable)
    )
    return F.concat(F.lit("unregistered:"), key)
