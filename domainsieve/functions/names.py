"""Column expressions that clean and take apart DNS names and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from domainsieve.fixed import NEVER_BLOCK_SUFFIXES

_SPACE = " \t\n\r\f\x0b"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"^{_OCTET}(?:[.]{_OCTET}){{3}}$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def explode_if(value: Column, keep) -> Column:
    """A row with value where keep(value) holds, no row elsewhere. Unlike a filter behind a
    projection, which the optimizer would merge, this computes value once."""
    return F.explode(F.filter(F.array(value), keep))


def clean_name(c: Column) -> Column:
    """Lower case, trailing dots cut."""
    return F.lower(F.rtrim(c, F.lit(".")))


def label_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1


def first_label(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def ends_with_any(c: Column, suffixes) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes], F.lit(False))


def is_internal(c: Column) -> Column:
    return ends_with_any(c, NEVER_BLOCK_SUFFIXES)


def is_ip(c: Column) -> Column:
    return c.rlike(rf"^{_IPV4}$") | c.rlike(rf"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:{_IPV4})?(?:%\S+)?$")


def url_host(c: Column) -> Column:
    """Host of a URL without port and credentials; null when it has none."""
    host = F.regexp_extract(c, _SCHEME + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    host = F.lower(F.btrim(host, F.lit("[]")))
    return F.when(host != "", host)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, _SCHEME + r"[^/?#]*([^?#]*)", 1)
