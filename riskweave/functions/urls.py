"""URLs in texts: what to show of them, their exact hash, and whether they name a fixed revision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"""https?://[^\s<>"'`)\]}]+"""
_REVISION = "[0-9a-f]{40}"


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def redacted(url: Column, most: int = 2048) -> Column:
    """Without user, query and fragment; cut to ``most`` characters."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-z]+://)[^/?#@]*@", "$1")
    return F.substring(plain, 1, most)


def pinned(url: Column) -> Column:
    """Whether a file address on a code host names a full commit."""
    plain = redacted(url)
    raw = plain.rlike(rf"^https?://raw\.githubusercontent\.com/[^/]+/[^/]+/{_REVISION}/[^/]")
    return raw | plain.rlike(rf"^https?://github\.com/[^/]+/[^/]+/(?:blob|raw)/{_REVISION}/[^/]")
