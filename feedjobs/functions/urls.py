"""URL functions on columns."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Second-level labels under which sites register.
SECOND_LEVEL = ("ac", "co", "edu", "org", "gov")


def _resolve(href: str | None, base: str | None) -> str | None:
    if href is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", href.strip()))
    except ValueError:
        return None
    if parts.scheme in ("http", "https"):
        if not parts.hostname or " " in parts.netloc:
            return None
        quote = lambda s: s.replace(" ", "%20").replace('"', "%22").replace("<", "%3C").replace(">", "%3E")
        return urlunsplit((parts.scheme, parts.netloc.lower(), quote(parts.path) or "/", quote(parts.query), quote(parts.fragment)))
    return parts.geturl() if parts.scheme else None


@F.pandas_udf(T.StringType())
def _resolve_udf(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_resolve(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute URL, or null. Whole http URLs and root-relative links stay in the JVM; the rest goes to a helper."""
    h = F.trim(href)
    plain = ~h.rlike(r"[\s\"<>]|/\.\.?(/|$)")
    absolute = h.rlike(r"^https?://[a-z0-9.-]+(:[0-9]+)?/") & plain
    rooted = h.rlike(r"^/([^/]|$)") & plain & base.rlike(r"^https?://[a-z0-9.-]+(:[0-9]+)?(/|$|\?|#)")
    return F.when(absolute, h).when(rooted, F.concat(origin(base), h)).otherwise(_resolve_udf(F.when(~(absolute | rooted), href), base))


def host(url: Column) -> Column:
    """Host in lower case without `www.`; empty for none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def base_domain(host_: Column) -> Column:
    """Registrable domain: the last two labels, or three under a second-level label such as `ac`."""
    labels = F.split(F.regexp_replace(host_, r"^www\.", ""), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    k = F.least(n, F.when(deep, 3).otherwise(2))
    return F.array_join(F.slice(labels, n - k + 1, k), ".")


def url_root(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/$", "")


def ancestors(url: Column) -> Column:
    """What stands before each slash of a URL: `a` is among the ancestors of `b` just where b starts with `a/`."""
    parts = F.split(url, "/", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def same_site(url: Column, site_host: Column, mode: str) -> Column:
    """Does a URL belong to a site? `domain`: same host or registrable domain; `subdomain`: same host or one below it."""
    h = host(url)
    if mode == "domain":
        return (h == site_host) | (base_domain(h) == base_domain(site_host))
    return (h == site_host) | F.endswith(h, F.concat(F.lit("."), site_host))


def expand_since(url: Column, now: Column) -> Column:
    """`{since:N}` becomes the date N days before now, for up to two placeholders."""
    out = url
    for _ in range(2):
        n = F.regexp_extract(out, r"\{since:(\d+)\}", 1)
        day = F.date_format(F.date_sub(now, F.coalesce(n.try_cast("int"), F.lit(0))), "yyyy-MM-dd")
        out = F.when(n != "", F.replace(out, F.concat(F.lit("{since:"), n, F.lit("}")), day)).otherwise(out)
    return out
