"""Column functions on urls. All run inside the JVM; a null url gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def host(url: Column) -> Column:
    """Lower-cased authority, with port and user."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def pattern(url: Column) -> Column:
    """The shape of a url: digits become N, the last of several segments *. One chain: no part is written, or run, twice."""
    out = path(url)
    for rx, to in ((r"/+$", ""), (r"^$", "/"), (r"\d+", "N"), (r"^(/.*/)[^/]*$", "$1*")):
        out = F.regexp_replace(out, rx, to)
    return F.substring(out, 1, 200)


def family(url: Column) -> Column:
    """Path and query with number-bearing and Roman tokens as <n>; the pattern where there are none."""
    shape = url
    for rx, to in ((r"^[^:/?#]+://[^/?#]*", ""), (r"#.*$", ""), (r"\?$", ""), (r"[0-9][0-9A-Za-z]*", "<n>"), (P.ROMAN, "<n>")):
        shape = F.regexp_replace(shape, rx, to)
    return F.coalesce(F.nullif(F.regexp_extract(shape, "^.*<n>.*$", 0), F.lit("")), pattern(url))


def canonical(url: Column) -> Column:
    """https, lower-cased host without a default port, no tracking or blank parameters, no fragment."""
    kept = F.array_join(F.filter(F.split(url_query(url), "&"), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).rlike(P.TRACKING) & p.rlike("=.")), "&")
    return F.concat(F.lit("https://"), F.regexp_replace(host(url), r":(80|443)$", ""), path(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def locale(url: Column) -> Column:
    return F.regexp_extract(path(url), P.LOCALE, 1)


def is_asset(url: Column) -> Column:
    return url.rlike(P.ASSET)


def in_scope(url: Column, start_host: Column, directory: Column) -> Column:
    """On the start's host (but for www.) and under its directory."""
    return (bare_host(url) == start_host) & F.startswith(path(url), directory)


def slug_key(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Decoded and lower-cased, then rewritten by ordered rules; + is not a blank."""
    out = F.lower(F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))
    for rx, to in rules:
        out = F.regexp_replace(out, rx, to)
    return out


def mirror_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def family_regex(shape: str) -> str:
    """A family as an expression for ``rlike``; it is searched in path and query."""
    return "".join({"<n>": "[0-9A-Za-z]+", "*": "[^/?]+"}.get(x, re.escape(x)) for x in re.split(r"(<n>|\*)", shape)) + "/?$"


def encoded(value: Column) -> Column:
    """Percent-encoded with nothing safe, a blank as %20."""
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
