"""URL rules as column expressions: which URLs are accepted, and the title a URL stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import constants as C

# scheme, slashes, optional user info, host, optional port, path.  Tabs and line breaks inside
# a URL are ignored, and a backslash counts as a slash.
_AUTHORITY = r"^(?i:https?|ftp|wss?):[/\\]*(?:[^/\\?#]*@)?"
_HOST = _AUTHORITY + r"(\[[0-9A-Fa-f:.]+\]|[^/\\?#@:]*)"
_PATH = _AUTHORITY + r"[^/\\?#]*([^?#]*)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}\.?(?=[:/\\?#]|\z)"
_IPV6 = r"\[[0-9A-Fa-f:.]+\]"
# A name whose last label is a number would be read as an IPv4 address.
_NAME = r"(?!(?:[^/\\?#:@]*\.)?[0-9]+\.?(?:[:/\\?#]|\z))[^\x00-\x20\x7F/\\?#:@<>^|%\[\]]+"
_PORT = (
    r"(?::0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?"
)
_ABSOLUTE = _AUTHORITY + f"(?:{_IPV6}|{_IPV4}|{_NAME})" + _PORT + r"(?=[/\\?#]|\z)"
# Characters of a path that are shown as they are; all others are shown percent-encoded.
_PLAIN_PATH_CHAR = r"""^[!$-;=@-\[\]_a-z|~\\]\z"""


def _cleaned(url: Column) -> Column:
    """Leading and trailing control characters and spaces, and all tabs and line breaks, do not count."""
    edges = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.when(url.rlike(r"[\x00-\x20]"), F.translate(edges, "\t\n\r", "")).otherwise(url)


def _is_absolute(clean_url: Column) -> Column:
    return F.coalesce(clean_url.rlike(_ABSOLUTE), F.lit(False))


def is_valid_url(url: Column) -> Column:
    """An absolute URL that starts with a lower-case http:// or https://."""
    return F.coalesce(
        (url.startswith("http://") | url.startswith("https://")) & _is_absolute(_cleaned(url)),
        F.lit(False),
    )


def _resolved_segments(path: Column) -> Column:
    """Path segments after '.' and '..' are resolved; the empty first segment is left out."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    dots = F.transform(parts, lambda p: F.regexp_replace(p, r"(?i)%2e", "."))
    named = F.transform(parts, lambda p, i: F.when(F.get(dots, i).isin(".", ".."), F.get(dots, i)).otherwise(p))
    rest = F.slice(named, F.lit(2), F.greatest(F.size(named) - 1, F.lit(0)))
    return F.aggregate(
        rest,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )


def _percent_encode(col: Column) -> Column:
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    return F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c.rlike(_PLAIN_PATH_CHAR) | (c == "%"), c).otherwise(
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )


def title_from_url(url: Column) -> Column:
    """'<last path segment> - <host>', or the host alone, or a fixed text for what is not a URL."""
    clean = _cleaned(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(clean, _HOST, 1)), r"^www\.", "")
    segments = F.filter(_resolved_segments(F.regexp_extract(clean, _PATH, 1)), lambda p: p != "")
    last = F.element_at(segments, -1)
    return (
        F.when(~_is_absolute(clean), F.lit(C.UNPARSABLE_URL_TITLE))
        .when(F.size(segments) == 0, host)
        .otherwise(F.concat(_percent_encode(last), F.lit(" - "), host))
    )
