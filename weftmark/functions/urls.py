"""URL validation and navigation budget as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Fixed values (messages and budgets must equal the reference's).
MSG_NOT_STRING = "url must be a non-empty string"
MSG_EMPTY = "url cannot be empty"
MSG_SCHEME = "url must start with http:// or https://"
MSG_MALFORMED_TAIL = "Must include a valid hostname."
MSG_IPV6 = "Invalid IPv6 URL"
BASE_BUDGET_MS = 45000
EXTRA_BUDGET_MS = 15000

# urlsplit drops these anywhere in the URL before splitting
_UNSAFE = "[\\t\\r\\n]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_clean(url) -> Column:
    """``url.strip()``."""
    return py_strip(_col(url))


def _split_parts(clean: Column):
    """netloc / path / query of an http(s) URL the way ``urlsplit`` cuts them."""
    u = F.regexp_replace(clean, _UNSAFE, "")
    rest = F.regexp_extract(u, "(?s)^[A-Za-z][A-Za-z0-9+.-]*:(.*)$", 1)
    has_auth = rest.startswith("//")
    netloc = F.when(has_auth, F.regexp_extract(rest, "^//([^/?#]*)", 1)).otherwise(F.lit(""))
    after = F.when(has_auth, F.regexp_extract(rest, "(?s)^//[^/?#]*(.*)$", 1)).otherwise(rest)
    no_frag = F.regexp_extract(after, "^([^#]*)", 1)
    path = F.regexp_extract(no_frag, "^([^?]*)", 1)
    query = F.regexp_extract(no_frag, "(?s)^[^?]*\\??(.*)$", 1)
    return netloc, path, query


def url_netloc(url) -> Column:
    return _split_parts(url_clean(url))[0]


def url_error(url) -> Column:
    """the validation message, or null when the URL is accepted.

    Checks run in the reference's order. The host-less message is wrapped twice,
    exactly as the reference's nested ``try`` produces it.
    """
    raw = _col(url)
    clean = url_clean(raw)
    netloc = _split_parts(clean)[0]
    bad_brackets = (netloc.contains("[") & ~netloc.contains("]")) | (netloc.contains("]") & ~netloc.contains("["))
    prefix = F.concat(F.lit("URL is malformed: '"), clean, F.lit("'. "))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(MSG_NOT_STRING))
        .when(clean == "", F.lit(MSG_EMPTY))
        .when(~(clean.startswith("http://") | clean.startswith("https://")), F.lit(MSG_SCHEME))
        .when(bad_brackets, F.concat(prefix, F.lit(MSG_IPV6)))
        .when(netloc == "", F.concat(prefix, prefix, F.lit(MSG_MALFORMED_TAIL)))
    )


def url_echo(url) -> Column:
    """URL echoed in an error row: null if the input was not a string, else stripped."""
    raw = _col(url)
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(raw == "", raw).otherwise(url_clean(raw))


def url_budget_ms(url) -> Column:
    """45 s, plus 15 s when there is a query or the path has more than 3 slashes."""
    _, path, query = _split_parts(url_clean(url))
    slashes = F.length(path) - F.length(F.regexp_replace(path, "/", ""))
    extra = (query != "") | (slashes > 3)
    return (F.lit(BASE_BUDGET_MS) + F.when(extra, F.lit(EXTRA_BUDGET_MS)).otherwise(F.lit(0))).cast("int")


def url_budget_seconds(url) -> Column:
    """Native fetch timeout: ``max(1.0, ms / 1000)``."""
    return F.greatest(F.lit(1.0), url_budget_ms(url) / F.lit(1000.0))


def url_host(url) -> Column:
    """Lower-cased host without user info or port (reports)."""
    netloc = url_netloc(url)
    host = F.regexp_extract(netloc, "^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)", 1)
    return F.lower(host)
