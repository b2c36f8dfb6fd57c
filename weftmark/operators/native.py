"""Native markdown route over captured responses."""

from __future__ import annotations

import encodings
import importlib
import pkgutil
from encodings.aliases import aliases as _ALIASES

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import literal_map, py_strip
from ..functions.urls import url_clean
from ..options import JobOptions

#: Optional sequence or time (as a long) of a capture; larger is later.
CAPTURE_ORDER = "capture_seq"
# Charset spellings Python's codec registry maps to the three
# charsets Spark decodes natively.
_UTF8 = ["utf-8", "utf8", "u8", "utf", "utf_8", "cp65001"]
_LATIN1 = ["iso-8859-1", "iso8859-1", "iso_8859_1", "iso8859_1", "latin-1", "latin1", "latin_1", "l1", "8859", "cp819", "iso-ir-100", "iso_8859-1", "iso_8859-1:1987", "latin"]
_ASCII = ["ascii", "us-ascii", "us_ascii", "646", "us", "ansi_x3.4-1968", "iso646-us", "cp367", "csascii", "ibm367", "iso-ir-6", "us-ascii"]


def header(headers: Column, name: str) -> Column:
    """Case-insensitive header lookup (the first value if a name repeats)."""
    hit = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(hit), F.lit(1))


def is_native_markdown(content_type: Column) -> Column:
    """``content_type.lower().startswith('text/markdown')``; a missing header is ''."""
    return F.lower(F.coalesce(content_type, F.lit(""))).startswith("text/markdown")


def fetch_ok(http_status: Column, fetch_error: Column) -> Column:
    """the fetch counts only for a final 2xx response without a transport error."""
    return fetch_error.isNull() & http_status.between(200, 299)


def charset_of(content_type: Column) -> Column:
    """``charset=([^;]+)`` (case-insensitive), stripped, quotes stripped; default utf-8."""
    m = F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset=([^;]+)", 1)
    cs = F.regexp_replace(py_strip(m), '^"+|"+$', "")
    return F.when(m == "", F.lit("utf-8")).otherwise(cs)


def _code_pages() -> dict[str, str]:
    """Characters of the bytes 1 … 255 in each single-byte codec of the standard library; U+FFFE where undefined."""
    found = {}
    for module in pkgutil.iter_modules(encodings.__path__):
        if module.name not in ("aliases", "mbcs", "oem"):
            table = getattr(importlib.import_module(f"encodings.{module.name}"), "decoding_table", None)
            if isinstance(table, str) and len(table) == 256 and table[0] == "\0":
                found[module.name] = table[1:]
    return found


_PAGES = _code_pages()
_PAGE_ALIASES = {alias: name for alias, name in _ALIASES.items() if name in _PAGES}
_PAGE_NAMES = {name: name for name in _PAGES} | _PAGE_ALIASES
_BYTES = "".join(map(chr, range(1, 256)))


def codec_name(charset: Column) -> Column:
    """A charset's spelling as the codec registry compares it: lower case, each run of other signs one ``_``."""
    return F.btrim(F.regexp_replace(F.lower(charset), "[^a-z0-9.]+", "_"), F.lit("_"))


def code_page(charset: Column) -> Column:
    """The single-byte codec that a charset names, or null."""
    plain = charset.rlike("^[\\x01-\\x7f]*$")
    name = codec_name(charset)
    dotless = F.replace(name, F.lit("."), F.lit("_"))  # the registry tries this among its aliases only
    return F.when(plain, F.coalesce(F.try_element_at(literal_map(_PAGE_NAMES), name), F.try_element_at(literal_map(_PAGE_ALIASES), dotless)))


@pandas_udf(StringType())
def _decode_py(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Multi-byte and other charsets Spark has no decoder for (shift_jis, gb18030, ...), vectorised per batch."""
    out = []
    for b, cs in zip(body, charset):
        if b is None:
            out.append(None)
            continue
        try:
            out.append(bytes(b).decode(cs))
        except (LookupError, ValueError, TypeError):
            out.append(bytes(b).decode("utf-8", errors="replace"))
    return pd.Series(out, dtype=object)


def charset_error(charset: Column) -> Column:
    """Why a charset makes the whole request fail, or null: an embedded NUL, and the codec that always fails."""
    return F.when(charset.contains("\0"), F.lit("embedded null character")).when(codec_name(charset) == "undefined", F.lit("undefined encoding"))


def decode_body(body: Column, charset: Column) -> Column:
    """Decode with the declared charset; unknown charset or bad bytes -> UTF-8 with U+FFFD; null where ``charset_error``.

    Single-byte charsets are decoded natively: each byte as one character, which its code page renames.
    """
    cs = F.lower(charset)
    as_utf8 = F.make_valid_utf8(body.cast("string"))
    page = code_page(charset)
    renamed = F.call_function("translate", F.decode(body, "ISO-8859-1"), F.lit(_BYTES), F.try_element_at(literal_map(_PAGES), page))
    # a UDF inside ``when`` runs for every row: all but the other charsets send it nulls
    other = ~cs.isin(_UTF8 + _LATIN1 + _ASCII) & page.isNull() & charset_error(charset).isNull()
    high_byte = F.hex(body).rlike("^(?:..)*?[89A-F]")
    return (
        F.when(body.isNull() | charset_error(charset).isNotNull(), F.lit(None).cast("string"))
        .when(cs.isin(_UTF8), as_utf8)
        .when(cs.isin(_LATIN1), F.decode(body, "ISO-8859-1"))
        .when(cs.isin(_ASCII), F.when(high_byte, as_utf8).otherwise(F.decode(body, "US-ASCII")))
        .when(page.isNotNull(), F.when(renamed.contains("\ufffe"), as_utf8).otherwise(renamed))
        .otherwise(_decode_py(F.when(other, body), F.when(other, charset)))
    )


def markdown_tokens_header(value: Column) -> Column:
    """Integer ``X-Markdown-Tokens``; a non-integer value is ignored (null)."""
    return value.try_cast("int")


def native_markdown(responses: DataFrame, options: JobOptions | None = None) -> DataFrame:
    """Native route: ``(url, content, source_content_type, markdown_tokens, capture_seq, decode_error)`` per usable response.

    ``decode_error`` is null, or says why the request fails; ``content`` is null then.

    When the Accept header leaves out markdown the branch is empty (F2); the
    literal ``false`` lets Catalyst prune it from the plan.
    """
    options = options or JobOptions()
    ct = header(F.col("headers"), "Content-Type")
    df = responses.select(
        url_clean(F.col("url")).alias("url"),
        F.col("http_status"),
        F.col("fetch_error"),
        ct.alias("content_type"),
        header(F.col("headers"), "X-Markdown-Tokens").alias("_tok"),
        F.col("body"),
        (F.col(CAPTURE_ORDER) if CAPTURE_ORDER in responses.columns else F.lit(0)).cast("long").alias(CAPTURE_ORDER),
    )
    df = df.filter(F.lit(options.native_enabled) & fetch_ok(F.col("http_status"), F.col("fetch_error")) & is_native_markdown(F.col("content_type")) & F.col("body").isNotNull())
    return df.select(
        "url",
        decode_body(F.col("body"), charset_of(F.col("content_type"))).alias("content"),
        F.col("content_type").alias("source_content_type"),
        markdown_tokens_header(F.col("_tok")).alias("markdown_tokens"),
        CAPTURE_ORDER,
        charset_error(charset_of(F.col("content_type"))).alias("decode_error"),
    )


def one_per_url(native: DataFrame, keep_order: bool = False) -> DataFrame:
    """One captured answer per URL: a readable one first, a non-empty one before an empty one, then the latest by
    ``capture_seq`` (responses without that column count as simultaneous), then the smallest
    content. Partial aggregation comes first, so a URL captured millions of times is combined
    map-side before the shuffle. ``keep_order`` adds ``capture_seq`` of the one taken."""
    pick = F.min(F.struct(F.col("decode_error").isNotNull().alias("failed"), (F.col("content") == "").alias("empty"), (-F.col(CAPTURE_ORDER)).alias("age"), "content", "source_content_type", "markdown_tokens", "decode_error"))
    return native.groupBy("url").agg(pick.alias("n")).select(
        "url", F.col("n.content").alias("content"), F.col("n.source_content_type").alias("source_content_type"),
        F.col("n.markdown_tokens").alias("markdown_tokens"), F.col("n.decode_error").alias("decode_error"),
        *([(-F.col("n.age")).alias(CAPTURE_ORDER)] if keep_order else []),
    )
