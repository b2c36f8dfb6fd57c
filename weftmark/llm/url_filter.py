"""URL filter: host and path rules, then a blocked Bloom filter in front of an exact hash join.

The filter is a table of 512-bit blocks: eight words of 64 bits, one bit of each set for a
listed URL. It is built by aggregating bit-ors and has at most ``max_blocks`` rows, so it may
be broadcast whatever the list's length; a longer list only lets more false positives through
to the join, which removes them all. URLs that miss the filter are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import ascii_lower, free_prefix, staged

WORDS = 8
MAX_BLOCKS = 1 << 17  # 8 MB of filter words
URLS_PER_BLOCK = 48  # about 10 bits a URL


@dataclass(frozen=True)
class UrlRule:
    """``text`` is host + path, like ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def url_parts(url: Column) -> dict[str, Column]:
    """``host`` and ``path``, both empty for a null url or one without ``://``."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    return {"host": ascii_lower(host), "path": F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)}


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.``, ``m.``, port or end dot, path without a slash or ``.html`` at its end; no query."""
    bare = F.regexp_replace(F.regexp_replace(host, "\\.?(:[0-9]*)?$", ""), "^(www|m)\\.", "")
    return F.concat(bare, F.regexp_replace(path, "(/|\\.html)$", ""))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(F.lit(1), url)
    places = [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_blocks(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """(block, w0 … w7) of the listed URLs, at most ``blocks`` rows."""
    words = [b.alias(f"w{j}") for j, b in enumerate(_bits(F.col(url_col)))]
    return listed.select(_block(F.col(url_col), blocks).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def in_list(rows: DataFrame, url_col: str, listed: DataFrame, listed_col: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add ``listed`` (boolean): whether ``url_col`` is among ``listed_col``; null is never listed."""
    p = free_prefix(rows)
    u, block, hit, words = f"{p}u", f"{p}b", f"{p}hit", [f"{p}w{j}" for j in range(WORDS)]
    urls = staged(listed.select(F.col(listed_col).alias(u)).filter(F.col(u).isNotNull()).distinct(), "listed")
    blocks = max(1, min(max_blocks, -(-urls.count() // URLS_PER_BLOCK)))
    bloom = staged(bloom_blocks(urls, u, blocks).toDF(block, *words), "bloom")
    probe = rows.drop("listed").withColumn(block, _block(F.col(url_col), blocks)).join(F.broadcast(bloom), block, "left")
    every = F.lit(True)
    for w, b in zip(words, _bits(F.col(url_col)), strict=True):
        every = every & (F.col(w).bitwiseAND(b) != 0)
    probe = probe.withColumn(hit, F.coalesce(every, F.lit(False)) & F.col(url_col).isNotNull()).drop(block, *words)
    exact = probe.filter(hit).withColumn(u, F.col(url_col)).join(urls.withColumn("listed", F.lit(True)), u, "left")
    missed = probe.filter(~F.col(hit)).withColumn("listed", F.lit(False))
    return exact.withColumn("listed", F.coalesce("listed", F.lit(False))).drop(hit, u).unionByName(missed.drop(hit))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[UrlRule], url_col: str = "url", listed_col: str = "canonical",
               max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add ``host``, ``path``, ``canonical``, ``rule``, ``listed`` and ``verdict`` (allow or block).

    A fitting rule decides, the longest one first; else a page is blocked if its canonical URL is
    listed. A null url, or one without ``://``, has empty host and path and is allowed unless the
    list holds the empty text. Repeated rows get the same verdict, an empty list blocks nothing,
    an empty table gives no rows, and added columns replace input columns of their names.
    """
    parts = url_parts(F.col(url_col))
    v = free_prefix(pages) + "v"
    out = pages.drop("listed").withColumns(parts)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"canonical": canonical_url(F.col("host"), F.col("path")), "rule": rule, v: verdict})
    out = in_list(out, "canonical", listed, listed_col, max_blocks)
    return out.withColumn("verdict", F.coalesce(v, F.when(F.col("listed"), "block").otherwise("allow"))).drop(v)
