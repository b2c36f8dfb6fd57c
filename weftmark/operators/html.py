"""HTML pages to markdown as a relational job.

A page is exploded into a token table once; from then on every step is a window
or a grouped aggregate keyed by the page key, so after the single exchange on
the key there is no further shuffle and no pairwise join:

* element extents come from per-tag running levels (open/close pairing) and,
  for tags left open, from the nearest following terminator inside the same
  paired-depth scope (one descending running-min window);
* "is this row inside an element of kind X" is a running max of the extents'
  ends (inside iff ``max(end of X opened so far) >= pos``), which replaces the
  interval joins of a naive design and holds for any number of elements;
* blocks, direct children, list items and table cells are running counts and
  ``last(... ignorenulls)`` lookups inside a (page, block) window;
* text runs are merged by one grouped aggregate per node (linear in the run);
* rendering is three small grouped aggregates (unit -> row -> block) and the
  page assembly is one more (page). All aggregates group by the page key plus
  sub-keys, so none of them shuffles.

Column conventions on the token table: ``pos`` token position, ``kind`` one of
open/close/void/raw/text/comment/decl/none, ``tag`` lower-cased tag name,
``attrs`` map of lower-cased attribute names to values, ``text`` decoded text of
a text node (a run of text and entity tokens), ``e`` end position of the
element opened at this row.
"""

from __future__ import annotations

import html.entities as _entities

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_map, noise_filter, normalize_lines, py_strip, token_estimate
from ..session import size_partitions

# ---------------------------------------------------------------------------
# Fixed values (tag lists, selectors and patterns that decide the output).
# ---------------------------------------------------------------------------
# ASCII whitespace spelled out so the same patterns mean the same in Java and RE2
SP = "\\t\\n\\x0b\\x0c\\r "
# A quote opens a quoted value only after '='; in it, '>' does not end the tag. The possessive loop
# takes any number of attributes without growing the regex engine's stack.
TAG_BODY = f"(?:[^>=]++|=[{SP}]*+(?:\"[^\"]*+(?:\"|\\z)|'[^']*+(?:'|\\z))?+)*+"
# Lossless tokeniser: comments, raw-text elements, tags, declarations, character references, text.
# What is never closed runs to the end of the page, as in an HTML5 tokeniser. So a pattern that has
# scanned far ahead never fails, and the whole page takes linear time.
TOKEN_RE = (
    "(?is)<!--(?:-?>|.*?(?:-->|\\z))"
    + "".join(f"|<{t}[{SP}/>].*?(?:</{t}(?:[{SP}/][^>]*)?(?:>|\\z)|\\z)" for t in ("script", "style", "textarea"))
    + f"|</?[a-z]{TAG_BODY}(?:>|\\z)"
    "|<[!?][^>]*(?:>|\\z)"
    "|&(?:#[0-9]+;?|#x[0-9a-f]+;?|[a-z][a-z0-9]*;?)"
    "|[^<&]+|<|&"
)
ATTR_NAME = f"[^{SP}\"'>/=]+"
ATTR_RE = f"({ATTR_NAME})(?:[{SP}]*=[{SP}]*(?:\"[^\"]*\"|'[^']*'|[^{SP}\"'>][^{SP}>]*))?"
OPENING_TAG_RE = f"(?is)^(<[a-z]{TAG_BODY}>?)"
RAW_RE = f"(?is)^<(?:script|style|textarea)[{SP}/>]"
SELF_CLOSE_RE = f"/[{SP}]*>$"
TAG_NAME_RE = "^</?([A-Za-z][A-Za-z0-9:_-]*)"
# Pieces of a run of text and reference tokens
RUN_PIECE_RE = "(?is)&(?:#[0-9]+;?|#x[0-9a-f]+;?|[a-z][a-z0-9]*;?)|[^&]+|&"
ENTITY_TOKEN_RE = "^&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)$"

VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"]
RAW_TAGS = ["script", "style", "textarea"]
# H7: subtrees removed before conversion
NON_CONTENT_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "button", "input", "select", "textarea", "svg", "canvas"]
# H5: removed by the render step's page cleanup ('header nav' / 'footer nav' are inside H7's header/footer)
CHROME_TAGS = ["script", "style", "noscript", "iframe"]
CHROME_CLASSES = ["advertisement", "ads", "ad-container", "cookie-banner", "cookie-notice", "gdpr-banner", "newsletter-signup", "popup", "modal"]
# H6: substring match on class or id (opt-in)
CONSENT_MARKERS = ["cookie", "banner"]
# H8: removed when they hold no text
EMPTY_CHECK_TAGS = ["div", "span"]
# The walk descends through these; anything else is one block
CONTAINER_TAGS = ["div", "section", "article", "main", "body", "span"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# H9: main region selectors, in priority order; body is the fallback
REGION_SELECTORS = ["main", "article", '[role="main"]', "#main", ".main-content", "#content", ".content"]

# Our own repair rules for elements that are never closed (parity with a full
# HTML tree builder is only claimed for well-formed input).
INLINE_TAGS = ["a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"]
P_CLOSERS = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "li", "dd", "dt"]
IMPLIED_END = {
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr", "tbody", "thead", "tfoot"],
    "td": ["td", "th", "tr", "tbody", "thead", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "thead", "tfoot"],
    "option": ["option", "optgroup"],
    "thead": ["thead", "tbody", "tfoot"],
    "tbody": ["thead", "tbody", "tfoot"],
    "tfoot": ["thead", "tbody", "tfoot"],
    "head": ["body"],
}

# Named character references known to the HTML 4 parser, taken from the
# standard library's table (plus &apos;).
_ENTITY_MAP = dict(_entities.name2codepoint)
_ENTITY_MAP["apos"] = 39
# Names that HTML5 also takes without a semicolon, from the same library's table.
_BARE_MAP = {k: v for k, v in _entities.html5.items() if not k.endswith(";")}
_BARE_LENGTHS = sorted({len(k) for k in _BARE_MAP}, reverse=True)

OPENING = ["open", "void", "raw"]

#: Bytes of input files for one partition of the chain. Its token rows are far larger than the compressed
#: pages and are sorted for most of the windows, so larger partitions spill at many sorts.
PAGE_BYTES = 1 << 20

#: An empty string in a collation that no hash aggregate takes, so that an aggregate keyed by it too runs over
#: the rows as the windows before it sorted them. A hash aggregate of lists would sort them anew, twice.
AS_SORTED = "_as_sorted"


_EXPR_CACHE: dict = {}


def _cached(name: str, build):
    """Build a fixed column expression once per JVM (expressions are immutable and can be
    shared by any number of DataFrames); saves thousands of driver-to-JVM calls per query."""
    from pyspark import SparkContext

    k = (name, id(SparkContext._jvm))
    expr = _EXPR_CACHE.get(k)
    if expr is None:
        expr = _EXPR_CACHE[k] = build()
    return expr


def _in(col: Column, values) -> Column:
    return col.isin(list(values))


def _w(key, *parts, order="pos", desc=False):
    cols = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*cols, *parts)
    o = F.col(order).desc() if desc else F.col(order)
    return w.orderBy(o)


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _entities_lit() -> Column:
    return literal_map({k: chr(v) for k, v in _ENTITY_MAP.items()})


def _bare_lit() -> Column:
    return literal_map(_BARE_MAP)


def _codepoint_to_str(cp: Column) -> Column:
    ok = cp.isNotNull() & (cp >= 1) & (cp <= 0x10FFFF) & ~((cp >= 0xD800) & (cp <= 0xDFFF))
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def _numeric(tok: Column) -> Column:
    """The character of a numeric reference token, or null; its semicolon may be missing."""
    is_dec = tok.rlike("^&#[0-9]")
    is_hex = tok.rlike("^&#[xX]")
    # leading zeros do not count; more digits than the range needs are out of it
    digits = F.regexp_extract(tok, "^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    dec_cp = F.when(F.length(digits).between(1, 7), digits.try_cast("bigint"))
    hex_cp = F.when(F.length(digits).between(1, 6), F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(is_dec, _codepoint_to_str(dec_cp)).when(is_hex, _codepoint_to_str(hex_cp))


def _named(tok: Column) -> Column:
    """The character of a named reference token that has its semicolon, or null."""
    return F.try_element_at(_entities_lit(), F.regexp_extract(tok, "^&(.*);$", 1))


def decode_entity(tok: Column) -> Column:
    """H4: decode one character reference token of a text; unknown names stay as written.

    Without its semicolon, or with more letters than a known name, a reference means the longest
    name it begins with that HTML5 takes bare, and the rest is text: ``&notit;`` is ``¬it;``.
    """
    body = F.substr(tok, F.lit(2))
    bare = [F.concat(F.try_element_at(_bare_lit(), F.substr(body, F.lit(1), F.lit(n))), F.substr(body, F.lit(n + 1))) for n in _BARE_LENGTHS]
    return F.coalesce(_numeric(tok), _named(tok), *bare, tok)


def decode_run(run: Column) -> Column:
    """H4: decode each character reference of a run of text and reference tokens."""
    pieces = F.regexp_extract_all(run, F.lit(RUN_PIECE_RE), 0)
    decoded = F.transform(pieces, lambda p: F.when(p.startswith("&") & (p != "&"), decode_entity(p)).otherwise(p))
    return F.when(run.contains("&"), F.array_join(decoded, "")).otherwise(run)


ATTR_PIECE_RE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)|[^&]+|&"


def decode_attr_value(v: Column) -> Column:
    """H4 inside attribute values. Without its semicolon a name counts only as a whole, and not before
    ``=``, so that ``?a=1&copy=2`` keeps its parameter."""
    pieces = F.regexp_extract_all(v, F.lit(ATTR_PIECE_RE), 0)
    bare = lambda p: F.try_element_at(_bare_lit(), F.substr(p, F.lit(2)))
    decoded = F.transform(pieces, lambda p: F.when(p.startswith("&"), F.coalesce(_numeric(p), _named(p), bare(p), p)).otherwise(p))
    return F.when(v.contains("&"), F.array_join(decoded, "")).otherwise(v)


# ---------------------------------------------------------------------------
# tokens
# ---------------------------------------------------------------------------

def _token_runs(toks: Column) -> Column:
    """``array<struct<pos, tok>>``: each run of text and reference tokens as one, at the place of its first token."""
    # of the tokens that begin with '<', only a lone '<' is text
    markup = lambda t: t.startswith("<") & (t != "<")

    def runs(ts: Column) -> Column:
        starts = F.filter(F.transform(ts, lambda t, i: F.when(markup(t) | (i == 0) | markup(F.get(ts, i - 1)), i)), lambda i: i.isNotNull())
        size = lambda ss, p, j: F.coalesce(F.get(ss, j + 1), F.size(ts)) - p
        return _once(starts, lambda ss: F.transform(ss, lambda p, j: F.struct(
            p.alias("pos"), F.when(size(ss, p, j) == 1, F.get(ts, p)).otherwise(F.array_join(F.slice(ts, p + 1, size(ss, p, j)), "")).alias("tok"))))

    return _once(toks, runs)


def html_tokens(pages: DataFrame, key: str = "page_id", html_col: str = "html", keep_cols=("url",), runs: bool = False) -> DataFrame:
    """H1: one row per token, ``concat(tok order by pos) = html``.

    Every page keeps at least one row (``kind = 'none'`` for an empty page) so it
    reaches the output. ``keep_cols`` ride along on the first row only. With ``runs``, a run of
    text and reference tokens is one row at the place of its first token; places stay.
    """
    cols = [F.col(key)] + [F.col(c) for c in keep_cols]
    toks = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKEN_RE), 0)
    if runs:
        exploded = pages.select(*cols, F.explode_outer(_token_runs(toks)).alias("_t")).select(key, *keep_cols, "_t.pos", "_t.tok")
    else:
        exploded = pages.select(*cols, F.posexplode_outer(toks).alias("pos", "tok"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    return exploded.select(
        key,
        F.coalesce(F.col("pos"), F.lit(0)).alias("pos"),
        "tok",
        *[F.when(first, F.col(c)).alias(c) for c in keep_cols],
    )


def _classify_exprs() -> dict:
    tok = F.col("tok")
    tag = F.lower(F.regexp_extract(tok, TAG_NAME_RE, 1))
    is_tag_open = tok.rlike("^<[A-Za-z]")
    unclosed = tok.rlike("^</?[A-Za-z]") & ~tok.endswith(">")  # a tag that the page ends in
    kind = (
        F.when(tok.isNull(), F.lit("none"))
        # text is told by its first character, so that no pattern reads it
        .when(~tok.startswith("<") & ~tok.startswith("&"), F.lit("text"))
        .when(tok.startswith("&"), F.when(tok.rlike(ENTITY_TOKEN_RE), F.lit("entity")).otherwise(F.lit("text")))
        .when(tok.startswith("<!--"), F.lit("comment"))
        .when(tok.rlike("^<[!?]"), F.lit("decl"))
        .when(tok.rlike(RAW_RE), F.lit("raw"))
        .when(unclosed, F.lit("decl"))
        .when(tok.rlike("^</[A-Za-z]"), F.lit("close"))
        .when(is_tag_open & (_in(tag, VOID_TAGS) | tok.rlike(SELF_CLOSE_RE)), F.lit("void"))
        .when(is_tag_open, F.lit("open"))
        .otherwise(F.lit("text"))
    )
    opening = _in(F.col("kind"), OPENING)
    return {
        "kind": kind,
        "tag": F.when(opening | (F.col("kind") == "close"), tag),
        "_entries": F.when(opening, attr_entries(tok)),
        "attrs": attrs_from_entries(F.col("_entries")),
        "val": F.when(F.col("kind") == "text", tok).when(F.col("kind") == "entity", decode_entity(tok)),
        "run_val": F.when(_in(F.col("kind"), ["text", "entity"]), decode_run(tok)),
    }


def classify_tokens(tokens: DataFrame, runs: bool = False) -> DataFrame:
    """Kind, tag, attributes (H3) and decoded value (H4) of each token; ``runs`` as in ``html_tokens``."""
    e = _cached("classify", _classify_exprs)
    df = tokens.withColumn("kind", e["kind"]).withColumns({"tag": e["tag"], "_entries": e["_entries"], "val": e["run_val" if runs else "val"]})
    return df.withColumn("attrs", e["attrs"]).drop("_entries")


def attr_entries(tok: Column) -> Column:
    """H3 (step 1): ``array<struct<k, v>>`` of an opening tag's attributes, in order."""
    # a tag without blank or slash ends with its name
    named = tok.rlike(f"[{SP}/]")
    open_tag = F.when(named, F.regexp_extract(tok, OPENING_TAG_RE, 1)).otherwise(F.lit(""))
    region = F.regexp_replace(open_tag, f"^<[A-Za-z][^{SP}/>]*", "")
    pairs = F.when(named, F.regexp_extract_all(region, F.lit(ATTR_RE), 0)).otherwise(F.array().cast("array<string>"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, f"^({ATTR_NAME})", 1)).alias("k"),
            decode_attr_value(
                F.when(
                    p.contains("="),
                    F.regexp_replace(F.regexp_replace(p, f"^[^=]*=[{SP}]*", ""), "(?s)^\"(.*)\"$|^'(.*)'$", "$1$2"),
                ).otherwise(F.lit(""))
            ).alias("v"),
        ),
    )


def attrs_from_entries(entries: Column) -> Column:
    """H3 (step 2): the map, first occurrence of a repeated name kept.

    Entries are sorted by (name, place) and the first of each name stays. The sorted array is a
    lambda variable, made once for each tag.
    """
    placed = F.array_sort(F.transform(entries, lambda s, i: F.struct(s["k"].alias("k"), i.alias("i"), s["v"].alias("v"))))
    firsts = F.transform(F.array(placed), lambda es: F.filter(es, lambda s, i: (i == 0) | (F.get(es, i - 1)["k"] != s["k"])))[0]
    return F.when(entries.isNotNull(), F.map_from_entries(F.transform(firsts, lambda s: F.struct(s["k"], s["v"]))))


def parse_attrs(tok: Column) -> Column:
    """H3: attribute map of an opening tag; names lower-cased, first one of a name wins."""
    return attrs_from_entries(attr_entries(tok))


def text_nodes(tokens: DataFrame, key: str = "page_id", runs: bool = False) -> DataFrame:
    """Merge each run of text/entity tokens into one text row.

    With ``runs`` (as in ``html_tokens``) the runs are one row each already, and no sort or
    aggregate is needed; ``html_elements`` then finds two pages under one key. Otherwise:

    The run is joined before any stripping; a run ends at any other token,
    including comments and tags of removed elements (nodes are never merged).
    A node is one non-text token plus the run after it: one grouped aggregate per
    node (linear in the run, unlike a whole-run window, which would copy the run's
    array into each of its rows), then an explode back to at most two rows.
    """
    kind, pos = F.col("kind"), F.col("pos")
    is_text = _in(kind, ["text", "entity"])
    if runs:
        keep = [c for c in tokens.columns if c not in (key, "pos", "tok", "kind", "tag", "attrs", "val")]
        return tokens.select(key, "pos", F.when(~is_text, F.col("tok")).alias("tok"), *keep,
                             F.when(is_text, F.lit("text")).otherwise(kind).alias("kind"), "tag", "attrs", F.col("val").alias("text"))
    # every page has one row at position 0: a second one means two pages under one key
    twice = F.sum(F.when(pos == 0, 1).otherwise(0)).over(_running(_w(key))) > 1
    node = F.sum(F.when(is_text, 0).otherwise(1)).over(_running(_w(key)))
    df = tokens.withColumn("_node", F.when(twice, F.raise_error(F.concat(F.lit(f"two pages have the same {key}: "), F.col(key).cast("string")))
                                           .cast("long")).otherwise(node))
    extra = [c for c in tokens.columns if c not in (key, "pos", "tok", "kind", "tag", "attrs", "val")]
    head = F.struct(pos.alias("pos"), F.col("tok").alias("tok"), kind.alias("kind"), F.col("tag").alias("tag"),
                    F.col("attrs").alias("attrs"))
    agg = df.groupBy(key, "_node").agg(
        F.min_by(F.when(~is_text, head), F.when(~is_text, pos)).alias("_h"),
        F.min(F.when(is_text, pos)).alias("_tpos"),
        F.array_sort(F.collect_list(F.when(is_text, F.struct(pos.alias("p"), F.col("val").alias("v"))))).alias("_run"),
        *[F.max(c).alias(c) for c in extra],
    )
    h = F.col("_h")
    null_s = F.lit(None).cast("string")
    out_rows = F.array(
        F.when(h.isNotNull(), F.struct(h["pos"].alias("pos"), h["tok"].alias("tok"), h["kind"].alias("kind"), h["tag"].alias("tag"),
                                       h["attrs"].alias("attrs"), null_s.alias("text"))),
        F.when(F.col("_tpos").isNotNull(), F.struct(
            F.col("_tpos").alias("pos"), null_s.alias("tok"), F.lit("text").alias("kind"), null_s.alias("tag"),
            F.lit(None).cast("map<string,string>").alias("attrs"),
            F.array_join(F.transform(F.col("_run"), lambda x: x["v"]), "").alias("text"))),
    )
    out = agg.select(key, *extra, F.explode(F.filter(out_rows, lambda r: r.isNotNull())).alias("_r"))
    return out.select(
        key, F.col("_r.pos").alias("pos"), F.col("_r.tok").alias("tok"),
        *[F.when(F.col("_r.pos") == 0, F.col(c)).alias(c) for c in extra],
        F.col("_r.kind").alias("kind"), F.col("_r.tag").alias("tag"), F.col("_r.attrs").alias("attrs"), F.col("_r.text").alias("text"),
    )


# ---------------------------------------------------------------------------
# H2: element extents
# ---------------------------------------------------------------------------

def _element_steps(key: str) -> list[dict]:
    """The column steps of ``html_elements`` (each step may read the previous ones)."""
    kind, tag, pos = F.col("kind"), F.col("tag"), F.col("pos")
    is_open = kind == "open"
    is_close = kind == "close"
    delta = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    steps = [
        {"_lvl": F.when(tag.isNotNull(), F.sum(delta).over(_running(_w(key, "tag"))))},
        # links do not nest: all their opens and closes are on one level
        {"_k": F.when((is_open | is_close) & (tag == "a"), F.lit(0)).when(is_open, F.col("_lvl")).when(is_close, F.col("_lvl") + 1)},
    ]
    w_pair = _w(key, "tag", "_k")
    steps.append({
        "_pair_close": F.when(is_open & (F.lead("kind").over(w_pair) == "close"), F.lead("pos").over(w_pair)),
        "_paired_close": is_close & (F.lag("kind").over(w_pair) == "open") & F.col("_k").isNotNull(),
        "_next_link": F.when(is_open & (tag == "a") & (F.lead("kind").over(w_pair) == "open"), F.lead("pos").over(w_pair)),
    })
    d = F.when(is_open & F.col("_pair_close").isNotNull(), 1).when(F.col("_paired_close"), -1).otherwise(0)
    w_pos = _w(key)
    # every page has one row at position 0: a second one means two pages under one key
    firsts = F.sum(F.when(pos == 0, 1).otherwise(0)).over(_whole(w_pos))
    twice = F.raise_error(F.concat(F.lit(f"two pages have the same {key}: "), F.col(key).cast("string"))).cast("bigint")
    steps.append({"_D": F.when(firsts > 1, twice).otherwise(F.coalesce(F.sum(d).over(_before(w_pos)), F.lit(0))), "_page_end": F.max("pos").over(_whole(w_pos))})
    w_scope = _before(_w(key, "_D", desc=True))
    opening = _in(kind, ["open", "void"])

    def nxt(cond: Column) -> Column:
        return F.min(F.when(cond, pos)).over(w_scope)

    groups: dict = {}
    for t, enders in IMPLIED_END.items():
        groups.setdefault(tuple(enders), []).append(t)
    nxt_cols = {"_scope_close": nxt(F.col("_paired_close")), "_nxt_p": nxt(opening & _in(tag, P_CLOSERS))}
    term = F.when(_in(tag, ["p"] + INLINE_TAGS), F.col("_nxt_p"))
    for i, (enders, tags) in enumerate(groups.items()):
        c = f"_nxt_{i}"
        nxt_cols[c] = nxt(opening & _in(tag, list(enders)))
        term = term.when(_in(tag, tags), F.col(c))
    steps.append(nxt_cols)
    limit = F.least(F.col("_scope_close"), term, F.col("_next_link"))
    e = (
        F.when(_in(kind, ["void", "raw"]), pos)
        .when(is_open & F.col("_pair_close").isNotNull(), F.col("_pair_close"))
        .when(is_open, F.coalesce(limit - 1, F.col("_page_end")))
    )
    steps.append({"e": e, "paired": F.when(is_open, F.col("_pair_close").isNotNull())})
    return steps


def html_elements(items: DataFrame, key: str = "page_id") -> DataFrame:
    """H2: add ``e`` (end position, inclusive) to every opening row.

    1. per tag, a running level pairs each open with its close (``lead`` inside
       the (tag, level) partition);
    2. ``D`` = number of *paired* elements enclosing the row;
    3. an element left open ends just before the first later row in the same
       ``D`` scope that is the enclosing element's close or a tag that implies
       its end (a new ``p`` ends an open ``p``, a new ``li`` an open ``li``...);
       with neither, at the end of the page.

    A link never holds a link: a new ``a`` ends the open one, and the close left over is ignored.
    """
    steps = _cached(f"elements:{key}", lambda: _element_steps(key))
    df = items
    for cols in steps:
        df = df.withColumns(cols)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c != "_page_end"]).withColumnRenamed("_page_end", "page_end")


# ---------------------------------------------------------------------------
# Pruning, empty containers, main region, hidden elements
# ---------------------------------------------------------------------------

def _names(classes: Column) -> Column:
    return F.split(F.trim(F.coalesce(classes, F.lit(""))), "[ \\t\\n\\r\\x0c]+")


def _class_list(attrs: Column) -> Column:
    return _names(attrs["class"])


def _has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(_class_list(attrs), name)


def is_hidden_style(attrs: Column) -> Column:
    """F8: inline style with spaces removed contains display:none or visibility:hidden."""
    s = F.replace(F.coalesce(attrs["style"], F.lit("")), F.lit(" "), F.lit(""))
    return s.contains("display:none") | s.contains("visibility:hidden")


def _covered(flag: Column, key: str, inclusive: bool = True) -> Column:
    """True when the row lies inside an element whose opening row has ``flag``."""
    w = _w(key)
    frame = _running(w) if inclusive else _before(w)
    reach = F.max(F.when(flag, F.col("e"))).over(frame)
    return F.coalesce(reach >= F.col("pos"), F.lit(False))


def prune_flags(elements: DataFrame, key: str = "page_id", chrome: bool = True, consent: bool = False) -> DataFrame:
    """H5 + H6 + H7 + H8: ``removed`` marks rows gone before region choice.

    ``pruned`` covers H5-H7 subtrees; ``removed`` adds div/span elements with
    no non-blank text left inside them (an image-only div goes with its image).
    """
    kind, tag, attrs = F.col("kind"), F.col("tag"), F.col("attrs")
    opening = _in(kind, OPENING)
    flag = _in(tag, NON_CONTENT_TAGS)
    if chrome:
        cls = F.arrays_overlap(_class_list(attrs), F.array(*[F.lit(c) for c in CHROME_CLASSES]))
        flag = flag | _in(tag, CHROME_TAGS) | (attrs["class"].isNotNull() & cls)
    if consent:
        ids = F.coalesce(attrs["class"], F.lit("")).contains(CONSENT_MARKERS[0])
        for m in CONSENT_MARKERS:
            ids = ids | F.coalesce(attrs["class"], F.lit("")).contains(m) | F.coalesce(attrs["id"], F.lit("")).contains(m)
        flag = flag | ids
    # <head> coverage shares this window pass; main_region needs it for the implied-body case
    df = elements.withColumns({
        "pruned": _covered(opening & flag, key),
        "in_head": _covered((kind == "open") & (tag == "head"), key),
    })
    nonblank = (kind == "text") & ~F.col("pruned") & (F.length(py_strip(F.col("text"))) > 0)
    # the next one in the order of the other windows, so that rows are not sorted again
    df = df.withColumn("_nb", F.when(nonblank, F.col("pos")))
    df = df.withColumn("_nxt", F.expr(f"lead(_nb, 1) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY pos)"))
    nxt_nb = F.col("_nxt")
    empty = opening & _in(tag, EMPTY_CHECK_TAGS) & ~F.col("pruned") & (nxt_nb.isNull() | (nxt_nb > F.col("e")))
    df = df.withColumn("_empty", empty)
    df = df.withColumn("removed", F.col("pruned") | _covered(F.col("_empty"), key))
    return df.drop("_empty", "_nb", "_nxt")


def region_priority(tag: Column, attrs: Column) -> Column:
    """H9: priority of a main-region candidate (lower wins); body is the fallback."""
    role = attrs["role"]
    ident = attrs["id"]
    return (
        F.when(tag == "main", 1)
        .when(tag == "article", 2)
        .when(role == "main", 3)
        .when(ident == "main", 4)
        .when(_has_class(attrs, "main-content"), 5)
        .when(ident == "content", 6)
        .when(_has_class(attrs, "content"), 7)
        .when(tag == "body", 8)
    )


def main_region(flagged: DataFrame, key: str = "page_id") -> DataFrame:
    """H9: ``region`` struct (prio, s, e) per page; first match in priority then document order."""
    opening = _in(F.col("kind"), ["open", "void"]) & ~F.col("removed")
    cand = F.when(opening, F.struct(region_priority(F.col("tag"), F.col("attrs")).alias("prio"), F.col("pos").alias("s"), F.col("e").alias("e")))
    cand = F.when(cand["prio"].isNotNull(), cand)
    df = flagged.withColumn("region", F.min(cand).over(Window.partitionBy(key)))
    # no region element at all: the whole document minus <head> (an implied body)
    in_head = F.col("in_head")
    inside = F.when(
        F.col("region").isNull(), ~in_head
    ).otherwise((F.col("pos") >= F.col("region")["s"]) & (F.col("pos") <= F.col("region")["e"]))
    return df.withColumn("in_region", inside & ~F.col("removed"))


# ---------------------------------------------------------------------------
# The block walk
# ---------------------------------------------------------------------------

def block_segments(region_rows: DataFrame, key: str = "page_id", part: str | None = None) -> DataFrame:
    """H10 + H12: block numbers over the rows of the main region.

    The walk descends through containers; the outermost non-container element
    or loose text node is one block. Hidden elements the walk reaches are
    skipped with their subtree.
    """
    keys = [key] + ([part] if part else [])
    kind, tag = F.col("kind"), F.col("tag")
    opening = _in(kind, OPENING)
    is_container = opening & _in(tag, CONTAINER_TAGS)
    nc_el = opening & ~is_container
    w_pos = _w(keys)
    nc_reach = F.max(F.when(nc_el, F.col("e"))).over(_before(w_pos))
    df = region_rows.withColumn("_walk", nc_reach.isNull() | (nc_reach < F.col("pos")))
    hid = F.col("_walk") & opening & is_hidden_style(F.col("attrs"))
    df = df.withColumn("_hidden", F.coalesce(F.max(F.when(hid, F.col("e"))).over(_running(w_pos)) >= F.col("pos"), F.lit(False)))
    start = F.col("_walk") & ~F.col("_hidden") & (nc_el | (kind == "text"))
    df = df.withColumn("_start", start)
    in_blk = ~F.col("_hidden") & (F.col("_start") | ~F.col("_walk"))
    # a block's first row is where it starts; the rows before every start are block 0
    first = F.coalesce(F.max(F.when(F.col("_start"), F.col("pos"))).over(_running(w_pos)), F.min(F.when(in_blk, F.col("pos"))).over(_running(w_pos)))
    df = df.withColumns({"blk": F.sum(F.when(F.col("_start"), 1).otherwise(0)).over(_running(w_pos)), "root_s": first})
    if part:
        # rows of the other copies (whole-page text, anchor) form one block each
        is_walk = F.col(part) == "walk"
        df = df.withColumn("blk", F.when(is_walk, F.col("blk")).otherwise(F.lit(0).cast("bigint")))
        in_blk = in_blk | ~is_walk
    return df.filter(in_blk).drop("_walk", "_hidden", "_start")


def block_units(blocks: DataFrame, key: str = "page_id", part: str | None = None) -> DataFrame:
    """Direct children and list items of each block, and the extents of table parts.

    Every table row and cell gets a second row (``kind = 'end'``) at its end position. Running
    counts of cells, header cells, texts and rows at both places say what the element holds, at
    any depth: its cells and texts are ranges of the block's cells and texts.
    """
    keys = [key] + ([part] if part else [])
    kind, tag, pos = F.col("kind"), F.col("tag"), F.col("pos")
    open_part = (kind == "open") & _in(tag, ["td", "th", "tr"])
    at = F.array(F.struct(F.col("pos").alias("p"), F.lit(0).alias("o")))
    both = F.when(open_part, F.array(F.struct(F.col("pos").alias("p"), F.lit(0).alias("o")), F.struct(F.col("e").alias("p"), F.lit(1).alias("o")))).otherwise(at)
    df = blocks.withColumn("_s", pos).withColumn("_at", F.explode(both)).withColumns({
        "pos": F.col("_at.p"), "_ord": F.col("_at.o"), "kind": F.when(F.col("_at.o") == 1, F.lit("end")).otherwise(kind)}).drop("_at")
    real = F.col("_ord") == 0
    opening = real & _in(kind, OPENING)
    df = df.withColumn(AS_SORTED, F.collate(F.substring(kind, 1, 0), "UTF8_LCASE"))
    w_blk = Window.partitionBy(key, AS_SORTED, *keys[1:], "blk").orderBy("pos", "_ord")
    run = _running(w_blk)
    inner = pos > F.col("root_s")
    # pass 1: direct-child test and the running counts of table parts
    reach = F.max(F.when(inner & opening, F.col("e"))).over(_before(w_blk))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(run)
    is_open = real & (kind == "open")
    df = df.withColumns({
        "_top": real & inner & (reach.isNull() | (reach < pos)),
        "n_cell": count(is_open & inner & _in(tag, ["td", "th"])), "n_th": count(is_open & inner & (tag == "th")),
        "n_text": count(real & (kind == "text")), "n_row": count(real),
    })
    # pass 2: unit number = running count of direct children; rendering only reads where a unit starts
    df = df.withColumn("unit_start", F.col("_top") & (opening | (kind == "text")))
    df = df.withColumn("unit", F.sum(F.when(F.col("unit_start"), 1).otherwise(0)).over(run))
    if part:
        df = df.withColumn("unit", F.when(F.col(part) == "walk", F.col("unit")).otherwise(F.lit(0).cast("bigint")))
    return df.drop("_top")


# ---------------------------------------------------------------------------
# rendering
# ---------------------------------------------------------------------------

def _ordered_join(val: Column, sep: str) -> Column:
    """``array_join`` of a per-group ``collect_list`` sorted by ``pos``."""
    arr = F.array_sort(F.collect_list(F.when(val.isNotNull(), F.struct(F.col("pos").alias("p"), val.alias("v")))))
    return F.array_join(F.transform(arr, lambda x: x["v"]), sep)


def _link(text: Column, href: Column) -> Column:
    """a link only with text and href not starting with 'javascript:'."""
    ok = (text != "") & href.isNotNull() & (href != "") & ~href.startswith("javascript:")
    return F.when(ok, F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")"))).when(text != "", text)


def render_blocks(units: DataFrame, key: str = "page_id", part: str | None = None) -> DataFrame:
    """One markdown string (or null) per block, in ``blk`` order.

    One grouped aggregate holds each block's rows in order; its units (direct children, list
    items) are ranges of them.
    """
    keys = [key] + ([part] if part else [])
    has_url = "url" in units.columns
    e = _cached(f"render:{has_url}", lambda: _render_exprs(has_url))
    blocks = _block_rows(units, keys, e).withColumn("txt_nl", e["txt_nl"])
    extra = ["url", "txt_nl", AS_SORTED] if has_url else ["txt_nl", AS_SORTED]
    return blocks.withColumn("md", e["md"]).select(
        *keys, "blk", F.col("root")["tag"].alias("block_tag"), F.col("root")["kind"].alias("block_kind"), "md", *extra
    )


def inline_parts(units: DataFrame, key: str = "page_id") -> DataFrame:
    """The inline part of each direct child of a paragraph (nulls left out)."""
    e = _cached("render:False", lambda: _render_exprs(False))
    blocks = _block_rows(units, [key], e).filter(F.col("root.tag") == "p")
    return blocks.select(key, "blk", F.explode(e["parts"]).alias("_u")).select(key, "blk", "_u.unit", "_u.tag", "_u.inline")


def _block_rows(units: DataFrame, keys: list[str], e: dict) -> DataFrame:
    """One row for each block: ``rows`` and ``ends`` in order of their places, and ``root``."""
    df = units.withColumns(e["row"])
    blocks = df.groupBy(keys[0], AS_SORTED, *keys[1:], "blk").agg(*e["agg"])
    return blocks.withColumn("rows", F.sort_array("rows")).withColumn("root", e["root"])


def _render_exprs(has_url: bool) -> dict:
    """The column expressions of the render stage (built once per JVM)."""
    kind, tag, pos = F.col("kind"), F.col("tag"), F.col("pos")
    is_text = kind == "text"
    real = kind != "end"
    stripped = py_strip(F.col("text"))
    nonempty = F.when(is_text & (F.length(stripped) > 0), stripped)
    url_cols = [F.max("url").alias("url")] if has_url else []

    # a table part's start (its open row) or end (its end row), with the counts before or up to it
    opened = real & (kind == "open") & (pos > F.col("root_s")) & _in(tag, ["td", "th", "tr"])
    edge = F.struct(
        F.col("_s").alias("s"), (tag == "tr").alias("tr"), (F.col("n_cell") - F.when(opened & (tag != "tr"), 1).otherwise(0)).alias("cells"),
        (F.col("n_th") - F.when(opened & (tag == "th"), 1).otherwise(0)).alias("ths"), F.col("n_text").alias("texts"),
        (F.col("n_row") - F.when(opened, 1).otherwise(0)).alias("rows"),
    )
    row = {
        "_row": F.when(real, F.struct(
            pos.alias("p"), F.col("unit_start").alias("first"), kind.alias("kind"), tag.alias("tag"), F.col("e").alias("e"), nonempty.alias("ne"),
            F.when(is_text, F.col("text")).alias("t"), F.col("tok").alias("tok"), F.when(opened, edge).alias("start"),
            (pos == F.col("root_s")).alias("root"), *[F.col("attrs")[a].alias(a) for a in ("href", "src", "alt", "class")])),
        "_end": F.when((kind == "end") & (F.col("_s") > F.col("root_s")), edge),
    }
    agg = [*url_cols, F.collect_list("_row").alias("rows"), F.collect_list("_end").alias("ends")]
    rows = F.col("rows")
    joined = lambda rs, field, sep="": F.array_join(F.transform(rs, lambda r: r[field]), sep)

    def inline(head: Column, txt: Column, raw: Column) -> Column:
        """The part that a direct child of a paragraph makes."""
        htag = head["tag"]
        return (
            F.when(head["kind"] == "text", F.when(txt != "", txt))
            .when(_in(htag, ["strong", "b"]), F.when(txt != "", F.concat(F.lit("**"), txt, F.lit("**"))))
            .when(_in(htag, ["em", "i"]), F.when(txt != "", F.concat(F.lit("*"), txt, F.lit("*"))))
            .when(htag == "code", _once(raw, lambda r: F.when(r != "", F.concat(F.lit("`"), r, F.lit("`")))))
            .when(htag == "a", _link(txt, head["href"]))
            .when(htag == "br", F.lit("\n"))
            .when(head["kind"].isin("open", "void", "raw"), F.when(txt != "", txt))
        )

    def unit(number: Column, at: Column, stop: Column) -> Column:
        """One unit from its first row up to the next unit's; its texts are made once."""
        made = F.slice(rows, at + 1, F.coalesce(stop, F.size(rows)) - at)
        head = lambda xs: F.get(xs, F.lit(0))
        return _once(made, lambda xs: _once(joined(xs, "ne"), lambda txt: F.struct(
            number.cast("bigint").alias("unit"), head(xs)["tag"].alias("tag"), head(xs)["kind"].alias("kind"), txt.alias("txt"),
            inline(head(xs), txt, joined(xs, "t")).alias("inline"))))

    # the rows before the first direct child, such as the block's own, are in no unit
    starts = F.filter(F.transform(rows, lambda r, i: F.when(r["first"], i)), lambda i: i.isNotNull())
    units = _once(starts, lambda ss: F.transform(ss, lambda i, j: unit(j + 1, i, F.get(ss, j + 1))))
    parts = F.filter(units, lambda u: u["inline"].isNotNull())

    # both lists hold the same parts in the order of their starts
    opens = F.filter(F.transform(rows, lambda r: r["start"]), lambda x: x.isNotNull())
    extents = F.transform(F.arrays_zip(opens.alias("starts"), F.sort_array("ends").alias("ends")), lambda z: F.struct(
        z["starts"]["tr"].alias("tr"), z["starts"]["cells"].alias("c0"), z["ends"]["cells"].alias("c1"), (z["ends"]["ths"] > z["starts"]["ths"]).alias("th"),
        z["starts"]["texts"].alias("t0"), z["ends"]["texts"].alias("t1"), z["starts"]["rows"].alias("r0"), z["ends"]["rows"].alias("r1")))
    table_rows = F.transform(rows, lambda r: F.struct(r["ne"].alias("ne"), r["t"].alias("t"), F.coalesce(r["t"], r["tok"]).alias("s")))
    # the first code element of a block: a pre block's root is none, so there it is the first inner one
    code_el = F.get(F.filter(rows, lambda r: (r["kind"] == "open") & (r["tag"] == "code")), F.lit(0))
    code_raw = lambda c: F.array_join(F.transform(F.filter(rows, lambda r: (r["p"] >= c["p"]) & (r["p"] <= c["e"])), lambda r: r["t"]), "")
    return {
        "row": row, "agg": agg, "txt_nl": joined(rows, "ne", "\n"), "parts": parts,
        "root": F.get(F.filter(rows, lambda r: r["root"]), F.lit(0)),
        "md": _render_block(F.col("root"), joined(rows, "ne"), joined(rows, "t"), units, parts, code_el, code_raw, _table_lines(extents, table_rows)),
    }


def _range(array: Column, start: Column, stop: Column) -> Column:
    """Items start … stop - 1, read one by one."""
    return F.when(stop > start, F.transform(F.sequence(start, stop - 1), lambda i: F.get(array, i.cast("int")))).otherwise(F.slice(array, 1, 0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once, as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def _table_lines(extents: Column, rows: Column) -> Column:
    """Every tr with all cells below it, at any depth; null without a tr.

    A separator follows each row that has a header cell and equals the first row.
    """
    def lines(trs: Column, cells: Column, texts: Column, tokens: Column) -> Column:
        cell_text = F.transform(cells, lambda c: F.array_join(_range(texts, c["t0"], c["t1"]), ""))

        def line(r: Column, cell: Column, first: Column) -> Column:
            row = F.concat(F.lit("| "), F.array_join(_range(cell, r["c0"], r["c1"]), " | "), F.lit(" |"))
            rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), (r["c1"] - r["c0"]).cast("int")), " | "), F.lit(" |"))
            same = F.array_join(_range(tokens, r["r0"], r["r1"]), "") == first
            return F.when(r["c1"] > r["c0"], F.when(r["th"] & same, F.concat(row, rule)).otherwise(row))

        first = F.when(F.size(trs) > 0, F.array_join(_range(tokens, F.get(trs, F.lit(0))["r0"], F.get(trs, F.lit(0))["r1"]), "")).otherwise(F.lit(""))
        return _once(cell_text, lambda cell: _once(first, lambda f: F.filter(F.transform(trs, lambda r: line(r, cell, f)), lambda x: x.isNotNull())))

    def with_parts(xs: Column, rs: Column) -> Column:
        trs = F.filter(xs, lambda x: x["tr"])
        cells = F.filter(xs, lambda x: ~x["tr"])
        texts = F.transform(F.filter(rs, lambda r: r["t"].isNotNull()), lambda r: F.coalesce(r["ne"], F.lit("")))
        tokens = F.transform(rs, lambda r: F.coalesce(r["s"], F.lit("")))
        made = _once(trs, lambda a: _once(cells, lambda b: _once(texts, lambda c: _once(tokens, lambda d: lines(a, b, c, d)))))
        text = lambda ls: F.concat(F.lit("\n"), F.array_join(ls, "\n"), F.when(F.size(ls) > 0, F.lit("\n")).otherwise(F.lit("")))
        return F.when(F.exists(xs, lambda x: x["tr"]), _once(made, text))

    return _once(extents, lambda xs: _once(rows, lambda rs: with_parts(xs, rs)))


def _render_block(root: Column, full_txt: Column, full_raw: Column, units: Column, inline: Column, code_el: Column, code_raw, table: Column) -> Column:
    """``full_txt``: the text of the whole block, every node stripped, glued without separator."""
    rtag, rkind = root["tag"], root["kind"]
    once = lambda value, use: _once(value, lambda v: F.when(v != "", use(v)))

    # H13 heading
    level = F.regexp_extract(rtag, "^h([1-6])$", 1).cast("int")
    heading = once(full_txt, lambda t: F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t, F.lit("\n")))
    # H14/H15 paragraph
    paragraph = _once(inline, lambda us: F.when(F.size(us) > 0, F.concat(F.array_join(F.transform(us, lambda u: u["inline"]), " "), F.lit("\n"))))
    # H16 lists: numbering counts every direct li, empty ones included
    lis = F.filter(units, lambda u: (u["kind"] == "open") & (u["tag"] == "li"))
    numbered = F.transform(lis, lambda x, i: F.struct(x["txt"].alias("t"), (i + 1).alias("n")))
    bullet = F.when(rtag == "ul", F.lit("- "))
    items = F.transform(
        F.filter(numbered, lambda x: x["t"] != ""),
        lambda x: F.concat(F.coalesce(bullet, F.concat(x["n"].cast("string"), F.lit(". "))), x["t"]),
    )
    listing = _once(items, lambda xs: F.concat(F.lit("\n"), F.array_join(xs, "\n"), F.when(F.size(xs) > 0, F.lit("\n")).otherwise(F.lit(""))))
    # H17 blockquote
    qlines = lambda t: F.transform(
        F.filter(F.split(t, "\n"), lambda x: F.length(py_strip(x)) > 0), lambda x: F.concat(F.lit("> "), py_strip(x))
    )
    quote = once(full_txt, lambda t: F.concat(F.lit("\n"), F.array_join(qlines(t), "\n"), F.lit("\n")))
    # H18 code block: text of the first inner code element (else of pre), language from its class
    lang_cls = lambda c: F.filter(_names(c["class"]), lambda x: x.contains("language-"))
    lang = lambda c: F.coalesce(F.replace(F.try_element_at(lang_cls(c), F.lit(1)), F.lit("language-"), F.lit("")), F.lit(""))
    pre = _once(code_el, lambda c: once(
        F.when(c.isNotNull(), code_raw(c)).otherwise(full_raw),
        lambda t: F.concat(F.lit("\n```"), F.when(c.isNotNull(), lang(c)).otherwise(F.lit("")), F.lit("\n"), py_strip(t), F.lit("\n```\n"))))
    # H19 block-level code
    code = once(full_raw, lambda t: F.concat(F.lit("`"), t, F.lit("`")))
    # H21 image, H22 link, H23 anything else
    src = F.coalesce(root["src"], F.lit(""))
    image = F.when(src != "", F.concat(F.lit("!["), F.coalesce(root["alt"], F.lit("")), F.lit("]("), src, F.lit(")")))
    link = _once(full_txt, lambda t: _link(t, root["href"]))
    other = _once(full_txt, lambda t: F.when(F.length(t) > 2, t))
    # loose text node at walk level
    loose = _once(full_txt, lambda t: F.when(F.length(t) > 1, t))

    return (
        F.when(rkind == "text", loose)
        .when(_in(rtag, HEADING_TAGS), heading)
        .when(rtag == "p", paragraph)
        .when(_in(rtag, ["ul", "ol"]), listing)
        .when(rtag == "blockquote", quote)
        .when(rtag == "pre", pre)
        .when(rtag == "code", code)
        .when(rtag == "table", table)
        .when(rtag == "img", image)
        .when(rtag == "a", link)
        .otherwise(other)
    )


# ---------------------------------------------------------------------------
# The whole chain
# ---------------------------------------------------------------------------

def prepare(pages: DataFrame, key: str = "page_id", chrome: bool = True, consent: bool = False, repartition: bool = True,
            num_partitions: int | None = None) -> DataFrame:
    """Tokens with element extents, prune flags and the main region (H1-H9).

    ``num_partitions`` sizes the one exchange. By default that follows the optimizer's estimate of
    the pages' bytes, ``PAGE_BYTES`` of them a partition, and is at least ``spark.sql.shuffle.partitions``.
    AQE does not coalesce a number given so: it goes by the bytes of the pages, not of their tokens.
    """
    if repartition:
        # the only exchange of the whole chain: every later window and aggregate
        # is keyed by the page key (plus sub-keys) and reuses this partitioning
        pages = pages.repartition(num_partitions or size_partitions(pages, PAGE_BYTES), key)
    toks = classify_tokens(html_tokens(pages, key, runs=True), runs=True)
    items = text_nodes(toks, key, runs=True)
    el = html_elements(items, key)
    fl = prune_flags(el, key, chrome=chrome, consent=consent)
    return main_region(fl, key)


def page_markdown(pages: DataFrame, key: str = "page_id", chrome: bool = True, consent: bool = False,
                  repartition: bool = True, denoise: bool = True, num_partitions: int | None = None) -> DataFrame:
    """``(key, url, content, estimated_tokens)``, one row per page.

    The main-region walk and the whole-page text fallback (H26) travel through
    the same aggregates as two copies of the rows (``part``), so the token
    chain is computed once.
    """
    reg = prepare(pages, key, chrome=chrome, consent=consent, repartition=repartition, num_partitions=num_partitions)
    kind = F.col("kind")
    fb = (kind == "text") & ~F.col("removed")
    walk = F.col("in_region") & ~_in(kind, ["comment", "decl", "none"])
    anchor = F.col("pos") == 0
    copies = F.filter(
        F.array(
            F.when(walk, F.lit("walk")),
            F.when(fb, F.lit("fallback")),
            F.when(anchor, F.lit("anchor")),
        ),
        lambda x: x.isNotNull(),
    )
    rows = reg.select("*", F.explode(copies).alias("part"))
    blocks = render_blocks(block_units(block_segments(rows, key, "part"), key, "part"), key, "part")
    walk_md = F.when(F.col("part") == "walk", F.struct(F.col("blk").alias("p"), F.col("md").alias("v")))
    # H24 assembly + H26 fallback, one aggregate per page
    page = blocks.groupBy(key, AS_SORTED).agg(
        F.max("url").alias("url"),
        F.array_sort(F.collect_list(walk_md)).alias("_blocks"),
        F.max(F.when(F.col("part") == "fallback", F.col("txt_nl"))).alias("_fb"),
    )
    return page.select(key, "url", _cached(f"assemble:{denoise}", lambda: _assemble(denoise)).alias("content")).withColumn(
        "estimated_tokens", _cached("tokens", lambda: token_estimate(F.col("content"))))


def _assemble(denoise: bool) -> Column:
    """H24 join + H25 normalise + H26 fallback (+ N0-N10) over the page aggregate."""
    mds = F.filter(F.transform(F.col("_blocks"), lambda x: x["v"]), lambda x: x.isNotNull())
    md = normalize_lines(F.array_join(mds, "\n"))
    fallback = F.coalesce(F.col("_fb"), F.lit(""))
    md = F.when(md == "", fallback).otherwise(md)
    return noise_filter(md) if denoise else md
