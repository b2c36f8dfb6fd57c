"""The page-to-markdown chain written as one DuckDB statement (oracle for H2, H9, H27).

It restates the same rules as ``operators/html.py`` with DuckDB's window
functions and aggregates, written from the rules rather than from the Spark plan:
per-tag levels pair tags, the paired-depth scope gives implied ends, running maxima
of extent ends give containment, and ordered string aggregates render the blocks.
Both engines use the same regex texts (RE2-compatible, no back-references).
"""

from __future__ import annotations

from ..functions.text import HWS_CLASS, WS
from ..operators import html as H
from .corpus import WIDE_TAG

NL = "chr(10)"
HWS = HWS_CLASS[1:-1]
OPENING = "('open', 'void', 'raw')"


HIDDEN = "(contains(replace(coalesce(a_style, ''), ' ', ''), 'display:none') OR contains(replace(coalesce(a_style, ''), ' ', ''), 'visibility:hidden'))"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _lst(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _arr(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def est(x: str) -> str:
    return f"(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)::BIGINT"


def _classes(x: str) -> str:
    return f"regexp_split_to_array(trim(coalesce({x}, '')), '[ \\t\\n\\r\\x0c]+')"


def _attr_value(pair: str) -> str:
    val = (f"regexp_replace(regexp_replace({pair}, '^[^=]*=[{H.SP}]*', ''), "
           f"'(?s)^\"(.*)\"$|^''(.*)''$', '\\1\\2')")
    return f"CASE WHEN {pair} IS NULL THEN NULL WHEN contains({pair}, '=') THEN {_decoded(val)} ELSE '' END"


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{_sq(k)}': '{_sq(v)}'" for k, v in sorted(pairs.items())) + "}"


def _numeric(t: str) -> tuple[str, str]:
    """(whether ``t`` is a numeric reference, its character)."""
    dec, hexa = (f"ltrim(regexp_extract({t}, '^&#{x}', 1), '0')" for x in ("([0-9]+)", "[xX]([0-9a-fA-F]+)"))
    one = (f"CASE WHEN regexp_matches({t}, '^&#[0-9]') THEN {_cp(f'CASE WHEN length({dec}) BETWEEN 1 AND 7 THEN TRY_CAST({dec} AS BIGINT) END')} "
           f"ELSE {_cp(f"CASE WHEN length({hexa}) BETWEEN 1 AND 6 THEN TRY_CAST('0x' || {hexa} AS BIGINT) END")} END")
    return f"starts_with({t}, '&#')", one


def text_reference(t: str) -> str:
    """A reference token of a text: numeric, a whole name, else its longest beginning that needs no semicolon."""
    is_number, number = _numeric(t)
    whole = _map({f"&{k};": chr(v) for k, v in H._ENTITY_MAP.items()})
    bare = _map({f"&{k}": v for k, v in H._BARE_MAP.items()})
    tries = ", ".join(f"{bare}[substr({t}, 1, {n})] || substr({t}, {n + 1})" for n in range(max(map(len, H._BARE_MAP)) + 1, 2, -1))
    return f"CASE WHEN {is_number} THEN {number} ELSE coalesce({whole}[{t}], {tries}, {t}) END"


def _decoded(val: str) -> str:
    """Character references anywhere in ``val``: cut it at references and look each one up."""
    is_number, number = _numeric("t")
    names = _map({f"&{k};": chr(v) for k, v in H._ENTITY_MAP.items()} | {f"&{k}": v for k, v in H._BARE_MAP.items()})
    pieces = f"regexp_extract_all({val}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|&|[^&]+')"
    one = f"CASE WHEN regexp_matches(t, '^&#([0-9]|[xX][0-9a-fA-F])') THEN {number} ELSE coalesce({names}[t], t) END"
    return f"CASE WHEN contains({val}, '&') THEN array_to_string(list_transform({pieces}, lambda t: {one}), '') ELSE {val} END"


#: The token rules once more, in RE2 and in other words than the Spark chain's.
_TAG = f"(?:[^>=]|=[{H.SP}]*(?:\"[^\"]*(?:\"|\\z)|'[^']*(?:'|\\z))?)*"
TOKENS_RE2 = "|".join([
    "(?s:<!--(?:>|->|.*?-->|.*))",
    *(f"(?is:<{t}[{H.SP}/>].*?</{t}(?:[{H.SP}/][^>]*)?(?:>|\\z)|<{t}[{H.SP}/>].*)" for t in ("script", "style", "textarea")),
    f"<[A-Za-z]{_TAG}>?", f"</[A-Za-z]{_TAG}>?", "<![^>]*>?", "<[?][^>]*>?",
    "&#[0-9]+;?", "&#[xX][0-9a-fA-F]+;?", "&[A-Za-z][A-Za-z0-9]*;?", "[^<&]+", "<", "&"])
_PAIRS = (f"regexp_extract_all(regexp_replace(regexp_extract(tok, '{_sq(f"^<[A-Za-z]{_TAG}")}'), '^<[A-Za-z][^{H.SP}/>]*', ''), "
          f"'{_sq(f"[^{H.SP}\"'>/=]+(?:[{H.SP}]*=[{H.SP}]*(?:\"[^\"]*\"|'[^']*'|[^{H.SP}\"'>][^{H.SP}>]*))?")}')")


def tokens_of(pages: str) -> str:
    """``(page_id, pos, tok)`` of the pages of a table or subquery."""
    return f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, tok FROM (
    SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS tok
    FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_sq(TOKENS_RE2)}') AS t FROM {pages}))"""


def _attr_name(pair: str) -> str:
    return f"lower(regexp_extract({pair}, '^({_sq(H.ATTR_NAME)})', 1))"


def _attr(name: str) -> str:
    pick = f"list_filter(pairs, lambda p: {_attr_name('p')} = '{name}')[1]"
    return f"{_attr_value(pick)} AS a_{name}"


def _cp(cp: str) -> str:
    return f"CASE WHEN {cp} BETWEEN 1 AND 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) THEN chr(CAST({cp} AS INTEGER)) ELSE chr(65533) END"


def _region_prio() -> str:
    return """CASE WHEN tag = 'main' THEN 1 WHEN tag = 'article' THEN 2 WHEN a_role = 'main' THEN 3 WHEN a_id = 'main' THEN 4
      WHEN list_contains(cls, 'main-content') THEN 5 WHEN a_id = 'content' THEN 6 WHEN list_contains(cls, 'content') THEN 7
      WHEN tag = 'body' THEN 8 END"""


def _terminator() -> str:
    groups: dict = {}
    for t, enders in H.IMPLIED_END.items():
        groups.setdefault(tuple(enders), []).append(t)
    cols, case = [], [f"WHEN tag IN {_lst(['p'] + H.INLINE_TAGS)} THEN nxt_p"]
    for i, (enders, tags) in enumerate(groups.items()):
        cols.append(f"min(CASE WHEN kind IN ('open', 'void') AND tag IN {_lst(enders)} THEN pos END) OVER ws AS nxt_{i}")
        case.append(f"WHEN tag IN {_lst(tags)} THEN nxt_{i}")
    return ",\n      ".join(cols), "CASE " + " ".join(case) + " END"


def chain_ctes(pages_sql: str, consent: bool = False) -> str:
    """CTEs ending in ``r3`` (flagged rows with ``in_region``) and ``blocks`` / ``page_md``."""
    nxt_cols, term = _terminator()
    prune_flag = (f"tag IN {_lst(H.NON_CONTENT_TAGS + H.CHROME_TAGS)} OR list_has_any(cls, {_arr(H.CHROME_CLASSES)})")
    if consent:
        for m in H.CONSENT_MARKERS:
            prune_flag += f" OR contains(coalesce(a_class, ''), '{m}') OR contains(coalesce(a_id, ''), '{m}')"
    hidden = HIDDEN
    nonempty = f"CASE WHEN kind = 'text' AND length({strip('text')}) > 0 THEN {strip('text')} END"
    return f"""
pg AS ({pages_sql}),
tk AS ({tokens_of("pg")}),
c0 AS (
  SELECT *, CASE WHEN starts_with(tok, '<!--') THEN 'comment'
      WHEN regexp_matches(tok, '^<[!?]') THEN 'decl'
      WHEN regexp_matches(tok, '(?i)^<(script|style|textarea)[{H.SP}/>]') THEN 'raw'
      WHEN regexp_matches(tok, '^</?[A-Za-z]') AND NOT ends_with(tok, '>') THEN 'decl'
      WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close'
      WHEN regexp_matches(tok, '^<[A-Za-z]') AND (lower(regexp_extract(tok, '{H.TAG_NAME_RE}', 1)) IN {_lst(H.VOID_TAGS)}
           OR regexp_matches(tok, '{H.SELF_CLOSE_RE}')) THEN 'void'
      WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open'
      WHEN regexp_matches(tok, '^&#?[A-Za-z0-9]') THEN 'entity'
      ELSE 'text' END AS kind
  FROM tk),
c1 AS (
  SELECT *, CASE WHEN kind IN ('open', 'void', 'raw', 'close') THEN lower(regexp_extract(tok, '{H.TAG_NAME_RE}', 1)) END AS tag,
         CASE WHEN kind IN {OPENING} THEN {_PAIRS} END AS pairs
  FROM c0),
c2 AS (
  SELECT c1.* EXCLUDE (pairs), {_attr('class')}, {_attr('id')}, {_attr('role')}, {_attr('style')},
         {_attr('href')}, {_attr('src')}, {_attr('alt')},
         CASE WHEN kind = 'text' THEN tok WHEN kind = 'entity' THEN {text_reference('tok')} END AS val
  FROM c1),
n0 AS (
  SELECT *, kind IN ('text', 'entity') AS is_text,
         sum(CASE WHEN kind IN ('text', 'entity') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS node
  FROM c2),
it AS (
  SELECT page_id, pos, tok, kind, tag, a_class, a_id, a_role, a_style, a_href, a_src, a_alt, CAST(NULL AS VARCHAR) AS text
  FROM n0 WHERE NOT is_text
  UNION ALL
  SELECT page_id, min(pos), NULL, 'text', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, string_agg(val, '' ORDER BY pos)
  FROM n0 WHERE is_text GROUP BY page_id, node),
e1 AS (
  SELECT *, CASE WHEN tag IS NOT NULL THEN sum(CASE WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END)
             OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS lvl,
         {_classes('a_class')} AS cls
  FROM it),
e2 AS (SELECT *, CASE WHEN tag = 'a' AND kind IN ('open', 'close') THEN 0 WHEN kind = 'open' THEN lvl WHEN kind = 'close' THEN lvl + 1 END AS k FROM e1),
e3 AS (
  SELECT *, CASE WHEN kind = 'open' AND lead(kind) OVER w = 'close' THEN lead(pos) OVER w END AS pair_close,
         (kind = 'close' AND lag(kind) OVER w = 'open' AND k IS NOT NULL) AS paired_close,
         CASE WHEN kind = 'open' AND tag = 'a' AND lead(kind) OVER w = 'open' THEN lead(pos) OVER w END AS next_link
  FROM e2 WINDOW w AS (PARTITION BY page_id, tag, k ORDER BY pos)),
e4 AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'open' AND pair_close IS NOT NULL THEN 1 WHEN paired_close THEN -1 ELSE 0 END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS D,
         max(pos) OVER (PARTITION BY page_id) AS page_end
  FROM e3),
e5 AS (
  SELECT *, min(CASE WHEN paired_close THEN pos END) OVER ws AS scope_close,
      min(CASE WHEN kind IN ('open', 'void') AND tag IN {_lst(H.P_CLOSERS)} THEN pos END) OVER ws AS nxt_p,
      {nxt_cols}
  FROM e4 WINDOW ws AS (PARTITION BY page_id, D ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
el AS (
  SELECT *, CASE WHEN kind IN ('void', 'raw') THEN pos
                 WHEN kind = 'open' AND pair_close IS NOT NULL THEN pair_close
                 WHEN kind = 'open' THEN coalesce(least(scope_close, {term}, next_link) - 1, page_end) END AS e,
         CASE WHEN kind = 'open' THEN pair_close IS NOT NULL END AS paired
  FROM e5),
p1 AS (
  SELECT *, coalesce(max(CASE WHEN kind IN {OPENING} AND ({prune_flag}) THEN e END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) >= pos, false) AS pruned
  FROM el),
p2 AS (
  SELECT *, min(CASE WHEN kind = 'text' AND NOT pruned AND length({strip('text')}) > 0 THEN pos END)
             OVER (PARTITION BY page_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nxt_nb
  FROM p1),
p3 AS (
  SELECT *, pruned OR coalesce(max(CASE WHEN kind IN {OPENING} AND tag IN ('div', 'span') AND NOT pruned
                                             AND (nxt_nb IS NULL OR nxt_nb > e) THEN e END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) >= pos, false) AS removed
  FROM p2),
r1 AS (SELECT *, CASE WHEN kind IN ('open', 'void') AND NOT removed THEN {_region_prio()} END AS prio FROM p3),
r2 AS (
  SELECT *, min(CASE WHEN prio IS NOT NULL THEN {{'prio': prio, 's': pos, 'e': e}} END) OVER (PARTITION BY page_id) AS region,
         coalesce(max(CASE WHEN kind = 'open' AND tag = 'head' THEN e END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) >= pos, false) AS in_head
  FROM r1),
r3 AS (
  SELECT *, (CASE WHEN region IS NULL THEN NOT in_head ELSE pos >= region.s AND pos <= region.e END) AND NOT removed AS in_region
  FROM r2),
w0 AS (
  SELECT *, kind IN {OPENING} AND NOT tag IN {_lst(H.CONTAINER_TAGS)} AS nc_el
  FROM r3 WHERE in_region AND kind NOT IN ('comment', 'decl', 'none')),
w1 AS (
  SELECT *, coalesce(max(CASE WHEN nc_el THEN e END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < pos, true) AS walk
  FROM w0),
w2 AS (
  SELECT *, coalesce(max(CASE WHEN walk AND kind IN {OPENING} AND {hidden} THEN e END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) >= pos, false) AS hidden
  FROM w1),
w3 AS (
  SELECT *, sum(CASE WHEN walk AND NOT hidden AND (nc_el OR kind = 'text') THEN 1 ELSE 0 END)
             OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS blk,
         walk AND NOT hidden AND (nc_el OR kind = 'text') AS bstart
  FROM w2),
b0 AS (SELECT * FROM w3 WHERE NOT hidden AND (bstart OR NOT walk)),
b1 AS (
  SELECT *, min(pos) OVER (PARTITION BY page_id, blk) AS root_s,
         first_value(tag) OVER (PARTITION BY page_id, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'table' AS is_table
  FROM b0),
b2 AS (
  SELECT *, pos > root_s AND coalesce(max(CASE WHEN pos > root_s AND kind IN {OPENING} THEN e END)
             OVER (PARTITION BY page_id, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < pos, true) AS top
  FROM b1),
b3 AS (
  SELECT *, sum(CASE WHEN top AND (kind IN {OPENING} OR kind = 'text') THEN 1 ELSE 0 END) OVER wb AS unit,
         min(CASE WHEN pos > root_s AND kind = 'open' AND tag = 'code' THEN pos END) OVER (PARTITION BY page_id, blk) AS code_s
  FROM b2 WINDOW wb AS (PARTITION BY page_id, blk ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b5 AS (
  SELECT *, max(CASE WHEN pos = code_s THEN e END) OVER (PARTITION BY page_id, blk) AS code_e,
         max(CASE WHEN pos = code_s THEN a_class END) OVER (PARTITION BY page_id, blk) AS code_class
  FROM b3),
tb AS (SELECT * FROM b5 WHERE is_table),
trs AS (SELECT page_id, blk, pos AS tr, e FROM tb WHERE pos > root_s AND kind = 'open' AND tag = 'tr'),
cells AS (SELECT page_id, blk, pos AS cell, e, tag FROM tb WHERE pos > root_s AND kind = 'open' AND tag IN ('td', 'th')),
cell_txt AS (
  SELECT c.page_id, c.blk, c.cell, any_value(c.tag) AS tag, coalesce(string_agg({nonempty}, '' ORDER BY tb.pos), '') AS txt
  FROM cells c LEFT JOIN tb ON tb.page_id = c.page_id AND tb.blk = c.blk AND tb.pos BETWEEN c.cell AND c.e
  GROUP BY c.page_id, c.blk, c.cell),
tr_sig AS (
  SELECT r.page_id, r.blk, r.tr, string_agg(coalesce(tb.text, tb.tok), '' ORDER BY tb.pos) AS sig
  FROM trs r JOIN tb ON tb.page_id = r.page_id AND tb.blk = r.blk AND tb.pos BETWEEN r.tr AND r.e
  GROUP BY r.page_id, r.blk, r.tr),
tr_line AS (
  SELECT r.page_id, r.blk, r.tr, count(c.cell) AS n_cells, string_agg(c.txt, ' | ' ORDER BY c.cell) AS cells,
         coalesce(bool_or(c.tag = 'th'), false) AS has_th
  FROM trs r LEFT JOIN cell_txt c ON c.page_id = r.page_id AND c.blk = r.blk AND c.cell BETWEEN r.tr AND r.e
  GROUP BY r.page_id, r.blk, r.tr),
t2 AS (
  SELECT l.*, s.sig, CASE WHEN n_cells > 0 THEN '| ' || cells || ' |' END AS line,
         first_value(s.sig) OVER (PARTITION BY l.page_id, l.blk ORDER BY l.tr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_sig
  FROM tr_line l JOIN tr_sig s USING (page_id, blk, tr)),
t3 AS (
  SELECT page_id, blk, count(*) AS n_trs, count(line) AS n_lines,
         string_agg(CASE WHEN has_th AND sig = first_sig
                         THEN line || {NL} || '| ' || array_to_string(list_transform(range(n_cells), lambda x: '---'), ' | ') || ' |'
                         ELSE line END, {NL} ORDER BY tr) AS tlines
  FROM t2 GROUP BY page_id, blk),
u1 AS (
  SELECT page_id, blk, unit,
         arg_min_null(kind, pos) AS h_kind, arg_min_null(tag, pos) AS h_tag, arg_min_null(a_href, pos) AS h_href,
         arg_min_null(a_src, pos) AS h_src, arg_min_null(a_alt, pos) AS h_alt,
         any_value(code_s) AS code_s, any_value(code_class) AS code_class,
         coalesce(string_agg({nonempty}, '' ORDER BY pos), '') AS txt,
         coalesce(string_agg(CASE WHEN kind = 'text' THEN text END, '' ORDER BY pos), '') AS raw,
         coalesce(string_agg(CASE WHEN kind = 'text' AND (code_s IS NULL OR (pos >= code_s AND pos <= code_e)) THEN text END, '' ORDER BY pos), '') AS code_raw
  FROM b5 GROUP BY page_id, blk, unit),
u2 AS (
  SELECT *,
    CASE WHEN unit > 0 THEN CASE
      WHEN h_kind = 'text' THEN CASE WHEN txt <> '' THEN txt END
      WHEN h_tag IN ('strong', 'b') THEN CASE WHEN txt <> '' THEN '**' || txt || '**' END
      WHEN h_tag IN ('em', 'i') THEN CASE WHEN txt <> '' THEN '*' || txt || '*' END
      WHEN h_tag = 'code' THEN CASE WHEN raw <> '' THEN '`' || raw || '`' END
      WHEN h_tag = 'a' THEN CASE WHEN txt <> '' AND h_href IS NOT NULL AND h_href <> '' AND NOT starts_with(h_href, 'javascript:')
                                 THEN '[' || txt || '](' || h_href || ')' WHEN txt <> '' THEN txt END
      WHEN h_tag = 'br' THEN {NL}
      WHEN h_kind IN {OPENING} THEN CASE WHEN txt <> '' THEN txt END END END AS inline,
    unit > 0 AND h_kind = 'open' AND h_tag = 'li' AS is_li,
    first_value(h_tag) OVER wbu AS root_tag,
    sum(CASE WHEN unit > 0 AND h_kind = 'open' AND h_tag = 'li' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, blk ORDER BY unit ROWS UNBOUNDED PRECEDING) AS li_n
  FROM u1 WINDOW wbu AS (PARTITION BY page_id, blk ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bk AS (
  SELECT page_id, blk,
         arg_min_null(h_kind, unit) AS rkind, arg_min_null(h_tag, unit) AS rtag,
         arg_min_null(h_href, unit) AS rhref, arg_min_null(h_src, unit) AS rsrc,
         arg_min_null(h_alt, unit) AS ralt,
         any_value(code_s) AS code_s, any_value(code_class) AS code_class,
         coalesce(string_agg(txt, '' ORDER BY unit), '') AS full_txt,
         coalesce(string_agg(raw, '' ORDER BY unit), '') AS full_raw,
         coalesce(string_agg(code_raw, '' ORDER BY unit), '') AS code_raw,
         string_agg(inline, ' ' ORDER BY unit) AS parts,
         string_agg(CASE WHEN is_li AND txt <> '' THEN CASE WHEN root_tag = 'ul' THEN '- ' ELSE CAST(li_n AS VARCHAR) || '. ' END || txt END,
                    {NL} ORDER BY unit) AS items
  FROM u2 GROUP BY page_id, blk),
blocks AS (
  SELECT bk.page_id, bk.blk, rtag AS block_tag, rkind AS block_kind,
    CASE
      WHEN rkind = 'text' THEN CASE WHEN length(full_txt) > 1 THEN full_txt END
      WHEN rtag IN {_lst(H.HEADING_TAGS)} THEN CASE WHEN full_txt <> '' THEN repeat('#', CAST(regexp_extract(rtag, '^h([1-6])$', 1) AS INTEGER)) || ' ' || full_txt || {NL} END
      WHEN rtag = 'p' THEN CASE WHEN parts IS NOT NULL THEN parts || {NL} END
      WHEN rtag IN ('ul', 'ol') THEN {NL} || coalesce(items, '') || CASE WHEN items IS NOT NULL THEN {NL} ELSE '' END
      WHEN rtag = 'blockquote' THEN CASE WHEN full_txt <> '' THEN {NL} || array_to_string(list_transform(
              list_filter(string_split(full_txt, {NL}), lambda x: length({strip('x')}) > 0), lambda x: '> ' || {strip('x')}), {NL}) || {NL} END
      WHEN rtag = 'pre' THEN CASE WHEN (CASE WHEN code_s IS NOT NULL THEN code_raw ELSE full_raw END) <> ''
           THEN {NL} || '```' || CASE WHEN code_s IS NOT NULL AND len(list_filter({_classes('code_class')}, lambda c: contains(c, 'language-'))) > 0
                                      THEN replace(list_filter({_classes('code_class')}, lambda c: contains(c, 'language-'))[1], 'language-', '') ELSE '' END
                || {NL} || {strip("CASE WHEN code_s IS NOT NULL THEN code_raw ELSE full_raw END")} || {NL} || '```' || {NL} END
      WHEN rtag = 'code' THEN CASE WHEN full_raw <> '' THEN '`' || full_raw || '`' END
      WHEN rtag = 'table' THEN CASE WHEN coalesce(t3.n_trs, 0) > 0 THEN {NL} || coalesce(t3.tlines, '') || CASE WHEN t3.n_lines > 0 THEN {NL} ELSE '' END END
      WHEN rtag = 'img' THEN CASE WHEN coalesce(rsrc, '') <> '' THEN '![' || coalesce(ralt, '') || '](' || rsrc || ')' END
      WHEN rtag = 'a' THEN CASE WHEN full_txt <> '' AND rhref IS NOT NULL AND rhref <> '' AND NOT starts_with(rhref, 'javascript:')
                                THEN '[' || full_txt || '](' || rhref || ')' WHEN full_txt <> '' THEN full_txt END
      ELSE CASE WHEN length(full_txt) > 2 THEN full_txt END
    END AS md
  FROM bk LEFT JOIN t3 ON t3.page_id = bk.page_id AND t3.blk = bk.blk),
fb AS (
  SELECT page_id, string_agg({strip('text')}, {NL} ORDER BY pos) FILTER (WHERE length({strip('text')}) > 0) AS fallback
  FROM r3 WHERE kind = 'text' AND NOT removed GROUP BY page_id),
md AS (SELECT page_id, string_agg(md, {NL} ORDER BY blk) AS raw_md FROM blocks WHERE md IS NOT NULL GROUP BY page_id),
page_md AS (
  SELECT pg.page_id, pg.url,
         CASE WHEN {_norm("coalesce(md.raw_md, '')")} = '' THEN coalesce(fb.fallback, '') ELSE {_norm("coalesce(md.raw_md, '')")} END AS content
  FROM pg LEFT JOIN md ON md.page_id = pg.page_id LEFT JOIN fb ON fb.page_id = pg.page_id)"""


def _norm(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({x}, '[{HWS}]*\\n[{HWS}]*', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")


def page_markdown_sql(pages_sql: str) -> str:
    return f"WITH {chain_ctes(pages_sql)}\nSELECT page_id, url, content, {est('content')} AS estimated_tokens FROM page_md"


def elements_sql(pages_sql: str) -> str:
    return (f"WITH {chain_ctes(pages_sql)}\nSELECT page_id, pos AS start, e AS \"end\", tag, kind, paired FROM el WHERE e IS NOT NULL")


def main_region_sql(pages_sql: str) -> str:
    return (f"WITH {chain_ctes(pages_sql)}\nSELECT page_id, max(region.prio) AS priority, max(region.s) AS start, "
            f"max(region.e) AS \"end\" FROM r3 GROUP BY page_id")


def blocks_sql(pages_sql: str, tags=None) -> str:
    where = f"WHERE block_tag IN {_lst(tags)}" if tags else ""
    return f"WITH {chain_ctes(pages_sql)}\nSELECT page_id, blk, block_tag, md FROM blocks {where}"


PAGES = "SELECT page_id, url, html FROM pages"


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def rich_pages_sql() -> str:
    """The same derivation as ``corpus.rich_pages``."""
    first = f"regexp_extract(text, '^([^{H.SP}]+)', 1)"
    did = "CAST(doc_id AS VARCHAR)"
    level = "CAST(((i - 1) // 6) % 6 + 1 AS VARCHAR)"
    lis = f"array_to_string(list_transform(list_filter(string_split(s, '. '), lambda x: length(x) > 0), lambda x: '<li>' || {_esc('x')} || '</li>'), '')"
    kinds = [
        f"'<h' || {level} || '>' || {_esc('s')} || '</h' || {level} || '>'",
        f"'<p><b>' || {_esc(f"regexp_extract(s, '^([^{H.SP}]+)', 1)")} || '</b> ' || {_esc('s')} || ' <a href=\"/d?i=' || {did} || '&amp;l=' "
        f"|| CAST(i - 1 AS VARCHAR) || '\">' || lang || '</a> <code>n = ' || CAST(n_chars AS VARCHAR) || '</code><br>&copy; ' || source || '</p>'",
        f"'<ul>' || {lis} || '</ul><ol><li></li><li>' || {_esc('s')} || '</li></ol>'",
        f"'<blockquote>' || {_esc('s')} || '</blockquote>'",
        f"'<pre><code class=\"x language-' || lang || '\">' || {_esc('s')} || '</code></pre>'",
        f"'<table><tr><th>lang</th><th>text</th></tr><tr><td>' || lang || '<table><tr><th>in</th><td>' || source || '</td></tr></table></td><td>' "
        f"|| {_esc('s')} || '</td></tr><tr><td>' || {did} || '</td></tr></table>'",
    ]
    case = "CASE " + " ".join(f"WHEN (i - 1) % 6 = {k} THEN {v}" for k, v in enumerate(kinds)) + " END"
    blocks = f"array_to_string(list_transform(string_split(text, {NL}), lambda s, i: {case}), '')"
    html = " || ".join([
        "'<!DOCTYPE html><html><head><title>'", _esc(first), "'</title><script>var x = ''<p>'';</script></head><body>'",
        "'<header><nav><a href=\"/\">Home</a></nav></header><main>'", blocks,
        "'<div style=\"display: none\">hidden '", did, "'</div><div class=\"ads\">ad '", did, "'</div>'",
        "'<div><span> </span></div><img src=\"/img/'", did, "'.png?a=1&#38;b=2\" alt=\"caf&eacute; &#x2014; '", "lang", "'\">'",
        "'<a href=\"javascript:void(0)\">'", "source", "'</a><a href=\"/&lt;'", "source", "'&gt;\">&#0000065; &#x00042; '", "source", "'</a>'",
        "'<code>'", "lang", "'</code><small>'", "source", "'</small>'",
        f"CASE WHEN lang = 'es' THEN '{WIDE_TAG}' || source || '</div>' ELSE '' END",
        "'<a title=\"a > b\" href=\"/keep?x=1&copy=2&lt\">'", "source", "'</a><img alt=''5 > 3'' src=\"/i.png\"><div data-x=\"1>2\" class=\"ads\">ad '", did,
        "'</div><div title=it''s style=\"a>b; display:none\">hidden '", did, "'</div><p>&copy 2020 &notit; &ampx &#65 &AMP</p>'",
        "'<p><a href=\"/one\">'", "lang", "' <a href=\"/two\">'", "source", "'</a> after</a></p>'",
        "'<div class=\"cookie-consent\">consent '", did, "'</div>'",
        "'</main><footer>footer '", did, "'</footer></body></html>'",
    ])
    return f"SELECT doc_id AS page_id, 'https://docs.example.org/' || lang || '/' || {did} AS url, {html} AS html FROM documents"


KNOWN_BLOCKS = _lst(H.HEADING_TAGS + ["p", "ul", "ol", "blockquote", "pre", "code", "table", "img", "a"])


def chain_sql(pages_sql: str, select: str, consent: bool = False) -> str:
    return f"WITH {chain_ctes(pages_sql, consent)}\n{select}"


# H3: every attribute of every opening tag, names lower-cased, the first of a repeated name kept
ATTRS_SQL = f"""
WITH tk AS ({tokens_of("pages")}),
op AS (
  SELECT page_id, pos, lower(regexp_extract(tok, '{H.TAG_NAME_RE}', 1)) AS tag, {_PAIRS} AS pairs
  FROM tk
  WHERE regexp_matches(tok, '^<[A-Za-z]') AND (ends_with(tok, '>') OR regexp_matches(tok, '(?i)^<(script|style|textarea)[{H.SP}/>]'))),
ex AS (SELECT page_id, pos, tag, unnest(pairs) AS p, unnest(range(len(pairs))) AS i FROM op),
nm AS (SELECT *, {_attr_name('p')} AS name FROM ex)
SELECT page_id, pos, tag, name, {_attr_value('p')} AS value
FROM nm QUALIFY row_number() OVER (PARTITION BY page_id, pos, name ORDER BY i) = 1
"""


def chrome_only_pages_sql() -> str:
    """The same derivation as ``corpus.chrome_only_pages``."""
    lines = f"array_to_string(list_transform(string_split(text, {NL}), lambda x: '<a>' || {_esc('x')} || '</a>'), '')"
    html = f"'<html><head><title>' || {_esc('text')} || '</title></head><body><nav>' || {lines} || '</nav><div><span> </span></div></body></html>'"
    return f"SELECT doc_id AS page_id, 'https://docs.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url, {html} AS html FROM documents"


def doc_pages_sql() -> str:
    """The same derivation as ``corpus.pages_for_documents``."""
    paras = f"array_to_string(list_transform(string_split(text, {NL}), lambda x: '<p>' || x || '</p>'), '')"
    html = f"'<html><head><title>doc</title></head><body><nav>menu</nav><article>' || {paras} || '</article></body></html>'"
    return (f"SELECT -(doc_id + 1) AS page_id, 'https://docs.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url, {html} AS html, "
            "lang, source FROM documents")
