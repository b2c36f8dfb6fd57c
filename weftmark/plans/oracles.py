"""DuckDB SQL for the queries of ``queries.py`` (the driver's correctness oracle).

Each statement recomputes its query from the same parquet views with DuckDB's
own functions (RE2 regexes, list functions, window functions). RE2 has no
back-reference, which three noise patterns need to find a repeated phrase. A text
with fewer than two places where the phrase may begin cannot match them, so the
statements leave those patterns out there; they fail on any other text. Repeats are
checked against hand-derived rows in ``tests/``.
"""

from __future__ import annotations

from ..functions.text import HWS_CLASS, WS
from ..operators.html import HEADING_TAGS
from . import oracle_html as OH

HWS = HWS_CLASS[1:-1]

NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _est(x: str) -> str:
    return f"(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)::BIGINT"


def _sq(s: str) -> str:
    return s.replace("'", "''")


DOC_URL = "('https://docs.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR))"

REQUESTS = f"""
  SELECT page_id * 2 AS request_id, url, CAST(NULL AS VARCHAR) AS wait_for_selector, CAST(NULL AS INTEGER) AS wait_time,
         CAST(NULL AS BOOLEAN) AS scroll_to_bottom,
         CASE WHEN contains(url, 'utm_source') THEN false END AS truncate,
         CASE WHEN ends_with(url, '#top') THEN 1000 END AS max_length,
         CASE WHEN contains(url, '?page=') THEN true END AS use_summarization,
         CASE WHEN contains(url, '?page=') THEN 200 WHEN ends_with(url, '.html') THEN 50 END AS summary_target_tokens,
         CAST(NULL AS VARCHAR) AS summary_host, CAST(NULL AS VARCHAR) AS summary_model
  FROM pages
  UNION ALL
  SELECT doc_id * 2 + 1, {DOC_URL}, NULL, NULL, NULL, NULL,
         CASE WHEN lang = 'de' THEN 3000 END,
         CASE WHEN lang = 'fr' THEN true END,
         CASE WHEN lang = 'en' THEN 1000 WHEN lang = 'fr' THEN 100 WHEN lang = 'es' THEN 0 END,
         NULL, NULL
  FROM documents
"""

RESPONSES = f"""
  SELECT {DOC_URL} AS url, doc_id, text,
         CASE WHEN source = 'src7' THEN 403 ELSE 200 END AS http_status,
         CASE WHEN source = 'src13' THEN 'timed out' END AS fetch_error,
         CASE WHEN lang = 'en' THEN 'text/markdown; charset=utf-8'
              WHEN lang = 'fr' THEN 'text/markdown; charset="UTF-8"'
              WHEN lang = 'de' THEN 'TEXT/MARKDOWN'
              ELSE 'text/html; charset=utf-8' END AS content_type,
         CASE WHEN lang = 'en' THEN CAST(n_chars // 4 AS VARCHAR) WHEN lang = 'fr' THEN 'n/a' END AS markdown_tokens_header
  FROM documents
"""

VARIANTS = """
  SELECT page_id, 0 AS variant_no, 'as_is' AS variant, url FROM pages
  UNION ALL SELECT page_id, 1, 'padded', '  ' || url || chr(9) FROM pages
  UNION ALL SELECT page_id, 2, 'upper_scheme', regexp_replace(url, '^https?', 'HTTP') FROM pages
  UNION ALL SELECT page_id, 3, 'ftp', regexp_replace(url, '^https?', 'ftp') FROM pages
  UNION ALL SELECT page_id, 4, 'no_host', regexp_replace(url, '^(https?://)[^/?#]*', '\\1') FROM pages
  UNION ALL SELECT page_id, 5, 'bracket', regexp_replace(url, '^(https?://)', '\\1[') FROM pages
  UNION ALL SELECT page_id, 6, 'blank', regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', ' ', 'g') FROM pages
  UNION ALL SELECT page_id, 7, 'empty', '' FROM pages
"""


def _url_parts(src: str) -> str:
    """netloc / path / query columns over ``src`` (which has ``clean_url``)."""
    return f"""
  SELECT *, CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//([^/?#]*)', 1) ELSE '' END AS netloc,
         regexp_extract(regexp_extract(after, '^([^#]*)', 1), '^([^?]*)', 1) AS path,
         regexp_extract(regexp_extract(after, '^([^#]*)', 1), '(?s)^[^?]*\\??(.*)$', 1) AS query
  FROM (
    SELECT *, CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '(?s)^//[^/?#]*(.*)$', 1) ELSE rest END AS after
    FROM (SELECT *, regexp_extract(regexp_replace(clean_url, '[\\t\\r\\n]', '', 'g'), '(?s)^[A-Za-z][A-Za-z0-9+.-]*:(.*)$', 1) AS rest
          FROM ({src}))
  )"""


URL_ERROR = """CASE WHEN url IS NULL OR url = '' THEN 'url must be a non-empty string'
     WHEN clean_url = '' THEN 'url cannot be empty'
     WHEN NOT (starts_with(clean_url, 'http://') OR starts_with(clean_url, 'https://')) THEN 'url must start with http:// or https://'
     WHEN (contains(netloc, '[') AND NOT contains(netloc, ']')) OR (contains(netloc, ']') AND NOT contains(netloc, '['))
       THEN 'URL is malformed: ''' || clean_url || '''. Invalid IPv6 URL'
     WHEN netloc = '' THEN 'URL is malformed: ''' || clean_url || '''. URL is malformed: ''' || clean_url || '''. Must include a valid hostname.'
END"""

NOISE_CORE = [
    r"(?im)info[WS]*The top.*?preferences\.",
    r"(?im)(?:We use cookies|This site uses cookies|By continuing|Accept all cookies).*?(?:\.|$)",
    r"(?im)(?:Share on|Follow us on|Connect with us).*?(?:Facebook|Twitter|LinkedIn|Instagram)",
    r"(?im)(?:Subscribe|Sign up|Newsletter|Email updates).*?(?:newsletter|updates|alerts)",
]


def _noise_core(x: str) -> str:
    s = x
    for p in NOISE_CORE:
        s = f"regexp_replace({s}, '{_sq(p.replace('[WS]', '[' + WS + ']'))}', '', 'g')"
    s = f"regexp_replace({s}, '\\n[{WS}]*\\n[{WS}]*\\n', {NL} || {NL}, 'g')"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {_strip(s)} END)"


#: Where the phrase of each pattern with a back-reference may begin.
REPEAT_STARTS = {
    "favorite_repeat": "(?i)favorite",
    "footer_repeat": "(?i)copyright|all rights reserved|privacy policy|terms of service",
    "breadcrumb_repeat": "(?i)home[" + WS + "]*>",
}


def _no_repeat(x: str, value: str) -> str:
    many = " OR ".join(f"len(regexp_extract_all({x}, '{r}')) > 1" for r in REPEAT_STARTS.values())
    return f"(CASE WHEN {many} THEN CAST(error('a phrase may repeat') AS VARCHAR) ELSE {value} END)"


def _noise(x: str) -> str:
    """N0-N10."""
    return _no_repeat(x, _noise_core(x))


def _noise_audit_sql() -> str:
    names = ["top_stories", "cookie_notice", "share_buttons", "newsletter"]
    steps, prev = [], "s0"
    for i, pat in enumerate(NOISE_CORE):
        pat = _sq(pat.replace("[WS]", "[" + WS + "]"))
        steps.append(f"t{i + 1} AS (SELECT *, regexp_replace({prev}, '{pat}', '', 'g') AS s{i + 1}, "
                     f"len(regexp_extract_all({prev}, '{pat}')) AS h{i + 1} FROM t{i})")
        prev = f"s{i + 1}"
    rows = [f"SELECT source AS host, '{n}' AS pattern, h{i + 1} AS h, length(s{i}) - length(s{i + 1}) AS r FROM t4" for i, n in enumerate(names)]
    rows += [f"SELECT source, '{n}', 0, 0 FROM t4" for n in REPEAT_STARTS]
    return (f"WITH t0 AS (SELECT source, {_no_repeat('text', 'text')} AS s0 FROM documents), {', '.join(steps)}, x AS ({' UNION ALL '.join(rows)}) "
            "SELECT host, pattern, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(r) AS BIGINT) AS removed_chars, count(*) FILTER (WHERE h > 0) AS documents_hit "
            "FROM x GROUP BY host, pattern")


def _page_md(pages_sql: str) -> str:
    return (f"WITH {OH.chain_ctes(pages_sql)}, d AS (SELECT page_id, url, {_noise('content')} AS content FROM page_md) "
            f"SELECT page_id, url, content, {_est('content')} AS estimated_tokens FROM d")


PLANNED_SOURCE = f"""
        SELECT doc_id, text AS content, coalesce(lang = 'fr', false) AS flag,
               CAST(CASE WHEN lang = 'en' THEN 1000 WHEN lang = 'fr' THEN 100 WHEN lang = 'es' THEN 0 END AS INTEGER) AS target,
               {_est('text')} AS orig
        FROM documents"""


def _planned(source: str) -> str:
    return f"""
  SELECT doc_id, content, flag, target, orig,
         enabled, active, needed,
         CASE WHEN needed THEN CASE WHEN orig <= 8000 THEN 'single-pass' ELSE 'map-reduce' END END AS strategy
  FROM (
    SELECT *, enabled AND coalesce(target <> 0, false) AND target > 0 AS active,
              enabled AND coalesce(target <> 0, false) AND target > 0 AND (flag OR orig > target) AS needed
    FROM (
      SELECT *, flag OR coalesce(target <> 0, false) AS enabled
      FROM ({source})))
"""


PLANNED = _planned(PLANNED_SOURCE)


def _chunk_target(target: str, n: str) -> str:
    return f"CAST(greatest(300, floor(CAST({target} AS DOUBLE) * 1.5 / greatest(1, {n}))) AS INTEGER)"


TOKENS = OH.tokens_of("pages")


ENTITIES = f"""
  SELECT page_id, pos, tok, {OH.text_reference('tok')} AS value FROM ({TOKENS}) WHERE regexp_matches(tok, '^&#?[A-Za-z0-9]')
"""

TEXT_NODES = f"""
  WITH t AS ({TOKENS}),
  v AS (
    SELECT t.page_id, t.pos, (t.tok = '<' OR NOT starts_with(t.tok, '<')) AS is_text, coalesce(en.value, t.tok) AS val
    FROM t LEFT JOIN ({ENTITIES}) en ON en.page_id = t.page_id AND en.pos = t.pos),
  n AS (SELECT *, sum(CASE WHEN is_text THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node FROM v)
  SELECT page_id, min(pos) AS pos, string_agg(val, '' ORDER BY pos) AS text
  FROM n WHERE is_text GROUP BY page_id, node
"""


def _summarize_sql(planned: str = PLANNED) -> str:
    sp_ans = "substring(content, 1, target * 4)"
    return f"""
  WITH p AS ({planned}),
  mr AS (SELECT doc_id, content, target, (length(content) - 1) // 12000 + 1 AS n FROM p WHERE strategy = 'map-reduce'),
  ch AS (SELECT doc_id, target, n, i, substring(content, i * 12000 + 1, 12000) AS chunk
         FROM (SELECT doc_id, content, target, n, unnest(range(n)) AS i FROM mr)),
  ca AS (SELECT doc_id, target, string_agg({_strip(f"substring(chunk, 1, {_chunk_target('target', 'n')} * 4)")}, {NL} || {NL} ORDER BY i) AS combined
         FROM ch GROUP BY doc_id, target),
  ans AS (SELECT doc_id, {sp_ans} AS answer FROM p WHERE strategy = 'single-pass'
          UNION ALL SELECT doc_id, substring(combined, 1, target * 4) FROM ca),
  s AS (SELECT p.*, {_strip('a.answer')} AS summary FROM p LEFT JOIN ans a USING (doc_id)),
  d AS (SELECT *, {_est('summary')} AS s_tok FROM s),
  k AS (SELECT *, coalesce(s_tok < target AND orig <= target AND orig > s_tok, false) AS keep FROM d),
  o AS (SELECT *, CASE WHEN needed AND NOT keep THEN summary ELSE content END AS content_out FROM k)
  SELECT doc_id, content_out AS content, enabled, needed AS used, strategy, target AS target_tokens,
         orig AS original_estimated_tokens,
         CASE WHEN NOT active THEN orig WHEN NOT needed THEN NULL ELSE {_est('content_out')} END AS final_estimated_tokens,
         CASE WHEN needed AND keep THEN 'summary_shorter_than_target_and_original_under_target' END AS fallback_reason
  FROM o
"""


ORACLES = {
    "request_source": f"""
  SELECT request_id, url, wait_for_selector, CAST(coalesce(wait_time, 2000) AS INTEGER) AS wait_time,
         coalesce(scroll_to_bottom, true) AS scroll_to_bottom, coalesce(truncate, true) AS truncate,
         CAST(coalesce(max_length, 100000) AS INTEGER) AS max_length, coalesce(use_summarization, false) AS use_summarization,
         CAST(summary_target_tokens AS INTEGER) AS summary_target_tokens, summary_host, summary_model
  FROM ({REQUESTS})""",
    "response_source": f"""
  SELECT url, http_status, fetch_error, content_type, markdown_tokens_header, CAST(strlen(text) AS BIGINT) AS body_bytes
  FROM ({RESPONSES})""",
    "page_source": "SELECT page_id, url, html FROM pages",
    "url_validation": f"""
  SELECT page_id, variant, url, clean_url, {URL_ERROR} AS error
  FROM ({_url_parts(f"SELECT *, {_strip('url')} AS clean_url FROM ({VARIANTS})")})""",
    "url_normalize": f"SELECT page_id, variant, {_strip('url')} AS clean_url FROM ({VARIANTS})",
    "url_budget": f"""
  SELECT page_id, url, CAST(45000 + CASE WHEN query <> '' OR length(path) - length(replace(path, '/', '')) > 3 THEN 15000 ELSE 0 END AS INTEGER) AS budget_ms
  FROM ({_url_parts(f"SELECT page_id, url, {_strip('url')} AS clean_url FROM pages")})""",
    "native_markdown_filter": f"""
  SELECT url, content_type, starts_with(lower(coalesce(content_type, '')), 'text/markdown') AS is_markdown,
         fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AS fetch_ok
  FROM ({RESPONSES})""",
    "fetch_failure_filter": f"""
  SELECT url, http_status, fetch_error FROM ({RESPONSES})
  WHERE NOT (fetch_error IS NULL AND http_status BETWEEN 200 AND 299)""",
    "decode_body": f"""
  SELECT {_strip('url')} AS url, decode(encode(text)) AS content, content_type AS source_content_type,
         TRY_CAST(markdown_tokens_header AS INTEGER) AS markdown_tokens
  FROM ({RESPONSES})
  WHERE fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AND starts_with(lower(coalesce(content_type, '')), 'text/markdown')""",
    "header_int": f"SELECT url, markdown_tokens_header AS raw, TRY_CAST(markdown_tokens_header AS INTEGER) AS markdown_tokens FROM ({RESPONSES})",
    "token_estimate": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {_est('text')} AS estimated_tokens FROM documents",
    "truncate_content": f"""
  SELECT doc_id, CASE WHEN coalesce(lang <> 'es', true) AND length(text) > 5000
                      THEN substring(text, 1, 5000) || {NL} || {NL} || '... [content truncated]' ELSE text END AS content
  FROM documents""",
    "noise_filter_core": f"SELECT doc_id, {_noise_core('text')} AS content FROM documents",
    "summary_options": f"""
  SELECT doc_id, enabled, active, needed, strategy, target AS target_tokens, orig AS original_estimated_tokens FROM ({PLANNED})""",
    "text_chunks": """
  SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk_no, CAST(n AS INTEGER) AS n_chunks, substring(content, i * 12000 + 1, 12000) AS text
  FROM (SELECT doc_id, content, n, unnest(range(n)) AS i
        FROM (SELECT doc_id, text AS content, CASE WHEN length(text) > 0 THEN (length(text) - 1) // 12000 + 1 ELSE 0 END AS n FROM documents))""",
    "chunk_target": f"""
  SELECT doc_id, CAST(n AS INTEGER) AS n_chunks, {_chunk_target('2000', 'n')} AS chunk_target
  FROM (SELECT doc_id, (length(text) - 1) // 12000 + 1 AS n FROM documents WHERE length(text) > 0)""",
    "summarize_documents": _summarize_sql(),
    "summarize_needed": f"SELECT doc_id, enabled, active, needed FROM ({PLANNED})",
    "summary_strategy": f"SELECT doc_id, strategy FROM ({PLANNED})",
    "normalize_lines": f"""
  SELECT doc_id, {_strip(f"regexp_replace(regexp_replace(text, '[{HWS}]*\\n[{HWS}]*', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")} AS content
  FROM documents""",
    "html_tokens": TOKENS,
    "entity_decode": ENTITIES,
    "text_nodes": TEXT_NODES,
    "page_markdown_raw": OH.page_markdown_sql(OH.PAGES),
    "rich_page_markdown_raw": OH.page_markdown_sql(OH.rich_pages_sql()),
    "html_elements": OH.elements_sql(OH.PAGES),
    "main_region": OH.main_region_sql(OH.PAGES),
    "block_segments": f"WITH {OH.chain_ctes(OH.PAGES)}\nSELECT page_id, blk, block_tag, block_kind, md FROM blocks",
    "render_heading": OH.blocks_sql(OH.rich_pages_sql(), HEADING_TAGS),
    "render_paragraph": OH.blocks_sql(OH.rich_pages_sql(), ["p"]),
    "render_list": OH.blocks_sql(OH.rich_pages_sql(), ["ul", "ol"]),
    "render_blockquote": OH.blocks_sql(OH.rich_pages_sql(), ["blockquote"]),
    "render_code_block": OH.blocks_sql(OH.rich_pages_sql(), ["pre"]),
    "render_inline_code_block": OH.blocks_sql(OH.rich_pages_sql(), ["code"]),
    "render_table": OH.blocks_sql(OH.rich_pages_sql(), ["table"]),
    "render_image": OH.blocks_sql(OH.rich_pages_sql(), ["img"]),
    "render_link": OH.blocks_sql(OH.rich_pages_sql(), ["a"]),
    "prune_non_content": OH.chain_sql(OH.PAGES, "SELECT page_id, pos, kind, tag FROM p3 WHERE NOT removed"),
    "prune_page_chrome": OH.chain_sql(OH.rich_pages_sql(), "SELECT page_id, pos, tag FROM p1 WHERE pruned AND kind IN ('open', 'void', 'raw')"),
    "prune_empty_containers": OH.chain_sql(
        OH.rich_pages_sql(), "SELECT page_id, pos, tag FROM p3 WHERE removed AND NOT pruned AND tag IN ('div', 'span') AND kind = 'open'"),
    "hidden_filter": OH.chain_sql(OH.rich_pages_sql(), f"SELECT page_id, pos, tag, a_style AS style FROM r3 WHERE in_region AND {OH.HIDDEN}"),
    "link_filter": OH.chain_sql(OH.rich_pages_sql(), "SELECT page_id, blk, block_tag, md FROM blocks WHERE contains(md, '](') OR block_tag = 'a'"),
    "render_other": OH.chain_sql(OH.rich_pages_sql(), f"SELECT page_id, blk, block_tag, md FROM blocks WHERE block_tag NOT IN {OH.KNOWN_BLOCKS} AND block_kind <> 'text'"),
    "min_text_filter": OH.chain_sql(
        OH.rich_pages_sql(),
        f"SELECT page_id, blk, block_kind, block_tag, md IS NOT NULL AS kept FROM blocks WHERE block_kind = 'text' OR block_tag NOT IN {OH.KNOWN_BLOCKS}"),
    "html_attrs": OH.ATTRS_SQL,
    "noise_filter": f"SELECT doc_id, {_noise('text')} AS content FROM documents",
    "noise_audit": _noise_audit_sql(),
    "page_markdown": _page_md(OH.PAGES),
    "rich_page_markdown": _page_md(OH.rich_pages_sql()),
    "empty_fallback": _page_md(OH.chrome_only_pages_sql()),
    "assemble_markdown": f"WITH {OH.chain_ctes(OH.rich_pages_sql())}\n  SELECT page_id, count(*) FILTER (WHERE md IS NOT NULL) AS n_blocks, "
                         "coalesce(string_agg(md, chr(10) ORDER BY blk), '') AS joined FROM blocks GROUP BY page_id",
    "prune_hidden": OH.chain_sql(OH.rich_pages_sql(), "SELECT page_id, pos, kind, tag, text FROM b0 WHERE kind = 'text' OR a_style IS NOT NULL"),
    "render_inline": OH.chain_sql(OH.rich_pages_sql(), "SELECT page_id, blk, unit, h_tag AS tag, inline FROM u2 WHERE root_tag = 'p' AND inline IS NOT NULL"),
    "empty_fallback_raw": OH.page_markdown_sql(OH.chrome_only_pages_sql()),
}


# --- summary tables, routing and error rows -------------------------------------------

def _lit(s: str) -> str:
    """A Python string as a DuckDB literal (newlines kept as they are)."""
    return "'" + s.replace("'", "''") + "'"


from ..operators import summary as _M  # noqa: E402

_ROUND1 = f"""
  p AS ({PLANNED}),
  mr AS (SELECT doc_id, content, target, (length(content) - 1) // 12000 + 1 AS n FROM p WHERE strategy = 'map-reduce'),
  ch AS (SELECT doc_id, target, n, i, substring(content, i * 12000 + 1, 12000) AS chunk,
                {_chunk_target('target', 'n')} AS per
         FROM (SELECT doc_id, content, target, n, unnest(range(n)) AS i FROM mr)),
  r1 AS (
    SELECT CAST(doc_id AS VARCHAR) || ':1:0' AS prompt_id, doc_id, 1 AS round, 0 AS chunk_no, 'gpt-oss:20b' AS model,
           {_lit(_M.SINGLE_PASS_SYSTEM)} AS system,
           {_lit(_M.SINGLE_PASS_HEAD)} || CAST(target AS VARCHAR) || {_lit(_M.SINGLE_PASS_MID)} || content || {_lit(_M.SINGLE_PASS_TAIL)} AS prompt,
           target AS target_tokens, content AS inner_text
    FROM p WHERE strategy = 'single-pass'
    UNION ALL
    SELECT CAST(doc_id AS VARCHAR) || ':1:' || CAST(i + 1 AS VARCHAR), doc_id, 1, CAST(i + 1 AS INTEGER), 'gpt-oss:20b', NULL,
           {_lit(_M.CHUNK_HEAD)} || CAST(i + 1 AS VARCHAR) || {_lit(_M.CHUNK_MID1)} || CAST(n AS VARCHAR) || {_lit(_M.CHUNK_MID2)}
             || CAST(per AS VARCHAR) || {_lit(_M.CHUNK_MID3)} || chunk || {_lit(_M.CHUNK_TAIL)},
           per, chunk
    FROM ch),
  a1 AS (SELECT *, substring(inner_text, 1, target_tokens * 4) AS answer FROM r1),
  red AS (SELECT doc_id, string_agg({_strip('answer')}, {NL} || {NL} ORDER BY chunk_no) AS combined, count(*) AS n_chunks
          FROM a1 GROUP BY doc_id),
  r2 AS (
    SELECT CAST(p.doc_id AS VARCHAR) || ':2:0' AS prompt_id, p.doc_id, 2 AS round, 0 AS chunk_no,
           {_lit(_M.SINGLE_PASS_HEAD)} || CAST(p.target AS VARCHAR) || {_lit(_M.SINGLE_PASS_MID)} || red.combined || {_lit(_M.SINGLE_PASS_TAIL)} AS prompt,
           p.target AS target_tokens
    FROM p JOIN red USING (doc_id) WHERE p.strategy = 'map-reduce')
"""

_FAILED = f"""
  WITH s AS ({_summarize_sql()}),
  l AS (SELECT doc_id, lang FROM documents)
  SELECT doc_id, used, strategy,
         CASE WHEN used AND l.lang = 'en' THEN 'error: HTTP Error 500: model unavailable' ELSE fallback_reason END AS fallback_reason,
         CASE WHEN used AND l.lang = 'en' THEN NULL ELSE final_estimated_tokens END AS final_estimated_tokens
  FROM s JOIN l USING (doc_id)
"""

_ALL_REQUESTS = f"""
  SELECT request_id, url FROM ({REQUESTS})
  UNION ALL
  SELECT -(page_id * 8 + variant_no) - 1, url FROM ({VARIANTS}) WHERE variant <> 'as_is'
"""

_VALIDATED = f"""
  SELECT request_id, url, clean_url, {URL_ERROR} AS error
  FROM ({_url_parts(f"SELECT request_id, url, {_strip('url')} AS clean_url FROM ({_ALL_REQUESTS})")})
"""

_ECHO = f"CASE WHEN url IS NULL THEN NULL WHEN url = '' THEN url ELSE {_strip('url')} END"

_ROUTED = f"""
  WITH nat AS (
    SELECT {_strip('url')} AS url, min({{'c': decode(encode(text)), 't': content_type, 'm': TRY_CAST(markdown_tokens_header AS INTEGER)}}) AS n
    FROM ({RESPONSES})
    WHERE fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AND starts_with(lower(coalesce(content_type, '')), 'text/markdown')
    GROUP BY 1),
  known AS (SELECT DISTINCT {_strip('url')} AS url FROM (SELECT url FROM pages UNION ALL SELECT {DOC_URL} FROM documents)),
  req AS (SELECT request_id, url, {_strip('url')} AS clean_url FROM ({REQUESTS}))
  SELECT req.request_id, req.clean_url,
         CASE WHEN nat.url IS NOT NULL THEN 'native_markdown' ELSE 'playwright' END AS render_method,
         nat.n.t AS source_content_type, nat.n.m AS markdown_tokens,
         CASE WHEN nat.url IS NULL AND known.url IS NULL
              THEN 'Web URL reading failed: no captured response or page for ' || req.clean_url END AS error
  FROM req LEFT JOIN nat ON nat.url = req.clean_url LEFT JOIN known ON known.url = req.clean_url
"""

ORACLES.update({
    "round1_prompts": f"WITH {_ROUND1} SELECT prompt_id, doc_id, round, chunk_no, model, system, prompt, target_tokens FROM r1",
    "completion_source": f"WITH {_ROUND1} SELECT prompt_id, answer AS response FROM a1",
    "apply_completions": f"WITH {_ROUND1} SELECT prompt_id, doc_id, chunk_no, answer, CAST(NULL AS VARCHAR) AS call_error FROM a1",
    "reduce_summaries": f"WITH {_ROUND1} SELECT doc_id, combined, n_chunks FROM red",
    "prompt_table": f"""WITH {_ROUND1}
  SELECT prompt_id, doc_id, round, chunk_no, prompt, target_tokens FROM r1
  UNION ALL SELECT prompt_id, doc_id, round, chunk_no, prompt, target_tokens FROM r2""",
    "prompt_sink": f"""WITH {_ROUND1}
  SELECT prompt_id, 'http://localhost:11434' AS host,
         CASE WHEN system IS NOT NULL AND system <> ''
              THEN CAST(to_json({{'model': model, 'prompt': prompt, 'stream': false, 'system': system}}) AS VARCHAR)
              ELSE CAST(to_json({{'model': model, 'prompt': prompt, 'stream': false}}) AS VARCHAR) END AS payload
  FROM r1""",
    "summary_plan_report": f"""WITH {_ROUND1},
  allp AS (SELECT doc_id, round, chunk_no, 'gpt-oss:20b' AS model, prompt FROM r1
           UNION ALL SELECT doc_id, round, chunk_no, 'gpt-oss:20b', prompt FROM r2),
  st AS (SELECT *, max(CASE WHEN chunk_no > 0 OR round = 2 THEN 'map-reduce' ELSE 'single-pass' END) OVER (PARTITION BY doc_id) AS strategy FROM allp)
  SELECT strategy, model, count(DISTINCT doc_id) AS documents, count(*) AS calls, sum({_est('prompt')}) AS prompt_tokens
  FROM st GROUP BY strategy, model""",
    "chunk_debug": f"""WITH {_ROUND1}
  SELECT doc_id, 'map-reduce' AS stage, CAST(n AS BIGINT) AS num_chunks FROM mr""",
    "summary_error": _FAILED,
    "request_response_join": _ROUTED,
    "render_route": f"SELECT request_id, clean_url, render_method FROM ({_ROUTED})",
    "error_sink": f"SELECT request_id, error, {_ECHO} AS url, 'error' AS status FROM ({_VALIDATED}) WHERE error IS NOT NULL",
    "error_envelope": f"""
  SELECT request_id, CAST(to_json({{'error': error, 'url': {_ECHO}, 'status': 'error'}}) AS VARCHAR) AS json
  FROM ({_VALIDATED}) WHERE error IS NOT NULL""",
    "prune_consent_nodes": OH.chain_sql(
        OH.rich_pages_sql(),
        "SELECT page_id, pos, tag FROM p1 WHERE pruned AND kind = 'open' AND contains(coalesce(a_class, ''), 'cookie')", consent=True),
    "status_split": f"""
  SELECT request_id, CASE WHEN error IS NULL THEN clean_url ELSE {_ECHO} END AS url,
         CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status
  FROM ({_VALIDATED})""",
})


# --- the whole job ---------------------------------------------------------------------------

_REQUESTS_WITH_OPTIONS = f"""
  SELECT * FROM ({REQUESTS})
  UNION ALL
  SELECT -(page_id * 8 + variant_no) - 1, url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({VARIANTS}) WHERE variant <> 'as_is'
"""


def _results_sql(requests: str) -> str:
    """The accepted requests of ``requests`` with final content, route and the JSON envelope."""
    native = f"fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AND starts_with(lower(coalesce(content_type, '')), 'text/markdown')"
    need = (f"SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM ({OH.doc_pages_sql()}) "
            f"WHERE url NOT IN (SELECT url FROM ({RESPONSES}) WHERE {native})")
    md = f"WITH {OH.chain_ctes(need)} SELECT page_id, url, {_noise('content')} AS content FROM page_md"
    planned = _planned(f"SELECT k AS doc_id, content, use_summarization AS flag, target, {_est('content')} AS orig FROM asked")
    meta = ("{'enabled': s.enabled, 'used': s.used, 'strategy': s.strategy, 'model': 'gpt-oss:20b', 'host': 'http://localhost:11434', "
            "'target_tokens': s.target_tokens, 'original_estimated_tokens': s.original_estimated_tokens, "
            "'final_estimated_tokens': s.final_estimated_tokens, 'fallback_reason': s.fallback_reason}")
    base = ("'url': r.clean_url, 'content': out, 'format': 'markdown', 'status': 'success', 'wait_for_selector': wait_for_selector, 'wait_time': wait_time, "
            "'scroll_to_bottom': scroll_to_bottom, 'truncate': truncate, 'max_length': max_length, 'render_method': render_method")
    js = lambda more: "CAST(to_json({" + base + more + ", 'summarization': " + meta + "}) AS VARCHAR)"
    return f"""
  WITH valid AS (
    SELECT request_id, clean_url, wait_for_selector, CAST(coalesce(wait_time, 2000) AS INTEGER) AS wait_time, coalesce(scroll_to_bottom, true) AS scroll_to_bottom,
           coalesce(truncate, true) AS truncate, CAST(coalesce(max_length, 100000) AS INTEGER) AS max_length,
           coalesce(use_summarization, false) AS use_summarization, CAST(summary_target_tokens AS INTEGER) AS target,
           clean_url || '|' || coalesce(use_summarization, false) || '|' || coalesce(CAST(summary_target_tokens AS VARCHAR), 'none') AS k
    FROM ({_url_parts(f"SELECT *, {_strip('url')} AS clean_url FROM ({requests})")}) WHERE ({URL_ERROR}) IS NULL),
  content AS (
    SELECT url AS c_url, 'native_markdown' AS render_method, text AS content, content_type AS source_content_type,
           TRY_CAST(markdown_tokens_header AS INTEGER) AS markdown_tokens FROM ({RESPONSES}) WHERE {native}
    UNION ALL SELECT {_strip('url')}, 'playwright', content, NULL, NULL FROM ({md})),
  asked AS (SELECT DISTINCT k, use_summarization, target, content, render_method, source_content_type, markdown_tokens FROM valid JOIN content ON c_url = clean_url),
  s AS ({_summarize_sql(planned)}),
  r AS (
    SELECT valid.*, a.render_method, a.source_content_type, a.markdown_tokens,
           CASE WHEN truncate AND max_length > 0 AND length(s.content) > max_length
                THEN substring(s.content, 1, max_length) || {NL} || {NL} || '... [content truncated]' ELSE s.content END AS out
    FROM valid JOIN asked a ON a.k = valid.k JOIN s ON s.doc_id = valid.k)
  SELECT request_id, clean_url AS url, render_method, out AS content,
         CASE WHEN render_method = 'playwright' THEN {js("")}
              WHEN markdown_tokens IS NULL THEN {js(", 'source_content_type': source_content_type")}
              ELSE {js(", 'source_content_type': source_content_type, 'markdown_tokens': markdown_tokens")} END AS json
  FROM r JOIN s ON s.doc_id = r.k"""


_RESULTS = _results_sql(_REQUESTS_WITH_OPTIONS)
_FROM_PAGES = "request_id < 0 OR request_id % 2 = 0"
_HOST = "lower(regexp_extract(netloc, '^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)', 1))"

ORACLES.update({
    "result_sink": f"SELECT request_id, url, render_method, json FROM ({_RESULTS})",
    "result_envelope": f"SELECT request_id, json FROM ({_RESULTS})",
    "summary_meta": f"""WITH s AS ({_summarize_sql()})
  SELECT doc_id, enabled, used, strategy, 'gpt-oss:20b' AS model, 'http://localhost:11434' AS host, target_tokens, original_estimated_tokens,
         final_estimated_tokens, fallback_reason FROM s""",
    "summary_decision": f"""WITH s AS ({_summarize_sql()})
  SELECT doc_id, CASE WHEN NOT used THEN 'not needed' WHEN fallback_reason IS NOT NULL THEN 'kept' ELSE 'replaced' END AS decision,
         length(content) AS content_chars FROM s""",
    "extraction_report": f"""
  WITH ok AS (SELECT url, render_method, 'success' AS status, length(content) AS chars, {_est('content')} AS tokens FROM ({_RESULTS})),
  bad AS (SELECT {_ECHO} AS url, 'none' AS render_method, 'error' AS status, 0 AS chars, 0 AS tokens FROM ({_VALIDATED}) WHERE error IS NOT NULL),
  x AS (SELECT coalesce(url, '') AS clean_url, render_method, status, chars, tokens FROM (SELECT * FROM ok UNION ALL SELECT * FROM bad)),
  h AS (SELECT {_HOST} AS host, render_method, status, chars, tokens FROM ({_url_parts('SELECT * FROM x')}))
  SELECT host, render_method, status, count(*) AS requests, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens
  FROM h GROUP BY ROLLUP (host, render_method, status)""",
})

ORACLES.update({
    "stream_results": f"""
  SELECT request_id, url, 'success' AS status, json FROM ({_results_sql(f"SELECT * FROM ({_REQUESTS_WITH_OPTIONS}) WHERE {_FROM_PAGES}")})
  UNION ALL
  SELECT request_id, {_ECHO}, 'error', CAST(to_json({{'error': error, 'url': {_ECHO}, 'status': 'error'}}) AS VARCHAR)
  FROM ({_VALIDATED}) WHERE error IS NOT NULL AND ({_FROM_PAGES})""",
    "stream_light": f"""
  SELECT doc_id, CAST(NULL AS VARCHAR) AS url_error, url AS clean_url,
         CAST(45000 + CASE WHEN length(url) - length(replace(url, '/', '')) - 2 > 3 THEN 15000 ELSE 0 END AS INTEGER) AS budget_ms,
         starts_with(lower(coalesce(content_type, '')), 'text/markdown') AS is_markdown, {_est('text')} AS estimated_tokens,
         CASE WHEN length(text) > 5000 THEN 5025 ELSE length(text) END AS truncated_chars, {_noise('text')} AS denoised,
         CAST(i + 1 AS INTEGER) AS chunk_no, CAST(n AS INTEGER) AS n_chunks, length(substring(text, i * 12000 + 1, 12000)) AS chunk_chars,
         {_chunk_target('2000', 'n')} AS chunk_target
  FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, (length(text) - 1) // 12000 + 1 AS n FROM ({RESPONSES}) WHERE length(text) > 0))""",
})

_PAGE_REQUESTS = f"SELECT * FROM ({_REQUESTS_WITH_OPTIONS}) WHERE {_FROM_PAGES}"
_IN_TIME = "(NOT ends_with(clean_url, '#top') AND (contains(clean_url, '?page=') OR NOT contains(clean_url, 'utm_source')))"
_LATE = "'Web URL reading failed: no captured response or page for ' || clean_url"
_IS_NATIVE = "fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AND starts_with(lower(coalesce(content_type, '')), 'text/markdown')"

ORACLES.update({
    "stream_waiting": f"""
  SELECT request_id, url, 'success' AS status, json FROM (SELECT *, url AS clean_url FROM ({_results_sql(_PAGE_REQUESTS)})) WHERE {_IN_TIME}
  UNION ALL
  SELECT request_id, {_ECHO}, 'error', CAST(to_json({{'error': error, 'url': {_ECHO}, 'status': 'error'}}) AS VARCHAR)
  FROM ({_VALIDATED}) WHERE error IS NOT NULL AND ({_FROM_PAGES})
  UNION ALL
  SELECT request_id, clean_url, 'error', CAST(to_json({{'error': {_LATE}, 'url': clean_url, 'status': 'error'}}) AS VARCHAR)
  FROM ({_VALIDATED}) WHERE error IS NULL AND ({_FROM_PAGES}) AND NOT {_IN_TIME}""",
    "committed_batches": f"""
  SELECT request_id, CASE WHEN error IS NULL THEN clean_url ELSE {_ECHO} END AS url, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, 'pages' AS batch
  FROM ({_VALIDATED}) WHERE {_FROM_PAGES}""",
    "capture_store": f"""
  WITH c AS (
    SELECT {_strip('url')} AS url, 0 AS rank, NULL AS page_id FROM ({RESPONSES}) WHERE {_IS_NATIVE}
    UNION ALL SELECT {_strip('url')}, CASE WHEN trim(coalesce(html, '')) = '' THEN 2 ELSE 1 END, page_id FROM pages
    UNION ALL SELECT {DOC_URL}, 1, -(doc_id + 1) FROM documents),
  b AS (SELECT url, min({{'rank': rank, 'page_id': page_id}}) AS p FROM c GROUP BY url)
  SELECT url, p.rank = 0 AS native, p.page_id AS page_id FROM b WHERE url IN (SELECT clean_url FROM ({_VALIDATED}) WHERE error IS NULL)""",
})

ORACLES.update({
    "decode_legacy": "SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{7f}\\x{a0}-\\x{ff}]', '?', 'g') AS content FROM documents",
    "accept_gate": f"""
  SELECT url, accept FROM ({RESPONSES}) CROSS JOIN (VALUES ('default'), ('upper')) a(accept)
  WHERE fetch_error IS NULL AND http_status BETWEEN 200 AND 299 AND starts_with(lower(coalesce(content_type, '')), 'text/markdown')""",
    "job_options": """
  SELECT doc_id, environment, CASE WHEN lang = 'en' THEN 'http://own' WHEN environment = 'set' THEN 'http://env' ELSE 'http://localhost:11434' END AS host,
         CASE WHEN lang = 'de' THEN 'own-model' WHEN environment = 'set' THEN 'env-model' ELSE 'gpt-oss:20b' END AS model,
         CAST(CASE WHEN lang = 'en' THEN 5 WHEN environment = 'set' THEN 70 END AS INTEGER) AS target_tokens
  FROM documents CROSS JOIN (VALUES ('none'), ('set'), ('bad')) e(environment)""",
})
