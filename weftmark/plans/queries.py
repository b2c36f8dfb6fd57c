"""Named queries over the corpus tables, one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the given parquet tables (or tables
Spark derives from them) and returns a DataFrame; ``oracles.py`` holds the
matching DuckDB SQL where one exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H
from ..operators import native as N
from ..operators import summary as M
from ..options import ENV_ACCEPT, ENV_HOST, ENV_MODEL, ENV_TARGET, JobOptions
from ..session import fresh_path
from ..sources.captures import create_captures
from ..sources.commits import read_committed
from ..sources.io import write_results
from . import corpus as C
from . import read_urls as R
from . import reports as X

TRUNCATE_AT = 5000
TARGET_FOR_CHUNKS = 2000
CORE_NOISE = ["top_stories", "cookie_notice", "share_buttons", "newsletter"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- sources -----------------------------------------------------------------

def all_requests(spark, d):
    return C.requests_from_pages(_t(spark, d, "pages")).unionByName(C.requests_from_documents(_t(spark, d, "documents")))


def request_source(spark, d):
    return R.request_defaults(all_requests(spark, d))


def response_source(spark, d):
    r = C.responses_from_documents(_t(spark, d, "documents"))
    return r.select(
        "url", "http_status", "fetch_error",
        N.header(F.col("headers"), "Content-Type").alias("content_type"),
        N.header(F.col("headers"), "X-Markdown-Tokens").alias("markdown_tokens_header"),
        F.length("body").cast("bigint").alias("body_bytes"),
    )


def page_source(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", "html")


# --- URL and routing ---------------------------------------------------------

def url_validation(spark, d):
    v = C.url_variants(_t(spark, d, "pages"))
    return v.select("page_id", "variant", "url", U.url_clean(F.col("url")).alias("clean_url"), U.url_error(F.col("url")).alias("error"))


def url_budget(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", "url", U.url_budget_ms(F.col("url")).alias("budget_ms"))


def native_markdown_filter(spark, d):
    r = C.responses_from_documents(_t(spark, d, "documents"))
    ct = N.header(F.col("headers"), "Content-Type")
    return r.select(
        "url", ct.alias("content_type"),
        N.is_native_markdown(ct).alias("is_markdown"),
        N.fetch_ok(F.col("http_status"), F.col("fetch_error")).alias("fetch_ok"),
    )


def fetch_failure_filter(spark, d):
    r = C.responses_from_documents(_t(spark, d, "documents"))
    return r.filter(~N.fetch_ok(F.col("http_status"), F.col("fetch_error"))).select("url", "http_status", "fetch_error")


def decode_body(spark, d):
    found = N.native_markdown(C.responses_from_documents(_t(spark, d, "documents")))
    return found.select("url", "content", "source_content_type", "markdown_tokens")


def header_int(spark, d):
    r = C.responses_from_documents(_t(spark, d, "documents"))
    h = N.header(F.col("headers"), "X-Markdown-Tokens")
    return r.select("url", h.alias("raw"), N.markdown_tokens_header(h).alias("markdown_tokens"))


def decode_legacy(spark, d):
    """P3 on declared charsets: UTF-16 (fr), windows-1252 (de) and an unknown name (en) need Python, latin-1 (es) does not."""
    lang, text = F.col("lang"), F.regexp_replace("text", "[^\\x{00}-\\x{7f}\\x{a0}-\\x{ff}]", "?")
    charset = F.when(lang == "fr", "utf-16").when(lang == "de", "Windows-1252").when(lang == "es", "latin-1").otherwise("no-such-charset")
    body = F.when(lang == "fr", F.encode(text, "UTF-16")).when(lang.isin("de", "es"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return _t(spark, d, "documents").select("doc_id", N.decode_body(body, charset).alias("content"))


def accept_gate(spark, d):
    """the native route answers only if the Accept header asks for markdown."""
    r = C.responses_from_documents(_t(spark, d, "documents"))
    asked = {"default": JobOptions.from_env({}), "upper": JobOptions.from_env({ENV_ACCEPT: " TEXT/MARKDOWN "}), "html": JobOptions.from_env({ENV_ACCEPT: "text/html"})}
    parts = [N.native_markdown(r, o).select("url", F.lit(name).alias("accept")) for name, o in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def job_options(spark, d):
    """Request column, else environment, else default, for host, model and target."""
    lang = F.col("lang")
    req = _doc_requests(spark, d).withColumns({
        "summary_host": F.when(lang == "en", "http://own").when(lang == "fr", ""), "summary_model": F.when(lang == "de", "own-model"),
        "summary_target_tokens": F.when(lang == "en", 5).cast("int")})
    envs = {"none": {}, "set": {ENV_HOST: "http://env", ENV_MODEL: "env-model", ENV_TARGET: "70"}, "bad": {ENV_HOST: "", ENV_TARGET: "7x"}}
    parts = [M.summary_options(req, JobOptions.from_env(e)).select(
        "doc_id", F.lit(name).alias("environment"), F.col("s_host").alias("host"), F.col("s_model").alias("model"), F.col("s_target").alias("target_tokens"))
        for name, e in envs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- text --------------------------------------------------------------------

def token_estimate(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), T.token_estimate(F.col("text")).alias("estimated_tokens"))


def truncate_content(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", T.truncate_content(F.col("text"), F.col("lang") != "es", F.lit(TRUNCATE_AT)).alias("content"))


def noise_filter_core(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", T.noise_filter(F.col("text"), CORE_NOISE).alias("content"))


def noise_filter(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", T.noise_filter(F.col("text")).alias("content"))


def url_normalize(spark, d):
    v = C.url_variants(_t(spark, d, "pages"))
    return v.select("page_id", "variant", U.url_clean(F.col("url")).alias("clean_url"))


# --- summary planning ----------------------------------------------------------

def _doc_requests(spark, d):
    return C.requests_from_documents(_t(spark, d, "documents"), keep=(F.col("doc_id"), F.col("lang"), F.col("text").alias("content")))


def summary_options(spark, d):
    p = M.summary_options(_doc_requests(spark, d))
    return p.select(
        "doc_id", F.col("s_enabled").alias("enabled"), F.col("s_active").alias("active"), F.col("s_needed").alias("needed"),
        F.col("s_strategy").alias("strategy"), F.col("s_target").alias("target_tokens"), F.col("orig_tokens").alias("original_estimated_tokens"),
    )


def text_chunks(spark, d):
    doc = _t(spark, d, "documents")
    return M.text_chunks(doc.select("doc_id", F.col("text").alias("content")))


def chunk_target(spark, d):
    ch = text_chunks(spark, d).groupBy("doc_id").agg(F.max("n_chunks").alias("n_chunks"))
    return ch.select("doc_id", "n_chunks", M.chunk_target(F.lit(TARGET_FOR_CHUNKS), F.col("n_chunks")).alias("chunk_target"))


def _planned(spark, d):
    return M.summary_options(_doc_requests(spark, d))


def round1_prompts(spark, d):
    return M.round1_prompts(_planned(spark, d)).select("prompt_id", "doc_id", "round", "chunk_no", "model", "system", "prompt", "target_tokens")


def prompt_table(spark, d):
    return M.prompt_table(_planned(spark, d), M.prefix_summarizer()).select("prompt_id", "doc_id", "round", "chunk_no", "prompt", "target_tokens")


def prompt_sink(spark, d):
    return M.prompt_payload(M.round1_prompts(_planned(spark, d)))


def completion_source(spark, d):
    r1 = M.round1_prompts(_planned(spark, d))
    c = M.prefix_summarizer()(r1)
    return c.select("prompt_id", M.completion_text(F.col("body")).alias("response"))


def apply_completions(spark, d):
    r1 = M.round1_prompts(_planned(spark, d))
    a = M.apply_completions(r1, M.prefix_summarizer()(r1))
    return a.select("prompt_id", "doc_id", "chunk_no", "answer", "call_error")


def reduce_summaries(spark, d):
    r1 = M.round1_prompts(_planned(spark, d))
    a = M.apply_completions(r1, M.prefix_summarizer()(r1))
    return M.reduce_summaries(a).select("doc_id", "combined", "n_chunks")


def summarize_documents(spark, d):
    done = M.summarize(_planned(spark, d), M.prefix_summarizer())
    s = F.col("summarization")
    return done.select(
        "doc_id", "content", s["enabled"].alias("enabled"), s["used"].alias("used"), s["strategy"].alias("strategy"),
        s["target_tokens"].alias("target_tokens"), s["original_estimated_tokens"].alias("original_estimated_tokens"),
        s["final_estimated_tokens"].alias("final_estimated_tokens"), s["fallback_reason"].alias("fallback_reason"),
    )


def summary_meta(spark, d):
    """All nine fields."""
    done = M.summarize(_planned(spark, d), M.prefix_summarizer())
    return done.select("doc_id", "summarization.*")


def summary_decision(spark, d):
    """What became of each content."""
    done = M.summarize(_planned(spark, d), M.prefix_summarizer())
    s = F.col("summarization")
    decision = F.when(~s["used"], "not needed").when(s["fallback_reason"].isNotNull(), "kept").otherwise("replaced")
    return done.select("doc_id", decision.alias("decision"), F.length("content").cast("bigint").alias("content_chars"))


def summary_error(spark, d):
    """Every call for English documents fails; the original is kept with the reason."""
    planned = _planned(spark, d)

    def failing(prompts):
        ok = M.prefix_summarizer()(prompts)
        return ok.join(prompts.select("prompt_id", "doc_id"), "prompt_id").join(
            _t(spark, d, "documents").select("doc_id", "lang"), "doc_id"
        ).select(
            "prompt_id",
            F.when(F.col("lang") == "en", F.lit(None).cast("string")).otherwise(F.col("body")).alias("body"),
            F.when(F.col("lang") == "en", F.lit("HTTP Error 500: model unavailable")).alias("error"),
        )

    done = M.summarize(planned, failing)
    s = F.col("summarization")
    return done.select("doc_id", s["used"].alias("used"), s["strategy"].alias("strategy"), s["fallback_reason"].alias("fallback_reason"),
                       s["final_estimated_tokens"].alias("final_estimated_tokens"))


def chunk_debug(spark, d):
    done = M.summarize(_planned(spark, d), M.prefix_summarizer())
    return done.filter(F.col("summarization.strategy") == "map-reduce").select(
        "doc_id", F.lit("map-reduce").alias("stage"), F.col("num_chunks").cast("bigint").alias("num_chunks"))


# --- HTML ----------------------------------------------------------------------

def _prepared(spark, d):
    return H.prepare(_t(spark, d, "pages"))


def html_tokens(spark, d):
    t = H.html_tokens(_t(spark, d, "pages").repartition("page_id"), keep_cols=())
    return t.filter(F.col("tok").isNotNull()).select("page_id", F.col("pos").cast("bigint").alias("pos"), "tok")


def html_attrs(spark, d):
    t = H.classify_tokens(H.html_tokens(_t(spark, d, "pages").repartition("page_id"), keep_cols=()))
    return t.filter(F.col("attrs").isNotNull()).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "tag", F.explode("attrs").alias("name", "value"))


def entity_decode(spark, d):
    t = H.classify_tokens(H.html_tokens(_t(spark, d, "pages").repartition("page_id"), keep_cols=()))
    return t.filter(F.col("kind") == "entity").select("page_id", F.col("pos").cast("bigint").alias("pos"), "tok", F.col("val").alias("value"))


def text_nodes(spark, d):
    t = H.text_nodes(H.classify_tokens(H.html_tokens(_t(spark, d, "pages").repartition("page_id"), keep_cols=())))
    return t.filter(F.col("kind") == "text").select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


def html_elements(spark, d):
    p = _t(spark, d, "pages").repartition("page_id")
    el = H.html_elements(H.text_nodes(H.classify_tokens(H.html_tokens(p))))
    return el.filter(F.col("e").isNotNull()).select("page_id", F.col("pos").alias("start"), F.col("e").alias("end"), "tag", "kind", "paired")


def prune_page_chrome(spark, d):
    r = H.prepare(C.rich_pages(_t(spark, d, "documents")))
    return r.filter(F.col("pruned") & F.col("kind").isin("open", "void", "raw")).select("page_id", "pos", "tag")


def prune_non_content(spark, d):
    r = _prepared(spark, d)
    return r.filter(~F.col("removed")).select("page_id", "pos", "kind", "tag")


def prune_empty_containers(spark, d):
    r = H.prepare(C.rich_pages(_t(spark, d, "documents")))
    return r.filter(F.col("removed") & ~F.col("pruned") & F.col("tag").isin("div", "span") & (F.col("kind") == "open")).select("page_id", "pos", "tag")


def main_region(spark, d):
    r = _prepared(spark, d)
    return r.groupBy("page_id").agg(F.first("region").alias("region")).select(
        "page_id", F.col("region.prio").alias("priority"), F.col("region.s").alias("start"), F.col("region.e").alias("end"))


def _blocks(spark, d, rich=True):
    pages = C.rich_pages(_t(spark, d, "documents")) if rich else _t(spark, d, "pages")
    reg = H.prepare(pages)
    rows = reg.filter(F.col("in_region") & ~F.col("kind").isin("comment", "decl", "none"))
    return H.render_blocks(H.block_units(H.block_segments(rows)))


def block_segments(spark, d):
    return _blocks(spark, d, rich=False).select("page_id", "blk", "block_tag", "block_kind", "md")


def _render(tags):
    def q(spark, d):
        b = _blocks(spark, d)
        return b.filter(F.col("block_tag").isin(tags)).select("page_id", "blk", "block_tag", "md")
    return q


def hidden_filter(spark, d):
    reg = H.prepare(C.rich_pages(_t(spark, d, "documents")))
    rows = reg.filter(F.col("in_region") & H.is_hidden_style(F.col("attrs")))
    return rows.select("page_id", "pos", "tag", F.col("attrs")["style"].alias("style"))


def prune_hidden(spark, d):
    """The texts and styled elements that survive inside the blocks."""
    reg = H.prepare(C.rich_pages(_t(spark, d, "documents")))
    b = H.block_segments(reg.filter(F.col("in_region") & ~F.col("kind").isin("comment", "decl", "none")))
    return b.filter((F.col("kind") == "text") | F.col("attrs")["style"].isNotNull()).select("page_id", "pos", "kind", "tag", "text")


def render_inline(spark, d):
    """The parts of each paragraph, one row per direct child."""
    reg = H.prepare(C.rich_pages(_t(spark, d, "documents")))
    units = H.block_units(H.block_segments(reg.filter(F.col("in_region") & ~F.col("kind").isin("comment", "decl", "none"))))
    return H.inline_parts(units).select("page_id", "blk", "unit", "tag", "inline")


def assemble_markdown(spark, d):
    """The blocks of each page joined in order, before normalisation."""
    b = _blocks(spark, d)
    parts = F.array_sort(F.collect_list(F.when(F.col("md").isNotNull(), F.struct("blk", "md"))))
    pages = b.groupBy("page_id", H.AS_SORTED).agg(F.count("md").alias("n_blocks"), F.array_join(F.transform(parts, lambda x: x["md"]), "\n").alias("joined"))
    return pages.drop(H.AS_SORTED)


def link_filter(spark, d):
    b = _blocks(spark, d)
    return b.filter(F.col("md").contains("](") | (F.col("block_tag") == "a")).select("page_id", "blk", "block_tag", "md")


def page_markdown(spark, d):
    return H.page_markdown(_t(spark, d, "pages"))


def page_markdown_raw(spark, d):
    """H27 without the noise filter (whose back-reference steps DuckDB cannot run)."""
    return H.page_markdown(_t(spark, d, "pages"), denoise=False)


def rich_page_markdown_raw(spark, d):
    return H.page_markdown(C.rich_pages(_t(spark, d, "documents")), denoise=False)


def rich_page_markdown(spark, d):
    return H.page_markdown(C.rich_pages(_t(spark, d, "documents")))


def prune_consent_nodes(spark, d):
    """H6 (opt-in): class or id containing cookie/banner; compare with the default run."""
    r = H.prepare(C.rich_pages(_t(spark, d, "documents")), consent=True)
    return r.filter(F.col("pruned") & (F.col("kind") == "open") & F.coalesce(F.col("attrs")["class"], F.lit("")).contains("cookie")).select("page_id", "pos", "tag")


def render_other(spark, d):
    b = _blocks(spark, d)
    known = H.HEADING_TAGS + ["p", "ul", "ol", "blockquote", "pre", "code", "table", "img", "a"]
    return b.filter(~F.col("block_tag").isin(known) & (F.col("block_kind") != "text")).select("page_id", "blk", "block_tag", "md")


def min_text_filter(spark, d):
    """loose text nodes need more than 1 character, other elements more than 2."""
    b = _blocks(spark, d)
    return b.filter((F.col("block_kind") == "text") | ~F.col("block_tag").isin(H.HEADING_TAGS + ["p", "ul", "ol", "blockquote", "pre", "code", "table", "img", "a"])).select(
        "page_id", "blk", "block_kind", "block_tag", F.col("md").isNotNull().alias("kept"))


def normalize_lines(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", T.normalize_lines(F.col("text")).alias("content"))


def empty_fallback(spark, d):
    return H.page_markdown(C.chrome_only_pages(_t(spark, d, "documents")))


def empty_fallback_raw(spark, d):
    """H26 before the noise filter (DuckDB-checkable)."""
    return H.page_markdown(C.chrome_only_pages(_t(spark, d, "documents")), denoise=False)


def summarize_needed(spark, d):
    return summary_options(spark, d).select("doc_id", "enabled", "active", "needed")


def summary_strategy(spark, d):
    return summary_options(spark, d).select("doc_id", "strategy")


def render_route(spark, d):
    _, pages, responses = _captures(spark, d)
    return R.routes(R.valid_requests(all_requests(spark, d))[0], responses, pages).select("request_id", "clean_url", "render_method")


def result_envelope(spark, d):
    return result_sink(spark, d).select("request_id", "json")


def error_envelope(spark, d):
    return R.read_errors(*_captures(spark, d)).select("request_id", "json")


# --- results ---------------------------------------------------------------------

def _captures(spark, d):
    """Requests for every page and document, and in every malformed spelling; pages; responses."""
    pages = _t(spark, d, "pages")
    doc = _t(spark, d, "documents")
    req = C.all_page_requests(pages).unionByName(C.requests_from_documents(doc))
    return req, pages.unionByName(C.pages_for_documents(doc)), C.responses_from_documents(doc)


def _store(spark, d):
    """Requests, and a capture store of the pages and responses."""
    req, pages, responses = _captures(spark, d)
    return req, create_captures(spark, fresh_path(spark, "captures"), pages, responses)


def _read(spark, d):
    req, store = _store(spark, d)
    return R.read_urls(req, store, summarizer=M.prefix_summarizer())


def result_sink(spark, d):
    res, _ = _read(spark, d)
    return res.select("request_id", "url", "render_method", "json")


def error_sink(spark, d):
    return R.read_errors(*_captures(spark, d)).select("request_id", "error", "url", "status")


def status_split(spark, d):
    return R.status_split(*_captures(spark, d))


def request_response_join(spark, d):
    pages = _t(spark, d, "pages")
    doc = _t(spark, d, "documents")
    ok, _ = R.routed(all_requests(spark, d), C.responses_from_documents(doc), pages.unionByName(C.pages_for_documents(doc)))
    return ok.select("request_id", "clean_url", "render_method", "source_content_type", "markdown_tokens", "error")


def extraction_report(spark, d):
    res, err = _read(spark, d)
    return X.extraction_report(res, err)


def summary_plan_report(spark, d):
    return X.summary_plan_report(M.prompt_table(_planned(spark, d), M.prefix_summarizer()))


def noise_audit(spark, d):
    return X.noise_audit(_t(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("host"), F.col("text").alias("content")))


# --- streaming -----------------------------------------------------------------------

def stream_results(spark, d):
    from ..streaming import jobs
    return jobs.stream_requests(spark, d)


def stream_waiting(spark, d):
    from ..streaming import jobs
    return jobs.stream_waiting(spark, d)


def capture_store(spark, d):
    """The capture that a store's index picks for each requested URL."""
    req, store = _store(spark, d)
    wanted = R.valid_requests(req)[0].select(F.col("clean_url").alias("url")).distinct()
    return store.picks(wanted).select("url", "native", "page_id")


def committed_batches(spark, d):
    """S4 + S5: results and errors of the page requests committed as one batch and read back by the manifest."""
    pages = _t(spark, d, "pages")
    at = fresh_path(spark, "sink")
    write_results(*R.read_urls(C.all_page_requests(pages), pages), at, batch="pages")
    results, errors = read_committed(spark, at)
    return results.select("request_id", "url", "status", "batch").unionByName(errors.select("request_id", "url", "status", "batch"))


def stream_light(spark, d):
    from ..streaming import jobs
    return jobs.stream_light(spark, d)


QUERIES = {
    "request_source": request_source,
    "response_source": response_source,
    "page_source": page_source,
    "result_sink": result_sink,
    "error_sink": error_sink,
    "completion_source": completion_source,
    "prompt_sink": prompt_sink,
    "url_validation": url_validation,
    "url_normalize": url_normalize,
    "url_budget": url_budget,
    "native_markdown_filter": native_markdown_filter,
    "fetch_failure_filter": fetch_failure_filter,
    "decode_body": decode_body,
    "decode_legacy": decode_legacy,
    "accept_gate": accept_gate,
    "job_options": job_options,
    "header_int": header_int,
    "status_split": status_split,
    "request_response_join": request_response_join,
    "token_estimate": token_estimate,
    "truncate_content": truncate_content,
    "noise_filter_core": noise_filter_core,
    "noise_filter": noise_filter,
    "summary_options": summary_options,
    "text_chunks": text_chunks,
    "chunk_target": chunk_target,
    "round1_prompts": round1_prompts,
    "prompt_table": prompt_table,
    "apply_completions": apply_completions,
    "reduce_summaries": reduce_summaries,
    "summarize_documents": summarize_documents,
    "summary_error": summary_error,
    "chunk_debug": chunk_debug,
    "html_tokens": html_tokens,
    "html_attrs": html_attrs,
    "entity_decode": entity_decode,
    "text_nodes": text_nodes,
    "html_elements": html_elements,
    "prune_page_chrome": prune_page_chrome,
    "prune_non_content": prune_non_content,
    "prune_empty_containers": prune_empty_containers,
    "main_region": main_region,
    "hidden_filter": hidden_filter,
    "block_segments": block_segments,
    "render_heading": _render(H.HEADING_TAGS),
    "render_paragraph": _render(["p"]),
    "render_list": _render(["ul", "ol"]),
    "render_blockquote": _render(["blockquote"]),
    "render_code_block": _render(["pre"]),
    "render_table": _render(["table"]),
    "render_image": _render(["img"]),
    "render_link": _render(["a"]),
    "render_inline": render_inline,
    "render_inline_code_block": _render(["code"]),
    "render_other": render_other,
    "min_text_filter": min_text_filter,
    "prune_consent_nodes": prune_consent_nodes,
    "prune_hidden": prune_hidden,
    "normalize_lines": normalize_lines,
    "assemble_markdown": assemble_markdown,
    "empty_fallback": empty_fallback,
    "empty_fallback_raw": empty_fallback_raw,
    "summarize_needed": summarize_needed,
    "summary_strategy": summary_strategy,
    "summary_decision": summary_decision,
    "summary_meta": summary_meta,
    "render_route": render_route,
    "result_envelope": result_envelope,
    "error_envelope": error_envelope,
    "link_filter": link_filter,
    "page_markdown": page_markdown,
    "rich_page_markdown": rich_page_markdown,
    "page_markdown_raw": page_markdown_raw,
    "rich_page_markdown_raw": rich_page_markdown_raw,
    "extraction_report": extraction_report,
    "summary_plan_report": summary_plan_report,
    "noise_audit": noise_audit,
    "stream_results": stream_results,
    "stream_light": stream_light,
    "stream_waiting": stream_waiting,
    "capture_store": capture_store,
    "committed_batches": committed_batches,
}
