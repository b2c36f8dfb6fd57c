"""Requests in, one result or error row out.

``requests -> validate -> route (native markdown | page markdown) -> summary
plan -> truncate -> envelope``. Live fetching is not data work: the captured
``responses`` and ``pages`` tables stand for the network and the browser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_content
from ..functions.urls import url_clean, url_echo, url_error
from ..operators import html as H
from ..operators import native as N
from ..operators import summary as M
from ..options import (
    DEFAULT_MAX_LENGTH,
    DEFAULT_SCROLL,
    DEFAULT_TRUNCATE,
    DEFAULT_USE_SUMMARIZATION,
    DEFAULT_WAIT_TIME,
    JobOptions,
)
from ..schemas import REQUEST
from ..session import staged
from ..sources.captures import CaptureStore

RENDER_NATIVE = "native_markdown"
RENDER_BROWSER = "playwright"
FAILURE_PREFIX = "Web URL reading failed: "


def request_defaults(requests: DataFrame) -> DataFrame:
    """The fixed request schema with defaults; a null takes the default."""
    cols = []
    defaults = {
        "wait_time": DEFAULT_WAIT_TIME,
        "scroll_to_bottom": DEFAULT_SCROLL,
        "truncate": DEFAULT_TRUNCATE,
        "max_length": DEFAULT_MAX_LENGTH,
        "use_summarization": DEFAULT_USE_SUMMARIZATION,
    }
    for f in REQUEST.fields:
        c = F.col(f.name) if f.name in requests.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    extra = [c for c in requests.columns if c not in REQUEST.fieldNames()]
    return requests.select(*cols, *extra)


def validate(requests: DataFrame) -> DataFrame:
    """F1 + P1: ``error`` (null when valid) and the stripped ``clean_url``."""
    return requests.withColumn("error", url_error(F.col("url"))).withColumn("clean_url", url_clean(F.col("url")))


def picked_pages(pages: DataFrame) -> DataFrame:
    """One capture per URL, ``(url, page_id)``: one with HTML before a blank one, then the latest by
    ``capture_seq`` (pages without that column count as simultaneous), then the smallest page_id.

    Only these narrow columns are shuffled, with map-side partial minima.
    """
    seq = (F.col(N.CAPTURE_ORDER) if N.CAPTURE_ORDER in pages.columns else F.lit(0)).cast("long")
    blank = F.coalesce(F.btrim(F.col("html")) == "", F.lit(True))
    pick = F.min(F.struct(blank.alias("blank"), (-seq).alias("age"), "page_id"))
    return pages.select(url_clean(F.col("url")).alias("url"), "page_id", "html", *([N.CAPTURE_ORDER] if N.CAPTURE_ORDER in pages.columns else [])).groupBy(
        "url").agg(pick.alias("p")).select("url", F.col("p.page_id").alias("page_id"))


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` requests; neither reads a capture."""
    req = validate(request_defaults(requests))
    return req.filter(F.col("error").isNull()).drop("error"), req.filter(F.col("error").isNotNull())


def _native(responses: DataFrame | None, options: JobOptions) -> DataFrame | None:
    return N.native_markdown(responses, options) if responses is not None and options.native_enabled else None


NATIVE_COLUMNS = ["content", "source_content_type", "markdown_tokens", "decode_error"]


def _converted(pages: DataFrame, options: JobOptions, repartition: bool = True) -> DataFrame:
    """Content rows of the page route; ``repartition`` is False for pages that lie in their key's buckets."""
    return H.page_markdown(pages, "page_id", chrome=options.prune_page_chrome, consent=options.prune_consent_nodes, repartition=repartition)


def stored_content(store: CaptureStore, picks: DataFrame, options: JobOptions, capture: Column) -> DataFrame:
    """Contents of staged ``picks`` of a store: ``(capture, render_method, content, …, decode_error)``.

    ``capture`` names a pick, by its columns (``url, native, page_id, ingest``). The picks are
    narrow; contents stay in their buckets up to the result.
    """
    native = store.native_contents(picks).join(picks.filter("native").select("url", "ingest", capture.alias("capture")).distinct(), ["url", "ingest"])
    native = native.select("capture", F.lit(RENDER_NATIVE).alias("render_method"), *NATIVE_COLUMNS)
    pages = _converted(store.picked_pages(picks), options, repartition=False).select("page_id", "content")
    named = pages.join(picks.filter(~F.col("native")).select("page_id", capture.alias("capture")).distinct(), "page_id")
    return native.unionByName(named.select(
        "capture", F.lit(RENDER_BROWSER).alias("render_method"), "content",
        F.lit(None).cast("string").alias("source_content_type"), F.lit(None).cast("int").alias("markdown_tokens"), F.lit(None).cast("string").alias("decode_error")))


def content_by_url(accepted: DataFrame, responses: DataFrame | None, pages: DataFrame | CaptureStore, options: JobOptions) -> DataFrame:
    """One row per requested URL that has a capture: the native answer if there is one, else the
    converted page.

    The cheap route comes first: a page is converted only if its URL is requested and has no
    native answer. The URL lists that decide this are narrow. With a capture store in place of
    ``pages`` (``responses`` is then not read) the store's index decides, and contents are not exchanged.
    """
    wanted = accepted.select(F.col("clean_url").alias("url")).distinct()
    if isinstance(pages, CaptureStore):
        picks = staged(pages.picks(wanted, options), "picks")
        return stored_content(pages, picks, options, F.col("url")).withColumnRenamed("capture", "url")
    native, need = None, wanted
    if (found := _native(responses, options)) is not None:
        native = N.one_per_url(found).join(wanted, "url", "left_semi").select(
            "url", F.lit(RENDER_NATIVE).alias("render_method"), *NATIVE_COLUMNS)
        need = wanted.join(found.select("url").distinct(), "url", "left_anti")
    ids = picked_pages(pages).join(need, "url", "left_semi")
    some = pages.join(ids.select("page_id"), "page_id", "left_semi")
    converted = _converted(some, options).select(
        url_clean(F.col("url")).alias("url"), F.lit(RENDER_BROWSER).alias("render_method"), "content",
        F.lit(None).cast("string").alias("source_content_type"), F.lit(None).cast("int").alias("markdown_tokens"), F.lit(None).cast("string").alias("decode_error"))
    return converted if native is None else native.unionByName(converted)


def _no_capture(clean_url: Column) -> Column:
    return F.concat(F.lit(FAILURE_PREFIX + "no captured response or page for "), clean_url)


def routes(accepted: DataFrame, responses: DataFrame | None, pages: DataFrame | CaptureStore, options: JobOptions | None = None) -> DataFrame:
    """Render method of each request, and the error of one without a capture, from URL lists alone."""
    options = options or JobOptions()
    if isinstance(pages, CaptureStore):
        known = pages.picks(options=options).select("url", F.col("native").cast("int").alias("native"), "decode_error")
    else:
        known = pages.select(url_clean(F.col("url")).alias("url"), F.lit(0).alias("native"), F.lit(None).cast("string").alias("decode_error"))
        if (found := _native(responses, options)) is not None:
            known = known.unionByName(found.select("url", F.lit(1).alias("native"), F.coalesce("decode_error", F.lit("")).alias("decode_error")))
    # a URL fails if none of its native answers is readable
    known = staged(known.groupBy("url").agg(F.max("native").alias("native"), F.nullif(F.min("decode_error"), F.lit("")).alias("decode_error")), "known-urls")
    j = accepted.join(known.select(F.col("url").alias("clean_url"), "native", "decode_error"), "clean_url", "left")
    method = F.when(F.col("native") == 1, F.lit(RENDER_NATIVE)).otherwise(F.lit(RENDER_BROWSER))
    error = F.when(F.col("native").isNull(), _no_capture(F.col("clean_url"))).otherwise(F.col("decode_error"))
    return j.withColumns({"render_method": method, "error": error}).drop("native", "decode_error")


def routed(requests: DataFrame, responses: DataFrame | None, pages: DataFrame | CaptureStore, options: JobOptions | None = None):
    """J1 + P7: ``(accepted requests with their content, rejected requests)``.

    The contents are written as one row per URL first. The join is then between two plain
    inputs, so the adaptive skew join can split a URL that a third of all requests name.
    """
    options = options or JobOptions()
    accepted, bad = valid_requests(requests)
    content = staged(content_by_url(accepted, responses, pages, options), "content").withColumnRenamed("url", "clean_url")
    ok = accepted.join(content, "clean_url", "left")
    error = F.when(F.col("render_method").isNull(), _no_capture(F.col("clean_url"))).otherwise(F.col("decode_error"))
    return ok.withColumn("error", error).withColumn("render_method", F.coalesce("render_method", F.lit(RENDER_BROWSER))).drop("decode_error"), bad


def _summarization_json_struct(s: Column) -> Column:
    return F.struct(*[s[f].alias(f) for f in [
        "enabled", "used", "strategy", "model", "host", "target_tokens",
        "original_estimated_tokens", "final_estimated_tokens", "fallback_reason"]])


def envelope_json(df: DataFrame) -> Column:
    """P8 + S4: the success envelope as JSON, keys in the reference's order, nulls kept.

    ``source_content_type`` / ``markdown_tokens`` appear only on the native route,
    ``markdown_tokens`` only when the header held an integer.
    """
    base = [
        F.col("url"), F.col("content"), F.lit("markdown").alias("format"), F.lit("success").alias("status"),
        F.col("wait_for_selector"), F.col("wait_time"), F.col("scroll_to_bottom"), F.col("truncate"), F.col("max_length"),
        F.col("render_method"),
    ]
    summ = _summarization_json_struct(F.col("summarization")).alias("summarization")
    opts = {"ignoreNullFields": "false"}
    browser = F.to_json(F.struct(*base, summ), opts)
    native_no_tok = F.to_json(F.struct(*base, F.col("source_content_type"), summ), opts)
    native_tok = F.to_json(F.struct(*base, F.col("source_content_type"), F.col("markdown_tokens"), summ), opts)
    return (
        F.when(F.col("render_method") == RENDER_BROWSER, browser)
        .when(F.col("markdown_tokens").isNull(), native_no_tok)
        .otherwise(native_tok)
    )


SUMMARY_OPTIONS = ["use_summarization", "summary_target_tokens", "summary_host", "summary_model"]


def summarize_distinct(contents: DataFrame, summarizer: M.Summarizer, options: JobOptions) -> DataFrame:
    """Final content and ``summarization`` for rows with content and summary options.

    Rows whose options ask for no summary pass by unchanged. The others are planned once per
    distinct content and options: the key is a SHA-256, grouped with map-side partial
    aggregation, and the answers are joined back as a stage table.
    """
    planned = M.summary_options(contents, options)
    needed = staged(planned.filter(F.col("s_needed")).withColumn(
        "skey", F.concat(F.sha2(F.col("content"), 256), F.to_json(F.struct("s_target", "s_host", "s_model", "s_enabled", "s_active")))), "to-summarize")
    plain = M.not_summarized(planned.filter(~F.col("s_needed")))
    own = ["content", "orig_tokens", *[c for c in needed.columns if c.startswith("s_")]]
    uniq = staged(needed.groupBy("skey").agg(*[F.first(c).alias(c) for c in own]), "contents")
    done = staged(M.summarize(uniq, summarizer, "skey").select("skey", F.col("content").alias("_final"), "summarization"), "summaries")
    joined = needed.drop(*own).join(done, "skey").drop("skey").withColumnRenamed("_final", "content")
    return plain.unionByName(joined)


def read_urls(requests: DataFrame, pages: DataFrame | CaptureStore, responses: DataFrame | None = None,
              summarizer: M.Summarizer | None = None, options: JobOptions | None = None):
    """The whole job. Returns ``(results, errors)``.

    ``results``: request_id, url, content, format, status, echoed options,
    render_method, source_content_type, markdown_tokens, summarization, json.
    ``errors``: request_id, error, url, status, json.

    The captures are a ``CaptureStore``, or a ``pages`` and a ``responses`` table. Without a
    summarizer, content that needs a summary stays as it is, with the error ``no summarizer`` in
    its summarization.
    """
    options = options or JobOptions()
    accepted, _ = valid_requests(requests)
    content = staged(content_by_url(accepted, responses, pages, options), "content").withColumnRenamed("url", "capture")
    res = results_of(accepted.withColumn("capture", F.col("clean_url")), content, summarizer, options)
    return res, read_errors(requests, pages, responses, options)


def results_of(accepted: DataFrame, content: DataFrame, summarizer: M.Summarizer | None, options: JobOptions) -> DataFrame:
    """Result rows of the accepted requests whose ``capture`` is in ``content`` (staged, a row for each capture)."""
    # what a result's content depends on: the capture and the summary options
    asked = accepted.select("capture", *SUMMARY_OPTIONS).distinct()
    finals = asked.join(content.filter("decode_error is null").drop("decode_error"), "capture")
    rkey = F.to_json(F.struct("capture", *SUMMARY_OPTIONS))
    done = staged(summarize_distinct(finals, summarizer or M.no_summarizer(), options).withColumn("rkey", rkey)
                  .select("rkey", "content", "render_method", "source_content_type", "markdown_tokens", "summarization"), "finals")
    res = accepted.withColumn("rkey", rkey).join(done, "rkey")
    res = res.withColumn("content", truncate_content(F.col("content"), F.col("truncate"), F.col("max_length")))
    res = res.select(
        "request_id", F.col("clean_url").alias("url"), "content", F.lit("markdown").alias("format"), F.lit("success").alias("status"),
        "wait_for_selector", "wait_time", "scroll_to_bottom", "truncate", "max_length",
        "render_method", "source_content_type", "markdown_tokens", "summarization",
    )
    return res.withColumn("json", envelope_json(res))


def read_picked(requests: DataFrame, store: CaptureStore, summarizer: M.Summarizer | None = None, options: JobOptions | None = None):
    """``(results, errors)`` of requests that carry their capture: ``native, page_id, ingest, decode_error``, all null where none came."""
    options = options or JobOptions()
    pick = ["native", "page_id", "ingest"]
    accepted, bad = valid_requests(requests)
    key = F.to_json(F.struct(F.col("clean_url").alias("url"), *pick))
    found = accepted.filter(F.col("native").isNotNull() & F.col("decode_error").isNull()).withColumn("capture", key)
    picks = staged(found.select(F.col("clean_url").alias("url"), *pick).distinct(), "picks")
    content = staged(stored_content(store, picks, options, F.to_json(F.struct("url", *pick))), "content")
    failed = accepted.withColumn("error", F.when(F.col("native").isNull(), _no_capture(F.col("clean_url"))).otherwise(F.col("decode_error"))).filter(F.col("error").isNotNull())
    return results_of(found, content, summarizer, options), error_rows(bad, failed)


def read_errors(requests: DataFrame, pages: DataFrame | CaptureStore, responses: DataFrame | None = None, options: JobOptions | None = None) -> DataFrame:
    """P9 + S5: rejected requests and accepted ones without a capture; converts no page."""
    accepted, bad = valid_requests(requests)
    failed = routes(accepted, responses, pages, options).filter(F.col("error").isNotNull())
    return error_rows(bad, failed)


def error_rows(bad: DataFrame, failed: DataFrame) -> DataFrame:
    """Error rows of rejected requests (``url`` echoed) and of accepted ones that failed (``clean_url``)."""
    err = bad.select("request_id", "error", url_echo(F.col("url")).alias("url"), F.lit("error").alias("status")).unionByName(
        failed.select("request_id", "error", F.col("clean_url").alias("url"), F.lit("error").alias("status")))
    return err.withColumn("json", F.to_json(F.struct("error", "url", "status"), {"ignoreNullFields": "false"}))


def status_split(requests: DataFrame, pages: DataFrame | CaptureStore, responses: DataFrame | None = None, options: JobOptions | None = None) -> DataFrame:
    """one status row per request (success / error), from URL lists alone."""
    accepted, bad = valid_requests(requests)
    known = routes(accepted, responses, pages, options)
    return known.select("request_id", F.col("clean_url").alias("url"), F.when(F.col("error").isNull(), "success").otherwise("error").alias("status")).unionByName(
        bad.select("request_id", url_echo(F.col("url")).alias("url"), F.lit("error").alias("status")))
