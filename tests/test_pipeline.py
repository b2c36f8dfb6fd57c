"""End-to-end: requests to result/error rows, envelope keys, stream = batch."""

import json

from pyspark.sql import functions as F

from weftmark.operators import summary as M
from weftmark.options import JobOptions
from weftmark.plans import corpus as C
from weftmark.plans import read_urls as R

from .conftest import SF


def test_read_urls_end_to_end(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    req = C.requests_from_pages(pages).unionByName(C.requests_from_documents(docs))
    bad = spark.createDataFrame([(900001, "ftp://invalid"), (900002, "   ")], "request_id bigint, url string")
    req = req.unionByName(bad, allowMissingColumns=True)
    res, err = R.read_urls(req, pages.unionByName(C.pages_for_documents(docs)), C.responses_from_documents(docs), M.prefix_summarizer())
    res_rows, err_rows = res.collect(), err.collect()
    assert len(res_rows) + len(err_rows) == req.count()
    assert {(e.request_id, e.error, e.url) for e in err_rows} == {
        (900001, "url must start with http:// or https://", "ftp://invalid"), (900002, "url cannot be empty", "")}
    for r in res_rows:
        env = json.loads(r.json)
        keys = list(env)
        assert keys[:10] == ["url", "content", "format", "status", "wait_for_selector", "wait_time", "scroll_to_bottom", "truncate", "max_length", "render_method"]
        assert keys[-1] == "summarization" and len(env["summarization"]) == 9
        if r.render_method == "playwright":
            assert "source_content_type" not in env
        if r.truncate and r.max_length:
            assert len(r.content) <= r.max_length + 25
    routes = {r.render_method for r in res_rows}
    assert routes == {"native_markdown", "playwright"}


def test_stream_equals_batch(spark):
    from weftmark.streaming import jobs

    streamed = sorted(map(tuple, jobs.stream_requests(spark, SF).collect()))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    responses = C.responses_from_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    res, err = R.read_urls(C.all_page_requests(pages), pages, responses, M.prefix_summarizer())
    cols = ["request_id", "url", "status", "json"]
    assert streamed == sorted(map(tuple, res.select(cols).unionByName(err.select(cols)).collect()))


def test_without_a_summarizer_the_content_stays(spark):
    text = "word " * 400
    pages = spark.createDataFrame([(1, "https://x.example/a", f"<html><body><p>{text}</p></body></html>")], "page_id bigint, url string, html string")
    req = spark.createDataFrame([(1, "https://x.example/a", True, 50)], "request_id bigint, url string, use_summarization boolean, summary_target_tokens int")
    row = R.read_urls(req, pages)[0].first()
    assert row.content == text.strip() and row.summarization.fallback_reason == "error: no summarizer"


def test_captures_are_picked_by_order_not_by_content(spark):
    from weftmark.operators import native as N

    ct = {"Content-Type": "text/markdown"}
    rows = [("u", 200, None, ct, b"", 9), ("u", 200, None, ct, b"b real", 1), ("u", 200, None, ct, b"a later", 2), ("e", 200, None, ct, b"", 1), ("n", 200, None, ct, None, 1)]
    df = spark.createDataFrame(rows, "url string, http_status int, fetch_error string, headers map<string,string>, body binary, capture_seq long")
    assert {r.url: r.content for r in N.one_per_url(N.native_markdown(df)).collect()} == {"u": "a later", "e": ""}
    html = [(1, "u", " "), (2, "u", "<p>x</p>"), (3, "u", "<p>y</p>"), (4, "v", None)]
    pages = spark.createDataFrame(html, "page_id bigint, url string, html string")
    assert {r.url: r.page_id for r in R.picked_pages(pages).collect()} == {"u": 2, "v": 4}
    assert R.picked_pages(pages.withColumn("capture_seq", F.col("page_id"))).filter("url = 'u'").first().page_id == 3


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_error_rows_convert_no_page_and_results_only_needed_ones(spark):
    from weftmark.plans import queries as Q

    for name in ("error_sink", "error_envelope", "status_split", "render_route"):
        assert "regexp_extract_all" not in _plan(Q.QUERIES[name](spark, SF))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted, _ = R.valid_requests(C.requests_from_pages(pages))
    plan = _plan(R.content_by_url(accepted, C.responses_from_documents(docs), pages, JobOptions()))
    below = plan[plan.index("regexp_extract_all"):]
    assert "LeftSemi" in below and "LeftAnti" in below


def test_hot_url_join_is_split(spark):
    """90% of the requests name one URL; its partition must be split by the adaptive skew join."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in low}
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example/"), "id").alias("url"), F.lit("<p>some text</p>").alias("html"))
    req = spark.range(100_000).repartition(8).select(
        F.col("id").alias("request_id"), F.concat(F.lit("https://h.example/"), F.when(F.col("id") % 10 == 0, F.col("id") % 200).otherwise(7)).alias("url"))
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        ok, _ = R.routed(req, None, pages)
        assert ok.filter("error is null").count() == 100_000
        joined = ok.select("request_id", "content")
        joined.write.format("noop").mode("overwrite").save()
        qe = joined._jdf.queryExecution()
        joined.collect()
        assert "skew=true" in qe.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_url_is_summarized_once(spark):
    pages = spark.createDataFrame([(1, "https://x.example/a", "<html><body><p>" + "word " * 400 + "</p></body></html>")],
                                  "page_id bigint, url string, html string")
    req = spark.createDataFrame([(i, "https://x.example/a", True, 50) for i in range(6)],
                                "request_id bigint, url string, use_summarization boolean, summary_target_tokens int")
    seen = []

    def counting(prompts):
        seen.append(prompts.count())
        return M.prefix_summarizer()(prompts)

    res, err = R.read_urls(req, pages, summarizer=counting)
    rows = res.collect()
    assert len(rows) == 6 and err.count() == 0
    assert seen[0] == 1  # one prompt for six identical requests
    assert {r.content for r in rows} == {rows[0].content} and rows[0].summarization.used
