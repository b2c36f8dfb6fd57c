"""Readers and writers round-trip through files."""

import json
import os
import tempfile

from weftmark.plans import corpus as C
from weftmark.plans import read_urls as R
from weftmark.sources import io as IO

from .conftest import SF


def test_requests_json_to_results_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="weftmark-io-")
    with open(os.path.join(d, "requests.json"), "w") as f:
        f.write(json.dumps({"request_id": 1, "url": "ftp://invalid"}) + "\n")
        f.write(json.dumps({"request_id": 2, "url": "https://x.example/a", "max_length": 20}) + "\n")
        f.write("{not json}\n")
    pages = spark.createDataFrame([(7, "https://x.example/a", "<html><body><p>" + "word " * 50 + "</p></body></html>")],
                                  "page_id bigint, url string, html string")
    req = IO.read_requests(spark, os.path.join(d, "requests.json"))
    assert req.columns[:2] == ["request_id", "url"]
    res, err = R.read_urls(req, pages)
    IO.write_results(res, err, os.path.join(d, "out"), fmt="json")
    ok = [json.loads(x.value) for x in spark.read.text(os.path.join(d, "out/results")).collect()]
    bad = [json.loads(x.value) for x in spark.read.text(os.path.join(d, "out/errors")).collect()]
    assert [o["url"] for o in ok] == ["https://x.example/a"] and len(ok[0]["content"]) == 20 + 25
    errors = sorted((b["error"], b["url"]) for b in bad)
    assert ("url must start with http:// or https://", "ftp://invalid") in errors
    assert ("url must be a non-empty string", None) in errors  # the unparseable line


def test_prompts_and_completions_files(spark):
    from weftmark.operators import summary as M

    d = tempfile.mkdtemp(prefix="weftmark-io-")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5).selectExpr("doc_id", "text AS content", "true AS use_summarization", "50 AS summary_target_tokens")
    prompts = M.round1_prompts(M.summary_options(docs))
    IO.write_prompts(prompts, os.path.join(d, "prompts"))
    sent = [json.loads(x.value) for x in spark.read.text(os.path.join(d, "prompts")).collect()]
    assert len(sent) == prompts.count() and json.loads(sent[0]["payload"])["stream"] is False
    with open(os.path.join(d, "completions.json"), "w") as f:
        for s in sent:
            f.write(json.dumps({"prompt_id": s["prompt_id"], "body": json.dumps({"response": "short"})}) + "\n")
    comp = IO.read_completions(spark, os.path.join(d, "completions.json"))
    done = M.summarize(M.summary_options(docs), M.table_summarizer(comp)).collect()
    assert all(r.summarization.used for r in done)
    assert {r.content for r in done} <= {"short"} | {r.content for r in done if r.summarization.fallback_reason}
