"""Native markdown route rows (FIXTURES §3)."""

from pyspark.sql import functions as F

from weftmark.operators import native as N
from weftmark.options import JobOptions


def run(spark, rows, options=None):
    df = spark.createDataFrame(rows, "url string, http_status int, fetch_error string, headers map<string,string>, body binary")
    return {r.url: r for r in N.native_markdown(df, options).collect()}


def test_native_rows(spark):
    rows = [
        ("https://a/1", 200, None, {"Content-Type": "text/markdown; charset=utf-8", "X-Markdown-Tokens": "42"}, b"# Native\n\nHello"),
        ("https://a/2", 200, None, {"Content-Type": "text/html; charset=utf-8"}, b"<html></html>"),
        ("https://a/3", 403, None, {}, None),
        ("https://a/4", 200, None, {"content-type": "TEXT/MARKDOWN", "x-markdown-tokens": "abc"}, b"hi"),
        ("https://a/5", 200, None, {"Content-Type": " text/markdown"}, b"hi"),
        ("https://a/6", 200, None, {"Content-Type": 'text/markdown; charset="iso-8859-1"'}, b"\xe9"),
        ("https://a/7", 200, None, {"Content-Type": "text/markdown; charset=bogus"}, b"\xc3\xa9"),
        ("https://a/8", 200, None, {"Content-Type": "text/markdown; charset=utf-8"}, b"\xc3\xa9\xff"),
        ("https://a/9", 200, None, {"Content-Type": "text/markdown; charset=windows-1252"}, b"\x93q\x94"),
        ("https://a/10", 200, "timed out", {"Content-Type": "text/markdown"}, b"x"),
    ]
    got = run(spark, rows)
    assert set(got) == {"https://a/1", "https://a/4", "https://a/6", "https://a/7", "https://a/8", "https://a/9"}
    assert (got["https://a/1"].content, got["https://a/1"].markdown_tokens) == ("# Native\n\nHello", 42)
    assert (got["https://a/4"].content, got["https://a/4"].markdown_tokens) == ("hi", None)
    assert got["https://a/6"].content == "é"
    assert got["https://a/7"].content == "é"
    assert got["https://a/8"].content == "é�"
    assert got["https://a/9"].content == "“q”"


def test_accept_gate(spark):
    rows = [("https://a/1", 200, None, {"Content-Type": "text/markdown"}, b"x")]
    assert run(spark, rows, JobOptions(accept_header="text/html")) == {}
    assert JobOptions.from_env({}).accept_header == "text/markdown, text/plain;q=0.99, text/html;q=0.9, */*;q=0.8"
    assert JobOptions.from_env({"WEFTMARK_ACCEPT_HEADER": "application/json"}).accept_header == "application/json"


def python_decoding(body, charset):
    try:
        return body.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", errors="replace")


def test_every_single_byte_charset_natively(spark):
    from weftmark.operators.native import _PAGE_NAMES, _PAGES

    assert len(_PAGES) > 50
    every = bytes(range(256))
    fine = {n: bytes(b for b in range(256) if b == 0 or t[b - 1] != "\ufffe") for n, t in _PAGES.items()}
    rows = [(alias, b) for alias, name in sorted(_PAGE_NAMES.items()) for b in (every, fine[name], b"", b"plain")]
    rows += [(spelling, b"\x93q\x94") for spelling in ("Windows-1252", "CP1252", " windows_1252", "windows 1252", "windows--1252", "koi8-r", "x.y", "KOI8.R", "ISO_8859-2:1987", "")]
    df = spark.createDataFrame(rows, "charset string, body binary").repartition(4)
    got = df.select("charset", "body", N.decode_body(F.col("body"), F.col("charset")).alias("c"), N.code_page(F.col("charset")).isNotNull().alias("native")).collect()
    assert len(got) == len(rows)
    bad = [(r.charset, bytes(r.body)[:8], r.c) for r in got if r.c != python_decoding(bytes(r.body), r.charset)]
    assert bad == []
    assert all(r.native for r in got if r.charset in _PAGE_NAMES and r.charset.islower())  # one alias has capitals, which nobody can name


def test_multi_byte_charsets_go_through_python(spark):
    rows = [("shift_jis", "日本".encode("shift_jis")), ("gb18030", "中文".encode("gb18030")), ("euc-kr", "한".encode("euc-kr")), ("utf-16", "é".encode("utf-16")),
            ("shift_jis", b"\xff\xff"), ("hex", b"6162"), ("idna", b"a..b"), ("punycode", b"\x80-"), ("nöt", b"x")]
    df = spark.createDataFrame(rows, "charset string, body binary")
    for r in df.select("charset", "body", N.decode_body(F.col("body"), F.col("charset")).alias("c")).collect():
        assert r.c == python_decoding(bytes(r.body), r.charset), r.charset


def test_charsets_that_fail_the_request(spark, tmp_path):
    """The reference's decode raises neither of the caught errors there, so the request fails with the bare message."""
    from weftmark.plans import read_urls as R
    from weftmark.sources.captures import create_captures

    at = "https://x.example/"
    kinds = {"undefined": "text/markdown; charset=undefined", "nul": "text/markdown; charset=utf\0-8", "fine": "text/markdown; charset=utf-8", "quoted": 'text/markdown; charset="Undefined"'}
    rows = [(at + k, 200, None, {"Content-Type": v}, b"some words") for k, v in kinds.items()]
    rows.append((at + "both", 200, None, {"Content-Type": kinds["undefined"]}, b"not this"))
    rows.append((at + "both", 200, None, {"Content-Type": kinds["fine"]}, b"but this"))
    responses = spark.createDataFrame(rows, "url string, http_status int, fetch_error string, headers map<string,string>, body binary")
    pages = spark.createDataFrame([(1, at + "undefined", "<p>the page</p>"), (2, at + "page", "<p>a page</p>")], "page_id bigint, url string, html string")
    req = spark.createDataFrame([(i, at + n) for i, n in enumerate(["undefined", "nul", "fine", "quoted", "both", "page", "none"])], "request_id bigint, url string")
    want_ok = [(2, "some words"), (4, "but this"), (5, "a page")]
    want_bad = [(0, "undefined encoding"), (1, "embedded null character"), (3, "undefined encoding"), (6, f"Web URL reading failed: no captured response or page for {at}none")]
    store = create_captures(spark, str(tmp_path / "store"), pages, responses, buckets=2)
    for results, errors in (R.read_urls(req, pages, responses), R.read_urls(req, store)):
        assert sorted((r.request_id, r.content) for r in results.collect()) == want_ok
        assert sorted((e.request_id, e.error) for e in errors.collect()) == want_bad
    html_only = JobOptions(accept_header="text/html")
    assert [r.content for r in R.read_urls(req.filter("request_id = 0"), store, options=html_only)[0].collect()] == ["the page"]
    assert [r.error for r in R.routed(req.filter("request_id = 0"), responses, pages)[0].collect()] == ["undefined encoding"]
