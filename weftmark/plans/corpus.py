"""Request and capture tables derived from the corpus tables.

The driver data has pages and documents but no crawl log. These plans derive
one: every page becomes a request answered by the page route, every document a
request answered by a captured markdown response. Options and capture outcomes
are functions of the row itself (host, language, URL shape), so all branches of
the pipeline are exercised and the work grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC_URL_PREFIX = "https://docs.example.org/"


def doc_url(lang, doc_id):
    return F.concat(F.lit(DOC_URL_PREFIX), lang, F.lit("/"), doc_id.cast("string"))


def requests_from_pages(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select(
        (F.col("page_id") * 2).alias("request_id"),
        u.alias("url"),
        F.lit(None).cast("string").alias("wait_for_selector"),
        F.lit(None).cast("int").alias("wait_time"),
        F.lit(None).cast("boolean").alias("scroll_to_bottom"),
        F.when(u.contains("utm_source"), F.lit(False)).alias("truncate"),
        F.when(u.endswith("#top"), F.lit(1000)).alias("max_length"),
        F.when(u.contains("?page="), F.lit(True)).alias("use_summarization"),
        F.when(u.contains("?page="), F.lit(200)).when(u.endswith(".html"), F.lit(50)).alias("summary_target_tokens"),
        F.lit(None).cast("string").alias("summary_host"),
        F.lit(None).cast("string").alias("summary_model"),
    )


def requests_from_documents(documents: DataFrame, keep=()) -> DataFrame:
    lang = F.col("lang")
    return documents.select(
        *keep,
        (F.col("doc_id") * 2 + 1).alias("request_id"),
        doc_url(lang, F.col("doc_id")).alias("url"),
        F.lit(None).cast("string").alias("wait_for_selector"),
        F.lit(None).cast("int").alias("wait_time"),
        F.lit(None).cast("boolean").alias("scroll_to_bottom"),
        F.lit(None).cast("boolean").alias("truncate"),
        F.when(lang == "de", F.lit(3000)).alias("max_length"),
        F.when(lang == "fr", F.lit(True)).alias("use_summarization"),
        F.when(lang == "en", F.lit(1000)).when(lang == "fr", F.lit(100)).when(lang == "es", F.lit(0)).alias("summary_target_tokens"),
        F.lit(None).cast("string").alias("summary_host"),
        F.lit(None).cast("string").alias("summary_model"),
    )


def responses_from_documents(documents: DataFrame, keep=()) -> DataFrame:
    """Captured answers for the document URLs.

    en: markdown with a token header; fr: quoted charset, non-integer token
    header; de: upper-case type, no charset; es: an HTML answer (not native);
    two sources fail (HTTP 403 and a transport error) and fall through.
    """
    lang, src = F.col("lang"), F.col("source")
    ct = (
        F.when(lang == "en", F.lit("text/markdown; charset=utf-8"))
        .when(lang == "fr", F.lit('text/markdown; charset="UTF-8"'))
        .when(lang == "de", F.lit("TEXT/MARKDOWN"))
        .otherwise(F.lit("text/html; charset=utf-8"))
    )
    tok = F.when(lang == "en", (F.col("n_chars") / 4).cast("bigint").cast("string")).when(lang == "fr", F.lit("n/a"))
    headers = F.when(tok.isNotNull(), F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("X-Markdown-Tokens")), F.array(ct, tok))).otherwise(
        F.map_from_arrays(F.array(F.lit("content-type")), F.array(ct))
    )
    return documents.select(
        *keep,
        doc_url(lang, F.col("doc_id")).alias("url"),
        F.when(src == "src7", F.lit(403)).otherwise(F.lit(200)).alias("http_status"),
        F.when(src == "src13", F.lit("timed out")).alias("fetch_error"),
        headers.alias("headers"),
        F.encode(F.col("text"), "UTF-8").alias("body"),
    )


def pages_for_documents(documents: DataFrame) -> DataFrame:
    """Rendered pages for the document URLs (the browser route's answer when the
    native answer is missing or unusable): the text as paragraphs of an article.

    Page keys are negative so they never collide with the page table's keys
    (the page key must be unique: every page-level window is keyed by it)."""
    paras = F.transform(F.split(F.col("text"), "\n"), lambda s: F.concat(F.lit("<p>"), s, F.lit("</p>")))
    html = F.concat(
        F.lit("<html><head><title>doc</title></head><body><nav>menu</nav><article>"),
        F.array_join(paras, ""),
        F.lit("</article></body></html>"),
    )
    return documents.select(
        (-(F.col("doc_id") + 1)).alias("page_id"), doc_url(F.col("lang"), F.col("doc_id")).alias("url"), html.alias("html")
    )


def url_variants(pages: DataFrame) -> DataFrame:
    """Each page URL in the spellings the validator must tell apart (F1)."""
    u = F.col("url")
    host = F.regexp_extract(u, "^https?://([^/?#]*)", 1)
    variants = F.array(
        F.struct(F.lit("as_is").alias("variant"), u.alias("url")),
        F.struct(F.lit("padded").alias("variant"), F.concat(F.lit("  "), u, F.lit("\t")).alias("url")),
        F.struct(F.lit("upper_scheme").alias("variant"), F.regexp_replace(u, "^https?", "HTTP").alias("url")),
        F.struct(F.lit("ftp").alias("variant"), F.regexp_replace(u, "^https?", "ftp").alias("url")),
        F.struct(F.lit("no_host").alias("variant"), F.regexp_replace(u, "^(https?://)[^/?#]*", "$1").alias("url")),
        F.struct(F.lit("bracket").alias("variant"), F.regexp_replace(u, "^(https?://)", "$1[").alias("url")),
        F.struct(F.lit("blank").alias("variant"), F.regexp_replace(host, ".", " ").alias("url")),
        F.struct(F.lit("empty").alias("variant"), F.lit("").alias("url")),
    )
    return pages.select("page_id", F.posexplode(variants).alias("variant_no", "v")).select("page_id", "variant_no", "v.variant", "v.url")


def all_page_requests(pages: DataFrame) -> DataFrame:
    """Each page URL with its options, and every malformed spelling with none."""
    odd = url_variants(pages).filter(F.col("variant") != "as_is").select(
        (-(F.col("page_id") * 8 + F.col("variant_no")) - 1).cast("bigint").alias("request_id"), "url")
    return requests_from_pages(pages).unionByName(odd, allowMissingColumns=True)


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Attributes of the wide tag on every Spanish page.
WIDE_TAG = "<div " + " ".join(f'data-a{i}="{i}"' for i in range(201)) + ">"


def rich_pages(documents: DataFrame) -> DataFrame:
    """A page per document that uses every block kind the converter renders, filled with all of
    the document's lines: line i becomes a heading, paragraph, list, quote, code block or table
    with a table in a cell, in turn. Then follow hidden and ad nodes, an image, links, character
    references in texts and attributes, and page chrome."""
    did, lang, src = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")
    blank = "^([^\\t\\n\\x0b\\x0c\\r ]+)"
    first = F.regexp_extract(F.col("text"), blank, 1)

    def block(s, i):
        level = (F.floor(i / 6) % 6 + 1).cast("string")
        sentences = F.filter(F.split(s, "\\. "), lambda x: F.length(x) > 0)
        lis = F.array_join(F.transform(sentences, lambda x: F.concat(F.lit("<li>"), _esc(x), F.lit("</li>"))), "")
        kinds = [
            F.concat(F.lit("<h"), level, F.lit(">"), _esc(s), F.lit("</h"), level, F.lit(">")),
            F.concat(F.lit("<p><b>"), _esc(F.regexp_extract(s, blank, 1)), F.lit("</b> "), _esc(s), F.lit(" <a href=\"/d?i="), did, F.lit("&amp;l="),
                     i.cast("string"), F.lit("\">"), lang, F.lit("</a> <code>n = "), F.col("n_chars").cast("string"), F.lit("</code><br>&copy; "), src, F.lit("</p>")),
            F.concat(F.lit("<ul>"), lis, F.lit("</ul><ol><li></li><li>"), _esc(s), F.lit("</li></ol>")),
            F.concat(F.lit("<blockquote>"), _esc(s), F.lit("</blockquote>")),
            F.concat(F.lit("<pre><code class=\"x language-"), lang, F.lit("\">"), _esc(s), F.lit("</code></pre>")),
            F.concat(F.lit("<table><tr><th>lang</th><th>text</th></tr><tr><td>"), lang, F.lit("<table><tr><th>in</th><td>"), src, F.lit("</td></tr></table></td><td>"),
                     _esc(s), F.lit("</td></tr><tr><td>"), did, F.lit("</td></tr></table>")),
        ]
        out = kinds[-1]
        for k in range(5):
            out = F.when(i % 6 == k, kinds[k]).otherwise(out)
        return out

    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), _esc(first), F.lit("</title><script>var x = '<p>';</script></head><body>"),
        F.lit("<header><nav><a href=\"/\">Home</a></nav></header><main>"),
        F.array_join(F.transform(F.split(F.col("text"), "\n"), block), ""),
        F.lit("<div style=\"display: none\">hidden "), did, F.lit("</div><div class=\"ads\">ad "), did, F.lit("</div>"),
        F.lit("<div><span> </span></div><img src=\"/img/"), did, F.lit(".png?a=1&#38;b=2\" alt=\"caf&eacute; &#x2014; "), lang, F.lit("\">"),
        F.lit("<a href=\"javascript:void(0)\">"), src, F.lit("</a><a href=\"/&lt;"), src, F.lit("&gt;\">&#0000065; &#x00042; "), src, F.lit("</a>"),
        F.lit("<code>"), lang, F.lit("</code><small>"), src, F.lit("</small>"),
        F.when(lang == "es", F.concat(F.lit(WIDE_TAG), src, F.lit("</div>"))).otherwise(F.lit("")),
        F.lit("<a title=\"a > b\" href=\"/keep?x=1&copy=2&lt\">"), src, F.lit("</a><img alt='5 > 3' src=\"/i.png\"><div data-x=\"1>2\" class=\"ads\">ad "), did,
        F.lit("</div><div title=it's style=\"a>b; display:none\">hidden "), did, F.lit("</div><p>&copy 2020 &notit; &ampx &#65 &AMP</p>"),
        F.lit("<p><a href=\"/one\">"), lang, F.lit(" <a href=\"/two\">"), src, F.lit("</a> after</a></p>"),
        F.lit("<div class=\"cookie-consent\">consent "), did, F.lit("</div>"),
        F.lit("</main><footer>footer "), did, F.lit("</footer></body></html>"),
    )
    return documents.select(F.col("doc_id").alias("page_id"), doc_url(lang, F.col("doc_id")).alias("url"), html.alias("html"))


def chrome_only_pages(documents: DataFrame) -> DataFrame:
    """Pages whose body holds only removed chrome, so the whole-page text fallback (H26) decides
    the output: the title, which holds the whole text, survives, navigation does not."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.concat(F.lit("<a>"), _esc(x), F.lit("</a>")))
    html = F.concat(
        F.lit("<html><head><title>"), _esc(F.col("text")), F.lit("</title></head><body><nav>"), F.array_join(lines, ""),
        F.lit("</nav><div><span> </span></div></body></html>"),
    )
    return documents.select(F.col("doc_id").alias("page_id"), doc_url(F.col("lang"), F.col("doc_id")).alias("url"), html.alias("html"))


def request_time(page_id):
    return F.timestamp_seconds(F.lit(1_700_000_000) + page_id % 3600)


def timed_requests(pages: DataFrame) -> DataFrame:
    """Page requests, and their malformed spellings, with the time each was made."""
    page = F.when(F.col("request_id") >= 0, F.floor(F.col("request_id") / 2)).otherwise(F.floor((-F.col("request_id") - 1) / 8))
    return all_page_requests(pages).withColumn("request_time", request_time(page))


def timed_notices(index: DataFrame) -> DataFrame:
    """Notices of captured pages. A capture comes half an hour early for URLs with ``?page=``, two hours
    late for ones with ``utm_source``, never for ones that end in ``#top``, and five minutes after
    the request for all others."""
    u = F.col("url")
    delay = F.when(u.contains("?page="), F.expr("interval -30 minutes")).when(u.contains("utm_source"), F.expr("interval 2 hours")).otherwise(F.expr("interval 5 minutes"))
    return index.filter(~u.endswith("#top")).withColumn("capture_time", request_time(F.col("page_id")) + delay)


def closing_row(timed: DataFrame) -> DataFrame:
    """A row long after all others that asks for nothing and captures nothing: it lets every window close."""
    far = F.timestamp_seconds(F.lit(1_700_000_000 + 7 * 86_400))
    own = {"request_time": far, "capture_time": far, "url": F.lit(""), "native": F.lit(False)}
    return timed.sparkSession.range(1).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in timed.schema.fields])
