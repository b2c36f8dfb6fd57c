"""What a page's rows pay for on their way: sorts, aggregates and windows of the chain, and the rows of text."""

import re

import pytest
from pyspark.sql import functions as F

from weftmark.operators import html as H
from weftmark.options import JobOptions
from weftmark.plans.queries import QUERIES
from weftmark.plans.read_urls import _converted

from .conftest import SF

PAGES = "page_id long, url string, html string"
#: Queries whose pages go through one aggregate that follows the order of the windows before it.
SORTED = ["assemble_markdown", "link_filter", "render_code_block", "render_heading", "render_image", "render_inline_code_block", "render_link", "render_other", "render_paragraph", "render_table", "rich_page_markdown", "rich_page_markdown_raw", "render_blockquote", "min_text_filter", "render_list", "render_inline", "empty_fallback", "empty_fallback_raw"]


def _plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _count(plan, node):
    return len(re.findall(rf"^[\s:+\-|]*(?:\*\(\d+\) )?{node}\b", plan, re.M))


@pytest.mark.parametrize("name", SORTED)
def test_aggregates_take_rows_as_the_windows_sorted_them(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert _count(plan, "ObjectHashAggregate") == 0
    assert _count(plan, "SortAggregate") in (2, 4)
    assert _count(plan, "Sort") <= 7 and _count(plan, "Window") <= 13


def test_text_comes_as_one_row_a_run(spark):
    """Runs and single tokens give the same text nodes, at the same places."""
    html = ["a &amp;&copy x<b>&#65;&amp\n</b>5 < 6 & 7 &notit; &<i></i>&<!-- c -->&lt;p>&", "", "&amp", "<p>", "x" * 10 + "&&&<", "&amp;<", None]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], PAGES)
    cols = ["page_id", "pos", "kind", "tag", "text"]
    found = [H.text_nodes(H.classify_tokens(H.html_tokens(pages, **r), **r), **r).select(*cols).orderBy("page_id", "pos").collect() for r in ({}, {"runs": True})]
    assert found[0] == found[1]
    runs = H.html_tokens(pages, runs=True).filter("tok is not null")
    whole = runs.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("html"))
    assert {r.page_id: r.html for r in whole.collect()} == {i: h for i, h in enumerate(html) if h}


@pytest.mark.parametrize("html", ["", "text only", "<p>a</p>", "<br>"])
def test_two_pages_under_one_key_fail_without_any_open_element_too(spark, html):
    pages = spark.createDataFrame([(7, "u", html), (7, "v", html)], PAGES)
    with pytest.raises(Exception, match="two pages have the same page_id: 7"):
        H.page_markdown(pages).collect()


def test_empty_containers_look_ahead_in_linear_time(spark):
    """40,000 containers before the next text: each looks for it."""
    pages = spark.createDataFrame([(1, "u", "<main>" + "<div></div>" * 40_000 + "<div>text</div></main>")], PAGES)
    r = H.prepare(pages).filter((F.col("tag") == "div") & (F.col("kind") == "open"))
    assert r.groupBy("removed").count().orderBy("removed").collect() == [(False, 1), (True, 40_000)]


def test_rows_of_no_block_start_stay_together(spark):
    """Rows that a hidden element's child reaches beyond it are block 0, before any block starts."""
    html = "<main><pre style=\"display:none\"><b>x</pre>y</b><p>z</p></main>"
    reg = H.prepare(spark.createDataFrame([(1, "u", html)], PAGES)).filter(F.col("in_region") & ~F.col("kind").isin("comment", "decl", "none"))
    rows = H.block_segments(reg)
    firsts = rows.groupBy("blk").agg(F.min("pos").alias("p"), F.min("root_s").alias("a"), F.max("root_s").alias("b")).collect()
    assert firsts and all(r.p == r.a == r.b for r in firsts)
    assert sorted(r.blk for r in firsts)[0] == 0


@pytest.mark.parametrize("repartition", [True, False])
def test_page_route_takes_rows_as_the_windows_sorted_them(spark, repartition):
    """The conversion below ``request_response_join`` (pages moved to their key) and ``stream_results`` (pages in their buckets)."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = _plan(_converted(pages if repartition else pages.repartition(2, "page_id"), JobOptions(), repartition))
    assert _count(plan, "ObjectHashAggregate") == 0 and _count(plan, "SortAggregate") == 4
