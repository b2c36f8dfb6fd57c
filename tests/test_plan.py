"""The plan shape the scale argument rests on (README, 'How the HTML conversion runs')."""

import re

from weftmark.operators import html as H

from .conftest import SF


def test_page_chain_has_one_exchange_and_no_join(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = H.page_markdown(spark.read.parquet(f"{SF}/pages.parquet"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1
    assert "Exchange hashpartitioning(page_id" in plan
    assert not re.search(r"Join", plan)
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan
    # no Python in the chain
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_partitions_follow_the_input(spark):
    from weftmark.session import size_partitions

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    size = sum(len(open(f.removeprefix("file://"), "rb").read()) for f in pages.inputFiles())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size_partitions(pages, each=1 << 40) == least
    assert size_partitions(pages, each=size // 50) in (50, 51)


def test_pages_are_cut_finely_enough_for_their_tokens(spark, tmp_path):
    """Partitions follow the files by the MB, at any size of the input, and AQE leaves them so."""
    import secrets

    pages = [(i, "u", f"<p>{secrets.token_hex(400_000)}</p>") for i in range(8)]
    least = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for times in (1, 2):
            spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
            size = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet"))
            assert size > times * 3_000_000
            plan = H.prepare(spark.read.parquet(f"{tmp_path}/pages"))._jdf.queryExecution().executedPlan().toString()
            (n,) = re.findall(r"Exchange hashpartitioning\(page_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
            assert int(n) in (-(-size // (1 << 20)), -(-size // (1 << 20)) + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", least)


#: Queries over pages made of the documents, of which every one takes its rows through the page chain.
CHAIN = ["render_inline_code_block", "render_other", "assemble_markdown", "render_heading", "render_list", "render_image", "render_code_block", "render_table",
         "render_blockquote", "render_paragraph", "min_text_filter", "render_link", "render_inline", "prune_hidden", "hidden_filter", "prune_empty_containers"]


def test_every_chain_query_has_one_exchange_sized_by_its_input(spark, tmp_path):
    """Pages move once, into a partition for each MB of documents; nothing after that exchanges or joins."""
    import secrets

    from weftmark.plans.queries import QUERIES

    docs = [(i, secrets.token_hex(400_000), "en", "src1", 800_000) for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert size > 3_000_000
    least = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name in CHAIN:
            plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            exchanges = re.findall(r"Exchange (.*)", plan)
            assert len(exchanges) == 1, (name, exchanges)
            (n,) = re.findall(r"^hashpartitioning\(page_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", exchanges[0])
            assert int(n) in (-(-size // (1 << 20)), -(-size // (1 << 20)) + 1), name
            assert "Join" not in plan, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", least)
