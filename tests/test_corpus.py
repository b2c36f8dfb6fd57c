"""Derived fixture pages hold all of each document's text."""

from pyspark.sql import functions as F

from weftmark.plans import corpus as C

from .conftest import SF


def escaped(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def test_fixture_pages_hold_every_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rich = {r.page_id: r.html for r in C.rich_pages(docs).collect()}
    bare = {r.page_id: r.html for r in C.chrome_only_pages(docs).collect()}
    assert len(rich) == len(bare) == len(texts)
    for k, text in texts.items():
        for i, line in enumerate(text.split("\n")):
            assert escaped(line) in bare[k]
            if i % 6 != 2:
                assert escaped(line) in rich[k]
        assert all(escaped(s) in rich[k] for line in text.split("\n")[2::6] for s in line.split(". "))


def test_linear_text_kernels(spark):
    from weftmark.functions import text as T
    from weftmark.operators import summary as M

    one = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b \\n\n\n\n c")).alias("t"))
    got = one.select(T.normalize_lines(F.col("t")).alias("n")).first().n
    assert got.startswith("a  ") and got.endswith("b \\n\n\nc")
    chunks = M.text_chunks(spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("é23456789\n"), 5_000_000).alias("content")))
    r = chunks.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max("n_chunks").alias("m")).first()
    assert (r.n, r.c, r.m) == (4167, 50_000_000, 4167)


def test_only_legacy_charsets_reach_python(spark):
    from weftmark.operators import native as N

    rows = [(b"caf\xc3\xa9", "utf-8"), (b"caf\xe9", "windows-1252"), (b"\xe9", "latin-1"), (None, "koi8-r"), (b"\xff", "nonsense")]
    df = spark.createDataFrame(rows, "body binary, cs string").select(N.decode_body(F.col("body"), F.col("cs")).alias("t"))
    assert [r.t for r in df.collect()] == ["café", "café", "é", None, "\ufffd"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    call = plan[plan.index("_decode_py("):]
    assert call.startswith("_decode_py(CASE WHEN") or "CASE WHEN" in plan
