"""Chunking and the summary-planning truth table."""

from pyspark.sql import functions as F

from weftmark.operators import summary as M


def plan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, content string, use_summarization boolean, summary_target_tokens int")
    return M.summary_options(df)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "0123456789"), (2, "")], "doc_id bigint, content string")
    got = [(r.doc_id, r.chunk_no, r.n_chunks, r.text) for r in M.text_chunks(df, chunk_chars=3).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, 1, 4, "012"), (1, 2, 4, "345"), (1, 3, 4, "678"), (1, 4, 4, "9")]


def test_strategy_switch(spark):
    p = plan(spark, [(1, "A" * 32003, False, 2000), (2, "A" * 32004, False, 2000)]).orderBy("doc_id").collect()
    assert [r.s_strategy for r in p] == ["single-pass", "map-reduce"]
    prompts = M.round1_prompts(plan(spark, [(2, "A" * 32004, False, 2000)])).collect()
    assert len(prompts) == 3 and {r.target_tokens for r in prompts} == {1000}
    assert prompts[0].system is None


def fixed(answer, error=None):
    def run(prompts):
        return prompts.select("prompt_id", F.to_json(F.struct(F.lit(answer).alias("response"))).alias("body"),
                              F.lit(error).cast("string").alias("error"))
    return run


def summ(spark, rows, summarizer):
    r = M.summarize(plan(spark, rows), summarizer).orderBy("doc_id").collect()
    return [(x.content, x.summarization.enabled, x.summarization.used, x.summarization.strategy,
             x.summarization.final_estimated_tokens, x.summarization.fallback_reason) for x in r]


def test_truth_table(spark):
    rows = [
        (1, "A" * 2000, True, 100),   # forced single pass
        (2, "A" * 40, True, 100),     # summary shorter, original under target -> keep
        (3, "A" * 40, False, 100),    # enabled, not needed
        (4, "A" * 40, True, None),    # flag without target
        (5, "A" * 40, False, -5),     # negative target
        (6, "A" * 40, False, None),   # nothing
    ]
    got = summ(spark, rows, fixed("summary"))
    assert got[0] == ("summary", True, True, "single-pass", 1, None)
    assert got[1] == ("A" * 40, True, True, "single-pass", 10, "summary_shorter_than_target_and_original_under_target")
    assert got[2] == ("A" * 40, True, False, None, None, None)
    assert got[3] == ("A" * 40, True, False, None, 10, None)
    assert got[4] == ("A" * 40, True, False, None, 10, None)
    assert got[5] == ("A" * 40, False, False, None, 10, None)


def test_call_failure_keeps_original(spark):
    got = summ(spark, [(1, "A" * 2000, False, 100)], fixed(None, "HTTP Error 500: boom"))
    assert got == [("A" * 2000, True, True, "single-pass", None, "error: HTTP Error 500: boom")]


def test_map_reduce_counts(spark):
    planned = plan(spark, [(1, "long text " * 4000, False, 100)])
    prompts = M.prompt_table(planned, fixed("summarized chunk")).collect()
    assert sorted((p.round, p.chunk_no) for p in prompts) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert "summarized chunk\n\nsummarized chunk" in [p for p in prompts if p.round == 2][0].prompt
    got = summ(spark, [(1, "long text " * 4000, False, 100)], fixed("summarized chunk"))
    assert got[0][0] == "summarized chunk" and got[0][3] == "map-reduce"


def test_one_answer_for_each_prompt(spark):
    prompts = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 1), ("p4", 1)], "prompt_id string, doc_id long")
    body = lambda t: '{"response": "%s"}' % t
    calls = [("p1", None, "timed out", 1), ("p1", body("late"), None, 3), ("p1", body("early"), None, 2), ("p1", None, "again", 9),
             ("p2", body("b"), None, 1), ("p2", body("a"), None, 1), ("p2", body("a"), None, 1), ("p3", None, "y", 1), ("p3", None, "x", 1)]
    done = spark.createDataFrame(calls, "prompt_id string, body string, error string, call_seq long")
    got = {r.prompt_id: (r.answer, r.call_error) for r in M.apply_completions(prompts, done).collect()}
    assert got == {"p1": ("late", None), "p2": ("a", None), "p3": ("", "x"), "p4": ("", "no completion for prompt p4")}
    assert M.apply_completions(prompts, done.drop("call_seq")).count() == 4


def test_call_options_in_the_payload(spark):
    import json

    prompts = spark.createDataFrame([("p1", "h", "m", "say \"it\"", "sys"), ("p2", "h", "m", "x", None)], "prompt_id string, host string, model string, prompt string, system string")
    options = {"temperature": 0.2, "num_ctx": 8192, "stop": ["a", "'b'"]}
    got = {r.prompt_id: json.loads(r.payload) for r in M.prompt_payload(prompts, options).collect()}
    assert got == {"p1": {"model": "m", "prompt": 'say "it"', "stream": False, "system": "sys", "options": options},
                   "p2": {"model": "m", "prompt": "x", "stream": False, "options": options}}
    assert all("options" not in json.loads(r.payload) for r in M.prompt_payload(prompts, {}).collect())
