"""Summary planning as prompt and completion tables.

Model calls are not data work: a *summarizer* is any function turning a prompt
table into a completion table ``(prompt_id, body, error)``. The plan is two
rounds: round 1 holds every single-pass prompt and every chunk prompt; round 2
holds the final prompt of each map-reduce document, built from the round-1
answers joined back in chunk order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, token_estimate
from ..options import JobOptions
from ..session import staged

# Fixed values (prompt texts and limits must equal the reference's).
SINGLE_PASS_SYSTEM = (
    "You are a precise summarization assistant. Preserve key facts, numbers,"
    " names, code blocks, and structure. Avoid fluff. Maintain markdown formatting."
)
SINGLE_PASS_HEAD = "Summarize the following content into approximately "
SINGLE_PASS_MID = (
    " tokens. If the content is already concise, return it as-is.\n\n"
    "Output should be well-structured markdown with headings and bullet points "
    "where helpful.\n\n"
    "Content begins below:\n\n"
    "<CONTENT>\n"
)
SINGLE_PASS_TAIL = "\n</CONTENT>\n"
CHUNK_HEAD = "You are summarizing chunk "
CHUNK_MID1 = " of "
CHUNK_MID2 = ". Produce an accurate, non-lossy summary in about "
CHUNK_MID3 = (
    " tokens.\n\n"
    "Use markdown, keep key details, and preserve any code snippets.\n\n"
    "Chunk content:\n\n<CHUNK>\n"
)
CHUNK_TAIL = "\n</CHUNK>\n"
SINGLE_PASS_MAX_TOKENS = 8000
CHUNK_TOKEN_BUDGET = 3000
CHUNK_CHARS = CHUNK_TOKEN_BUDGET * 4
CHUNK_TARGET_FLOOR = 300
KEEP_ORIGINAL_REASON = "summary_shorter_than_target_and_original_under_target"

Summarizer = Callable[[DataFrame], DataFrame]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def summary_options(df: DataFrame, options: JobOptions | None = None) -> DataFrame:
    """M1 + F6 + M2: resolved target/model/host, enabled/active/needed flags and strategy.

    Expects ``content``, ``use_summarization``, ``summary_target_tokens``,
    ``summary_host``, ``summary_model`` (the last four may be absent).
    """
    options = options or JobOptions()
    def opt(name, typ):
        return F.col(name) if name in df.columns else F.lit(None).cast(typ)
    flag = F.coalesce(opt("use_summarization", "boolean"), F.lit(False))
    target = F.coalesce(opt("summary_target_tokens", "int"), F.lit(options.summary_target_tokens).cast("int"))
    host = F.coalesce(F.nullif(opt("summary_host", "string"), F.lit("")), F.lit(options.host))
    model = F.coalesce(F.nullif(opt("summary_model", "string"), F.lit("")), F.lit(options.model))
    out = df.withColumn("_flag", flag).withColumn("s_target", target).withColumn("s_host", host).withColumn("s_model", model)
    out = out.withColumn("orig_tokens", token_estimate(F.col("content")))
    truthy_target = F.coalesce(F.col("s_target") != 0, F.lit(False))
    out = out.withColumn("s_enabled", F.col("_flag") | (truthy_target & (F.col("s_model") != "")))
    out = out.withColumn("s_active", F.col("s_enabled") & (F.col("s_model") != "") & truthy_target & (F.col("s_target") > 0))
    out = out.withColumn("s_needed", F.col("s_active") & (F.col("_flag") | (F.col("orig_tokens") > F.col("s_target"))))
    return out.withColumn(
        "s_strategy",
        F.when(F.col("s_needed"), F.when(F.col("orig_tokens") <= SINGLE_PASS_MAX_TOKENS, F.lit("single-pass")).otherwise(F.lit("map-reduce"))),
    ).drop("_flag")


def text_chunks(df: DataFrame, text_col: str = "content", key: str = "doc_id", chunk_chars: int = CHUNK_CHARS, keep=(), outer: bool = False) -> DataFrame:
    """M3: fixed code-point slices, no overlap; empty text has no chunk.

    ``(key, chunk_no (1-based), n_chunks, text)`` and the columns named in ``keep``. One regex
    pass cuts the text, so the cost is linear in its length. With ``outer``, an empty or null
    text gives one row with ``n_chunks`` 0 and a null ``chunk_no`` and ``text``.
    """
    n = F.length(F.col(text_col))
    count = F.when(n > 0, F.floor((n - 1) / chunk_chars) + 1).otherwise(F.lit(0)).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{chunk_chars}}}"), 0)
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select(key, *keep, count.alias("n_chunks"), explode(pieces).alias("chunk_idx", "text")).select(
        key, (F.col("chunk_idx") + 1).alias("chunk_no"), "n_chunks", "text", *keep
    )


def chunk_target(target: Column, n_chunks: Column) -> Column:
    """M4: ``max(300, int(target * 1.5 / max(1, n)))``."""
    per = F.floor(target.cast("double") * 1.5 / F.greatest(F.lit(1), n_chunks).cast("double")).cast("int")
    return F.greatest(F.lit(CHUNK_TARGET_FLOOR), per)


def single_pass_prompt(text: Column, target: Column) -> Column:
    """M5 / M9."""
    return F.concat(F.lit(SINGLE_PASS_HEAD), target.cast("string"), F.lit(SINGLE_PASS_MID), text, F.lit(SINGLE_PASS_TAIL))


def chunk_prompt(chunk_no: Column, n_chunks: Column, per_target: Column, text: Column) -> Column:
    """M6."""
    return F.concat(
        F.lit(CHUNK_HEAD), chunk_no.cast("string"), F.lit(CHUNK_MID1), n_chunks.cast("string"),
        F.lit(CHUNK_MID2), per_target.cast("string"), F.lit(CHUNK_MID3), text, F.lit(CHUNK_TAIL),
    )


def _pid(doc: Column, rnd: int, chunk: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), F.lit(str(rnd)), chunk.cast("string"))


def round1_prompts(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Round 1: one prompt per single-pass document and one per chunk of a map-reduce one."""
    single = planned.filter(F.col("s_strategy") == "single-pass").select(
        _pid(F.col(key), 1, F.lit(0)).alias("prompt_id"), F.col(key), F.lit(1).alias("round"), F.lit(0).alias("chunk_no"),
        F.col("s_model").alias("model"), F.col("s_host").alias("host"), F.lit(SINGLE_PASS_SYSTEM).alias("system"),
        single_pass_prompt(F.col("content"), F.col("s_target")).alias("prompt"), F.col("s_target").alias("target_tokens"),
    )
    mr = planned.filter(F.col("s_strategy") == "map-reduce")
    ch = text_chunks(mr, "content", key, keep=("s_model", "s_host", "s_target"))
    per = chunk_target(F.col("s_target"), F.col("n_chunks"))
    chunks = ch.select(
        _pid(F.col(key), 1, F.col("chunk_no")).alias("prompt_id"), F.col(key), F.lit(1).alias("round"), F.col("chunk_no"),
        F.col("s_model").alias("model"), F.col("s_host").alias("host"), F.lit(None).cast("string").alias("system"),
        chunk_prompt(F.col("chunk_no"), F.col("n_chunks"), per, F.col("text")).alias("prompt"), per.alias("target_tokens"),
    )
    return single.unionByName(chunks)


def prompt_payload(prompts: DataFrame, options: dict | None = None) -> DataFrame:
    """The JSON body of each model call (model, prompt, stream=false, system if set, options if any).

    ``options`` are the model's call options, the same for all calls; an empty dict is left out.
    """
    base = [F.col("model"), F.col("prompt"), F.lit(False).alias("stream")]
    more = [F.from_json(F.lit(json.dumps(options)), F.schema_of_json(F.lit(json.dumps(options)))).alias("options")] if options else []
    payload = F.when(F.col("system").isNotNull() & (F.col("system") != ""), F.to_json(F.struct(*base, F.col("system"), *more))).otherwise(
        F.to_json(F.struct(*base, *more)))
    return prompts.select("prompt_id", "host", payload.alias("payload"))


def completion_text(body: Column) -> Column:
    """``parsed.get('response', '')``."""
    return F.coalesce(F.get_json_object(body, "$.response"), F.lit(""))


def one_completion(completions: DataFrame) -> DataFrame:
    """One answer for each prompt, ``(prompt_id, body, error)``, however often its call was made.

    A call that succeeded comes before one that failed, then the latest by the optional
    ``call_seq``, then the smallest body and error. Partial minima come before the shuffle.
    """
    seq = (F.col("call_seq") if "call_seq" in completions.columns else F.lit(0)).cast("long")
    failed = F.col("error").isNotNull() | F.col("body").isNull()
    pick = F.min(F.struct(failed.alias("failed"), (-seq).alias("age"), "body", "error"))
    return completions.groupBy("prompt_id").agg(pick.alias("c")).select("prompt_id", "c.body", "c.error")


def apply_completions(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """M7: one answer per prompt (see ``one_completion``); a missing completion counts as a failed call."""
    c = one_completion(completions).select("prompt_id", F.col("body").alias("_body"), F.col("error").alias("_err"))
    j = prompts.join(c, "prompt_id", "left")
    err = F.when(F.col("_body").isNull() & F.col("_err").isNull(), F.concat(F.lit("no completion for prompt "), F.col("prompt_id"))).otherwise(F.col("_err"))
    return j.select(*prompts.columns, completion_text(F.col("_body")).alias("answer"), err.alias("call_error"))


def reduce_summaries(answered: DataFrame, key: str = "doc_id") -> DataFrame:
    """M8: chunk answers, each stripped, joined in chunk order with a blank line.

    ``first_error`` is the error of the first failing chunk, as a sequential caller would see it.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk_no"), py_strip(F.col("answer")).alias("a"))))
    first_err = F.min_by(F.col("call_error"), F.when(F.col("call_error").isNotNull(), F.col("chunk_no")))
    return answered.filter(F.col("round") == 1).groupBy(key).agg(
        F.array_join(F.transform(parts, lambda x: x["a"]), "\n\n").alias("combined"),
        first_err.alias("first_error"),
        F.count("*").alias("n_chunks"),
    )


def round2_prompts(planned: DataFrame, reduced: DataFrame, key: str = "doc_id") -> DataFrame:
    """M9: the final single-pass prompt over the combined chunk summaries (error-free docs only)."""
    mr = planned.filter(F.col("s_strategy") == "map-reduce").select(key, "s_model", "s_host", "s_target")
    j = mr.join(reduced.filter(F.col("first_error").isNull()), key)
    return j.select(
        _pid(F.col(key), 2, F.lit(0)).alias("prompt_id"), F.col(key), F.lit(2).alias("round"), F.lit(0).alias("chunk_no"),
        F.col("s_model").alias("model"), F.col("s_host").alias("host"), F.lit(SINGLE_PASS_SYSTEM).alias("system"),
        single_pass_prompt(F.col("combined"), F.col("s_target")).alias("prompt"), F.col("s_target").alias("target_tokens"),
    )


def prompt_table(planned: DataFrame, summarizer: Summarizer, key: str = "doc_id") -> DataFrame:
    """M5 + M6 + M9: every prompt of both rounds (round 2 depends on round-1 answers)."""
    r1 = round1_prompts(planned, key)
    a1 = apply_completions(r1, summarizer(r1))
    r2 = round2_prompts(planned, reduce_summaries(a1, key), key)
    return r1.unionByName(r2)


def _cut(df: DataFrame, materialize: bool) -> DataFrame:
    """A stage table in the shared folder: the summarizer runs once per prompt even though both
    rounds read its answers, and a lost executor does not re-issue model calls."""
    return staged(df, "answers") if materialize else df


def not_summarized(planned: DataFrame) -> DataFrame:
    """M10 + M12 for rows that need no summary: the content stays, no prompt is made."""
    final = F.when(~F.col("s_active"), F.col("orig_tokens"))
    return planned.select(*_kept(planned), "content", _meta(final, F.lit(None).cast("string")).alias("summarization"))


def _kept(planned: DataFrame) -> list[str]:
    return [c for c in planned.columns if c != "content" and not c.startswith("s_") and c != "orig_tokens"]


def _meta(final_tokens: Column, reason: Column) -> Column:
    """The nine fields of ``summarization``."""
    return F.struct(
        F.col("s_enabled").alias("enabled"), F.col("s_needed").alias("used"), F.col("s_strategy").alias("strategy"),
        F.col("s_model").alias("model"), F.col("s_host").alias("host"), F.col("s_target").alias("target_tokens"),
        F.col("orig_tokens").alias("original_estimated_tokens"), final_tokens.alias("final_estimated_tokens"),
        reason.alias("fallback_reason"),
    )


def summarize(planned: DataFrame, summarizer: Summarizer, key: str = "doc_id", materialize: bool = True) -> DataFrame:
    """Final content and the ``summarization`` struct per document."""
    r1 = round1_prompts(planned, key)
    a1 = _cut(apply_completions(r1, summarizer(r1)), materialize)
    red = reduce_summaries(a1, key)
    r2 = round2_prompts(planned, red, key)
    a2 = _cut(apply_completions(r2, summarizer(r2)), materialize)
    single = a1.filter(F.col("chunk_no") == 0).select(key, F.col("answer").alias("_ans"), F.col("call_error").alias("_err"))
    final = a2.select(key, F.col("answer").alias("_ans2"), F.col("call_error").alias("_err2"))
    red = red.select(key, F.col("first_error").alias("_chunk_err"), F.col("n_chunks").alias("num_chunks"))
    j = planned.join(single, key, "left").join(red, key, "left").join(final, key, "left")

    strategy = F.col("s_strategy")
    answer = F.when(strategy == "single-pass", F.col("_ans")).when(strategy == "map-reduce", F.col("_ans2"))
    err = F.when(strategy == "single-pass", F.col("_err")).when(strategy == "map-reduce", F.coalesce(F.col("_chunk_err"), F.col("_err2")))
    summary = py_strip(answer)
    s_tok = token_estimate(summary)
    orig = F.col("orig_tokens")
    target = F.col("s_target")
    keep = (s_tok < target) & (orig <= target) & (orig > s_tok)
    needed = F.col("s_needed")
    failed = needed & err.isNotNull()
    content = F.when(needed & ~failed & ~keep, summary).otherwise(F.col("content"))
    reason = F.when(failed, F.concat(F.lit("error: "), err)).when(needed & keep, F.lit(KEEP_ORIGINAL_REASON))
    final_tokens = (
        F.when(~F.col("s_active"), orig)
        .when(~needed | failed, F.lit(None).cast("bigint"))
        .otherwise(token_estimate(content))
    )
    return j.select(*_kept(planned), content.alias("content"), _meta(final_tokens, reason).alias("summarization"), "num_chunks")


# ---------------------------------------------------------------------------
# Bundled summarizers
# ---------------------------------------------------------------------------

def prefix_summarizer(chars_per_token: int = 4) -> Summarizer:
    """Deterministic test summarizer: the first ``target_tokens * chars_per_token``
    characters of the text inside the prompt's CONTENT/CHUNK tags (native functions only)."""

    def run(prompts: DataFrame) -> DataFrame:
        inner = F.regexp_extract(F.col("prompt"), "(?s)<(CONTENT|CHUNK)>\\n(.*)\\n</\\1>\\n$", 2)
        resp = inner.substr(F.lit(1), (F.col("target_tokens") * chars_per_token).cast("int"))
        return prompts.select("prompt_id", F.to_json(F.struct(resp.alias("response"))).alias("body"), F.lit(None).cast("string").alias("error"))

    return run


def no_summarizer() -> Summarizer:
    """Every call fails (M11): a job without a model keeps the originals and says why."""

    def run(prompts: DataFrame) -> DataFrame:
        return prompts.select("prompt_id", F.lit(None).cast("string").alias("body"), F.lit("no summarizer").alias("error"))

    return run


def table_summarizer(completions: DataFrame) -> Summarizer:
    """Completions captured elsewhere (a batch scoring job, a cache), joined by ``prompt_id``."""

    def run(prompts: DataFrame) -> DataFrame:
        return prompts.select("prompt_id").join(completions.select("prompt_id", "body", "error", *[c for c in completions.columns if c == "call_seq"]), "prompt_id", "inner")

    return run
