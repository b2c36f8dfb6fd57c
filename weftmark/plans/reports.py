"""Corpus reports over the job's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOISE_PATTERNS, noise_hits, noise_may_match, noise_step, token_estimate
from ..functions.urls import url_host


def extraction_report(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Requests, characters and tokens by host / route / status, with rollup subtotals.

    Partial aggregation runs before the shuffle, so a host holding a third of all
    rows costs one partial row per task, not a hot partition.
    """
    ok = results.select(url_host(F.col("url")).alias("host"), "render_method", "status",
                        F.length("content").cast("bigint").alias("chars"), token_estimate(F.col("content")).alias("tokens"))
    bad = errors.select(url_host(F.coalesce(F.col("url"), F.lit(""))).alias("host"), F.lit("none").alias("render_method"), "status",
                        F.lit(0).cast("bigint").alias("chars"), F.lit(0).cast("bigint").alias("tokens"))
    return ok.unionByName(bad).rollup("host", "render_method", "status").agg(
        F.count("*").alias("requests"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"),
    )


def summary_plan_report(prompts: DataFrame) -> DataFrame:
    """Documents, model calls and prompt tokens by strategy and model.

    Round-1 prompts carry their strategy: a chunk number for map-reduce, none for single-pass.
    Every document has exactly one first prompt, so documents are counted without a distinct.
    """
    strategy = F.when((F.col("chunk_no") > 0) | (F.col("round") == 2), F.lit("map-reduce")).otherwise(F.lit("single-pass"))
    first = (F.col("round") == 1) & (F.col("chunk_no") <= 1)
    return prompts.groupBy(strategy.alias("strategy"), "model").agg(
        F.count_if(first).alias("documents"), F.count("*").alias("calls"),
        F.sum(token_estimate(F.col("prompt"))).alias("prompt_tokens"),
    )


def noise_audit(docs: DataFrame) -> DataFrame:
    """Matches and characters removed per noise pattern and host (``docs``: host, content).

    A document is one row: each pattern runs once over the text that the one before it left, and only
    where one of the pattern's literals occurs. The patterns become rows after the aggregate.
    """
    names = [name for name, _ in NOISE_PATTERNS]
    df = docs.select("host", F.col("content").alias("_s"))
    for i, name in enumerate(names):
        s = F.col("_s")
        df = df.withColumn("_may", noise_may_match(s, [name]))
        none = F.when(s.isNotNull(), F.lit(0))
        df = df.withColumns({f"_hits{i}": F.when(F.col("_may"), noise_hits(s, name)).otherwise(none).cast("bigint"),
                             "_after": F.when(F.col("_may"), noise_step(s, name)).otherwise(s)})
        df = df.withColumn(f"_chars{i}", (F.length(s) - F.length("_after")).cast("bigint")).drop("_s").withColumnRenamed("_after", "_s")
    sums = [F.struct(F.lit(name).alias("pattern"), F.sum(f"_hits{i}").alias("hits"), F.sum(f"_chars{i}").alias("removed_chars"),
                     F.count_if(F.col(f"_hits{i}") > 0).alias("documents_hit")) for i, name in enumerate(names)]
    return df.groupBy("host").agg(F.array(*sums).alias("_x")).select("host", F.explode("_x").alias("x")).select("host", "x.*")
