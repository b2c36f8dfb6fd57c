"""The corpus pipeline: ``documents`` in, packed training sequences out.

Every stage works on all that the stage before it kept. ``run`` writes each stage's rows as
Parquet to the shared folder and reads them back for the next one, so a lost executor costs
unfinished tasks of one stage only.

1. ``toxicity``: documents that the subword classifier rejects go.
2. ``line_dedup``: lines found in ten or more documents go; ``n_chars`` follows the text.
3. ``simhash``: of each group of near-duplicates one document stays, the smallest ``doc_id``.
4. ``mix_sources``: small sources are repeated, at most twice, so the shares move towards
   uniform; every document is kept at least once.
5. ``pack``: pieces of at most 2048 tokens with their sequence and offset.

Stages 1 to 4 return the columns of ``documents``. Nulls, empty texts, repeated rows and empty
tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm.common import free_prefix, staged, table
from weftmark.llm.line_dedup import line_dedup
from weftmark.llm.mixing import mix_sources
from weftmark.llm.packing import pack_documents
from weftmark.llm.simhash import drop_near_duplicates
from weftmark.llm.toxicity import fit_toxicity, with_toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), folds=5, held_out_fold=0)
    score = free_prefix(docs) + "score"
    return with_toxicity(docs, model, out_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup(docs, min_documents=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=4, radius=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, max_repeats=2.0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048, keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash", drop_copies),
    ("mix_sources", mix),
    ("pack", pack),
]

#: The classifier and the packing cannot be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
