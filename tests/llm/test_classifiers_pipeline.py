"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_dedup import plain_components, plain_fingerprint, plain_line_dedup
from weftmark.llm import quality_fm, queries, toxicity
from weftmark.llm.common import staged

SF001 = SF.replace("sf0.001", "sf0.01")


def fold_of(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


@pytest.mark.parametrize("name, label, k, out, least", [("op3_quality_fm", "quality", 4, 2, 0.95), ("op10_toxicity", "toxic", 5, 0, 0.95)])
def test_held_out_accuracy_and_folds(spark, name, label, k, out, least):
    rows = queries.QUERIES[name](spark, SF001)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = rows.collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    assert len(rows) == docs and all(r.held_out == (fold_of(r.doc_id, k) == out) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


def test_scores_do_not_use_ids_or_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spoilt = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, spoilt))
    assert np.array_equal(a.gain, b.gain) and a.bias == b.bias
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_fm.fit_quality(docs, x) for x in (labels, changed))
    assert np.array_equal(a.factors, b.factors) and a.bias == b.bias
    moved = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"), "n_chars")
    plain = {r.text: r.score for r in quality_fm.with_quality(docs, a).collect()}
    assert all(plain[r.text] == r.score for r in quality_fm.with_quality(moved, a).collect())


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    width = quality_fm.HASHED + len(quality_fm.STATISTICS)
    m = quality_fm.Machine(0.1, rng.normal(0, 0.1, width), rng.normal(0, 0.3, (width, 4)), np.zeros(len(quality_fm.STATISTICS)), np.ones(len(quality_fm.STATISTICS)))
    bucket, value, stats = quality_fm.features(b"some words some more ### words\nagain", 30.0)
    at, x = m.row(bucket, value, stats)
    logit = m.bias + sum(m.linear[i] * v for i, v in zip(at, x))
    logit += sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(bucket, value, stats) - 1 / (1 + np.exp(-logit))) < 1e-5


def test_misspelt_words_share_their_subwords():
    texts = [(f"fine fine word{i % 40}" + " worthless" * (i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    rows = [(*toxicity.features(t), y) for t, y in texts]
    among = np.zeros((2, toxicity.BUCKETS))
    for at, _, y in rows:
        among[y, at] += 1
    told = toxicity.telling(among, np.array([300, 100]))
    m = toxicity.fit([(at[told[at]].astype(np.int64), w[told[at]], y) for at, w, y in rows])
    good, bad = m.score("fine word3 " * 30), m.score("fine wortthless worthles " * 30)
    assert bad > 0.5 > good


def test_classifier_edge_cases(spark):
    rows = [(1, None, None), (2, "", 0), (None, "x", 1), (4, "w " * 100_000, 5), (4, "w " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for model, add in ((quality_fm.fit_quality(df, labels), quality_fm.with_quality), (toxicity.fit_toxicity(df, labels), toxicity.with_toxicity)):
            got = add(df, model).collect()
            assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
            assert add(df.limit(0), model).count() == 0
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), "test")
        kept[name] = docs
        if name != "pack":
            assert docs.dtypes == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            gone = before.join(docs, "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.filter("toxic = 0").count() == 0 and gone.filter("toxic = 1").count() > 0
        elif name == "line_dedup":
            rows = before.select("doc_id", "text").collect()
            want = {r.doc_id: t for r, (_, _, t) in zip(rows, plain_line_dedup([r.text for r in rows], 10))}
            got = docs.collect()
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        elif name == "simhash":
            pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(plain_components(pairs)))
        elif name == "mix_sources":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        else:
            assert docs.agg(F.sum("length")).first()[0] >= before.count()
            assert docs.filter("start = 0").count() == before.count()
    rows = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(key).collect())) == sorted(map(tuple, kept["pack"].select(key).collect()))


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a\nb" * 40_000, "de", "s", 3), (None, "x y z", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        at = some
        for _, stage in corpus_pipeline.STAGES:
            at = staged(stage(spark, at, SF), "odd")
        assert (at.count() > 0) == (some is docs)
