"""Clashing column names, null keys, huge values, long unbroken texts, and a session left as it was."""

import math
import random
import resource

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.conftest import SF
from weftmark.llm import queries, toxicity
from weftmark.llm.line_dedup import line_dedup
from weftmark.llm.mixing import mix_sources
from weftmark.llm.pivot_search import exact_top_k
from weftmark.llm.quality_rules import quality_rules
from weftmark.llm.rans import write_token_file
from weftmark.llm.tokens import TextEncoder
from weftmark.llm.url_filter import UrlRule, url_filter

HELPERS = ["__r", "__s", "__lost", "__t", "__w", "__l", "__g", "__key", "__h", "__b", "__u", "__v", "__hit", "__n", "__w0", "__w7", "__toxic", "____x"]


def _with_helpers(spark, rows, names):
    return spark.createDataFrame([(*r, *HELPERS) for r in rows], names + HELPERS)


def test_helper_names_of_the_input_stay(spark):
    docs = _with_helpers(spark, [(1, "a\nb", "x"), (2, "a", "y")], ["doc_id", "text", "source"])
    pages = _with_helpers(spark, [(1, "https://x.example/a"), (2, None)], ["page_id", "url"])
    listed = spark.createDataFrame([("x.example/a",)], "canonical string")
    made = {
        "lines": line_dedup(docs, min_documents=2),
        "rules": quality_rules(docs),
        "mixed": mix_sources(docs, max_repeats=2.0),
        "urls": url_filter(pages, listed, [UrlRule("net/", "block")]),
    }
    for name, df in made.items():
        rows = df.collect()
        assert rows and all([r[h] for h in HELPERS] == HELPERS for r in rows), name
    assert sorted((r.text, r.n_dropped) for r in made["lines"].collect()) == [("", 1), ("b", 1)]
    assert sorted((r.page_id, r.verdict) for r in made["urls"].collect()) == [(1, "block"), (2, "allow")]


def test_null_ids_and_null_texts_are_different_rows(spark):
    docs = spark.createDataFrame([(None, "dup"), ("dup", None), ("a", "dup"), ("b", "dup")], "doc_id string, text string")
    got = sorted(((r.doc_id or "", r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs, min_documents=3).collect()))
    assert got == [("", "", 1, 1), ("a", "", 1, 1), ("b", "", 1, 1), ("dup", "", 1, 0)]


def test_huge_components(spark):
    big = 250_000.0  # scaled by 256 just below the limit
    rows = [(0, [big, big]), (1, [big, -big]), (2, [1e300, 0.0]), (3, [-1e300, 1.0]), (4, [big, big - 0.25]), (5, [0.5, 0.25]), (6, [300_000.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i in (0, 1, 4, 5)}
    want = sorted(((sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (1, 4, 5)), key=lambda x: (-x[0], x[1]))
    assert got == [(0, k + 1, i, s) for k, (s, i) in enumerate(want)]


def _plain_score(model, text):
    """The average of all subword rows, padded, under the difference of the two logits."""
    from collections import Counter

    total, n = 0.0, toxicity.PADDING
    for w, c in Counter(toxicity.words_of(text)).items():
        for b in toxicity.rows_of(w):
            total += (1 + math.log(c)) * float(model.gain[b])
            n += 1 + math.log(c)
    z = model.bias + total / n
    e = np.exp(np.array([0.0, z]) - max(0.0, z))
    return float(e[1] / e.sum())


def test_toxicity_score_is_the_average_under_a_softmax(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Subwords(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.3)
    words = random.Random(1)
    text = " ".join("".join(words.choice("abcdé") for _ in range(words.randint(1, 9))) for _ in range(300))
    for t in (text, None, "", "one", text + " " + "x" * 5000):
        assert abs(model.score(t) - _plain_score(model, t)) < 1e-5
    whole, known = model.score(text + "q" * 3000), toxicity.features(text + "q" * 3000)
    monkeypatch.setattr(toxicity, "PART", 100)
    parts = toxicity.Subwords(model.gain, model.bias)
    assert abs(parts.score(text + "q" * 3000) - whole) < 1e-6
    which, share = toxicity.features(text + "q" * 3000)
    assert (which == known[0]).all() and np.allclose(share, known[1], rtol=1e-5)


def test_long_unbroken_text_takes_bounded_memory():
    model = toxicity.Subwords(np.ones(toxicity.BUCKETS, np.float32), 0.0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "".join(random.Random(3).choices("abcdefghij+/=", k=3_000_000))
    assert 0 < model.score(text) <= 1 and len(toxicity.features(text)[0])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


@pytest.mark.parametrize("name,width", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 4)])
def test_batches_give_the_library_ids(name, width):
    path = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(path), TextEncoder(path, width)
    rng = random.Random(5)
    parts = ["a", "The", "hello ", " ", "  ", "\n", "\t", "é", "ß", "Ω", "<|endoftext|>", "<|startoftext|>", "1", "23", ".", ",!?", "don't", " x", "ñ.", "中文", "\x1c", " ", "-", "_", "&|", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "a ", " a", "...", " ...", "a...\nb."]
    got = own.batch(pa.array(texts, pa.string()), (0).to_bytes(width, "little")).to_pylist()
    for t, g in zip(texts, got, strict=True):
        assert g == np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], f"<u{width}").tobytes(), t
    assert own.batch(pa.array([], pa.string())).to_pylist() == []


def test_token_file_takes_integer_ids_only(spark, tmp_path):
    with pytest.raises(ValueError, match="integer ids"):
        write_token_file(spark.createDataFrame([("a", "t")], "doc_id string, text string"), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))


def test_queries_leave_the_session_as_it_was(spark):
    before = dict(r[:] for r in spark.sql("SET").collect())
    for name in ("op4_rans_tokens", "op10_toxicity", "op12_decontaminate"):
        queries.QUERIES[name](spark, SF).count()
    assert dict(r[:] for r in spark.sql("SET").collect()) == before


def test_op8_query_takes_part_of_a_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_mix_sources(spark, SF).collect()
    weights = {r.source: r for r in queries.mix_weights(spark, SF).collect()}
    all_rows = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    taken = {s: sum(r.source == s and r.mix_epoch == weights[s].full for r in got) for s in weights}
    assert any(0 < taken[s] < all_rows[s] for s in weights)  # a last pass cut inside the source
    assert len({r.mix_weight for r in got}) > 1
    words = {r.doc_id: max(1, len(r.text.split())) for r in docs.collect()}
    for s, w in weights.items():
        used, most = sum(words[r.doc_id] for r in got if r.source == s), max(words[r.doc_id] for r in docs.collect() if r.source == s)
        quota = w.full * w.tokens + w.rest
        assert quota - most < used <= quota
