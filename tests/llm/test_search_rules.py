"""Pivot search, quality rules, URL filter and mixing against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftmark.llm import mixing, queries
from weftmark.llm.pivot_search import choose_pivots, exact_top_k, search_block
from weftmark.llm.quality_rules import Rule, quality_rules
from weftmark.llm.url_filter import UrlRule, bloom_blocks, in_list, url_filter


def plain_top_k(rows, k, every):
    """rows: (id, integer vector)."""
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_op6_against_brute_force(spark):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op6_pivot_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top_k(rows, 5, 50)


def test_top_k_edge_cases_over_blocks(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, base[i % 7] if i < 30 else base[i % 40]) for i in range(120)]  # many ties
    bad = [(500, None), (501, [None, 1.0]), (505, [nan]), (510, [inf, 0.0]), (None, [0.5] * 6), (0, rows[0][1])]
    short = [(600, [0.9]), (601, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + short], "vec_id long, embedding array<float>, score string")
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))) for i, v in rows + short]
    for qb, cb in ((2048, 4096), (3, 10)):
        got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, 5, query_block=qb, candidate_block=cb).collect())
        assert got == plain_top_k(whole, 5, 10)
    few = df.filter("vec_id in (10, 11)")
    assert [tuple(r)[:3] for r in exact_top_k(few, F.col("vec_id") % 10 == 0, 5).collect()] == [(10, 1, 11)]
    assert exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_pivots_stop_early_and_stay_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (20, 16))
    v = (centres[rng.integers(0, 20, 6000)] + rng.integers(-20, 20, (6000, 16))).astype(float)
    v = v / 4
    v = np.floor(v)
    p = choose_pivots(v[:500], 16)
    gap = lambda x: np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(-1))
    ids = np.arange(6000)
    got = search_block(ids[:30], v[:30], gap(v[:30]), ids, v, gap(v), 5)
    for q in range(30):
        order = sorted((-int(s), int(i)) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        assert [(i, s) for qq, i, s in got if qq == q] == [(i, -s) for s, i in order]


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_rule_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "a", "a a a a", "x y z x y z", "a b c d\na b c d\n\n \n", "É\x1cß #*$%&|<> \x0b\x0c", "q " * 5000,
             *(" ".join(rng.choice("ab") for _ in range(n)) for n in (3, 4, 5, 9, 60)),
             *("\n".join(" ".join(rng.choice("abcde ") for _ in range(6)) for _ in range(n)) for n in (2, 30)),
             "w" * 200_000 + " " + " ".join(str(i % 997) for i in range(20_000))]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[0], "n")], "doc_id long, text string, n_words string")
    got = quality_rules(df).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert len(got) == len(texts) + 1 and quality_rules(df.limit(0)).count() == 0
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_rules_hold_back_junk_and_keep_prose(spark):
    docs = queries.op7_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    wrong = docs.filter("not base_failed and kept <> (quality = 1)").count()
    assert wrong <= 0.02 * docs.count()
    only = quality_rules(spark.createDataFrame([("a b " * 40,)], "text string"), rules=[Rule("w", "word_chars", "n_words", high=0.5)], max_repeat_percent=100)
    assert only.first().failed_rules == ["w"] and not only.first().kept


URLS = ["https://www.Spam.example.org/a/b.html?x=1#y", "http://spam.example.org/a/b", "http://x.NET/", "http://x.net", "https://a.example.net/en/1",
        "https://example.net/en", "http://example.com/de/x", "http://notexample.com/de/x", "http://q.org/fr/", "no-scheme.net/", None, "", "://", "a://b://c/d",
        "http://h.org:80/p?q=/fr/", "http://net/x", "HTTP://ÄB.org/FR/", "http://h.org/fr", "http://m.free.example.org/z/#f"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_filter_rules_and_list(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("spam.example.org/a/b",), ("free.example.org/z",), ("spam.example.org/a/b",), (None,)], "canonical string")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = url_filter(df, listed, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain_parts(r.url)
        fits = [t for t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/"):])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (rules[rule] if rule else "block" if r.canonical in ("spam.example.org/a/b", "free.example.org/z") else "allow")
    assert url_filter(df, listed.limit(0), []).filter("verdict = 'block'").count() == 0
    assert url_filter(df.limit(0), listed, queries.URL_RULES).count() == 0
    assert UrlRule("net/", "block").path == "/"


def test_bloom_has_no_false_negative_and_the_join_no_false_positive(spark):
    urls = spark.range(4000).select(F.concat(F.lit("h/"), "id").alias("u"), "id")
    listed = urls.filter("id % 3 = 0").select(F.col("u").alias("canonical"))
    assert bloom_blocks(listed, "canonical", 5).count() <= 5
    for most in (1 << 17, 1):  # one block lets nearly all through to the join
        got = in_list(urls, "u", listed, "canonical", max_blocks=most)
        assert got.filter("listed <> (id % 3 = 0)").count() == 0 and got.count() == 4000


def test_weights_bisection(spark):
    tokens = [1_000_000, 90_000, 80_000, 500]
    counts = spark.createDataFrame([(str(i), t, 10) for i, t in enumerate(tokens)], "key string, tokens long, rows long").cache()

    def solve(**k):
        return {int(r.key): r for r in mixing.source_weights(counts, **k).collect()}

    for share in (0.2, 0.5, 0.9):
        w = [r.weight for r in solve(entropy_share=share).values()]
        assert abs(sum(w) - 1) < 1e-9
        entropy = -sum(x * math.log(x) for x in w) / math.log(4)
        natural = -sum(t / sum(tokens) * math.log(t / sum(tokens)) for t in tokens) / math.log(4)
        assert abs(entropy - max(share, natural)) < 1e-6
    for most in (1.5, 4.0, 1e9):
        r = solve(max_repeats=most)
        assert abs(max(x.repeats for x in r.values()) - min(most, 2000)) < 1e-6 * most
        assert min(x.repeats for x in r.values()) == 1.0 and r[0].full == 1 and r[0].rest == 0
    r = solve(max_repeats=2.0, budget_tokens=600_000)
    assert max(x.repeats for x in r.values()) <= 2.0 + 1e-9 and abs(sum(x.weight for x in r.values()) - 1) < 1e-9
    assert all(abs(x.full * x.tokens + x.rest - x.weight * 600_000) <= 1 for x in r.values())


def test_mixing_realises_quotas(spark):
    rng = random.Random(6)
    rows = [(i, "a" if i < 600 else "b" if i < 640 else None, "w " * rng.randint(1, 30), "x") for i in range(700)]
    rows += [(900, "c", None, "x"), (901, "c", "", "x"), (None, "c", "t t", "x"), (None, "c", "t t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_epoch string")
    got = mixing.mix_sources(df, max_repeats=3.0, block_rows=16)
    assert got.columns == ["doc_id", "source", "text", "mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_repeats"]
    got = got.collect()
    size = lambda t: max(1, len((t or "").split()))
    for source in ("a", "b", None, "c"):
        have = [r for r in rows if r[1] == source]
        mine = [r for r in got if r.source == source]
        total = sum(size(r[2]) for r in have)
        quota = mine[0].mix_repeats * total
        used = sum(size(r.text) for r in mine)
        assert quota - 62 <= used <= quota + 1
        times = collections.Counter((r.doc_id, r.text) for r in mine)
        assert len(times) == len({(r[0], r[2]) for r in have})  # every document at least once
        for epoch in {r.mix_epoch for r in mine}:
            assert epoch >= 0
    assert collections.Counter(r.mix_epoch for r in got if r.source == "a") == {0: 600}
    small = mixing.mix_sources(df, entropy_share=0.9, budget_tokens=1500, block_rows=16).collect()
    assert 1300 <= sum(size(r.text) for r in small) <= 1500 + 4
    assert mixing.mix_sources(df.limit(0), max_repeats=2.0).count() == 0
    plan = mixing.mix_sources(df, max_repeats=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_permutation_depends_on_the_seed(spark, seed):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("one two").alias("text"))
    ids = {r.doc_id for r in mixing.mix_sources(df, budget_tokens=200, seed=seed, block_rows=20).collect()}
    other = {r.doc_id for r in mixing.mix_sources(df, budget_tokens=200, seed=seed + 10, block_rows=20).collect()}
    assert len(ids) == len(other) == 100 and ids != other
