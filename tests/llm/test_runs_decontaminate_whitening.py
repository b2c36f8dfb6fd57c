"""Periodic runs, benchmark decontamination and whitening against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftmark.llm import decontaminate as dec
from weftmark.llm import queries
from weftmark.llm.runs import collapse_runs, lyndon_groups, runs_of
from weftmark.llm.whitening import whiten


def plain_runs(w, min_words, min_repeats):
    out, seen = [], set()
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(min_words, min_repeats * q) and (s, n) not in seen:  # the smallest period comes first
                seen.add((s, n))
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_groups_are_longest_lyndon_factors():
    rng = random.Random(1)
    for _ in range(400):
        c = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 25))]
        names = sorted(set(c))
        c = [names.index(x) for x in c]
        group, size = lyndon_groups(c, len(names))
        for i in range(len(c)):
            j = i + 1
            while j < len(c) and c[j:] > c[i:]:
                j += 1
            assert size[group[i]] == j - i
        same = {}
        for i, g in enumerate(group):
            assert same.setdefault(g, tuple(c[i:i + size[g]])) == tuple(c[i:i + size[g]])
        assert len(set(same.values())) == len(same)


def test_runs_against_every_period():
    rng = random.Random(2)
    for _ in range(800):
        w = []
        while len(w) < rng.randint(0, 80):
            w += [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        least, times = rng.choice([3, 6, 24]), rng.choice([3, 4])
        assert runs_of(w, least, times) == plain_runs(w, least, times)
    with pytest.raises(ValueError):
        runs_of(["a"] * 9, 3, 2)


def test_long_periods_and_long_texts():
    w = [f"x{i % 40_000}" for i in range(200_000)]
    assert runs_of(["head", *w, "tail"]) == [(1, 200_000, 40_000)]
    assert runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    assert runs_of([f"u{i}" for i in range(100_000)]) == []


def test_collapse_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "\t \n", "x"), (4, "a b " * 30 + "end", "x"), (4, "a b " * 30 + "end", "x"), (None, "no repeats here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = collapse_runs(docs).collect()
    assert got[0].__fields__ == ["doc_id", "text", "runs", "best_run", "collapsed"]
    assert [(r.doc_id, len(r.runs), r.best_run and tuple(r.best_run), r.collapsed) for r in got] == [
        (1, 0, None, ""), (2, 0, None, ""), (3, 0, None, ""), (4, 1, (0, 60, 2), "a b end"), (4, 1, (0, 60, 2), "a b end"), (None, 0, None, "no repeats here")]
    assert collapse_runs(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([("a " * 24, 7, 8, 9)], ["text", "t", "f", "c0"])
    assert collapse_runs(odd).select("t", "f", "c0", F.size("runs").alias("n")).collect()[0][:] == (7, 8, 9, 1)


def test_op11_query(spark):
    import zlib

    got = {r.doc_id: r for r in queries.op11_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            planted += 1
        runs = plain_runs(w, 24, 3)
        r = got[d.doc_id]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(listed.encode()).hexdigest())
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.collapsed_sha256 == hashlib.sha256(without_repeats(w, runs).encode()).hexdigest()
    assert planted > 5


def plain_hits(docs, items, window):
    out = []
    for d in docs:
        hit, names = set(), set()
        for name, w in items:
            n = min(window, len(w))
            own = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(d) - n + 1 if n else 0):
                if tuple(d[i:i + n]) in own:
                    hit.update(range(i, i + n))
                    names.add(name)
        out.append((len(d), sorted(hit), sorted(names)))
    return out


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits_of(rows):
    return [(r.n_words, [x for s in r.spans for x in range(s.start, s.start + s.length)], r["items"]) for r in rows]


def test_suffix_arrays_and_longest_matches():
    rng = random.Random(4)
    for _ in range(150):
        letters = [b"a", b"b", b"c", b"d"][:rng.randint(2, 4)]
        items = [[rng.choice(letters[:2]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        tests = dec.TestTexts([(str(k), w, len(w) < 3) for k, w in enumerate(items)], 3)
        codes = [c for _ in range(4) for c in [*tests.coded([rng.choice(letters) for _ in range(rng.randint(0, 40))]).tolist(), 0]]
        shard = dec.Shard(np.array(codes, np.int32), len(tests.vocabulary))
        suffix = lambda i: codes[i:codes.index(0, i)]  # noqa: E731, B023
        sorted_ = [suffix(i) for i in shard.places.tolist()]
        assert sorted_ == sorted(sorted_) and len(sorted_) == sum(c > 0 for c in codes)

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        longest, place = shard.longest(tests)
        for q, n, p in zip(tests.suffixes.tolist(), longest.tolist(), place.tolist(), strict=True):
            own = tests.codes[q:q + tests.left[q]].tolist()
            assert n == max((common(own, s) for s in sorted_), default=0)
            assert not n or common(own, suffix(p)) == n


def test_contamination_over_blocks_and_shards(spark):
    rng = random.Random(5)
    text = lambda n, k: " ".join(rng.choice("abcdef"[:k]) for _ in range(n))
    items = [(i % 9, text(rng.randint(0, 14), 3)) for i in range(20)] + [(50, None), (51, ""), (52, "A-b.C"), (None, "e e e e f")]
    docs = [(i, text(rng.choice([0, 5, 60, 200]), 6)) for i in range(40)] + [(90, None), (91, ""), (92, "É é a,B!c"), (3, "e E e e-f e e"), (3, "e E e e-f e e")]
    want = plain_hits([words(t) for _, t in docs], [("" if i is None else str(i), words(t)) for i, t in items], 4)
    d = spark.createDataFrame([(k, t, "kept") for k, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((1 << 20, 1 << 20), (50, 1 << 20), (1 << 20, 40), (30, 7)):
        got = dec.find_contamination(d, b, 4, shard_words=shard, block_words=block)
        assert got.columns == ["doc_id", "text", "n_words", "longest", "spans", "items"]
        rows = got.collect()
        assert sorted(hits_of(rows)) == sorted(want)
        assert all((r.longest >= 4) or not r["items"] or min(len(words(t)) for i, t in items if words(t)) < 4 for r in rows)
    left = dec.decontaminate(d, b, 4)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for (k, _), w in zip(docs, want) if not w[2])


def test_contamination_of_empty_tables_and_long_pieces(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "z a b c d e f g h i j z")], "item_id long, text string")
    assert hits_of(dec.find_contamination(d, b.limit(0)).collect()) == [(12, [], [])]
    assert dec.find_contamination(d.limit(0), b).collect() == []
    assert hits_of(dec.find_contamination(d, b).collect()) == [(12, [*range(10)], ["1"])]
    long = " ".join(f"w{i}" for i in range(100_000))
    many = spark.createDataFrame([(1, f"x {long} y"), (2, "w32760 w32761 w32762 w32763 w32764 w32765 w32766 w32767 w32768 w32769")], "doc_id long, text string")
    got = {r.doc_id: r for r in dec.find_contamination(many, spark.createDataFrame([(7, long)], "item_id long, text string"), shard_words=10).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 100_000)] and [tuple(s) for s in got[2].spans] == [(0, 10)]


def test_op12_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = plain_hits([words(d.text) for d in docs], [(str(i.item_id), words(i.text)) for i in items], 10)
    got = {r.doc_id: r for r in queries.op12_decontaminate(spark, SF).collect()}
    for d, (n, hit, names) in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    lifted = n * x - s
    centred = lifted / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (lifted.astype(object) ** 2).sum(1), centred @ u / np.sqrt(e), e / np.trace(cov)


def test_op13_query(spark):
    rows = sorted((r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    deviation, whitened, explained = plain_whitening([v for _, v in rows], 8)
    got = sorted(queries.op13_whitening(spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    mine = np.array([r.whitened for r in got]).reshape(-1, 8)
    sign = np.sign((mine * whitened).sum(0))  # one sign for each component
    assert np.abs(mine * sign - whitened).max() < 1e-8
    assert [got[8 * i].deviation for i in range(len(rows))] == [int(x) for x in deviation]
    assert np.allclose([r.explained for r in got[:8]], explained, rtol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_over_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(good)]
    rows += [(100, None, "a"), (101, [], "a"), (102, [1.0, None, 2.0, 3.0, 4.0], "a"), (103, [nan] * 5, "a"), (104, [inf] * 5, "a"), (105, [1e30] * 5, "a"),
             (106, [1.0, 2.0], "a"), (None, rows[0][1], None), (0, rows[0][1], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(7)
    got = whiten(df, components=3, block_rows=4)
    assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    rows_ = got.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows_) == sorted([*((False, i) for i in range(60)), (False, 0), (True, 0)])
    deviation, whitened, explained = plain_whitening([*good.tolist(), rows[0][1], rows[0][1]], 3)
    by_id = {r.vec_id: r for r in rows_ if r.vec_id}
    mine = np.array([by_id[i].whitened for i in range(1, 60)])
    sign = np.sign((mine * whitened[1:60]).sum(0))
    assert np.abs(mine * sign - whitened[1:60]).max() < 1e-8
    assert all(int(by_id[i].deviation) == int(deviation[i]) for i in range(1, 60)) and rows_[0].identity_error < 1e-9
    assert np.allclose(rows_[0].explained, explained, rtol=1e-6)


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(r.n, int(r.deviation), tuple(r.whitened), tuple(r.explained), r.identity_error) for r in whiten(flat).collect()} == {(5, 0, (None, None), (None, None), None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whiten(line).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None for r in rows) and rows[0].identity_error < 1e-9
    assert whiten(flat.limit(0)).collect() == [] and whiten(flat.limit(0)).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
